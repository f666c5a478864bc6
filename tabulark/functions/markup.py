"""Tags of a page and the elements that they open and close, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that never have an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

#: A tag with quoted attribute values taken whole; one whose quote is not closed is text.
_TAG = r"""(<(?:/?)[a-zA-Z][^\s/>]*(?:"[^"]*+"|'[^']*+'|[^"'>]++)*+>)"""
_SILENT = (r"(?s)<!--.*?(?:-->|\z)", r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)")


def tags(html: Column) -> Column:
    """Start and end tags in order; those in comments, scripts and styles are none."""
    for pattern in _SILENT:
        html = F.regexp_replace(html, pattern, " ")
    return F.regexp_extract_all(html, F.lit(_TAG), 1)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; null if it is missing or empty. Values of others do not count."""
    bare = F.regexp_replace(tag, r"""^<[^\s/>]*""", " ")
    found = F.regexp_extract(bare, rf"""(?i)^(?:\s*+/?(?!{name}[\s=/>])[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+\s*+/?{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", 1)
    return F.nullif(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit(""))


def inside(found: Column, wanted: str, element: str, classes: tuple[str, ...]) -> Column:
    """The ``wanted`` tags that stand in an ``element`` or in an element of one of the ``classes``, as ``pos, tag``.

    ``pos`` counts all wanted tags from 0. A fold keeps the stack of open elements: an end tag closes the last open
    element of its name and all that were opened after it, or nothing; what is never closed stays open to the end."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
    marked = lambda t: (name(t) == element) | F.coalesce(F.arrays_overlap(F.split(attribute(t, "class"), r"\s+"), F.array(*[F.lit(c) for c in classes])), F.lit(False))
    read = F.transform(found, lambda t: F.struct(t.alias("tag"), name(t).alias("name"), t.startswith("</").alias("ends"), t.endswith("/>").alias("alone"), marked(t).alias("marks")))
    start = "named_struct('names', cast(array() as array<string>), 'marks', cast(array() as array<boolean>), 'n', 0, 'found', cast(array() as array<struct<pos:int,tag:string>>))"

    def step(at: Column, t: Column) -> Column:
        names, marks = at["names"], at["marks"]
        left = F.size(names) - F.array_position(F.reverse(names), t["name"]).cast("int")
        open_ = ~t["ends"] & ~t["alone"] & ~t["name"].isin(*VOID)
        closes = t["ends"] & F.array_contains(names, t["name"])
        is_wanted = ~t["ends"] & (t["name"] == wanted)
        moved = lambda held, new: F.when(open_, F.concat(held, F.array(new))).when(closes, F.slice(held, 1, F.greatest(left, F.lit(0)))).otherwise(held)
        here = F.array_contains(marks, True)
        taken = F.when(is_wanted & here, F.concat(at["found"], F.array(F.struct(at["n"].alias("pos"), t["tag"].alias("tag"))))).otherwise(at["found"])
        count = at["n"] + F.when(is_wanted, 1).otherwise(0)
        return F.struct(moved(names, t["name"]).alias("names"), moved(marks, t["marks"]).alias("marks"), count.alias("n"), taken.alias("found"))

    return F.aggregate(read, F.expr(start), step, lambda at: at["found"])
