"""Links resolved against the page that they stand on, in column expressions.

RFC 3986, section 5, with the conventions of the standard library's join, which readers of such pages use: blanks
before a reference and tabs and line ends in it are cut, an empty query or fragment goes, empty segments inside a
merged path go, ``;parameters`` belong to the last segment, and a reference with a scheme of its own that differs
from the page's, or that has no hierarchy, stays as it is. A null page or reference gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes whose references are resolved, and those that may stand without a host.
HIERARCHICAL = ("", "http", "https", "ftp", "file", "sftp", "ws", "wss")

_SCHEME, _HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?+", r"(?://[^/?#]*+)?+"
#: Parts of a cleaned reference. A ``;`` counts in the last segment only.
_PARTS = {
    "scheme": (r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1),
    "host": (_SCHEME + r"//([^/?#]*)", 1),
    "path": (_SCHEME + _HOST + r"((?:[^?#]*/)?[^?#;]*)", 1),
    "parameters": (_SCHEME + _HOST + r"(?:[^?#]*/)?[^?#;/]*;([^?#/]*)(?:[?#]|$)", 1),
    "query": (r"^[^?#]*\?([^#]*)", 1),
    "fragment": (r"#(.*)$", 1),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cleaned(reference: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def parts(reference: Column) -> Column:
    """The six parts of a cleaned reference as a struct; what is missing is empty."""
    made = {name: F.regexp_extract(reference, pattern, group) for name, (pattern, group) in _PARTS.items()}
    return F.struct(F.lower(made.pop("scheme")).alias("scheme"), *[c.alias(name) for name, c in made.items()])


def without_dots(segments: Column) -> Column:
    """The path of segments after ``.`` and ``..`` are taken out: a fold whose state is a stack of segments."""
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))

    def folded(every: Column) -> Column:
        # A path that ends in a dot segment names a folder.
        open_ = F.when(F.element_at(every, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        path = F.aggregate(every, F.array().cast("array<string>"), step, lambda kept: F.array_join(F.concat(kept, open_), "/"))
        return F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))

    return _let(segments, folded)


def merged(base_path: Column, path: Column) -> Column:
    """Segments of a path laid on the folder of another; an absolute one stays alone."""
    # The folder is the base without its last segment, where that names something.
    folder = F.split(F.regexp_replace(base_path, "/[^/]+$|^[^/]+$", ""), "/")
    whole = F.when(base_path.rlike("^[^/]+$"), F.array().cast("array<string>")).otherwise(folder)

    def joined(every: Column) -> Column:
        # Between the first and the last segment, empty ones go.
        inner = F.filter(F.slice(every, 2, F.greatest(F.size(every) - 2, F.lit(0))), lambda s: s != "")
        return F.when(F.size(every) > 1, F.concat(F.slice(every, 1, 1), inner, F.slice(every, -1, 1))).otherwise(every)

    return F.when(path.startswith("/"), F.split(path, "/")).otherwise(_let(F.concat(whole, F.split(path, "/")), joined))


def unsplit(scheme: Column, host: Column, path: Column, parameters: Column, query: Column, fragment: Column) -> Column:
    """A reference from its parts."""
    led = lambda sign, part: F.when(part != "", F.concat(F.lit(sign), part)).otherwise(F.lit(""))
    named = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))

    def placed(full: Column) -> Column:
        rooted = F.when((full != "") & ~full.startswith("/"), F.lit("/")).otherwise(F.lit(""))
        bare = (scheme != "") & ((full == "") | full.startswith("/"))
        lead = F.when(host != "", F.concat(F.lit("//"), host, rooted)).when(full.startswith("//") | bare, F.lit("//")).otherwise(F.lit(""))
        return F.concat(named, lead, full, led("?", query), led("#", fragment))

    return _let(F.concat(path, led(";", parameters)), placed)


def join(page: Column, reference: Column) -> Column:
    """``reference`` as a reader of ``page`` would follow it."""

    def resolved(x: Column) -> Column:
        b, r = x["b"], x["r"]
        scheme = F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])
        same = (r["path"] == "") & (r["parameters"] == "")
        query = F.when(same & (r["query"] == ""), b["query"]).otherwise(r["query"])
        path = F.when(same, b["path"]).otherwise(without_dots(merged(b["path"], r["path"])))
        beside = r["host"] != ""
        # With a host of its own a reference keeps all its parts.
        parameters = F.when(same, b["parameters"]).otherwise(r["parameters"])
        pick = lambda own, other: F.when(beside, own).otherwise(other)
        chosen = F.struct(scheme.alias("s"), pick(r["host"], b["host"]).alias("h"), pick(r["path"], path).alias("p"), pick(r["parameters"], parameters).alias("m"), pick(r["query"], query).alias("q"), r["fragment"].alias("f"))
        foreign = (scheme != b["scheme"]) | ~scheme.isin(*HIERARCHICAL)
        made = _let(chosen, lambda c: unsplit(c["s"], c["h"], c["p"], c["m"], c["q"], c["f"]))
        return F.when(x["page"] == "", x["own"]).when(x["own"] == "", x["page"]).when(foreign, x["own"]).otherwise(made)

    both = F.struct(page.alias("page"), reference.alias("own"), parts(cleaned(page)).alias("b"), parts(cleaned(reference)).alias("r"))
    return F.when(page.isNotNull() & reference.isNotNull(), _let(both, resolved))


def sql_join(rows: str, keep: str) -> str:
    """The same in DuckDB's SQL over rows ``page, link``; the columns ``keep`` stay, and ``url`` comes."""
    clean = lambda c: rf"regexp_replace(regexp_replace({c}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"
    scheme, split = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", []
    for p, c in (("b", "page"), ("r", "link")):
        rest = rf"regexp_replace(c{p}, '^([a-zA-Z][a-zA-Z0-9+.\-]*:)?(//[^/?#]*)?', '')"
        split.append(rf"""lower(regexp_extract(c{p}, '{scheme}', 1)) AS {p}s, regexp_extract(regexp_replace(c{p}, '{scheme}', ''), '^//([^/?#]*)', 1) AS {p}h,
  regexp_extract({rest}, '^[^?#]*') AS {p}full, regexp_extract({p}full, '[^/]*$') AS {p}last, {p}full[:len({p}full) - len({p}last)] || split_part({p}last, ';', 1) AS {p}p,
  substr({p}last, len(split_part({p}last, ';', 1)) + 2) AS {p}m, regexp_extract(c{p}, '^[^?#]*\?([^#]*)', 1) AS {p}q, regexp_extract(c{p}, '#(.*)$', 1) AS {p}f""")
    unsplit = lambda s, h, p, m, q, f: f"""CASE WHEN {s} <> '' THEN {s} || ':' ELSE '' END || (CASE WHEN {h} <> '' THEN '//' || {h} || CASE WHEN {p} <> '' AND {p}[1] <> '/' THEN '/' ELSE '' END
    WHEN {p} LIKE '//%' OR ({s} <> '' AND ({p} = '' OR {p} LIKE '/%')) THEN '//' ELSE '' END) || {p} || CASE WHEN {m} <> '' THEN ';' || {m} ELSE '' END || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END || CASE WHEN {f} <> '' THEN '#' || {f} ELSE '' END"""  # noqa: E731
    known = ", ".join(f"'{s}'" for s in HIERARCHICAL)
    return f"""WITH u_rows AS ({rows}), u_clean AS (SELECT *, {clean("page")} AS cb, {clean("link")} AS cr FROM u_rows),
u_parts AS (SELECT *, {", ".join(split)} FROM u_clean),
u_list AS (SELECT *, CASE WHEN rs = '' THEN bs ELSE rs END AS s, rp = '' AND rm = '' AS same, string_split(bp, '/') AS bl, string_split(rp, '/') AS rl,
  CASE WHEN bl[len(bl)] <> '' THEN bl[:len(bl) - 1] ELSE bl END || rl AS el,
  CASE WHEN rp LIKE '/%' THEN rl WHEN len(el) > 1 THEN el[1:1] || list_filter(el[2:len(el) - 1], lambda x: x <> '') || el[len(el):len(el)] ELSE el END AS segs FROM u_parts),
u_fold AS (SELECT *, list_reduce(list_transform(segs, lambda x: [x]), lambda a, x: CASE x[1] WHEN '.' THEN a WHEN '..' THEN a[:len(a) - 1] ELSE a || x END, []::VARCHAR[])
  || CASE WHEN segs[len(segs)] IN ('.', '..') THEN [''] ELSE [] END AS st FROM u_list),
u_path AS (SELECT *, CASE WHEN same THEN bp WHEN array_to_string(st, '/') = '' THEN '/' ELSE array_to_string(st, '/') END AS p,
  CASE WHEN same THEN bm ELSE rm END AS m, CASE WHEN same AND rq = '' THEN bq ELSE rq END AS q FROM u_fold)
SELECT {keep}, CASE WHEN page IS NULL OR link IS NULL THEN NULL WHEN page = '' THEN link WHEN link = '' THEN page WHEN s <> bs OR s NOT IN ({known}) THEN link
  WHEN rh <> '' THEN {unsplit("s", "rh", "rp", "rm", "rq", "rf")} ELSE {unsplit("s", "bh", "p", "m", "q", "rf")} END AS url FROM u_path"""
