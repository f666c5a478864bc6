"""Quality rules: a threshold table compiled into column expressions, without user functions.

Words are runs of anything but the six ASCII white-space characters. Every metric is a count over the
whole text, every rule compares two counts in integers, and all of it is evaluated where the scan
reads the rows: no shuffle, no Python.

Defined results: a null or empty text (or one of white space only) has every count 0 and fails
``words_min``; a very long text is judged whole, with some 30 bytes a word in memory; nulls in other columns, repeated rows and ties pass through row by row; an empty table
gives an empty table; columns of the input keep their place, and a metric whose name the input
already uses is returned under that name with underscores appended.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "from",
    "de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "est", "pour", "par", "dans", "avec", "qui", "pas", "sur", "au",
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "auf", "für", "ist", "im", "nicht", "dem", "ein", "eine", "als",
    "el", "y", "los", "las", "se", "del", "por", "con", "no", "una", "su", "para", "es", "al", "lo",
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """Reject where ``factor * metric`` is beyond ``threshold * per`` (+ ``slack``); per None: beyond threshold."""

    name: str
    metric: str
    beyond: str
    threshold: int
    per: str | None = None
    factor: int = 1
    slack: int = 0
    base: bool = False

    def text(self) -> str:
        right = f"{self.threshold} * {self.per}" if self.per else f"{self.threshold}"
        return f"({self.factor} * {self.metric} {self.beyond} {right} + {self.slack})"

    def column(self, at: dict[str, Column]) -> Column:
        left, right = at[self.metric] * self.factor, (at[self.per] if self.per else F.lit(1)) * self.threshold + self.slack
        return left < right if self.beyond == "<" else left > right


#: The base rules and the verdict's own. The stop-word rule forgives two missing words, so that short texts pass.
#: No text is too long: the ratio rules judge long texts as they do others.
RULES = (
    Rule("words_min", "n_words", "<", 10, base=True),
    Rule("repeated_grams", "n_repeat_words", ">", 20, "n_words", 100, base=True),
    Rule("word_length_min", "word_chars", "<", 3, "n_words"),
    Rule("word_length_max", "word_chars", ">", 10, "n_words"),
    Rule("symbols", "n_symbols", ">", 10, "n_words", 100),
    Rule("stop_words", "n_stop_words", "<", 5, "n_words", 100, slack=-200),
    Rule("repeated_lines", "n_dup_lines", ">", 30, "n_lines", 100),
    Rule("capitals", "n_capitals", ">", 30, "word_chars", 100),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(df: DataFrame, text: str = "text", gram: int = 5) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``df`` and one long column per metric; the second value maps metric to column."""
    kept = df.columns
    tmp = {n: fresh(df, f"_q_{n}") for n in ("t", "words", "lines", "hashes", "grams", "sorted", "twice", "at")}
    out = {m: fresh(df, m) for m in METRICS}
    c = lambda n: F.col(f"`{tmp[n]}`")
    was = [F.col(f"`{k}`") for k in kept]
    named = lambda m, x: x.cast("long").alias(out[m])
    have = lambda *ms: [F.col(out[m]) for m in ms]

    step = df.select(*was, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(tmp["t"]))
    trimmed = F.btrim(c("t"), F.lit(WHITE))
    step = step.select(
        *was,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")).alias(tmp["words"]),
        F.filter(F.split(c("t"), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias(tmp["lines"]),
        named("word_chars", F.length(_without(c("t"), WHITE))),
        named("n_symbols", F.length(c("t")) - F.length(_without(c("t"), SYMBOLS))),
        named("n_capitals", F.length(c("t")) - F.length(_without(c("t"), CAPITALS))),
    )
    step = step.select(
        *was,
        *have("word_chars", "n_symbols", "n_capitals"),
        named("n_words", F.size(c("words"))),
        named("n_lines", F.size(c("lines"))),
        named("n_dup_lines", F.size(c("lines")) - F.size(F.array_distinct(c("lines")))),
        named("n_stop_words", F.size(F.filter(c("words"), lambda w: w.isin(*STOP_WORDS)))),
        F.transform(c("words"), lambda w: F.xxhash64(w)).alias(tmp["hashes"]),
    )
    firm = have("word_chars", "n_symbols", "n_capitals", "n_words", "n_lines", "n_dup_lines", "n_stop_words")
    ints = F.sequence(F.lit(0), F.size(c("hashes")) - gram)
    step = step.select(
        *was,
        *firm,
        F.when(F.size(c("hashes")) < gram, F.array().cast("array<bigint>"))
        .otherwise(F.transform(ints, lambda i: F.xxhash64(*[F.get(c("hashes"), i + j) for j in range(gram)])))
        .alias(tmp["grams"]),
    )
    # Only a text in which some window recurs pays for the sort that finds where.
    step = step.select(
        *was,
        *firm,
        F.when(
            F.size(c("grams")) > F.size(F.array_distinct(c("grams"))),
            F.array_sort(F.transform(c("grams"), lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias(tmp["sorted"]),
    )
    same = lambda x, i: F.coalesce(F.get(c("sorted"), i)["g"] == x["g"], F.lit(False))
    step = step.select(*was, *firm, F.filter(c("sorted"), lambda x, i: same(x, i - 1) | same(x, i + 1)).alias(tmp["twice"]))
    step = step.select(*was, *firm, F.sort_array(F.transform(c("twice"), lambda x: x["i"])).alias(tmp["at"]))
    covered = F.aggregate(
        c("at"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, p: F.struct((p + gram).alias("end"), (a["total"] + p + gram - F.greatest(p, a["end"])).alias("total")),
        lambda a: a["total"],
    )
    return step.select(*was, *firm, named("n_repeat_words", F.coalesce(covered, F.lit(0)))), out


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``measure`` and, as booleans, ``base_failed``, ``kept``, and the failed rules' names as ``failed``."""
    measured, at = measure(df, text)
    at = at | {n: fresh(df, n) for n in ("base_failed", "kept", "failed")}
    columns = {m: F.col(at[m]) for m in METRICS}
    hits = {r.name: r.column(columns) for r in rules}
    any_of = lambda names: reduce(lambda a, b: a | b, (hits[n] for n in names), F.lit(False))
    failed = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()]))
    return measured.select(
        "*",
        any_of(r.name for r in rules if r.base).alias(at["base_failed"]),
        (~any_of(hits)).alias(at["kept"]),
        failed.alias(at["failed"]),
    ), at


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of ``df``."""
    judged, at = judge(df, rules, text)
    # The optimizer does not move a filter below a row number. Moved below the metrics it would hold each of
    # them written out once for every use of every step, and planning would not end.
    row = fresh(judged, "_q_row")
    numbered = judged.withColumn(row, F.monotonically_increasing_id())
    return numbered.where(F.col(at["kept"]) & (F.col(row) >= 0)).select(*[F.col(f"`{c}`") for c in df.columns])
