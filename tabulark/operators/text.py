"""Vocabulary filtering, label composition and typo noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import h, u

MEDICAL, ENGLISH = (5, 12), (3, 12)
# The words used where no vocabulary can be read.
DEFAULT_WORDS = ("Control", "Treatment", "Survival", "Response", "Progression")
DEFAULT_ENGLISH = ("apple", "dog", "house", "car", "banana")


def words_of(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.select(F.explode(F.split(F.col(text), r"\s+")).alias("word"))


def alphabetic(word: Column, bounds: tuple[int, int] = MEDICAL) -> Column:
    """Letters only, of a length within bounds; tested before the word is stripped."""
    return word.rlike(r"^\p{L}+$") & F.length(word).between(*bounds)


def vocabulary(documents: DataFrame, bounds: tuple[int, int] = MEDICAL) -> DataFrame:
    """``word, n``: lower-cased words that pass, with their counts."""
    found = words_of(documents).where(alphabetic(F.col("word"), bounds))
    return found.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def seeded_sample(words: DataFrame, k: int = 2000, seed: str = "42") -> DataFrame:
    return words.select("word").distinct().orderBy(h(seed, F.col("word")), "word").limit(k)


def typo_noise(text: Column, key: Column, share: float = 0.3) -> Column:
    """With a chance of ``share``: case changes, widened blanks, a dropped character, or all three in that order."""
    kind = F.floor(u("kind", key) * 4)
    style = F.floor(u("case", key) * 3)
    mixed = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(u("mix", key, i) < 0.5, F.upper(c)).otherwise(F.lower(c))), "")
    cased = F.when(kind.isin(0, 3), F.when(style == 0, F.upper(text)).when(style == 1, F.lower(text)).otherwise(mixed)).otherwise(text)
    blanks = F.when(u("blank", key) < 0.5, "  ").otherwise("   ")
    spaced = F.when(kind.isin(1, 3), F.replace(cased, F.lit(" "), blanks)).otherwise(cased)
    at = (F.floor(u("drop", key) * (F.length(spaced) - 2)) + 1).cast("int")
    cut = F.concat(F.substring(spaced, F.lit(1), at), F.substring(spaced, at + 2, F.length(spaced)))
    dropped = F.when(kind.isin(2, 3) & (F.length(spaced) > 4), cut).otherwise(spaced)
    return F.when(u("typo", key) <= share, dropped).otherwise(text)


# What goes before and after a metric.
LABEL_PREFIXES = ("Estimated", "Adjusted", "Mean", "Median", "Baseline", "Post", "Aggregate", "Overall", "Comparative")
LABEL_UNITS = ("(%)", "(Months)", "(Days)", "(Years)", "(mg/mL)", "(ng/dL)", "Index", "Ratio", "Score", "/ week")

# What the arms of a chart are called, by style: a name before a letter or number, or four names.
ARM_STYLES = ("Treatment", "Drug", "Cohort", "Group", "Dose")
ARM_LETTERS = {"Treatment": "A", "Drug": "X"}
ARM_DOSES = ("Placebo", "Low Dose", "Medium Dose", "High Dose")


def arm_label(style: Column, index: Column) -> Column:
    """The name of the arm ``index`` (from 0) in a style; null for an unknown style, and for a fifth dose."""
    made = F.when(style == "Dose", F.get(F.array(*[F.lit(d) for d in ARM_DOSES]), index.cast("int")))
    for name in ARM_STYLES[:-1]:
        sign = F.char(F.lit(ord(ARM_LETTERS[name])) + index) if name in ARM_LETTERS else (index + 1).cast("string")
        made = made.when(style == name, F.concat(F.lit(f"{name} "), sign))
    return made


def arm_style(key: Column) -> Column:
    """The style of a chart's arms, by its key."""
    return F.element_at(F.array(*[F.lit(s) for s in ARM_STYLES]), (F.floor(u("style", key) * len(ARM_STYLES)) + 1).cast("int"))


def numbered_words(words: DataFrame, source: str, most: int, seed: str = "42") -> DataFrame:
    """``source, pos, word``: a seeded sample of at most ``most`` words, capitalised and numbered from 0."""
    w = Window.orderBy(h(seed, F.col("word")), "word")
    sample = seeded_sample(words, most, seed).withColumn("pos", F.row_number().over(w).cast("bigint") - 1)
    return sample.select(F.lit(source).alias("source"), "pos", F.initcap("word").alias("word"))


def chart_labels(rows: DataFrame, key: str, words: DataFrame, prefixes: tuple[str, ...], units: tuple[str, ...], anarchy: float = 0.2) -> DataFrame:
    """``key, label``: with a chance of ``anarchy`` one to three words of the source "english"; else a word of the source
    "medical" alone, with a prefix or a unit at even odds, or with both. Then typographic noise.

    ``words`` comes from ``numbered_words``. A label's words are rows that meet the vocabulary in a join."""
    k = F.col(key)
    fixed = lambda seed, of: F.element_at(F.array(*[F.lit(w) for w in of]), (F.floor(u(seed, k) * len(of)) + 1).cast("int"))
    part = lambda place, source, at, text: F.struct(F.lit(place).alias("place"), F.lit(source).alias("source"), at.alias("at"), text.alias("text"))
    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("string")
    free = F.transform(F.sequence(F.lit(1), (F.floor(u("words", k) * 3) + 1).cast("int")), lambda i: part(0, "english", u("free", k, i), nothing).withField("place", i))
    metric, prefix, unit = part(2, "medical", u("metric", k), nothing), part(1, "", none, fixed("prefix", prefixes)), part(3, "", none, fixed("unit", units))
    shape = F.floor(u("shape", k) * 3)
    two = F.when(u("two", k) < 0.5, F.array(prefix, metric)).otherwise(F.array(metric, unit))
    clinical = F.when(shape == 0, F.array(metric)).when(shape == 1, two).otherwise(F.array(prefix, metric, unit))
    parts = rows.select(key, F.inline(F.when(u("anarchy", k) < anarchy, free).otherwise(clinical)))
    sizes = words.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    placed = parts.join(sizes, "source", "left").withColumn("pos", F.floor(F.col("at") * F.col("size")))
    found = placed.join(words, ["source", "pos"], "left").select(key, "place", F.coalesce("text", "word").alias("word"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    return found.groupBy(key).agg(joined.alias("plain")).select(key, typo_noise(F.col("plain"), F.col(key)).alias("label"))


def compose_label(key: Column, prefixes: tuple[str, ...], metrics: tuple[str, ...], units: tuple[str, ...]) -> Column:
    """Metric; prefix and metric or metric and unit at even odds; or all three."""
    word = lambda seed, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(u(seed, key) * len(words)) + 1).cast("int"))
    metric, prefix, unit = word("metric", metrics), word("prefix", prefixes), word("unit", units)
    shape = F.floor(u("shape", key) * 3)
    two = F.when(u("two", key) < 0.5, F.concat_ws(" ", prefix, metric)).otherwise(F.concat_ws(" ", metric, unit))
    return F.when(shape == 0, metric).when(shape == 1, two).otherwise(F.concat_ws(" ", prefix, metric, unit))
