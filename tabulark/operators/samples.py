"""Training samples: class field, prompt routing, token arrays and loss masks, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import u

# The library's own default prompts; ``route`` takes others.
EXTRACT = "Extract all data from this chart as JSON."
CLASSIFY = "Classify this chart."
END = "</s>"
IGNORED = -100
VISUAL_PREFIX = 5 * 729


def class_field(body: Column, field: str = "chart_type") -> Column:
    """The field of a JSON text as a string: "unknown" if missing or no JSON object, "None" if JSON null."""
    v = F.try_parse_json(body)
    own = F.try_variant_get(v, f"$.{field}", "variant")
    text = F.try_variant_get(v, f"$.{field}", "string")
    return F.when(own.isNull(), "unknown").when(F.is_variant_null(own), "None").otherwise(F.coalesce(text, F.to_json(own)))


def sample_text(prompt: Column, target: Column) -> Column:
    return F.concat(prompt, F.lit("\n"), target, F.lit(END))


def route(key: Column, body: Column, label: Column, share: float = 0.05, seed: str = "route", prompts: tuple[str, str] = (EXTRACT, CLASSIFY)) -> tuple[Column, Column]:
    """Prompt and target: a share of rows is asked for the class, the others for everything."""
    classify = u(seed, key) < share
    extract, ask = prompts
    return F.when(classify, ask).otherwise(extract), F.when(classify, label).otherwise(body)


def word_ids(text: Column, vocabulary: int = 32000, most: int | None = None) -> Column:
    """The default tokenizer: words hashed to ids from 2 on (0 pads, 1 ends). With ``most``, only that many words
    are hashed: what a sample of that length can hold."""
    words = F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)
    words = words if most is None else F.slice(words, 1, most)
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % vocabulary + 2)


def shaped(prompt_ids: Column, target_ids: Column, length: int, pad: int = 0, end: int = 1) -> tuple[Column, Column, Column, Column]:
    """``input_ids, attention_mask, labels, n``: cut (the end token may go) and padded to a length; prompt
    and padding carry no loss."""
    ids = F.concat(prompt_ids, target_ids, F.array(F.lit(end)))
    n, prompt = F.least(F.size(ids), F.lit(length)), F.size(prompt_ids)
    full = F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))
    scored = F.slice(full, prompt + 1, F.greatest(n - prompt, F.lit(0)))
    ignored = lambda count: F.array_repeat(F.lit(IGNORED), count)
    labels = F.concat(ignored(F.least(prompt, n)), scored, ignored(length - n))
    return full, mask, labels, n


def with_prefix(samples: DataFrame, prefix: int = VISUAL_PREFIX) -> DataFrame:
    """Visual positions before the tokens as one length, not as repeated values: mask 1, no loss."""
    return samples.withColumn("prefix_len", F.lit(prefix)).withColumn("total_len", F.size("input_ids") + prefix)


def expanded_prefix(mask: Column, labels: Column, prefix: int = VISUAL_PREFIX) -> tuple[Column, Column]:
    """The arrays with the prefix written out, for a consumer that needs them."""
    return F.concat(F.array_repeat(F.lit(1), prefix), mask), F.concat(F.array_repeat(F.lit(IGNORED), prefix), labels)
