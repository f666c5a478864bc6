"""The chart-dataset operators as queries over the given tables, each with its DuckDB SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import urls
from .functions.draws import sql_between, sql_h, sql_normal, sql_pick, sql_u
from .functions.ordinal import claim, shared_folder
from .operators import documents, harvest, pairing, samples, sampling, summaries, survival, text
from .plans import augment, generate
from .registry import ORACLES, QUERIES, Tables, query

__all__ = ["ORACLES", "QUERIES"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Survival: time to a customer's next order, by market segment.
_SPELLS = """SELECT o_orderkey, c_mktsegment AS arm, CAST(least(coalesce(ev, ce), ce) AS DOUBLE) AS t, CAST(coalesce(ev <= ce, false) AS INTEGER) AS e FROM (
  SELECT o_orderkey, o_custkey, date_diff('day', o_orderdate::DATE, (lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::DATE) AS ev,
    date_diff('day', o_orderdate::DATE, DATE '2001-08-01') AS ce FROM orders) JOIN customer ON o_custkey = c_custkey"""
_EVENTS = f"""SELECT arm, t, d, c, CAST(sum(d + c) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n
  FROM (SELECT arm, t, CAST(sum(e) AS BIGINT) AS d, CAST(sum(1 - e) AS BIGINT) AS c FROM ({_SPELLS}) GROUP BY arm, t)"""


def _spells(t: Tables) -> DataFrame:
    return survival.next_order_spells(t.orders, t.customer)


@query(_SPELLS)
def km_spells(t: Tables) -> DataFrame:
    return _spells(t)


@query(_EVENTS)
def km_event_table(t: Tables) -> DataFrame:
    return survival.event_table(_spells(t))


@query(f"""WITH ev AS ({_EVENTS})
SELECT arm, t, round(product(1 - d / n) OVER (PARTITION BY arm ORDER BY t), 6) AS s FROM ev
UNION ALL SELECT arm, 0.0::DOUBLE, 1.0::DOUBLE FROM ev GROUP BY arm HAVING min(t) > 0""")
def km_curve(t: Tables) -> DataFrame:
    return rounded(survival.curve(_spells(t)), "s")


@query(f"WITH ev AS ({_EVENTS}) SELECT arm, count(*) AS n_ticks, string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS ticks FROM ev WHERE c > 0 GROUP BY arm")
def km_censor_ticks(t: Tables) -> DataFrame:
    days = F.array_join(F.transform("ticks", lambda x: x.cast("bigint").cast("string")), ",")
    return survival.censor_ticks(_spells(t)).select("arm", F.size("ticks").cast("bigint").alias("n_ticks"), days.alias("ticks"))


_MONTHS = "(SELECT arm, floor(t / 30.0) AS t, e FROM (" + _SPELLS + "))"


def _in_months(t: Tables) -> DataFrame:
    return _spells(t).withColumn("t", F.floor(F.col("t") / 30.0).cast("double"))


@query(f"""WITH ax AS (SELECT arm, max(t)::DOUBLE AS xmax FROM {_MONTHS} GROUP BY arm),
fit AS (SELECT arm, xmax, list_filter([5, 10, 20, 25, 50], lambda s: xmax / s <= 15) AS f FROM ax),
st AS (SELECT arm, xmax, f[CAST(floor({sql_u("tick-step", "arm")} * len(f)) + 1 AS INTEGER)] AS step FROM fit WHERE len(f) > 0)
SELECT arm, xmax, step, CAST(unnest(range(0, CAST(floor(xmax + step) AS INTEGER) + 1, step)) AS INTEGER) AS tick FROM st""")
def axis_ticks(t: Tables) -> DataFrame:
    return survival.axis_ticks(_in_months(t))


@query(f"""WITH sp AS MATERIALIZED ({_SPELLS}), tk AS (SELECT arm, floor(xmax * k / 10) AS tick FROM (SELECT arm, max(t) AS xmax FROM sp GROUP BY arm), range(11) r(k))
SELECT tk.arm, tick::DOUBLE AS tick, (SELECT count(*) FROM sp WHERE sp.arm = tk.arm AND sp.t > tk.tick) AS at_risk FROM tk""")
def km_at_risk(t: Tables) -> DataFrame:
    spells = _spells(t)
    return survival.at_risk(spells, survival.coarse_ticks(spells))


# Summaries.
_STUDIES = """SELECT n_regionkey AS chart, n_nationkey AS study, n_name AS study_label, greatest(0.1, ra / oa) AS ratio_value,
  greatest(0.01, greatest(0.1, ra / oa) - m) AS ci_lower, greatest(0.1, ra / oa) + m AS ci_upper FROM (
  SELECT n_regionkey, n_nationkey, n_name, avg(p) FILTER (WHERE r) AS ra, avg(p) FILTER (WHERE NOT r) AS oa,
    1.96 * stddev_samp(p) FILTER (WHERE r) / sqrt(count(*) FILTER (WHERE r)) / avg(p) FILTER (WHERE NOT r) AS m, count(*) FILTER (WHERE r) AS rn, count(*) FILTER (WHERE NOT r) AS on_
  FROM (SELECT l_suppkey, l_extendedprice AS p, l_returnflag = 'R' AS r FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
  WHERE rn > 1 AND on_ > 0"""
_POOLED = f"""SELECT chart, x AS ratio_value, x - e AS ci_lower, x + e AS ci_upper FROM (
  SELECT chart, avg(ratio_value) AS x, avg(ci_upper - ratio_value) / sqrt(count(*)) AS e FROM ({_STUDIES}) GROUP BY chart)"""
_ROUND3 = "round(ratio_value, 6) AS ratio_value, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper"


def _studies(t: Tables) -> DataFrame:
    return summaries.study_effects(t.lineitem, t.supplier, t.nation)


@query(f"SELECT chart, study, study_label, {_ROUND3} FROM ({_STUDIES})")
def study_effects(t: Tables) -> DataFrame:
    return rounded(_studies(t), "ratio_value", "ci_lower", "ci_upper")


@query(f"SELECT chart, {_ROUND3} FROM ({_POOLED})")
def forest_pooled(t: Tables) -> DataFrame:
    return rounded(summaries.pooled(_studies(t)), "ratio_value", "ci_lower", "ci_upper")


@query(f"""SELECT chart, count(*) OVER (PARTITION BY chart) - row_number() OVER (PARTITION BY chart ORDER BY study) + 1 AS position, study_label, {_ROUND3} FROM ({_STUDIES})
UNION ALL SELECT chart, 0, 'Overall', {_ROUND3} FROM ({_POOLED})""")
def forest_rows(t: Tables) -> DataFrame:
    return rounded(summaries.forest_rows(_studies(t)), "ratio_value", "ci_lower", "ci_upper")


_BARS = """SELECT chart, id, row_number() OVER (PARTITION BY chart ORDER BY value DESC, id) AS rank, value FROM (
  SELECT c_mktsegment AS chart, o_custkey AS id, greatest(-100.0, least(100.0, 100 * (b - a) / a)) AS value FROM (
    SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS a, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS b, count(*) AS n FROM orders GROUP BY o_custkey)
  JOIN customer ON o_custkey = c_custkey WHERE n > 1 AND a > 0)"""


def _bars(t: Tables) -> DataFrame:
    return summaries.waterfall(summaries.percent_changes(t.orders, t.customer))


@query(f"SELECT chart, id, rank, 'Patient ' || rank AS label, round(value, 6) AS value, CASE WHEN value > 20 THEN 'red' WHEN value < -30 THEN 'green' ELSE 'blue' END AS colour FROM ({_BARS})")
def waterfall_bars(t: Tables) -> DataFrame:
    return rounded(_bars(t), "value")


_MONTH = "strftime(o_orderdate, '%Y-%m')"


def _month() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM")


@query(f"SELECT m AS month, n, CAST(sum(n) OVER (ORDER BY m) AS BIGINT) AS total FROM (SELECT {_MONTH} AS m, count(*) AS n FROM orders GROUP BY 1)")
def running_series(t: Tables) -> DataFrame:
    return summaries.running(t.orders.groupBy(_month().alias("month")).agg(F.count(F.lit(1)).alias("n")), [], "month", "n", "total")


@query("""SELECT o_orderpriority, o_orderstatus, n, CAST(coalesce(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)""")
def stacked_bottoms(t: Tables) -> DataFrame:
    return summaries.stacked(t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")), ["o_orderpriority"], "o_orderstatus", "n")


@query(f"""SELECT o_orderpriority AS chart, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) AS position, m AS label, bar, round(line, 2) AS line
FROM (SELECT o_orderpriority, {_MONTH} AS m, count(*) AS bar, avg(o_totalprice) AS line FROM orders GROUP BY 1, 2)""")
def dual_axis(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.col("o_orderpriority").alias("chart"), _month().alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("p"))
    placed = by.withColumn("position", F.row_number().over(Window.partitionBy("chart").orderBy("label")).cast("bigint"))
    return summaries.dual_axis(placed.withColumn("value", F.col("n")), placed.withColumn("value", F.col("p")))


# Sampling.
@query("SELECT lang AS category, count(*) AS n, CAST(600 // count(*) OVER () AS BIGINT) AS quota, count(*) < 600 // count(*) OVER () AS short FROM documents GROUP BY lang")
def category_census(t: Tables) -> DataFrame:
    return sampling.census(t.documents, "lang", 600)


@query(f"""SELECT doc_id, lang, CAST(rn AS INTEGER) AS rn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_h("balance", "doc_id")}, doc_id) AS rn FROM documents)
WHERE rn <= 600 // (SELECT count(DISTINCT lang) FROM documents)""")
def balanced_sample(t: Tables) -> DataFrame:
    return sampling.balanced(t.documents.select("doc_id", "lang"), "lang", "doc_id", 600, "balance")


@query(f"SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY {sql_h('fraction', 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= floor((SELECT count(*) FROM documents) * 0.2)")
def exact_fraction(t: Tables) -> DataFrame:
    return sampling.exact_fraction(t.documents.select("doc_id"), "doc_id", 0.2, "fraction")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {sql_h('shuffle', 'doc_id')}, doc_id) AS ordinal FROM documents QUALIFY ordinal <= 500")
def shuffle_cap(t: Tables) -> DataFrame:
    return sampling.shuffle_cap(t.documents.select("doc_id"), "doc_id", 500, "shuffle")


@query("SELECT source AS category, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS base_name, doc_id FROM documents SEMI JOIN labels USING (doc_id) ORDER BY 1, 2 LIMIT 250")
def first_n_pairs(t: Tables) -> DataFrame:
    named = t.documents.select(F.col("source").alias("category"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("base_name"), "doc_id")
    return sampling.first_n(named.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("category", "base_name", "doc_id"), 250)


@query(f"""SELECT doc_id, rn, (rn - 1) // 32 AS batch, (rn - 1) // 32 // 8 AS step FROM (SELECT doc_id, row_number() OVER (ORDER BY {sql_h("epoch", "doc_id")}, doc_id) AS rn FROM documents)
WHERE (rn - 1) // 32 < (SELECT count(*) FROM documents) // 32""")
def epoch_batches(t: Tables) -> DataFrame:
    return sampling.batches(t.documents.select("doc_id"), "doc_id", 32, 8, "epoch")


# Pairing.
@query("""SELECT doc_id, lang, coalesce(a, b) AS image FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 'labels/' || doc_id AS a FROM labels) USING (doc_id)
LEFT JOIN (SELECT DISTINCT page_id AS doc_id, 'pages/' || page_id AS b FROM pages) USING (doc_id) WHERE coalesce(a, b) IS NOT NULL""")
def pair_prefer(t: Tables) -> DataFrame:
    named = lambda df, key, kind: df.select(F.col(key).alias("doc_id"), F.concat(F.lit(kind), F.col(key)).alias("image"))
    return pairing.pair_prefer(t.documents.select("doc_id", "lang"), named(t.labels, "doc_id", "labels/"), named(t.pages, "page_id", "pages/"), ["doc_id"], "image")


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def unpaired_anti(t: Tables) -> DataFrame:
    return pairing.unpaired(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("""WITH v AS (SELECT doc_id, quality = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(ok, false) AS valid, coalesce(min(CASE WHEN ok THEN doc_id END) OVER (ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), min(CASE WHEN ok THEN doc_id END) OVER ()) AS substitute FROM v""")
def next_valid(t: Tables) -> DataFrame:
    flagged = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return pairing.next_valid(flagged.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("valid")), "doc_id", "valid")


# Training samples.
@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'unknown') AS class FROM events")
def json_class_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", samples.class_field(F.col("props"), "k").alias("class"))


@query(f"SELECT conv_id, a.turn, a.text || chr(10) || b.text || '{samples.END}' AS sample FROM conversations a JOIN conversations b USING (conv_id) WHERE b.turn = a.turn + 1 AND a.role = 'user'")
def sft_text(t: Tables) -> DataFrame:
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return asked.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", samples.sample_text(F.col("prompt"), F.col("target")).alias("sample"))


@query(f"""SELECT doc_id, CASE WHEN c THEN '{samples.CLASSIFY}' ELSE '{samples.EXTRACT}' END AS prompt, md5(CASE WHEN c THEN lang ELSE text END) AS target_md5
FROM (SELECT *, {sql_u("route", "doc_id")} < 0.05 AS c FROM documents)""")
def sft_route(t: Tables) -> DataFrame:
    prompt, target = samples.route(F.col("doc_id"), F.col("text"), F.col("lang"))
    return t.documents.select("doc_id", prompt.alias("prompt"), F.md5(target).alias("target_md5"))


_LENGTH = 768


def _shaped(t: Tables) -> DataFrame:
    ids, mask, labels, n = samples.shaped(samples.word_ids(F.lit(samples.EXTRACT)), F.col("ids"), _LENGTH)
    tokens = t.documents.select("doc_id", samples.word_ids(F.coalesce("text", F.lit("")), most=_LENGTH).alias("ids"))
    return tokens.select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"), n.cast("bigint").alias("n"))


_TOKENS = f"""WITH tk AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'), lambda w: CAST(('0x' || substr(md5(w), 1, 7))::BIGINT % 32000 + 2 AS INTEGER)) AS t,
  list_transform(string_split('{samples.EXTRACT}', ' '), lambda w: CAST(('0x' || substr(md5(w), 1, 7))::BIGINT % 32000 + 2 AS INTEGER)) AS p FROM documents),
fl AS (SELECT doc_id, least({_LENGTH}, len(p) + len(t) + 1) AS n, len(p) AS k, list_concat(list_concat(p, t), [1])[1:{_LENGTH}] AS i FROM tk)"""


@query(f"{_TOKENS} SELECT doc_id, CAST(n AS BIGINT) AS n, md5(array_to_string(i, ',') || repeat(',0', {_LENGTH} - CAST(n AS INTEGER))) AS ids_md5, CAST(n AS BIGINT) AS mask_sum, CAST(greatest(0, n - k) AS BIGINT) AS unmasked FROM fl")
def sft_tokens(t: Tables) -> DataFrame:
    return _shaped(t).select(
        "doc_id",
        "n",
        F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
        F.size(F.filter("labels", lambda x: x != samples.IGNORED)).cast("bigint").alias("unmasked"),
    )


@query(f"{_TOKENS} SELECT doc_id, CAST(n AS BIGINT) AS n, CAST({samples.VISUAL_PREFIX} AS INTEGER) AS prefix_len, CAST({samples.VISUAL_PREFIX + _LENGTH} AS INTEGER) AS total_len FROM fl")
def sft_prefix(t: Tables) -> DataFrame:
    return samples.with_prefix(_shaped(t)).select("doc_id", "n", "prefix_len", "total_len")


@query(f"""{_TOKENS} SELECT doc_id, CAST({samples.VISUAL_PREFIX + _LENGTH} AS BIGINT) AS total_len, CAST({samples.VISUAL_PREFIX} + n AS BIGINT) AS mask_sum,
  CAST({samples.VISUAL_PREFIX + _LENGTH} - greatest(0, n - k) AS BIGINT) AS ignored, CASE WHEN n > k THEN CAST({samples.VISUAL_PREFIX + 1} + k AS BIGINT) ELSE 0 END AS first_scored FROM fl""")
def sft_expanded(t: Tables) -> DataFrame:
    """What the written-out visual prefix makes of mask and labels."""
    mask, labels = samples.expanded_prefix(F.col("attention_mask"), F.col("labels"))
    made = _shaped(t).select("doc_id", mask.alias("mask"), labels.alias("own"))
    scored = F.array_position(F.transform("own", lambda x: x != samples.IGNORED), True)
    total = F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select("doc_id", F.size("own").cast("bigint").alias("total_len"), total.alias("mask_sum"), F.size(F.filter("own", lambda x: x == samples.IGNORED)).cast("bigint").alias("ignored"), scored.alias("first_scored"))


# Text.
_VOCABULARY = r"SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS w FROM documents) WHERE regexp_full_match(w, '\p{L}+') AND length(w) BETWEEN 5 AND 12 GROUP BY 1"


@query(_VOCABULARY)
def vocab_filter(t: Tables) -> DataFrame:
    return text.vocabulary(t.documents)


@query(f"SELECT word FROM ({_VOCABULARY}) ORDER BY {sql_h('42', 'word')}, word LIMIT 2000")
def vocab_sample(t: Tables) -> DataFrame:
    return text.seeded_sample(text.vocabulary(t.documents))


_WIDE = f"replace(cased, ' ', CASE WHEN {sql_u('blank', 'k')} < 0.5 THEN '  ' ELSE '   ' END)"


@query(f"""WITH a AS (SELECT p_partkey AS k, p_name AS x, floor({sql_u("kind", "p_partkey")} * 4) AS kind, floor({sql_u("case", "p_partkey")} * 3) AS style FROM part),
b AS (SELECT *, CASE WHEN kind NOT IN (0, 3) THEN x WHEN style = 0 THEN upper(x) WHEN style = 1 THEN lower(x) ELSE array_to_string(list_transform(range(1, length(x) + 1),
  lambda i: CASE WHEN {sql_u("mix", "k", "i - 1")} < 0.5 THEN upper(x[i]) ELSE lower(x[i]) END), '') END AS cased FROM a),
c AS (SELECT *, CASE WHEN kind IN (1, 3) THEN {_WIDE} ELSE cased END AS y FROM b),
d AS (SELECT *, CAST(floor({sql_u("drop", "k")} * (length(y) - 2)) + 1 AS INTEGER) AS cut FROM c)
SELECT k AS p_partkey, CASE WHEN {sql_u("typo", "k")} > 0.3 THEN x WHEN kind IN (2, 3) AND length(y) > 4 THEN substr(y, 1, cut) || substr(y, cut + 2) ELSE y END AS noisy FROM d""")
def typo_noise(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.typo_noise(F.col("p_name"), F.col("p_partkey")).alias("noisy"))


def _sql_word(seed: str, words: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(w) for w in words)}][CAST(floor({sql_u(seed, 'c_custkey')} * {len(words)}) + 1 AS INTEGER)]"


@query(f"""SELECT c_custkey, CASE WHEN s = 0 THEN m WHEN s = 1 THEN CASE WHEN two < 0.5 THEN p || ' ' || m ELSE m || ' ' || q END ELSE p || ' ' || m || ' ' || q END AS label FROM (
  SELECT c_custkey, floor({sql_u("shape", "c_custkey")} * 3) AS s, {sql_u("two", "c_custkey")} AS two, {_sql_word("metric", text.DEFAULT_WORDS)} AS m, {_sql_word("prefix", text.LABEL_PREFIXES)} AS p, {_sql_word("unit", text.LABEL_UNITS)} AS q FROM customer)""")
def compose_labels(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.compose_label(F.col("c_custkey"), text.LABEL_PREFIXES, text.DEFAULT_WORDS, text.LABEL_UNITS).alias("label"))


def _sql_arm(key: str, index: str) -> str:
    doses = ", ".join(repr(d) for d in text.ARM_DOSES)
    styles = [f"'{s} ' || " + (f"chr(CAST({ord(text.ARM_LETTERS[s])} + {index} AS INTEGER))" if s in text.ARM_LETTERS else f"({index} + 1)") for s in text.ARM_STYLES[:-1]]
    cases = " ".join(f"WHEN {i} THEN {made}" for i, made in enumerate(styles))
    return f"CASE CAST(floor({sql_u('style', key)} * {len(text.ARM_STYLES)}) AS INTEGER) {cases} ELSE [{doses}][CAST({index} AS INTEGER) + 1] END"


@query(f"""SELECT chart, arm, n, {_sql_arm("chart", "i")} AS label FROM (
  SELECT c_nationkey AS chart, c_mktsegment AS arm, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS i FROM customer GROUP BY 1, 2)""")
def arm_labels(t: Tables) -> DataFrame:
    """The arms of a chart for each nation, named in the chart's style."""
    arms = t.customer.groupBy(F.col("c_nationkey").alias("chart"), F.col("c_mktsegment").alias("arm")).agg(F.count(F.lit(1)).alias("n"))
    placed = arms.withColumn("i", F.row_number().over(Window.partitionBy("chart").orderBy("arm")) - 1)
    return placed.select("chart", "arm", "n", text.arm_label(text.arm_style(F.col("chart")), F.col("i")).alias("label"))


def _sql_noise(source: str) -> str:
    """The SQL of text.typo_noise over rows ``k, x``; DuckDB has one capital sharp s, Spark two letters."""
    return f"""WITH a0 AS ({source}), a AS (SELECT k, x, floor({sql_u("kind", "k")} * 4) AS kind, floor({sql_u("case", "k")} * 3) AS style FROM a0),
b AS (SELECT *, CASE WHEN kind NOT IN (0, 3) THEN x WHEN style = 0 THEN upper(replace(x, 'ß', 'SS')) WHEN style = 1 THEN lower(x) ELSE array_to_string(list_transform(range(1, length(x) + 1),
  lambda i: CASE WHEN {sql_u("mix", "k", "i - 1")} < 0.5 THEN upper(replace(x[i], 'ß', 'SS')) ELSE lower(x[i]) END), '') END AS cased FROM a),
c AS (SELECT *, CASE WHEN kind IN (1, 3) THEN {_WIDE} ELSE cased END AS y FROM b),
d AS (SELECT *, CAST(floor({sql_u("drop", "k")} * (length(y) - 2)) + 1 AS INTEGER) AS cut FROM c)
SELECT k AS c_custkey, CASE WHEN {sql_u("typo", "k")} > 0.3 THEN x WHEN kind IN (2, 3) AND length(y) > 4 THEN substr(y, 1, cut) || substr(y, cut + 2) ELSE y END AS label FROM d"""


_ENGLISH_WORDS = _VOCABULARY.replace("BETWEEN 5 AND 12", "BETWEEN 3 AND 12")
_NUMBERED = lambda sql: f"SELECT CASE word[1] WHEN 'ß' THEN 'Ss' ELSE upper(word[1]) END || lower(word[2:]) AS word, row_number() OVER (ORDER BY {sql_h('42', 'word')}, word) - 1 AS pos FROM (SELECT word FROM ({sql}) ORDER BY {sql_h('42', 'word')}, word LIMIT 2000)"
_SQL_FIXED = lambda seed, words: f"[{', '.join(repr(w) for w in words)}][CAST(floor({sql_u(seed, 'k')} * {len(words)}) + 1 AS INTEGER)]"


@query(_sql_noise(f"""WITH medical AS ({_NUMBERED(_VOCABULARY)}), english AS ({_NUMBERED(_ENGLISH_WORDS)}), keys AS (SELECT c_custkey AS k FROM customer),
free AS (SELECT k, i, floor({sql_u("free", "k", "i")} * (SELECT count(*) FROM english)) AS pos FROM (SELECT k, unnest(range(1, CAST(floor({sql_u("words", "k")} * 3) AS INTEGER) + 2)) AS i FROM keys WHERE {sql_u("anarchy", "k")} < 0.2)),
clinical AS (SELECT k, floor({sql_u("metric", "k")} * (SELECT count(*) FROM medical)) AS pos, floor({sql_u("shape", "k")} * 3) AS s, {sql_u("two", "k")} AS two, {_SQL_FIXED("prefix", text.LABEL_PREFIXES)} AS p, {_SQL_FIXED("unit", text.LABEL_UNITS)} AS q
  FROM keys WHERE NOT {sql_u("anarchy", "k")} < 0.2)
SELECT k, string_agg(word, ' ' ORDER BY i) AS x FROM free JOIN english USING (pos) GROUP BY k
UNION ALL SELECT k, CASE WHEN s = 0 THEN word WHEN s = 1 THEN CASE WHEN two < 0.5 THEN p || ' ' || word ELSE word || ' ' || q END ELSE p || ' ' || word || ' ' || q END AS x FROM clinical JOIN medical USING (pos)"""))
def chart_labels(t: Tables) -> DataFrame:
    medical = text.numbered_words(text.vocabulary(t.documents), "medical", 2000)
    english = text.numbered_words(text.vocabulary(t.documents, text.ENGLISH), "english", 2000)
    return text.chart_labels(t.customer.select("c_custkey"), "c_custkey", medical.unionByName(english), text.LABEL_PREFIXES, text.LABEL_UNITS)


# Harvest.
@query("""WITH q AS (SELECT CAST(doc_id % 2 AS INTEGER) AS query, doc_id AS pos, source AS article_id FROM documents),
c AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos) <= 1000)
SELECT query, pos, article_id, row_number() OVER (PARTITION BY article_id ORDER BY query, pos) AS occurrence FROM c""")
def search_ids(t: Tables) -> DataFrame:
    every = t.documents.select(F.col("doc_id").alias("pos"), F.col("source").alias("article_id"))
    return harvest.capped_union([every.where("pos % 2 = 0"), every.where("pos % 2 = 1")], 1000)


_HREFS = r"""SELECT page_id, page, CAST(s.p - 1 AS BIGINT) AS pos, s.l AS link FROM (
  SELECT page_id, url AS page, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x, i: {'p': i, 'l': x})) AS s FROM pages)
  WHERE s.l <> '' AND NOT regexp_matches(lower(s.l), 'logo|icon|google|button')"""


@query(urls.sql_join(_HREFS, "page_id, pos, link"))
def page_links(t: Tables) -> DataFrame:
    return harvest.page_links(t.pages)


@query("""SELECT type, pos, article_id, images, before FROM (SELECT source AS type, doc_id AS pos, 'PMC' || doc_id AS article_id, 1 + n_chars % 5 AS images,
  CAST(coalesce(sum(1 + n_chars % 5) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents WHERE doc_id >= 100) WHERE before < 125""")
def resume_quota(t: Tables) -> DataFrame:
    articles = t.documents.select(F.col("source").alias("type"), F.col("doc_id").alias("pos"), F.concat(F.lit("PMC"), "doc_id").alias("article_id"), (F.col("n_chars") % 5 + 1).alias("images"))
    types = articles.select("type").distinct()
    return harvest.resume_quota(articles, types.withColumn("next_index", F.lit(100)), types.select("type", F.lit(0).alias("have"), F.lit(125).alias("target")))


_FILES = "SELECT p_brand AS type, CASE WHEN p_partkey % 7 = 0 THEN 'notes' || p_partkey || '.png' ELSE 'chart_' || (p_partkey * 3) || '.png' END AS name, p_partkey AS pos FROM part"


def _files(t: Tables) -> DataFrame:
    odd = F.col("p_partkey") % 7 == 0
    name = F.when(odd, F.concat(F.lit("notes"), "p_partkey", F.lit(".png"))).otherwise(F.concat(F.lit("chart_"), (F.col("p_partkey") * 3).cast("string"), F.lit(".png")))
    return t.part.select(F.col("p_brand").alias("type"), name.alias("name"), F.col("p_partkey").alias("pos"))


@query(f"""SELECT type, name, number, 'chart_' || CASE WHEN rank < 1000 THEN lpad(CAST(rank AS VARCHAR), 3, '0') ELSE CAST(rank AS VARCHAR) END || '_' || type || '.png' AS new_name FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY number, name) AS rank FROM (SELECT type, name, coalesce(TRY_CAST(nullif(regexp_extract(name, 'chart_(\\d+)', 1), '') AS BIGINT), 0) AS number FROM ({_FILES})))""")
def dense_reindex(t: Tables) -> DataFrame:
    return harvest.dense_reindex(_files(t))


@query("""SELECT p_brand AS type, p_partkey AS pos, coalesce(max(CASE WHEN p_size > 10 THEN p_partkey * 3 END) OVER (PARTITION BY p_brand), 0)
  + row_number() OVER (PARTITION BY p_brand, p_size <= 10 ORDER BY p_partkey) AS number FROM part QUALIFY p_size <= 10""")
def continuing_ids(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") * 3).alias("number"), "p_size")
    return harvest.continuing_ids(rows.where("p_size > 10"), rows.where("p_size <= 10").select("type", "pos"))


@query("SELECT source AS type, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def type_totals(t: Tables) -> DataFrame:
    return harvest.type_totals(t.documents, "source")


# Documents.
def _small_bars(t: Tables) -> DataFrame:
    """Bars of charts of 256 consecutive customers of a segment: a document is one row, and must not grow."""
    changes = summaries.percent_changes(t.orders, t.customer)
    chart = F.concat_ws("-", "chart", F.floor(F.col("id") / 256).cast("string"))
    return summaries.waterfall(changes.withColumn("chart", chart))


def _chart_documents(t: Tables) -> DataFrame:
    spells = _spells(t)
    by_month = t.orders.groupBy(F.col("o_orderpriority").alias("chart"), F.col("o_orderstatus").alias("series"), _month().alias("label")).agg(F.count(F.lit(1)).alias("value"))
    made = documents.waterfall_documents(_small_bars(t)).unionByName(documents.km_documents(survival.curve(spells), survival.censor_ticks(spells)))
    return made.unionByName(documents.forest_documents(summaries.forest_rows(_studies(t)))).unionByName(documents.series_documents(by_month))


_SMALL_BARS = _BARS.replace("c_mktsegment AS chart", "c_mktsegment || '-' || o_custkey // 256 AS chart")


@query(f"""SELECT chart, 'waterfall_plot' AS category, 'Change from baseline (%)' AS axis, count(*) AS parts, count(*) AS numbers FROM ({_SMALL_BARS}) GROUP BY chart
UNION ALL SELECT CAST(chart AS VARCHAR), 'forest_plot', 'Hazard Ratio (95% CI)', count(*), 3 * (count(*) + 1) FROM ({_STUDIES}) GROUP BY chart
UNION ALL SELECT o_orderpriority, 'multi_line', 'Month', count(DISTINCT o_orderstatus), count(*) FROM (SELECT DISTINCT o_orderpriority, o_orderstatus, {_MONTH} FROM orders) GROUP BY 1
UNION ALL SELECT 'km', 'kaplan_meier', 'Days', (SELECT count(DISTINCT arm) FROM ({_EVENTS})), (SELECT 2 * (count(*) + (SELECT count(*) FROM (SELECT arm FROM ({_EVENTS}) GROUP BY arm HAVING min(t) > 0))) FROM ({_EVENTS}))""")
def chart_documents(t: Tables) -> DataFrame:
    """What a reader of the documents finds in them: parts (bars, studies, series, arms) and the numbers in these."""
    every, found = _chart_documents(t), None
    zero = F.lit(0).cast("bigint")
    total = lambda items, size: F.aggregate(items, zero, lambda a, x: a + size(x))
    doc = F.col("doc")
    reads = {
        "waterfall_plot": (doc["axes"]["y"]["label"], doc["bars"], F.size(doc["bars"].getField("value")).cast("bigint")),
        "forest_plot": (doc["axes"]["x"]["label"], doc["studies"], (F.size(doc["studies"]).cast("bigint") + 1) * 3),
        "multi_line": (doc["axes"]["x"]["label"], doc["series"], total(doc["series"], lambda s: F.size(s["data"]))),
        "kaplan_meier": (doc["axes"]["x"]["label"], doc["arms"], total(doc["arms"], lambda a: F.size(F.flatten(a["coordinates"])))),
    }
    for kind, (axis, parts, numbers) in reads.items():
        read = documents.validate(every.where(F.col("category") == kind), kind).where("valid")
        one = read.select("chart", "category", axis.alias("axis"), F.size(parts).cast("bigint").alias("parts"), numbers.alias("numbers"))
        found = one if found is None else found.unionByName(one)
    return found


_FOUR = lambda x: f"CAST(round(round({x}, 4) * 10000) AS BIGINT)"


@query(f"""SELECT chart, 'waterfall_plot' AS category, md5(string_agg('Patient ' || rank || '=' || {_FOUR("value")}, ',' ORDER BY rank)) AS digest FROM ({_SMALL_BARS}) GROUP BY chart
UNION ALL SELECT CAST(s.chart AS VARCHAR), 'forest_plot', md5(string_agg(study_label || '=' || {_FOUR("s.ratio_value")} || ':' || {_FOUR("s.ci_lower")} || ':' || {_FOUR("s.ci_upper")}, ',' ORDER BY study)
  || ';Overall=' || any_value({_FOUR("p.ratio_value")}) || ':' || any_value({_FOUR("p.ci_lower")}) || ':' || any_value({_FOUR("p.ci_upper")})) FROM ({_STUDIES}) s JOIN ({_POOLED}) p ON s.chart = p.chart GROUP BY s.chart
UNION ALL SELECT chart, 'multi_line', md5(string_agg(series || '[' || points || ']', ',' ORDER BY series)) FROM (SELECT chart, series, string_agg(label || '=' || 10000 * n, ',' ORDER BY label) AS points
  FROM (SELECT o_orderpriority AS chart, o_orderstatus AS series, {_MONTH} AS label, count(*) AS n FROM orders GROUP BY ALL) GROUP BY chart, series) GROUP BY chart
UNION ALL SELECT 'km', 'kaplan_meier', md5(string_agg(arm || '[' || points || '|' || coalesce(ticks, '') || ']', ',' ORDER BY arm)) FROM (
  SELECT arm, string_agg(CAST(t AS BIGINT) || '=' || {_FOUR("s")}, ',' ORDER BY t, s) AS points FROM (
    WITH ev AS ({_EVENTS}) SELECT arm, t, product(1 - d / n) OVER (PARTITION BY arm ORDER BY t) AS s FROM ev UNION ALL SELECT arm, 0.0, 1.0 FROM ev GROUP BY arm HAVING min(t) > 0) GROUP BY arm)
  LEFT JOIN (SELECT arm, string_agg(CAST(t AS BIGINT), ',' ORDER BY t) AS ticks FROM ({_EVENTS}) WHERE c > 0 GROUP BY arm) USING (arm)""")
def chart_digests(t: Tables) -> DataFrame:
    """A digest of every value that a reader finds in a document, in the document's order."""
    every, found, doc = _chart_documents(t), None, F.col("doc")
    four = lambda x: F.round(x * 10000).cast("bigint").cast("string")
    listed = lambda items, one: F.array_join(F.transform(items, one), ",")
    study = lambda s: F.concat(s["study_label"], F.lit("="), F.concat_ws(":", *[four(s[c]) for c in ("ratio_value", "ci_lower", "ci_upper")]))
    pair = lambda p: F.concat(p[0].cast("bigint").cast("string"), F.lit("="), four(p[1]))
    reads = {
        "waterfall_plot": listed(doc["bars"], lambda b: F.concat(b["label"], F.lit("="), four(b["value"]))),
        "forest_plot": F.concat(listed(doc["studies"], study), F.lit(";"), study(doc["overall_effect"])),
        "multi_line": listed(doc["series"], lambda s: F.concat(s["series_name"], F.lit("["), listed(s["data"], lambda p: F.concat(p["x"], F.lit("="), four(p["y"]))), F.lit("]"))),
        "kaplan_meier": listed(doc["arms"], lambda a: F.concat(a["treatment_label"], F.lit("["), listed(a["coordinates"], pair), F.lit("|"), listed(a["censoring_ticks"], lambda x: x.cast("bigint").cast("string")), F.lit("]"))),
    }
    for kind, text_ in reads.items():
        one = documents.validate(every.where(F.col("category") == kind), kind).where("valid").select("chart", "category", F.md5(text_).alias("digest"))
        found = one if found is None else found.unionByName(one)
    return found


@query(f"""SELECT chart AS base_name, 'waterfall_plot' AS category, chart || CASE WHEN k = 0 THEN '.png' ELSE '.jpg' END AS image_path, true AS valid, n AS bars
FROM (SELECT chart, min(id) % 3 AS k, count(*) AS n FROM ({_SMALL_BARS}) GROUP BY chart) WHERE k < 2""")
def label_files(t: Tables) -> DataFrame:
    """Documents written by category, read again, paired with images (.png before .jpg) and validated."""
    path = claim(f"{shared_folder(t.spark)}/labels-{uuid.uuid4().hex}")
    bars = _small_bars(t)
    documents.write_documents(documents.waterfall_documents(bars), path)
    labels = documents.read_documents(t.spark, path).withColumnRenamed("chart", "base_name")
    kinds = bars.groupBy(F.col("chart").alias("base_name")).agg((F.min("id") % 3).alias("k")).withColumn("category", F.lit("waterfall_plot"))
    image = lambda which, ending: kinds.where(which).select("category", "base_name", F.concat("base_name", F.lit(ending)).alias("image_path"))
    paired = pairing.pair_prefer(labels, image("k = 0", ".png"), image("k < 2", ".jpg"), ["category", "base_name"], "image_path")
    read = documents.validate(paired, "waterfall_plot")
    return read.select("base_name", "category", "image_path", "valid", F.size("doc.bars").cast("bigint").alias("bars"))


@query(f"""SELECT chart, bool_and(id % 997 <> 5) AND min(id) % 5 <> 0 AS valid, CASE WHEN min(id) % 5 = 1 THEN NULL ELSE count(*) END AS n FROM ({_SMALL_BARS}) GROUP BY chart HAVING min(id) % 5 <> 1
UNION ALL SELECT chart, false, NULL FROM ({_SMALL_BARS}) GROUP BY chart HAVING min(id) % 5 = 1""")
def label_validate(t: Tables) -> DataFrame:
    """Documents some of which lack a bar's value, their axes, or their end."""
    bars = _small_bars(t)
    made = documents.waterfall_documents(bars.withColumn("value", F.when(F.col("id") % 997 != 5, F.col("value"))))
    first = bars.groupBy("chart").agg((F.min("id") % 5).alias("kind"))
    body = F.when(F.col("kind") == 0, F.replace("body", F.lit('"axes"'), F.lit('"axis"'))).when(F.col("kind") == 1, F.expr("substr(body, 1, length(body) - 1)")).otherwise(F.col("body"))
    read = documents.validate(made.join(first, "chart").withColumn("body", body), "waterfall_plot")
    return read.select("chart", "valid", F.when(F.col("doc._corrupt").isNull(), F.size("doc.bars").cast("bigint")).alias("n"))


# Plans and generated tables; a customer's key seeds a chart.
_PLAN = [("rotate", 0.5, sql_between("angle", -4, 4, "doc_id"), 1), ("perspective", 0.5, "0", 1), ("pad", 0.5, "0", 1), ("compress", 0.5, sql_pick("quality", 60, 90, "doc_id"), 0)]
_PLAN += [("noise", 0.5, sql_between("variance", 10, 50, "doc_id"), 0), ("blur", 0.3, sql_pick("kernel", 3, 5, "doc_id"), 0), ("dropout", 0.3, "0", 0)]


@query(" UNION ALL ".join(f"SELECT doc_id, {i} AS position, '{what}' AS transform, round(({value})::DOUBLE, 6) AS p1 FROM documents WHERE {sql_u('do-' + what, 'doc_id')} < {chance}" + (" AND doc_id % 3 = 0" if spatial else "") for i, (what, chance, value, spatial) in enumerate(_PLAN)))
def augment_plan(t: Tables) -> DataFrame:
    named = t.documents.select("doc_id", F.concat(F.lit("chart_"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "_anchor").otherwise(""), F.lit(".png")).alias("name"))
    return augment.augment_plan(named, "doc_id", "name")


def _sql_kind() -> str:
    total, out = 0.0, "CASE"
    for kind, share in generate.MIX[:-1]:
        total = round(total + share, 6)
        out += f" WHEN {sql_u('mix', 'c_custkey')} < {total!r} THEN '{kind}'"
    return f"{out} ELSE '{generate.MIX[-1][0]}' END"


@query(f"SELECT c_custkey, {_sql_kind()} AS kind FROM customer")
def gen_mix(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", generate.kind_of(F.col("c_custkey")).alias("kind"))


@query(f"""WITH a AS (SELECT c_custkey, unnest(range(1, {sql_pick("arms", 2, 4, "c_custkey")} + 1)) AS arm FROM customer),
b AS (SELECT *, {sql_between("shape", 0.8, 1.5, "c_custkey", "arm")} AS shape, {sql_between("scale", 20, 100, "c_custkey", "arm")} AS scale, {sql_between("rate", 0.1, 0.5, "c_custkey", "arm")} AS rate,
  unnest(range(1, {sql_pick("subjects", 50, 200, "c_custkey", "arm")} + 1)) AS subject FROM a),
c AS (SELECT *, scale * pow(-ln(1.0::DOUBLE - {sql_u("event", "c_custkey", "arm", "subject")}), 1.0 / shape) AS ev, {sql_u("censor", "c_custkey", "arm", "subject")} * scale * (1 + 2 * rate) AS ce FROM b)
SELECT c_custkey, arm, count(*) AS n, CAST(sum(CASE WHEN ev <= ce THEN 1 ELSE 0 END) AS BIGINT) AS events, round(sum(least(ev, ce)), 3) AS total, {_sql_arm("c_custkey", "arm - 1")} AS label FROM c GROUP BY c_custkey, arm""")
def gen_survival(t: Tables) -> DataFrame:
    rows = generate.survival_rows(t.customer.select("c_custkey"), "c_custkey")
    by = rows.groupBy("c_custkey", F.col("arm").cast("bigint").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.sum("e").cast("bigint").alias("events"), F.round(F.sum("t"), 3).alias("total"))
    return by.withColumn("label", text.arm_label(text.arm_style(F.col("c_custkey")), F.col("arm") - 1))


@query(f"""WITH a AS (SELECT c_custkey, unnest(range(1, {sql_pick("studies", 3, 10, "c_custkey")} + 1)) AS study FROM customer),
b AS (SELECT *, greatest(0.1, {sql_normal("ratio", 1.0, 0.4, "c_custkey", "study")}) AS r, {sql_between("margin", 0.1, 0.5, "c_custkey", "study")} AS m FROM a)
SELECT c_custkey, CAST(study AS INTEGER) AS study, round(r, 6) AS ratio_value, round(greatest(0.01, r - m), 6) AS ci_lower, round(r + m, 6) AS ci_upper FROM b""")
def gen_studies(t: Tables) -> DataFrame:
    return rounded(generate.study_rows(t.customer.select("c_custkey"), "c_custkey"), "ratio_value", "ci_lower", "ci_upper")


@query(f"""WITH a AS (SELECT c_custkey, unnest(range(1, {sql_pick("patients", 20, 50, "c_custkey")} + 1)) AS patient FROM customer),
b AS (SELECT *, greatest(-100.0, least(100.0, {sql_normal("change", -10.0, 30.0, "c_custkey", "patient")})) AS v FROM a)
SELECT c_custkey, CAST(patient AS INTEGER) AS patient, round(v, 6) AS value, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, patient) AS rank FROM b""")
def gen_bars(t: Tables) -> DataFrame:
    return rounded(generate.bar_rows(t.customer.select("c_custkey"), "c_custkey"), "value")


@query(None)
def gen_series(t: Tables) -> DataFrame:
    return generate.series_rows(t.customer.select("c_custkey"), "c_custkey")


from . import intake_queries  # noqa: E402, F401  registers its queries here
