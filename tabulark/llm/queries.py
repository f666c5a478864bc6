"""The operators with production parameters over their whole tables, as ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, collocations, fingerprint, hilbert, idfiles, neardup, packing, phrases, pieces, quality, suffixes, vectorcodes, warc
from .scratch import Scratch


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, at = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_capitals")
    return judged.select("doc_id", *[F.col(at[n]).alias(n) for n in names])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=2048, end_id=1)
    return pieces_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them."""
    model = vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = pieces.decode(encoded, model)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ")
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = phrases.remove_repeated(_table(spark, sf_dir, "documents"), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "idfiles").path("ids")
    idfiles.write_ids(_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return idfiles.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archives = scratch.write(warc.write_archives(_table(spark, sf_dir, "pages")), "archives", batch_bytes=warc.BATCH_BYTES, **warc.PARQUET)
    pages = warc.read_pages(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return scratch.write(pages, "pages", drop=("archives",), batch_bytes=warc.BATCH_BYTES)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    dimensions = {"lang": hilbert.quantised_name(F.col("lang"), 8), "source": hilbert.quantised_name(F.col("source"), 8), "size": hilbert.quantised_log(F.col("size"), 8)}
    placed = hilbert.shard_by_curve(rows, dimensions, 8, 24, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeated(_table(spark, sf_dir, "documents"), width=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = classifier.fit(docs, labels, ~held_out, label="quality")
    scored = classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"), most_words=3, least=10, cover=50, top=2000)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectorcodes.lloyd(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_near_duplicates,
        op3_sentencepiece,
        op4_quality_rules,
        op5_phrase_automata,
        op6_token_files,
        op7_warc,
        op8_hilbert_shards,
        op9_fingerprints,
        op10_suffix_dedup,
        op11_quality_classifier,
        op12_collocations,
        op13_vector_codes,
    )
}
