"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontaminate, htmlmain, langid, oracle, packing, quality, resample, search, secretscan, sharding, simhash, suffixes, tokencount
from .common import id_bucket, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rule counts, and the verdict of base rules and isolation forest."""
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; fold 2 of 4 is held out of training."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    model = langid.train(docs.filter(~held_out), langid.letter_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predicted(model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each tokenized document in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and class bigram scores of each document; fold 2 of 7 is held out of training."""
    return brown.scored(table(spark, sf_dir, "documents"), id_bucket("doc_id", 7) == 2)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; the law is `rows`: shards differ by at most one row."""
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    return secretscan.digest(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of each document."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and score of each document for the benchmark's distribution, and the rank of the drawn ones."""
    return resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the bytes of strings of 200 bytes that occur again."""
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_simhash, op2_quality, op3_language, op4_packing, op5_class_lm, op6_decontaminate, op7_html, op8_shards, op9_secrets, op10_token_counts, op11_search, op12_resample, op13_suffixes]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Hashes by seed, tokenizers, models and searches have no DuckDB form; tests hold brute-force versions of the others."""
    return {"op11_search": oracle.SEARCH, "op12_resample": oracle.RESAMPLE}
