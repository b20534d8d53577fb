"""The registered queries of this package, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, lm, media, mixing, near_dup, packing, quality, token_files, toxicity, warc
from .labels import remainder

#: Place of the tokenizer that op4 uses: a parameter, resolved on the machine.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_tokens(spark, folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.store_texts(table(spark, sf_dir, "documents")))


def _judged(scores: DataFrame, n: int, held: int, at: float) -> DataFrame:
    return scores.withColumn("held_out", remainder(F.col("doc_id"), n) == held).withColumn("predicted", (F.col("score") >= at).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return _judged(quality.score(docs, model), 4, 2, quality.KEEP_AT)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return _judged(toxicity.score(docs, model), 3, 1, toxicity.DROP_AT)


QUERIES = {f.__name__: f for f in (op1_lm_scores, op2_near_duplicates, op3_fingerprints, op4_token_files, op5_warc, op6_media_gif, op7_quality, op8_packing, op9_mixing, op10_toxicity)}
ORACLES = {"op5_warc": warc.ORACLE, "op9_mixing": mixing.ORACLE}
