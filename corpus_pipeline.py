"""The corpus pipeline: stages over the documents table, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mirador.llm import langid, linefreq, neardup, packing
from mirador.llm.registry import prepared
from mirador.llm.words import unsend
from mirador.sources.tables import stage
from mirador.sources.workspace import scratch

#: Rejected rows (two numbers each) that a broadcast may hold.
BROADCAST_ROWS = 2_000_000


def without(docs: DataFrame, rejected: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows of ``docs`` whose id and text are not among the rejected (doc_id, text_hash).

    With ``how`` left_semi, the rows that are. The rejected are written and counted first. Up to
    BROADCAST_ROWS of them are broadcast, so that texts stay where they are; more are joined by a
    shuffle.
    """
    gone = stage(rejected.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash"))
    return docs.join(gone, same, how)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters or fit no learned language.

    Null and empty texts have no letters and go. Repeated rows, and rows without an id, are judged
    each; without any known language all rows go.
    """
    models = langid.learn(langid.teachers(docs))
    return without(docs, langid.predictions(docs, models).filter("rejected"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines above the limits, and without documents that fail the base rules or are depleted.

    ``n_chars``, where there is one, is that of the text that is left. Null and empty texts fail the
    base rules and go. Repeated rows are judged each and count as one document of their host; a row
    without an id is judged like others.
    """
    kept = linefreq.cleaned(docs).filter("kept")
    columns = {c: F.col("doc")[c].alias(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        now = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("removed_words") > 0, now).otherwise(F.col("doc.n_chars")).alias("n_chars")
    return kept.select(*columns.values())


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component, in one row.

    Of several texts under the first id, or without any id, the one of least hash stays. Of rows
    that repeat an id and a text, the least by its other columns stays, also where the text is empty.
    """
    key = ["doc_id", "text_hash"]
    found = stage(neardup.grouped(docs).select(*key, "label", "kept"), "components")
    first = stage(found.filter("kept").groupBy("label", *key).agg(F.count(F.lit(1)).alias("copies")), "first")
    least = first.filter("label IS NOT NULL").groupBy("label").agg(F.min("text_hash").alias("least"))
    other = first.join(least, "label").filter("text_hash <> least").select(*key)
    one = without(docs, found.filter("NOT kept").select(*key).distinct().unionByName(other))
    repeated = stage(first.filter("copies > 1").select(*key), "repeated")
    if repeated.isEmpty():
        return one
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = without(one, repeated, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("doc_id", *rest)).alias("row"))
    again = again.select(*[F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in docs.columns])
    return without(one, repeated).unionByName(again)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in training sequences of 1024 tokens.

    Null and empty texts are one end token each; repeated rows, and rows without an id, are packed
    each; an empty table gives no rows.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed_pieces(docs, path, remembered=200_000).drop("text_hash")  # executors hold earlier stages, too


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("near_dedup", one_of_each),
    ("packing", sequences),
]

#: The stages learn models and pack by a linear program, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are the next one's documents."""
    folder = scratch(prepared(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        unsend()  # models and lookups of this stage
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
