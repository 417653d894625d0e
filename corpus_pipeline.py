"""The corpus pipeline: quality, near-duplicates, contamination, personal data, packing.

``run`` applies ``STAGES`` to the documents of a folder; every stage is written as Parquet and read again. All but the
last return the columns of their input. Rows are told apart by a hash of id and text, so null ids and repeated rows pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytofleet.llm import decontam, packing, pii, quality_lr, simhash
from cytofleet.llm.common import in_split, table, unstage
from cytofleet.session import ensure_checkpoint_dir

QUALITY = 0.3


def row_key(docs: DataFrame) -> Column:
    """A 96-bit hash of id and text, as text."""
    parts = [F.col("doc_id"), F.col("text")]
    return F.concat_ws(":", F.hex(F.xxhash64(*parts)), F.hex(F.hash(*parts)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose quality probability is below ``QUALITY``; learnt from the labels outside the held-out fifth."""
    model = quality_lr.train(docs, table(spark, sf_dir, "labels").filter(~in_split("doc_id", 5, 0)))
    scored = quality_lr.score(docs, model, tuple(docs.columns), "_quality")
    return scored.filter(F.col("_quality") >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (fingerprints within two bits, or five-word Jaccard 0.8), the document with the smallest id stays; repeated rows leave one."""
    keyed = docs.withColumn("_key", row_key(docs))
    seen = simhash.groups(keyed, ("_key", "doc_id"))
    # ids sort before null, and one key stands for all rows with that id and text
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_key").alias("k")))
    # a group without any id has no component name, but a root
    winners = seen.groupBy("root").agg(first.alias("w")).select(F.col("w.k").alias("_key")).distinct()
    kept = keyed.join(winners, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a test item go."""
    keyed = docs.withColumn("_key", row_key(docs))
    found = decontam.leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; n_chars follows."""
    found = pii.find(docs, tuple(docs.columns)).withColumn("_spans", F.concat("base", "found"))
    out = pii.mask(found, "_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: bucket, batch and place."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Learnt weights, alignments and induced patterns are beyond SQL; the tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            unstage(before)
        before = docs = spark.read.parquet(path)
        docs._staged = path
    return docs
