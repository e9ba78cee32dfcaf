"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, secrets are blotted out, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. `run`
writes every stage's rows to the shared folder and reads them back for the next one.

A null doc_id is an id of its own kind and takes part like any other. Near duplicates are told apart by row, not by id:
rows that repeat a doc_id, or have none, stay or go by their own texts, and one row of each class stays. Null texts count as empty and stay null until they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import decontamination, jaccard, packing, secrets, toxicity
from kerbline.llm.common import scratch, table


def _own(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among `docs`, does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _own(toxicity.score(docs, model).where("_kerbline_predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of documents connected by similarity 0.8 or more: that of the smallest doc_id, null last."""
    rows = jaccard.classes(docs).groupBy("class_node", "doc_id", "node").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "node", "times")).alias("first")
    kept = rows.groupBy("class_node").agg(first).select(
        F.col("first.doc_id").alias("_kerbline_kept"), F.col("first.node").alias("_kerbline_kept_node"), F.col("first.times").alias("_kerbline_times"))
    kept = scratch(kept, "kept")
    with_node = jaccard.with_nodes(docs, "_kerbline_node")
    marked = with_node.join(kept, with_node["doc_id"].eqNullSafe(kept["_kerbline_kept"]) & (with_node["_kerbline_node"] == kept["_kerbline_kept_node"]))
    # Rows of one id and one set of n-grams are copies, of which one stays.
    repeated = marked.where("_kerbline_times > 1").dropDuplicates(["doc_id", "_kerbline_node"])
    return _own(marked.where("_kerbline_times = 1").unionByName(repeated), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    return _own(decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a marker and n_chars counted again where the text changed."""
    found = secrets.find_spans(docs)
    out = secrets.redact(found.withColumn("_kerbline_changed", F.size("_kerbline_spans") > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_kerbline_changed"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _own(out, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", blot_secrets),
    ("packing", pack),
]

# Models, hashes and tokens are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
