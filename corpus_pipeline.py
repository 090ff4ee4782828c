"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, near_dedup, packing, suffix_dedup, toxicity
from spindrift.llm.common import released, stage_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score reaches the threshold go.  Null texts count as empty; each of repeated rows, of rows
    that share an id and of rows without one is scored by its own text."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs.select(*COLUMNS), model)
    return scored.where(F.col("toxicity_score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays, that of least id (null last).  Rows are told apart by a key of
    their own: a row goes only if its own text is another's near-duplicate, and of repeated rows one stays.  Null texts
    are no duplicates and stay."""
    rows = near_dedup.keyed_texts(docs, carry=("lang", "source", "n_chars"))
    gone = near_dedup.classes(rows).where(~F.col("kept")).select("row")
    return rows.join(gone, "row", "left_anti").withColumnRenamed("id", "doc_id").select(*COLUMNS)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of characters that a removal has cut in two go with it."""
    for batch in batches:
        text = pa.array([b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, batch.column("lang"), batch.column("source")], names=["doc_id", "text", "lang", "source"])


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes are cut out of the later texts; every row stays with its own columns, maybe with an
    empty text (null texts become empty).  Rows that share an id are cut by their own text alone."""
    cut = suffix_dedup.remove_repeats(docs, carry=("lang", "source")).select("doc_id", "kept", "lang", "source")
    cut = cut.mapInArrow(released(_decode), "doc_id long, text string, lang string, source string")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; null and empty texts hold none.  Each row goes by its own text."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 ids; each row is packed by itself, a null text as its end id."""
    return packing.packed_pieces(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
