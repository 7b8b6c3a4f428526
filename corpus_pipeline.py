"""The corpus pipeline: filter, deduplicate, decontaminate and tokenise documents.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet in the shared folder
and reads again as the next stage's documents.  All stages but the last return
the columns of ``documents``.

1. quality: documents that the classifier rejects (junk or toxic) go.
2. near_duplicates: five-word shingles, resemblance 0.8; the document of the
   least id of each component stays.
3. substrings: words covered by repeated 35-word windows are cut out of the
   texts; all documents stay.
4. decontamination: contaminated documents go, other hit words are cut out.
5. tokens: ids of every text and the text decoded from them.

No SQL form exists: the first stage trains a model.  ``tests/llm`` holds each
later stage against a brute-force version, and ``run`` against its stages.

Null and empty texts pass every stage as they are (null becomes empty where
substrings are cut) and have no tokens; texts of any length are whole rows.  Of
rows that repeat an id, all stay or go together in the second stage, and the
others judge each row.  A null id is kept by the second stage.  Columns of
documents besides ``doc_id`` and ``text`` travel in one struct, so they may be
called anything.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.llm import decontam, neardup, piece_bpe, quality, substring
from trialforge.llm.shared import written

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.classify(_bundled(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("text", "rest"))
    return _apart(judged.where("kept"), docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.dedup(_bundled(docs), keep_space=True, carry=("rest",))
    return _resized(_apart(out.withColumnRenamed("kept", "text"), docs), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="both"), docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = piece_bpe.encode(docs.select("doc_id", "text"), "text", "ids", "decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def _bundled(docs: DataFrame) -> DataFrame:
    """Id and text, and the other columns as one struct."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(None).cast("int").alias("_")).alias("rest"))


def _apart(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents again."""
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def _resized(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("substrings", substrings_stage), ("decontamination", decontamination_stage), ("tokens", tokens_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
