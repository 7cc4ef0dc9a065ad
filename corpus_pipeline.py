"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. So when a
stage starts, nothing will read the scratch tables of the stage before any more, and they are deleted. Each thread that
runs stages owns those of its own stages alone: other runs and other jobs of the process keep theirs.

Defined cases, of every stage: nulls in any column, empty and very long texts, ties and repeated rows are decided as the
stage's operator states, and all columns of the documents, also additional ones with any name, stay as they are but for
the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.lineage import Scratch, shared
from millrace.llm import decontaminate, mixing, probminhash, quality, token_store
from millrace.llm._common import table

#: Scratch of the stage that this thread ran last.
_BEFORE: ContextVar[Scratch | None] = ContextVar("stage", default=None)


def _stage(spark: SparkSession, job: Callable[[], DataFrame], first: bool = False) -> DataFrame:
    """Runs a stage in a scope of its own; the scope before it ends, unless this is a run's first stage."""
    before = _BEFORE.get()
    if before is not None and not first:
        before.delete()
    scope = Scratch(spark)
    _BEFORE.set(scope)
    with scope:
        return job()


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior, shrunk over source and language, reaches one half."""
    return _stage(spark, lambda: quality.keep_good(docs, table(spark, sf_dir, "labels")), first=True)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return _stage(spark, lambda: probminhash.deduplicate(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return _stage(spark, lambda: decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to source, language and topic targets."""
    return _stage(spark, lambda: mixing.sample_mixture(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the Parquet store; a row per document read back from it."""
    return _stage(spark, lambda: token_store.encode_documents(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: Fitted models, signatures and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's table goes when the stage after it has been written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with Scratch(spark) as own:
                path = shared(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            if read is not None:
                read.delete()
            read = own
    return docs
