"""Documents arriving as files: decode, detect, convert to markdown, chunk that or plain text, set rejects aside.

Every micro-batch runs the batch plan. Its scratch tables are its own and go with it; its results overwrite folders of its own,
so a replay after a failure repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.lineage import Scratch
from millrace.operators.chunking import CARRIED, chunk_documents
from millrace.operators.convert import convert_to_markdown
from millrace.operators.detect import decode_base64_payload, decode_text

#: Files of a micro-batch.
FILES = 64
#: What Spark tells of a file.
FILE = "path string, modificationTime timestamp, length long, content binary"


def _batch(out: str, texts: Callable[[DataFrame], DataFrame], chunking: dict) -> Callable[[DataFrame, int], None]:
    def run(df: DataFrame, batch_id: int) -> None:
        put = lambda table, name: table.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        with Scratch(df.sparkSession) as own:
            try:
                rows = texts(df)
                markdown, rejects = convert_to_markdown(rows)
                put(rejects.drop("kind"), "rejects")
                kinds = markdown.select("doc_id", "kind").unionByName(rejects.filter("status <> 400").select("doc_id", "kind"))
                put(kinds.select("doc_id", F.coalesce("kind", F.lit("none")).alias("kind")), "kinds")
                carried = [c for c in CARRIED if c in rows.columns]
                plain = rows.join(rejects.filter("status = 415").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
                bodies = markdown.select("doc_id", F.col("markdown").alias("text")).unionByName(plain)
                bodies = bodies.join(rows.select("doc_id", *carried).dropDuplicates(["doc_id"]), "doc_id") if carried else bodies
                put(chunk_documents(bodies, **chunking), "chunks")
            finally:
                own.delete()

    return run


def _run(stream: DataFrame, out: str, texts: Callable[[DataFrame], DataFrame], chunking: dict) -> str:
    query = stream.writeStream.foreachBatch(_batch(out, texts, chunking)).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def stream_convert_and_chunk(spark: SparkSession, source: str, schema: str, out: str, **chunking) -> str:
    """Runs all files that are there through the batch plan, one micro-batch after another: Parquet with ``doc_id, text``.

    ``out/chunks`` has the chunks of converted markdown, and of texts of no kind as they are; ``out/kinds`` every text's
    kind; ``out/rejects`` what had a bad payload (400), what no kind fits (415) or what could not be converted (422, 500;
    not chunked).
    """
    texts = lambda df: df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return _run(spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(source), out, texts, chunking)


def stream_payloads(spark: SparkSession, source: str, out: str, **chunking) -> str:
    """The same of JSON lines ``filename, content_base64``: each payload is a document, its file name its id and source."""

    def texts(df: DataFrame) -> DataFrame:
        rows = decode_text(decode_base64_payload(df))
        return rows.select(F.col("filename").alias("doc_id"), "text", "error", F.col("filename").alias("source_file"))

    return _run(spark.readStream.schema("filename string, content_base64 string").option("maxFilesPerTrigger", FILES).json(source), out, texts, chunking)


def stream_raw_files(spark: SparkSession, source: str, out: str, glob: str = "*", **chunking) -> str:
    """The same of any files below a folder, read as bytes: the whole path is a document's id and source."""

    def texts(df: DataFrame) -> DataFrame:
        return decode_text(df).select(F.col("path").alias("doc_id"), "text", F.col("path").alias("source_file"))

    stream = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source)
    return _run(stream, out, texts, chunking)
