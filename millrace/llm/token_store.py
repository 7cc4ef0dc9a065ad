"""Token store: documents as Parquet list columns of token ids, in ascending doc_id order.

Layout: one directory with a Parquet file per doc_id range, columns ``part``, ``doc_id``, ``n_tokens`` and
``tokens`` (list of int32, dictionary-encoded; the other columns fall to delta encoding under the version 2
writer). Row groups and pages are kept small by parameter, and rows ascend by doc_id, so the page index lets a
reader fetch a doc_id range or metadata alone without touching other token pages.

Ids come from the ``tokenizers`` library on whole texts. Where a tokenizer drops white space between its pieces (this
is read from its own description), texts are cut at spaces, line feeds and between a Latin word and the punctuation
that closes it, and distinct pieces are remembered up to a bound: the ids are those of the whole text (the tests compare
them). Any other tokenizer gets whole texts. A worker keeps its encoder until a task of another operator comes.

Defined cases: null and empty texts give the end id alone; repeated doc_ids keep one entry per row, ordered by
text; null doc_ids come first; an empty table gives an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import byte_slices, scratch, table, worker_memory

END_ID = 1
#: The public file that workers look up where no path is given.
TOKENIZER = "word_bpe_49k.json"
#: Pieces that a worker remembers, as Arrow text; beyond it the memory starts anew.
CACHE_PIECES = 160_000
#: Pieces encoded at once, to bound the Python objects and what the library holds.
LEARN_AT_ONCE = 2_000
#: Text bytes taken from a batch at once.
SLICE_BYTES = 1 << 20
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_LOWER_ACCENTED = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PLAIN = re.compile(f"[a-z{_LOWER_ACCENTED}]+")
#: Latin letters and the ASCII punctuation between them and white space, where the pre-tokenizer splits.
_WORD_END = rf"([{_LETTERS}])([!-/:-@\[-`{{-~]+) "
SCHEMA = "doc_id long, n_tokens long, tokens array<int>"


def splits_at_spaces(tokenizer: Any) -> bool:
    """Whether a tokenizer drops white space between pieces, so that text may be cut there before encoding.

    True for one that folds white space, lower-cases, and keeps the matches of a pattern in which white space occurs
    only as what is left out.
    """
    spec = json.loads(tokenizer.to_str())
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    folds = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in steps)
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    first, rest = splits[0], splits[1:]
    removes = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and re.sub(r"\[\^\\s", "", first["pattern"].get("Regex", r"\s")).find(r"\s") < 0
    plain = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in rest)
    lowers = any(n["type"] == "Lowercase" for n in steps)
    ends = spec["model"].get("end_of_word_suffix") == "</w>"
    return bool(folds and lowers and removes and plain and ends and spec["post_processor"] is None)


class PieceEncoder:
    """Texts to id arrays, with a bounded memory of pieces; whole texts where a tokenizer can't be cut at spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = splits_at_spaces(self.tokenizer)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _LOWER_ACCENTED}
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, fresh: pa.Array) -> None:
        """Remembers the ids of new pieces, a bounded number at once; the model alone is enough for plain lower-case words."""
        model, lens, flat = self.tokenizer.model.tokenize, [self.lens], [self.flat]
        for at in range(0, len(fresh), LEARN_AT_ONCE):
            pieces = fresh.slice(at, LEARN_AT_ONCE).to_pylist()
            got = [[t.id for t in model(p if p.isascii() else p.translate(self.as_bytes))] if _PLAIN.fullmatch(p) else None for p in pieces]
            rest = [i for i, ids in enumerate(got) if ids is None]
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
                got[i] = e.ids
            lens.append(np.fromiter(map(len, got), np.int32, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), np.int32, int(lens[-1].sum())))
        self.known = pa.concat_arrays([self.known, fresh])
        self.lens, self.flat = np.concatenate(lens), np.concatenate(flat)
        self.starts = np.cumsum(self.lens, dtype=np.int64) - self.lens

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the remembered pieces of all texts, and how many each text has."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()  # special tokens must stay as they are
        texts = pc.replace_substring(texts, "\n", " ")
        if not special:
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), _WORD_END, r"\1 \2 ")
        split = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.string())
        places = pc.index_in(distinct, value_set=self.known)
        if len(self.known) + places.null_count > CACHE_PIECES and len(self.known):
            self._reset()
            places = pc.index_in(distinct, value_set=self.known)
        new = pc.is_null(places)
        places = pc.fill_null(places, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        places[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(pc.sum(new).as_py() or 0)
        self._learn(distinct.filter(new))
        return places[coded.indices.to_numpy(zero_copy_only=False)], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by the end id; and the offsets of the texts."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            got = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], np.int32), np.cumsum([0, *map(len, got)])
        idx, counts = self._pieces(texts)
        lens = self.lens[idx]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        running = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        per_text = running[bounds[1:]] - running[bounds[:-1]] + 1
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        out = np.full(int(offsets[-1]), END_ID, np.int32)
        total = int(lens.sum())
        # all places but the texts' last ones take the pieces' ids in order
        inner = np.ones(len(out), bool)
        inner[offsets[1:] - 1] = False
        step = np.arange(total) - np.repeat(running[:-1] - self.starts[idx], lens)
        out[inner] = self.flat[step]
        return out, offsets


def _encode_batches(path: str | None, name: str, size: int = SLICE_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or worker_memory(("encoder", path, name), lambda: PieceEncoder(path or tokenizer_file(name)))
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in byte_slices(texts, size):
                flat, offsets = encoder.encode(texts.slice(lo, hi - lo))
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(offsets)), tokens], ["doc_id", "n_tokens", "tokens"])

    return run


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str | None = None,
    doc_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 128 << 10,
) -> str:
    """Encode all texts into a store at ``path``. Without a tokenizer's path each worker looks up its own public copy."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # text and row number split the rows of one id, and even repeated rows, over several ranges
    keys = [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.col("_row")]
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions("doc_id", "text").drop("_row")
    coded = rows.mapInArrow(_encode_batches(tokenizer_path, TOKENIZER), SCHEMA)
    (
        coded.withColumn("part", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id())
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before, to rows (part, seq, n_tokens, ...) of the store at ``path``.

    Sums of whole parts come first, from the counts' column alone; each part is then summed in its own order.
    """
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.select(F.col("part").alias("_p"), (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return rows.withColumn("_in", inner).join(F.broadcast(before), F.col("part") == F.col("_p")).withColumn("start", F.col("_before") + F.col("_in")).drop("_in", "_before", "_p")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, seq`` without reading token pages; start counts the ids of all documents before."""
    return with_starts(spark, path, spark.read.parquet(path).select("part", "seq", "doc_id", "n_tokens")).select("doc_id", "start", "n_tokens", "seq")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``doc_id, seq, tokens`` of a doc_id range; the filter reaches row groups and pages."""
    df = spark.read.parquet(path)
    df = df if low is None else df.filter(F.col("doc_id") >= low)
    df = df if high is None else df.filter(F.col("doc_id") <= high)
    return df.select("doc_id", "seq", "tokens")


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seq", "doc_id", "n_tokens"]
    for b in batches:
        lists = b.column("tokens")
        offsets, flat = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32, all from one pass over its files."""
    rows = spark.read.parquet(path).select("part", "seq", "doc_id", "n_tokens", "tokens")
    rows = rows.mapInArrow(_crc_batches, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    return with_starts(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return digests(spark, write_store(docs, scratch(spark, "tokens"), tokenizer_path))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
