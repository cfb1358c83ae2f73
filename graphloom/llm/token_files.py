"""Token ids in ORC files, in ascending order of doc_id.

Each file holds a range of doc_ids; its stripes hold whole documents with their
ids as integer run-length encoded lists, a row index every few thousand rows and
Bloom filters on doc_id.  Stripes are read in parallel: every row carries the
number of its file and its start within that file, so a global start needs the
total of each file only.

``write`` shuffles the texts once by ranges of doc_id and encodes after that;
``read`` shuffles nothing but one total for each file.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .pretokens import byte_alphabet, pretokenizer
from .wordtable import WordTable, lists_of, slices
from .workspace import small_batches

END_ID = 1
MOST_BROADCAST = 500_000  # files whose totals are broadcast


class LibraryEncoder:
    """The tokenizers library over whole texts, each distinct pre-token encoded once.

    The library's model encodes pre-tokens, in its byte-level letters, apart
    from each other; so a text's ids are those of its pre-tokens in order.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = Tokenizer.from_str(json.dumps(spec)).model
        self.letters = byte_alphabet()
        self.table = WordTable(pretokenizer(path), self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters, tokenize = self.letters, self.model.tokenize
        ids, sizes = [], []
        for word in words:
            made = tokenize(word if word.isascii() and word.isprintable() else "".join([letters[b] for b in word.encode()]))
            sizes.append(len(made))
            ids.extend([t.id for t in made])
        return np.array(ids, np.int64), np.array(sizes, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _ended(flat: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with the end id after each text."""
    return np.insert(flat, np.cumsum(sizes), end_id)


def write(docs: DataFrame, out: str, path: str, files: int | None = None, text: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of every whole text, each with the end id after it, in ascending order of doc_id.

    Null and empty texts have the end id alone; a null doc_id comes first;
    repeated doc_ids stand side by side in no fixed order; very long texts are
    taken whole; an empty table gives files without rows.  Columns: doc_id, file int, file_start long, ids.
    """
    def run(batches):
        words, part, start = encoder(path).table, TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                flat, sizes = words.ids_of(texts)
                ends = np.concatenate([[0], np.cumsum(sizes + 1)])
                columns = [batch.column(0).slice(at, len(texts)), pa.array(np.full(len(texts), part, np.int32)), pa.array(start + ends[:-1], pa.int64()), lists_of(_ended(flat, sizes, end_id), sizes + 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "file_start", "ids"])
                start += int(ends[-1])

    by = docs.select("doc_id", F.col(text).alias("text"))
    by = by.repartitionByRange(files, "doc_id") if files else by.repartitionByRange("doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = by.sortWithinPartitions("doc_id").transform(small_batches).mapInArrow(run, f"doc_id {kind}, file int, file_start long, ids array<int>")
    ids.write.options(**{"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "5000", "orc.stripe.size": str(64 << 20), "orc.create.index": "true"}).orc(out)


def read(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    With doc_ids, only stripes and row groups whose statistics and Bloom
    filters allow them are read; starts stay global.  Files without rows give
    none; repeated doc_ids and a null one are returned as they were written.
    """
    rows = spark.read.orc(out)
    totals = rows.groupBy("file").agg(F.max(F.col("file_start") + F.size("ids")).alias("total"))
    bases = totals.select("file", (F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    # a row for each file; the ids themselves are not to be moved
    few = len(rows.inputFiles()) <= MOST_BROADCAST
    return rows.join(F.broadcast(bases) if few else bases, "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """Put ids_crc32, of the ids as little-endian unsigned 32-bit integers, in place of ids."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + [sums], names=[*batch.schema.names[:-1], "ids_crc32"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.select(*[c for c in rows.columns if c != "ids"], "ids").transform(small_batches).mapInArrow(run, f"{kinds}, ids_crc32 long")
