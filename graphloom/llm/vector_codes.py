"""Vector codes: each part of a vector is replaced by its nearest codebook entry.

Components become integers, vectors are cut into equal parts, and each part
position has a codebook.  In each round the codebooks are broadcast as kd-trees
(parts * entries rows of a part's width, whatever the input), every task finds
the nearest entries by branch and bound and adds up integer sums, and Spark adds
the sums of all tasks: a round shuffles parts * entries rows a task at most, and
that many reach the driver.

Branch and bound goes on into boxes whose bound equals the best distance so far,
so of equally near entries the one with the lowest index is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import released
from .workspace import free_name, small_batches, store

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
MOST = 1 << 27  # integer components beyond are taken as this, so that squared distances fit 63 bits
LEAF = 8
ROWS_AT_ONCE = 4096
LABELS_BROADCAST = 1_000_000

_FAR = np.iinfo(np.int64).max


class KdTree:
    """Nearest entries of a codebook, exact, ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []  # least and greatest corner of a node's entries
        self.forks: list[tuple | None] = []  # axis, split, left node, right node
        self.members: list[np.ndarray] = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        own, node = self.entries[members], len(self.boxes)
        low, high = own.min(axis=0), own.max(axis=0)
        self.boxes.append((low, high))
        self.members.append(np.sort(members))
        self.forks.append(None)
        axis = int(np.argmax(high - low))
        if len(members) > LEAF and low[axis] < high[axis]:
            order = members[np.argsort(own[:, axis], kind="stable")]
            half = len(order) // 2
            self.forks[node] = (axis, self.entries[order[half], axis], self._grow(order[:half]), self._grow(order[half:]))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of every point."""
        best, where = np.full(len(points), _FAR), np.full(len(points), len(self.entries))

        def look(node: int, rows: np.ndarray) -> None:
            members = self.members[node]
            gap = points[rows][:, None, :] - self.entries[members][None, :, :]
            d = (gap * gap).sum(axis=2)
            j = d.argmin(axis=1)  # the first of equals, and members ascend
            d, at = d[np.arange(len(rows)), j], members[j]
            nearer = (d < best[rows]) | ((d == best[rows]) & (at < where[rows]))
            best[rows[nearer]], where[rows[nearer]] = d[nearer], at[nearer]

        todo = [(0, np.arange(len(points)))]
        while todo:  # the leaf that a point falls in gives a first distance
            node, rows = todo.pop()
            if self.forks[node] is None:
                look(node, rows)
                continue
            axis, split, left, right = self.forks[node]
            over = points[rows, axis] >= split
            todo += [(child, part) for child, part in ((left, rows[~over]), (right, rows[over])) if len(part)]
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            low, high = self.boxes[node]
            p = points[rows]
            out = np.maximum(np.maximum(low - p, p - high), 0)
            rows = rows[(out * out).sum(axis=1) <= best[rows]]
            if not len(rows):
                continue
            if self.forks[node] is None:
                look(node, rows)
            else:
                todo += [(child, rows) for child in self.forks[node][2:]]
        return where, best


@dataclass
class Codebooks:
    dims: int  # components of a vector, before it is filled up to equal parts
    books: list[np.ndarray]  # a table of integers, entry by component, for each part position

    def sha256(self) -> str:
        """Digest of all integer components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, dims: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the kept rows, their integer components, filled up with zeros to equal parts)."""
    lengths = np.asarray(column.value_lengths().fill_null(-1), np.int64)
    rows = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    kept = np.isfinite(values).all(axis=1)
    whole = np.floor(np.clip(values[kept] * SCALE, -MOST, MOST)).astype(np.int64)
    return rows[kept], np.pad(whole, ((0, 0), (0, -dims % parts)))


def _blocks(batch: pa.RecordBatch, vector: str, dims: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for i in range(0, batch.num_rows, ROWS_AT_ONCE):
        some = batch.slice(i, ROWS_AT_ONCE)
        rows, values = _matrix(some.column(some.schema.get_field_index(vector)), dims, parts)
        if len(rows):
            yield some.take(pa.array(rows)), values


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def first_entries(vectors: DataFrame, dims: int, parts: int, entries: int, vec_id: str, vector: str) -> np.ndarray:
    """Integer components of the kept rows with the smallest ids; equal ids by their components, null ids last."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))

    @released
    def run(batches):
        for batch in batches:
            for some, values in _blocks(batch, "v", dims, parts):
                flat = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))
                out = pa.RecordBatch.from_arrays([some.column(0), flat], names=["id", "v"])
                if out.num_rows > entries:  # all up to the id of the last place, so that equal ids are ordered by Spark
                    last = out.column(0)[pc.sort_indices(out.column(0))[entries - 1].as_py()]  # nulls last
                    out = out.filter(pc.less_equal(out.column(0), last).fill_null(False)) if last.is_valid else out
                yield out

    least = small_batches(rows).mapInArrow(run, f"id {_kind(vectors, vec_id)}, v array<bigint>").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.array([r[0] for r in least], np.int64).reshape(len(least), dims + -dims % parts)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks by ``rounds`` of assignment and integer means.

    Kept are vectors of the most frequent length (of several the shortest) whose
    components are all finite; a length that parts don't divide is filled up with
    zeros.  Components beyond MOST / SCALE count as that.  Each codebook starts
    as the parts of the ``entries`` smallest kept ids, so with fewer rows it has
    fewer entries; without rows, none.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index of two hex digits allows 1 to 256 entries")
    common = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return Codebooks(0, [np.empty((0, 0), np.int64)] * parts)
    dims = common[0]
    start = first_entries(vectors, dims, parts, entries, vec_id, vector)
    width = start.shape[1] // parts
    books = [start[:, i * width : (i + 1) * width] for i in range(parts)]
    sums = [f"s{i}" for i in range(width)]
    for _ in range(rounds if len(start) else 0):
        trees = vectors.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])

        @released
        def run(batches, trees=trees):
            total = np.zeros((parts, len(start), width + 1), np.int64)
            for batch in batches:
                for _, values in _blocks(batch, vector, dims, parts):
                    for i, tree in enumerate(trees.value):
                        own = values[:, i * width : (i + 1) * width]
                        where, _ = tree.nearest(own)
                        np.add.at(total[i], where, np.concatenate([own, np.ones((len(own), 1), np.int64)], axis=1))
            i, j = np.nonzero(total[:, :, -1])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(total[i, j, c]) for c in range(width + 1))], names=["part", "entry", *sums, "n"])

        kinds = ", ".join(["part int", "entry int", *(f"{s} bigint" for s in sums), "n bigint"])
        found = small_batches(vectors.select(vector)).mapInArrow(run, kinds).groupBy("part", "entry").agg(*(F.sum(s).alias(s) for s in sums), F.sum("n").alias("n")).collect()
        books = [b.copy() for b in books]
        for part, entry, *rest in found:
            books[part][entry] = [s // rest[-1] for s in rest[:-1]]
        trees.destroy()
    return Codebooks(dims, books)


def encode(vectors: DataFrame, codebooks: Codebooks, vector: str = "embedding") -> DataFrame:
    """The kept rows without their vector, with code (two hex digits a part) and error (squared distances over the parts).

    Rows are coded one by one, repeated ones alike; rows whose vector is null, of
    another length than the codebooks' or not finite are dropped; columns code
    and error are replaced, all others stay.
    """
    rest = vectors.drop("code", "error") if vector not in ("code", "error") else vectors
    names = [c for c in rest.columns if c != vector]
    kinds = ", ".join([*(f"`{c}` {_kind(rest, c)}" for c in names), "code string", "error bigint"])
    parts = len(codebooks.books)
    trees = vectors.sparkSession.sparkContext.broadcast([KdTree(b) for b in codebooks.books])
    dims, none = codebooks.dims, not len(codebooks.books[0])

    @released
    def run(batches):
        for batch in () if none else batches:
            for some, values in _blocks(batch, vector, dims, parts):
                width = values.shape[1] // parts
                codes, error = np.empty((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
                for i, tree in enumerate(trees.value):
                    codes[:, i], d = tree.nearest(values[:, i * width : (i + 1) * width])
                    error += d
                digits = codes.tobytes().hex()
                code = pa.array([digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), code, pa.array(error)], names=[*names, "code", "error"])

    return small_batches(rest).mapInArrow(run, kinds)


def with_label_error(encoded: DataFrame, label: str = "label") -> DataFrame:
    """The coded rows with label_error: the error summed over all rows of a label, null labels together.

    A sum beyond 63 bits is null.  The sums are broadcast up to LABELS_BROADCAST
    labels; beyond that they are joined by key, and Spark splits a label that is hot.
    """
    rows = store(encoded.drop("label_error"), "codes")
    key = free_name(rows, "_label")
    sums = store(rows.groupBy(F.col(label).alias(key)).agg(F.try_sum("error").alias("label_error")), "errors")
    if sums.count() <= LABELS_BROADCAST:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(label).eqNullSafe(F.col(key))).drop(key)
