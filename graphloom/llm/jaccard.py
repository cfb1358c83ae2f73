"""N-gram Jaccard join by a token-group matrix, exact, with its components.

Documents are sets of distinct shingles of five lower-cased words.  Shingles
have one order for all documents: first those that a count sketch of all
documents doesn't show to be hot, and of these the ones with the rarest words.
Two sets of at least 80 per cent similarity share a shingle among the first
n - ceil(0.8 n) + 1 of the larger and the first m - ceil(1.6 m / 1.8) + 1 of the
smaller; so only prefixes are joined.

1. Each map task puts documents with at least NEAR per cent in common into one
   group, whose rows are the union of its members' prefixes.  A group of copies
   that holds a third of all rows thus reaches the shuffle once for each task.
2. In each shingle's list, every group is compared with the most typical one of
   fitting size (a star, not all pairs): first with the centre that most of its
   lists have, then with those that aren't of its component by then; verified
   links join groups, and those within NEAR of a centre make its wider group.
3. The token-group matrix holds, for each shingle, the wider groups with it in
   their union.  In ROUNDS further stars, with centres in several orders, one
   group of each component in a list is compared with the list's centre; this
   leaves few components for the exact step.  What two groups share bounds the overlap of any two members;
   the distance of their centres less both radii bounds the distance of any two
   members (Jaccard distance is a metric).  Only groups that pass both bounds,
   and aren't linked yet, are opened, and their members compared by the same
   bounds.

Distances are first bounded from below by parity bitmaps (the bits in which two
of them differ are at most the shingles in which the sets differ); only pairs
that pass are verified, on whole texts.  Sets are taken for equal if their sizes
and 128-bit fingerprints are, and shingles if their 64-bit fingerprints are.

Counts cover all documents and no list is cut.  Shuffled are the prefixes (a
fifth of the shingles), bitmaps of candidates, and texts of verified pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .bitset import thin
from .components import components
from .workspace import drop, small_batches, store

PERCENT = 80  # smallest similarity of a link
NEAR = 90  # smallest similarity to the centre of a group
SKETCH_BITS = 20  # counters of shingles, and of words
CHUNK = 1024  # counters in a row of a sketch
HOT = 1.6  # times the mean counter
HELD = 1_000_000  # shingles of group centres that a task remembers
BITMAP = 2  # bits of a bitmap for each shingle, rounded up to a power of two
MOST_BITMAP = 1 << 16
MINI = 512  # bits of the bitmap that stands in the matrix
ROUNDS = 3  # of stars between components
ORDERS = 8  # of centres in a round, by shingle
SLACK = 1e-9


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set similar to it."""
    return -(-percent * n // 100)


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in the prefix of a set, as the larger of a pair."""
    return np.where(n > 0, n - needed(n, percent) + 1, 0)


def short_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in the prefix of a set, as the smaller of a pair."""
    return np.where(n > 0, n - -(-2 * percent * n // (100 + percent)) + 1, 0)


def _sketch(docs: DataFrame) -> np.ndarray:
    """Rarity classes of 2**SKETCH_BITS counters of words, and after them whether counters of distinct shingles a document are hot."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(2 * size, np.uint8)  # of a task; full counters stay full
        for batch in batches:
            for _, _, block in tk.blocks(batch.column(0)):
                for at, h in ((0, block.words), (size, block.shingle_sets()[0])):
                    slot, n = np.unique((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + at, return_counts=True)
                    total[slot] = np.minimum(total[slot] + n, 255)
        full = total.reshape(-1, CHUNK)
        some = np.flatnonzero(full.any(axis=1))
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([full[i].tobytes() for i in part], pa.binary())], names=["chunk", "counts"])

    def add(key, rows):
        total = np.zeros(CHUNK, np.uint32)
        for raw in rows.column("counts").to_pylist():
            total += np.frombuffer(raw, np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").transform(small_batches).mapInArrow(tk.released(count), "chunk long, counts binary")
    out = np.zeros(2 * size, np.uint32)
    for chunk, raw in parts.groupBy("chunk").applyInArrow(add, "chunk long, total binary").collect():  # 8 MB, a parameter
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(raw, np.uint32)
    rare = np.round(4 * np.log2(np.maximum(out[:size], 1))).astype(np.uint8)
    counts = out[size:].astype(float)
    hot = np.where(counts > HOT * max(counts.mean(), 4), np.ceil(np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)
    return np.concatenate([rare, hot])


def _ranked(block: tk.TextBlock, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text, ascending by text and fingerprint, the text of each, and its place in the order of all documents."""
    shift = np.uint64(64 - SKETCH_BITS)
    h, at = block.shingles()
    text = block.word_text[at]
    rare = classes[(block.words >> shift).astype(np.int64)].astype(np.int64)
    rank = sum(rare[at + i] for i in range(tk.SHINGLE)) if len(at) else np.empty(0, np.int64)
    few = block.n_words < tk.SHINGLE
    if (few & (block.n_words > 0)).any():
        every, owner = block.all_shingles()
        less = few[owner]
        h, text, rank = np.concatenate([h, every[less]]), np.concatenate([text, owner[less]]), np.concatenate([rank, np.zeros(int(less.sum()), np.int64)])
    rank = rank + classes[(1 << SKETCH_BITS) + (h >> shift).astype(np.int64)].astype(np.int64) * 4096
    order = np.lexsort((h, text))
    h, text, rank = h[order], text[order], rank[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new], rank[new]


def _bitmaps(h: np.ndarray, text: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity of the shingles in each slot, for every text."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(BITMAP * n, 1))).astype(np.int64), 64, MOST_BITMAP)
    ends = np.concatenate([[0], np.cumsum(bits)])
    slot = ends[text] + ((h >> np.uint64(8)) & (bits[text] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(slot, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])


def _minis(h: np.ndarray, text: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity of the shingles in each of 512 slots, for every text, as eight whole numbers."""
    slot = text.astype(np.int64) * MINI + ((h >> np.uint64(8)) & np.uint64(MINI - 1)).astype(np.int64)
    packed = np.packbits((np.bincount(slot, minlength=MINI * len(n)) & 1).astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (MINI // 64), pa.int32()), pa.array(packed))


class _Groups:
    """Groups of near copies that a task has met."""

    def __init__(self):
        self.by: tuple[dict, dict] = ({}, {})
        self.held = 0

    def centre(self, keys: tuple, print_: tuple, shingles: np.ndarray):
        """(centre, distance) of a group that a set belongs to, or None."""
        for key, known in zip(keys, self.by):
            found = known.get(key)
            if found is None:
                continue
            if found[1] == print_:
                return found, 0.0
            n, m = len(shingles), len(found[2])
            if 100 * min(n, m) < NEAR * max(n, m):
                continue
            at = np.minimum(np.searchsorted(found[2], shingles), m - 1)
            both = int((found[2][at] == shingles).sum())
            if 100 * both >= NEAR * (n + m - both):
                return found, 1 - both / (n + m - both)
        return None

    def add(self, keys: tuple, record: tuple) -> None:
        if self.held > HELD:
            self.by, self.held = ({}, {}), 0
        self.held += len(record[2])
        for key, known in zip(keys, self.by):
            known.setdefault(key, record)


def _prefixes(docs: DataFrame, classes, percent: int) -> DataFrame:
    """Every row's set: doc_id, n, fingerprints, bitmap, centre of its group and distance to it, and the rows that it adds to the group's union (the first n_short also as the smaller set of a pair).

    A row without doc_id is in no group and adds nothing.
    """

    def run(batches):
        sketch, groups = classes.value, _Groups()
        for batch in batches:
            for i, j, block in tk.blocks(batch.column(1)):
                ids = batch.column(0).slice(i, j - i)
                h, text, rank = _ranked(block, sketch)
                n = np.bincount(text, minlength=block.n)
                first = np.concatenate([[0], np.cumsum(n)])
                a, b = np.zeros(block.n, np.uint64), np.zeros(block.n, np.uint64)
                again = tk.mix(h ^ np.uint64(0x5851F42D4C957F2D))
                np.add.at(a, text, h)
                np.add.at(b, text, again)
                other = np.zeros(block.n, np.uint64)
                if len(h):
                    other[n > 0] = np.minimum.reduceat(again, first[:-1][n > 0])
                order = np.lexsort((h, rank, text))
                long, short = prefix_sizes(n, percent), short_sizes(n, percent)
                centre, gap, n_centre, typical, n_short, rows = [], [], [], [], [], []
                for k, (doc, print_) in enumerate(zip(ids.to_pylist(), zip(a.tolist(), b.tolist(), n.tolist()))):
                    if doc is None or not n[k]:
                        record, distance, few, many = (None, None, (), None, None, 0), None, h[:0], h[:0]
                    else:
                        own = h[first[k] : first[k + 1]]
                        keys = (int(own[0]), int(other[k]))
                        found = groups.centre(keys, print_, own)
                        at = order[first[k] : first[k] + long[k]]
                        few, many = h[at[: short[k]]], h[at[short[k] :]]
                        if found is None:
                            record, distance = (doc, print_, own.copy(), few, h[at], int(1000 * (rank[at] % 4096).mean())), 0.0
                            groups.add(keys, record)
                        else:
                            record, distance = found
                            few = few[~np.isin(few, record[3])] if distance else h[:0]
                            many = many[~np.isin(many, record[4])] if distance else h[:0]
                    centre.append(record[0])
                    n_centre.append(None if record[0] is None else len(record[2]))
                    typical.append(record[5])
                    gap.append(distance)
                    n_short.append(len(few))
                    rows.append(np.concatenate([few, many]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]), pa.int32()), pa.array(np.concatenate(rows).view(np.int64)))
                columns = [ids, pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _bitmaps(h, text, n), _minis(h, text, n), pa.array(centre, pa.int64()), pa.array(gap, pa.float64()), pa.array(n_centre, pa.int64()), pa.array(typical, pa.int32()), pa.array(n_short, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fp_a", "fp_b", "bitmap", "mini", "centre", "gap", "n_centre", "typical", "n_short", "rows"])

    return docs.select("doc_id", "text").transform(small_batches).mapInArrow(tk.released(run), "doc_id long, n long, fp_a long, fp_b long, bitmap binary, mini array<long>, centre long, gap double, n_centre long, typical int, n_short int, rows array<long>")


def _lists(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, node, short) of each shingle with two groups or more, each with the list's most typical one of fitting size."""

    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        token, node, n, typical, short = (table.column(c).to_numpy() for c in ("token", "node", "n", "typical", "short"))
        order = np.lexsort((~short, node, token))
        token, node, n, typical, short = token[order], node[order], n[order], typical[order], short[order]
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, typical, short = token[once], node[once], n[once], typical[once], short[once]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        token, node, n, typical, short, group = token[many], node[many], n[many], typical[many], short[many], group[many]
        if not len(token):
            return
        star = np.full(len(token), -1, np.int64)
        left = np.lexsort((node, -typical, group))
        while len(left):  # one star of each list at a time, until every row has had its turn
            g = group[left]
            head = np.ones(len(left), bool)
            head[1:] = g[1:] != g[:-1]
            heads = left[np.flatnonzero(head)[np.cumsum(head) - 1]]
            fits = 100 * np.minimum(n[left], n[heads]) >= percent * np.maximum(n[left], n[heads])
            star[left[fits]] = node[heads[fits]]
            left = left[~fits]
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(short), pa.array(star)], names=["token", "node", "short", "star"])

    return rows.repartition("token").transform(small_batches).mapInArrow(tk.released(run), "token long, node long, short boolean, star long")


def _bounded(pairs: DataFrame, sets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The pairs with ``low``, a lower bound on the distance of a and b from their bitmaps: -1 where the sets are equal.

    A doc_id with several sets makes several rows of a pair.
    """
    names, kinds = pairs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            low = np.empty(batch.num_rows)
            sides = [[columns[f"{c}_{s}"].to_pylist() for c in ("n", "fp_a", "fp_b", "bitmap")] for s in "xy"]
            for k, (n, p, q, x, m, r, s, y) in enumerate(zip(*sides[0], *sides[1])):
                if (n, p, q) == (m, r, s):
                    low[k] = -1
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                apart = max(int(np.bitwise_count(x ^ y).sum()), abs(n - m))
                low[k] = 2 * apart / (n + m + apart)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names] + [pa.array(low)], names=[*names, "low"])

    known = sets if ids is None else thin(sets, ids)
    side = lambda key, s: known.select(F.col("doc_id").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "fp_a", "fp_b", "bitmap")])
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.transform(small_batches).mapInArrow(run, f"{kinds}, low double")


def verify(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of doc_ids whose whole texts have the similarity asked for, with their distance."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(batch.schema.get_field_index("text_a")), batch.column(batch.schema.get_field_index("text_b"))
            at = 0
            while at < batch.num_rows:
                stop, size = at, 0
                while stop < batch.num_rows and (stop == at or size < tk.BLOCK_BYTES):
                    size += len(a[stop].as_buffer() or b"") + len(b[stop].as_buffer() or b"")
                    stop += 1
                yield _similar(batch.slice(at, stop - at), a.slice(at, stop - at), b.slice(at, stop - at), percent)
                at = stop

    texts = thin(docs.select("doc_id", "text").where("doc_id is not null"), pairs.select("a").union(pairs.select("b")).distinct())
    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return whole.select("a", "b", "text_a", "text_b").transform(small_batches).mapInArrow(tk.released(run), "a long, b long, distance double")


def _similar(rows, a, b, percent: int):
    sets = []
    for column in (a, b):
        h, t = [], []
        for i, _, block in tk.blocks(column, limit=1 << 62):
            x, y = block.shingle_sets()
            h.append(x)
            t.append(y + i)
        sets.append((np.concatenate(h), np.concatenate(t)))
    n_a, n_b = (np.bincount(t, minlength=rows.num_rows) for _, t in sets)
    h, t = np.concatenate([sets[0][0], sets[1][0]]), np.concatenate([sets[0][1], sets[1][1]])
    order = np.lexsort((h, t))
    both = (h[order][1:] == h[order][:-1]) & (t[order][1:] == t[order][:-1])
    inter = np.bincount(t[order][1:][both], minlength=rows.num_rows)
    union = n_a + n_b - inter
    good = (inter > 0) & (100 * inter >= percent * union)
    out = rows.select(["a", "b"])
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(1 - inter / np.maximum(union, 1))], names=["a", "b", "distance"]).filter(pa.array(good))


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null and empty texts, and those without words, have no shingles and are
    linked with nothing: each is its own component.  Very long texts are taken
    whole.  Rows that share a doc_id are one node, linked with whatever one of
    them links with; a row with a null doc_id is returned with a null component.
    An empty table gives no rows.  Only doc_id and text are read.
    """
    spark = docs.sparkSession
    most = 1 - percent / 100 + SLACK
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = spark.sparkContext.broadcast(_sketch(docs))
    signed = store(_prefixes(docs, classes, percent), "sets")
    grouped = signed.where("centre is not null")
    sets = grouped.select("doc_id", "n", "fp_a", "fp_b", "bitmap")

    same = grouped.groupBy("fp_a", "fp_b", "n").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).where("node < last").drop("last")
    copies = grouped.select("doc_id", "fp_a", "fp_b", "n").join(same, ["fp_a", "fp_b", "n"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    near = grouped.where("centre <> doc_id").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))

    rows = grouped.where(F.size("rows") > 0).select(F.posexplode("rows").alias("at", "token"), F.col("centre").alias("node"), F.col("n_centre").alias("n"), "typical", "n_short")
    lists = store(_lists(rows.select("token", "node", "n", "typical", F.expr("at < n_short").alias("short")), percent), "lists")
    star = store(lists.where("star <> node").groupBy(F.col("node").alias("a"), F.col("star").alias("b")).agg(F.count("*").alias("shared")), "stars")

    def linked(pairs: DataFrame) -> DataFrame:
        """Links (a, b, distance) among pairs of groups' centres."""
        near = store(_bounded(pairs, sets, pairs.select("a").union(pairs.select("b")).distinct()).where(F.col("low") <= most), "near-stars")
        equal = near.where("low < 0").select("a", "b", F.lit(0.0).alias("distance"))
        out = store(equal.union(verify(store(near.where("low >= 0").select("a", "b").distinct(), "pairs"), docs, percent)), "links")
        drop(near)
        return out

    # each group first meets the centre that most of its lists have; then the others, but those of its component
    nearest = store(star.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b")), "nearest")
    stars = linked(nearest)
    labels = components(stars.select("a", "b").union(copies).union(near))
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}"))
    others = star.join(nearest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    others = store(others.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"), "others")
    stars = stars.union(linked(others))
    labels = components(stars.select("a", "b").union(copies).union(near))

    best = stars.where(F.col("distance") <= 1 - NEAR / 100).groupBy("a").agg(F.min(F.struct("distance", "b")).alias("best"))
    centres = best.select(F.col("best.b").alias("a")).distinct()
    homes = store(best.join(centres, "a", "left_anti").select(F.col("a").alias("node"), F.col("best.b").alias("home"), F.col("best.distance").alias("way")), "homes")
    # copies of a group's centre need no row of their own
    members = grouped.where("gap > 0 or centre = doc_id").select("doc_id", "n", F.col("centre").alias("node"), "gap").join(homes, "node", "left")
    members = members.select("doc_id", "n", F.coalesce("home", "node").alias("home"), (F.col("gap") + F.coalesce("way", F.lit(0.0))).alias("way"))
    members = members.groupBy("home", "doc_id").agg(F.min("n").alias("n"), F.max("n").alias("n_most"), F.max("way").alias("way"))
    members = store(members, "members")
    groups = store(members.groupBy("home").agg(F.min("n").alias("least"), F.max("n_most").alias("most"), F.max("way").alias("radius")), "groups")

    kept = groups.join(labels.withColumnRenamed("node", "home"), "home", "left").withColumn("label", F.coalesce("label", "home"))
    owners = kept.withColumn("node", F.col("home")).unionByName(homes.select("node", "home").join(kept, "home"))
    placed = lists.select("token", "node", "short").join(owners, "node")
    matrix = placed.groupBy("token", "home").agg(F.max("short").alias("short"), *[F.min(c).alias(c) for c in ("label", "least", "most", "radius")])
    matrix = store(matrix, "matrix")
    label = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}"))

    def merged(pairs: DataFrame) -> DataFrame:
        """Links of components by links of documents."""
        return pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))

    def mixed(rows: DataFrame, name: str) -> DataFrame:
        """Rows of the shingles that several components have."""
        token = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
        return store(rows.join(token, "token"), name)

    opened = mixed(matrix, "mixed")
    known, wider = None, None  # links of components, and the components that these make
    for turn in range(ROUNDS):
        order = F.xxhash64(F.lit(turn), F.pmod("token", F.lit(ORDERS)), "home")
        reps = opened.groupBy("token", "label").agg(F.min_by(F.struct("home", "least", "most"), order).alias("r"), F.min(order).alias("o"))
        centre = reps.groupBy("token").agg(F.min_by(F.struct("label", "r"), "o").alias("c"))
        fits = f"label <> c.label and 100 * r.most >= {percent} * c.r.least and 100 * c.r.most >= {percent} * r.least"
        pairs = store(reps.join(centre, "token").where(fits).select(F.least("r.home", "c.r.home").alias("a"), F.greatest("r.home", "c.r.home").alias("b")).distinct(), "turn")
        close = store(_bounded(pairs, sets, pairs.select("a").union(pairs.select("b")).distinct()).where(F.col("low") <= most).select("a", "b").distinct(), "close")
        links = store(merged(verify(close, docs, percent).select("a", "b")), "merged")
        drop(pairs)
        drop(close)
        if links.isEmpty():
            drop(links)
            break
        known = links if known is None else known.union(links)
        wider = components(known)
        again = matrix.join(wider.withColumnRenamed("label", "_wider").withColumnRenamed("node", "label"), "label", "left")
        before, opened = opened, mixed(again.withColumn("label", F.coalesce("_wider", "label")).drop("_wider"), "mixed")
        drop(before)
    # of a doc_id with several sets, which only repeated doc_ids have, no bitmap is taken
    own = grouped.where("centre = doc_id").groupBy(F.col("doc_id").alias("home")).agg(F.min("n").alias("n"), F.max("n").alias("n_most"), F.min("fp_a").alias("p"), F.max("fp_a").alias("q"), F.first("mini").alias("mini"))
    own = own.select("home", "n", F.when((F.col("n") == F.col("n_most")) & (F.col("p") == F.col("q")), F.col("mini")).alias("mini"))
    placed = opened.join(own, "home")
    side = lambda s: placed.select("token", F.col("home").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("short", "label", "least", "most", "radius", "n", "mini")])
    fits = f"a < b and label_a <> label_b and 100 * most_a >= {percent} * least_b and 100 * most_b >= {percent} * least_a"
    # the bits in which two bitmaps differ bound the distance of two centres, and with the radii that of any two members
    apart = " + ".join(f"bit_count(mini_a[{i}] ^ mini_b[{i}])" for i in range(MINI // 64))
    near_enough = f"coalesce(({apart}) * (2 - ({most!r} + radius_a + radius_b)) <= ({most!r} + radius_a + radius_b) * (n_a + n_b), true)"
    met = side("a").join(side("b"), "token").where(fits).where(near_enough).groupBy("a", "b")
    met = met.agg(F.count("token").alias("shared"), F.max(F.expr("short_a or short_b")).alias("short"), *[F.min(f"{c}_{s}").alias(f"{c}_{s}") for c in ("least", "most", "radius") for s in "ab"])

    def enough(larger: str, smaller: str):
        # of the largest set of one group and the smallest of the other that fits: what is not in a prefix, and what an overlap takes
        n, rest = F.col(f"most_{larger}"), F.ceil(percent * F.col(f"most_{larger}") / 100)
        m = F.greatest(F.least(F.col(f"least_{smaller}"), n), rest)
        return F.col("shared") + rest >= F.ceil(percent * (n + m) / (100 + percent))

    met = store(met.where("short").where(enough("a", "b") | enough("b", "a")).select("a", "b", "radius_a", "radius_b"), "met")
    met = _bounded(met, sets, met.select("a").union(met.select("b")).distinct())
    met = store(met.where(F.col("low") <= most + F.col("radius_a") + F.col("radius_b")), "open")

    # open the first group, bound its members against the other's centre, then open the other
    one = members.select(F.col("home").alias("a"), F.col("doc_id").alias("d"), F.col("way").alias("way_d"))
    first = one.join(met.withColumnRenamed("low", "low_ab"), (one["a"] == met["a"]) & (F.col("low_ab") - one["way_d"] <= most + met["radius_b"]))
    first = store(first.select(F.col("d").alias("a"), "b", "radius_b").distinct(), "first")
    first = store(_bounded(first, sets, first.select("a").union(first.select("b")).distinct()).where(F.col("low") <= most + F.col("radius_b")).withColumnRenamed("low", "low_b").withColumnRenamed("b", "h"), "first")
    two = members.select(F.col("home").alias("h"), F.col("doc_id").alias("b"), F.col("way").alias("way_b"))
    pairs = first.join(two, (first["h"] == two["h"]) & (F.col("low_b") - F.col("way_b") <= most)).select("a", "b").distinct()
    pairs = store(pairs, "second")
    pairs = store(_bounded(pairs, sets, pairs.select("a").union(pairs.select("b")).distinct()).where(F.col("low") <= most).select("a", "b").distinct(), "pairs")
    more = verify(pairs, docs, percent).select("a", "b")

    # links between components join whole components
    more = merged(more)
    wider = components(store(more if known is None else more.union(known), "more"))
    for table in (lists, star, nearest, others, homes, members, groups, matrix, opened, met, first, pairs):
        drop(table)
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("node"))
    return out.join(wider, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
