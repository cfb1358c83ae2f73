"""A log of contributions as a stream, merged key by key under each policy.

The state of a key is what its policy needs to go on: the first or the last
value, the distinct values with their first arrival, or, for the policies that
flag, the contributions themselves, since one that comes late changes all
markers after it.  So however the contributions are split into micro-batches and
in whatever order they come, the merged values are those of the fold over all of
them.  With ``lateness`` the flagging policies keep only what is at most that far
(in seq) behind a key's newest contribution; the rest is folded for good, and
what comes later than that is left out and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import merge

MERGED = "id string, key string, op string, value string, values array<string>, conflict boolean, seq long, late long"
_STATE = "base string, base_seq long, seqs array<long>, values array<string>, sources array<string>, late long"


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of contributions to a table, each micro-batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flag(state: str, value: str, source: str) -> str:
    """One step of the flagging fold, as merge.fold_flagging takes it."""
    opened = state.startswith(merge.OPEN) and merge.MIDDLE in state and merge.CLOSE in state
    if value in ("", state) or opened and state.split(merge.MIDDLE)[-1].split(merge.CLOSE)[0] == value:
        return state
    return value if state == "" else f"{merge.OPEN}{state}{merge.MIDDLE}{value}{merge.CLOSE}{source}"


def step(op: str, held: list[tuple[int, str, str]], new: list[tuple[int, str | None, str]]) -> list[tuple[int, str, str]]:
    """What a key holds after further contributions (seq, value, source), by seq; a seq that is there already counts once."""
    if op in merge.LIST:
        first: dict[str, tuple[int, str]] = {}
        for seq, value, source in sorted([*held, *(x for x in new if x[1] is not None)]):
            first.setdefault(value, (seq, source))
        return sorted((seq, value, source) for value, (seq, source) in first.items())
    some = [*held, *(x for x in new if x[1])]
    if op in merge.FREEZE + merge.OVERWRITE:
        return [(min if op in merge.FREEZE else max)(some)] if some else []
    if op in merge.FLAG:
        return sorted({x[0]: x for x in reversed(some)}.values())
    raise ValueError(f"not a policy: {op}")


def merge_stream(contributions: DataFrame, lateness: int | None = None) -> DataFrame:
    """The merged value of each key that a micro-batch touches.

    ``contributions`` has id, key, op (a policy; null is union), seq, source and
    value.  List policies give ``values``, all others ``value`` and ``conflict``.
    """

    def run(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        op = names[2]
        base, base_seq, seqs, values, sources, late = state.get if state.exists else ("", None, [], [], [], 0)
        new = [(int(s), None if v is None or v != v else v, r or "") for f in frames for s, v, r in zip(f["seq"], f["value"], f["source"])]
        if op in merge.FLAG and base_seq is not None:
            late += sum(1 for x in new if x[0] <= base_seq)
            new = [x for x in new if x[0] > base_seq]
        held = step(op, list(zip(seqs, values, sources)), new)
        if op in merge.FLAG and lateness is not None and held:
            old = [x for x in held if x[0] < held[-1][0] - lateness]
            for _, value, source in old:
                base = flag(base, value, source)
            base_seq, held = (old[-1][0] if old else base_seq), held[len(old) :]
        state.update((base, base_seq, [x[0] for x in held], [x[1] for x in held], [x[2] for x in held], late))
        if op in merge.FLAG + merge.LIST and not held and not base:
            return  # nothing has a value
        value, many = None, None
        if op in merge.LIST:
            many = [x[1] for x in held]
        elif op in merge.FLAG:
            value = base
            for _, v, source in held:
                value = flag(value, v, source)
        else:
            value = held[0][1] if held else ""
        last = max([x[0] for x in held], default=base_seq)
        yield pd.DataFrame({"id": [names[0]], "key": [names[1]], "op": [op], "value": [value], "values": [many], "conflict": [bool(value and value.startswith(merge.OPEN) and merge.CLOSE in value)], "seq": pd.array([last], "Int64"), "late": [late]})

    rows = contributions.withColumn("op", F.coalesce("op", F.lit("union"))).select("id", "key", "op", "seq", "value", "source")
    return rows.groupBy("id", "key", "op").applyInPandasWithState(run, MERGED, _STATE, "update", GroupStateTimeout.NoTimeout)


def keep_merged(stream: DataFrame, path: str, checkpoint: str, lateness: int | None = None):
    """Merge a stream of contributions into a table at a path, a folder for each micro-batch.

    A micro-batch that is run again after a failure writes its folder anew, so
    each counts once.
    """

    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    merged = merge_stream(stream, lateness)
    return merged.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The newest merged value of every key of a table that keep_merged wrote."""
    rows = spark.read.schema(f"{MERGED}, batch long").parquet(path)
    newest = rows.groupBy("id", "key", "op").agg(F.max_by(F.struct("value", "values", "conflict", "seq", "late"), "batch").alias("x"))
    return newest.select("id", "key", "op", "x.*")
