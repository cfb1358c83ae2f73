"""Queries over streams, each with the SQL of the same fold over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..session import shared_dir
from ..sources import relational as rel
from ..streaming import ingest
from .registry import query

_PARTS = 3
_M = "'<<<<<<< existing' || chr(10) || state || chr(10) || '=======' || chr(10) || r.v || chr(10) || '>>>>>>> ' || r.s"


@query(f"""WITH RECURSIVE e AS (SELECT *, ['immutable', 'validatedOverwrite', 'firstWriteWin', 'fillIfEmpty', 'lastWriteWin', 'union', 'append'][1 + user_id % 7] AS op FROM events),
r AS MATERIALIZED (SELECT user_id, op, event_type AS v, 'e' || event_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e WHERE op IN ('firstWriteWin', 'fillIfEmpty')),
fold(user_id, op, n, state, inc) AS (SELECT user_id, op, n, v, CAST(NULL AS VARCHAR) FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.op, r.n, CASE WHEN r.v = state OR r.v = inc THEN state ELSE {_M} END, CASE WHEN r.v = state OR r.v = inc THEN inc ELSE r.v END
    FROM fold JOIN r ON r.user_id = fold.user_id AND r.n = fold.n + 1),
lists AS (SELECT user_id, op, string_agg(event_type, ',' ORDER BY t) AS v FROM (SELECT user_id, op, event_type, min(ts) AS t FROM e WHERE op IN ('union', 'append') GROUP BY ALL) GROUP BY ALL)
SELECT 'U' || user_id AS id, op, arg_min(event_type, ts) AS value FROM e WHERE op IN ('immutable', 'validatedOverwrite') GROUP BY ALL
UNION ALL SELECT 'U' || user_id, op, arg_max(event_type, ts) FROM e WHERE op = 'lastWriteWin' GROUP BY ALL
UNION ALL SELECT 'U' || user_id, op, arg_max(state, n) FROM fold GROUP BY ALL UNION ALL SELECT 'U' || user_id, op, v FROM lists""")
def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream that is stopped and taken up again, out of order, each user's under one of the policies."""
    op = F.element_at(F.array(*map(F.lit, merge.OPS)), (F.col("user_id") % len(merge.OPS) + 1).cast("int"))
    contributions = rel.table(spark, d, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"), F.lit("status").alias("key"), op.alias("op"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source"), F.col("event_type").alias("value"),
    )
    root = f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"
    for part in range(_PARTS):
        contributions.where(F.pmod(F.xxhash64("source"), F.lit(_PARTS)) == part).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(contributions.schema).parquet(f"{root}/log")
        ingest.keep_merged(stream, f"{root}/merged", f"{root}/checkpoint").awaitTermination()
    return ingest.merged(spark, f"{root}/merged").select("id", "op", F.coalesce("value", F.array_join("values", ",")).alias("value"))
