"""Registered queries that run as streams over a table's files, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.storage import new_path
from ..sources.tables import table
from ..streaming import changelog, keyed
from .queries import EPOCH, query

#: Seconds that an island's rows are apart at most.
GAP = 6 * 3600


def _stream(spark, d) -> DataFrame:
    """The files of the events, as they come."""
    schema = table(spark, d, "events").drop("props").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def _run(changes: DataFrame) -> str:
    """Folder of the changes, once the stream has read all files."""
    path = new_path(changes.sparkSession)
    changelog.started(changes, f"{path}/changes", f"{path}/checkpoint").awaitTermination()
    return f"{path}/changes"


@query(f"select user_id, h, event_id, event_type, value from (select user_id, {EPOCH} // 3600 as h, event_id, event_type, value, row_number() over (partition by user_id, {EPOCH} // 3600 order by value desc, event_id) k from events where value > 0.5) where k = 1")
def streamed_best_per_window(spark, d):
    rows = _stream(spark, d).where("value > 0.5")
    best = keyed.best_per_window(rows, ["user_id"], "ts", "1 hour", "value", ["event_id"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in best.schema)
    kept = keyed.best_kept(spark, _run(best), schema, ["user_id"])
    return kept.select("user_id", F.floor(F.unix_seconds("start") / 3600).alias("h"), "event_id", "event_type", "value")


@query(f"""with o as (select user_id, epoch_us(ts) as t, value, lag(epoch_us(ts)) over (partition by user_id order by ts) as p from events where value > 40),
m as (select *, sum(case when p is null or t - p > {GAP * 1_000_000} then 1 else 0 end) over (partition by user_id order by t) as island from o)
select user_id, min(t) as first, max(t) as last, count(*) as n, max(value) as peak from m group by user_id, island""")
def streamed_islands(spark, d):
    found = keyed.islands(_stream(spark, d), "user_id", "ts", "value", F.col("value") > 40, GAP)
    return keyed.islands_kept(spark, _run(found), "user_id", "bigint").drop("open")
