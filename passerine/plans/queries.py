"""The registered analytics queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalar import entropy, gini, unit_range
from ..operators import select, sequence, vectors
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").drop("props")


def _second():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


EPOCH = "cast(floor(epoch(ts)) as bigint)"


@query(f"select user_id, h, event_id, event_type, value from (select user_id, {EPOCH} // 3600 as h, event_id, event_type, value, row_number() over (partition by user_id, {EPOCH} // 3600 order by value desc, event_id) k from events where value > 0.5) where k = 1")
def best_event_per_window(spark, d):
    rows = _events(spark, d).where("value > 0.5").select("user_id", F.floor(_second() / 3600).alias("h"), "event_id", "event_type", "value")
    return select.best_by(rows, ["user_id", "h"], "value", ["event_id"])


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by value desc, event_id) k from events) where k = 1")
def best_event_per_user(spark, d):
    return select.best_by(_events(spark, d).select("user_id", "event_id", "event_type", "value"), ["user_id"], "value", ["event_id"])


@query("select user_id, event_id, value from (select * from events order by value desc, event_id limit 150)")
def top150_resort(spark, d):
    return _events(spark, d).select("user_id", "event_id", "value").orderBy(F.desc("value"), "event_id").limit(150).orderBy("user_id", "event_id")


@query("select user_id, coalesce(event_type, 'Unknown') as event_type, n, round(weight, 4) as weight from (select *, row_number() over (partition by user_id order by n desc, round(weight, 6) desc, event_type) k from (select user_id, event_type, count(*) n, sum(value) weight from events group by 1, 2)) where k = 1")
def modal_event_type(spark, d):
    counts = _events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("weight"))
    best = select.top_per_group(counts, ["user_id"], [F.desc("n"), F.desc(F.round("weight", 6)), F.col("event_type")], 1)
    return best.select("user_id", F.coalesce("event_type", F.lit("Unknown")).alias("event_type"), "n", F.round("weight", 4).alias("weight"))


@query("select event_type, count(*) as n, max(value) as best, min(value) as least from events group by 1")
def counts_by_type(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"), F.min("value").alias("least"))


@query("select event_type, user_id, event_id, rank_in_group from (select *, row_number() over (partition by event_type order by value desc, event_id) rank_in_group from events) where rank_in_group <= 50 and rank_in_group <= (select min(c) from (select count(*) c from events group by event_type having count(*) >= 2))")
def balanced_sample(spark, d):
    return select.balanced_sample(_events(spark, d), "event_type", [F.desc("value"), F.col("event_id")], 50).select("event_type", "user_id", "event_id", "rank_in_group")


@query("select event_type, count(*) as n from events group by 1 order by n desc, event_type limit 3")
def top_groups(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def semi_join_existing(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("select c_custkey, coalesce(lower(n_name), 'unknown') as nation from customer left join nation on c_nationkey = n_nationkey and n_regionkey < 3")
def left_join_default(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce(F.lower("n_name"), F.lit("unknown")).alias("nation"))


@query("select s_suppkey, s_name, s_acctbal from supplier where s_nationkey >= 5 union all select s_suppkey, upper(s_name), 0.0 from supplier where s_nationkey < 5")
def registry_upsert(spark, d):
    s = table(spark, d, "supplier")
    new = s.where("s_nationkey < 5").select("s_suppkey", F.upper("s_name").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return select.upsert(s.select("s_suppkey", "s_name", "s_acctbal"), new, ["s_suppkey"])


@query("select event_id, coalesce(round(abs(value - lag(value) over (partition by user_id order by ts, event_id)), 6), 0) as delta from events")
def lag_deltas(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).select("event_id", F.coalesce(F.round(F.abs(F.col("value") - F.lag("value").over(w)), 6), F.lit(0.0)).alias("delta"))


@query("select event_id, was, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) was from events) where was <> event_type")
def transitions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).withColumn("was", F.lag("event_type").over(w)).where("was <> event_type").select("event_id", "was", "event_type")


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) pos from events),
o as (select user_id, pos, lag(pos) over (partition by user_id order by pos) p from r where value > 40),
n as (select *, pos - coalesce(p, 0) - 1 as gap from o),
m as (select *, sum(case when p is null or gap > 2 then 1 else 0 end) over (partition by user_id order by pos) as island from n),
g as (select user_id, island, min(case when p is null and gap <= 2 then 1 else pos end) as first_row, max(pos) as last_row from m group by 1, 2)
select user_id, cast(island as bigint) as island, first_row, last_row from g where last_row - first_row + 1 >= 2""")
def islands_segmentation(spark, d):
    out = sequence.islands(_events(spark, d), "user_id", "event_id", "ts", F.col("value") > 40, 2, 2)
    return out.select("user_id", F.col("island").cast("long").alias("island"), F.col("first_row").cast("long").alias("first_row"), F.col("last_row").cast("long").alias("last_row"))


@query("with s as (select user_id, list_sort(list(value)) v from events group by 1) select user_id, v[1 + cast(floor(0.2 * (len(v) - 1)) as int)] as p20, v[1 + cast(floor(0.85 * (len(v) - 1)) as int)] as p85 from s")
def nearest_rank_quantiles(spark, d):
    return select.nearest_ranks(_events(spark, d), ["user_id"], "value", {"p20": 0.2, "p85": 0.85})


@query("select event_id, round(value / max(value) over (partition by user_id), 6) as share, round(coalesce((value - min(value) over (partition by user_id)) / nullif(max(value) over (partition by user_id) - min(value) over (partition by user_id), 0), 0.5), 6) as unit from events")
def minmax_norm(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "value")
    ends = e.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(ends, "user_id").select("event_id", F.round(F.col("value") / F.col("hi"), 6).alias("share"), F.round(unit_range(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("unit"))


@query(f"select user_id, {EPOCH} // 10800 as chunk, max(value) as best, count(*) as n from events group by 1, 2")
def tumbling_max(spark, d):
    return _events(spark, d).groupBy("user_id", F.floor(_second() / 10800).alias("chunk")).agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("n"))


@query(f"select user_id, {EPOCH} // 3600 - k as hop, count(*) as n, max(value) as best from events, (values (0), (1), (2)) t(k) group by 1, 2")
def hop_windows(spark, d):
    rows = _events(spark, d).select("user_id", "value", F.floor(_second() / 3600).alias("h"))
    return rows.select("user_id", "value", F.explode(F.array(*[F.col("h") - k for k in range(3)])).alias("hop")).groupBy("user_id", "hop").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))


@query("select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k <= 6")
def last_n(spark, d):
    return select.top_per_group(_events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 6).select("event_id", "user_id", "ts")


@query("select e.event_id, max_by(p.value, (p.ts, p.event_id)) as bought from events e left join events p on p.user_id = e.user_id and p.event_type = 'purchase' and p.ts <= e.ts where e.event_type = 'error' group by 1")
def asof_prev(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'error'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("bought"), F.col("event_id").alias("tie"))
    return sequence.asof(left, right, "user_id", "ts", "bought", "tie").select("event_id", "bought")


@query(f"with s as (select user_id, event_id as span_id, {EPOCH} as a, {EPOCH} + 7200 as b from events where event_type = 'signup') select e.event_id, min(s.span_id) as span_id from events e left join s on s.user_id = e.user_id and {EPOCH.replace('ts', 'e.ts')} >= s.a and {EPOCH.replace('ts', 'e.ts')} < s.b where e.event_type = 'click' group by 1")
def interval_join_first(spark, d):
    e = _events(spark, d).withColumn("sec", _second())
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("sec").alias("a"), (F.col("sec") + 7200).alias("b"))
    points = e.where("event_type = 'click'").select("user_id", "event_id", "sec")
    return sequence.interval_join(points, spans, "user_id", "sec", "a", "b", 7200, "span_id").select("event_id", "span_id")


_DIST = "round(list_sum(list_transform(range(1, 65), lambda i: (cast(a.embedding[i] as double) - cast(b.embedding[i] as double)) * (cast(a.embedding[i] as double) - cast(b.embedding[i] as double)))), 6)"


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query(f"select q_id, vec_id, nn_rank from (select a.vec_id q_id, b.vec_id, row_number() over (partition by a.vec_id order by {_DIST}, b.vec_id) nn_rank from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) where nn_rank <= 3")
def knn_edges(spark, d):
    e = _vectors(spark, d)
    return vectors.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3).select("q_id", "vec_id", "nn_rank")


_MAG = "list_transform(embedding, lambda x: abs(cast(x as double)))"


@query(f"with m as (select vec_id, {_MAG} v from embeddings), t as (select vec_id, v, list_sum(v) s from m) select vec_id, round(-list_sum(list_transform(v, lambda x: case when x > 0 then x / s * ln(x / s) else 0 end)), 6) as adi, round(list_sum(list_transform(list_sort(v), lambda x, i: (2 * i - 65) * x)) / (64 * s), 6) as aei from t")
def diversity(spark, d):
    v = F.transform("embedding", F.abs)
    return _vectors(spark, d).select("vec_id", F.round(entropy(v), 6).alias("adi"), F.round(gini(v), 6).alias("aei"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, count(*) as n from lineitem group by 1, 2")
def category_rollup(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count(F.lit(1)).alias("n"))
