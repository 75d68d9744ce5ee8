"""Registered queries of logs, timelines and registries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar
from ..operators import select, sequence
from ..sources import files
from ..sources.tables import table
from .queries import EPOCH, _events, _second, query

_AUDIO = "lpad(cast(user_id as varchar), 4, '0') || '_' || strftime(ts, '%Y%m%d_%H%M%S')"


def _log(spark, d) -> DataFrame:
    """Events as a detection log: a recording is a user and a day, a window an hour."""
    e = _events(spark, d).withColumn("sec", _second())
    return e.select(
        F.concat(F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit("_"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")).alias("audio_id"),
        F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")).alias("model"), (F.col("value") / 100).alias("confidence"),
        F.floor(F.pmod("sec", F.lit(86400)) / 3600).alias("start_time"), (F.floor(F.pmod("sec", F.lit(86400)) / 3600) + 1).alias("end_time"), "event_id", "user_id",
    )


_LOG = f"lg as (select lpad(cast(user_id as varchar), 4, '0') || '_' || strftime(ts, '%Y%m%d') as audio_id, '  ' || upper(event_type) || ' ' as model, value / 100 as confidence, {EPOCH} % 86400 // 3600 as start_time, {EPOCH} % 86400 // 3600 + 1 as end_time, event_id, user_id from events)"


@query(f"""with {_LOG}, k as (select *, row_number() over (partition by audio_id, start_time, end_time order by confidence desc, event_id) as k from lg where lower(trim(coalesce(model, ''))) = 'click' and confidence > 0.5)
select audio_id, start_time, end_time, confidence, 'Assets/' || audio_id || '.wav' as local_audio_path, 'logs/' || user_id as source_csv from k where k = 1""")
def manifest(spark, d):
    rows = _log(spark, d).withColumn("source_csv", F.concat(F.lit("logs\\"), F.col("user_id").cast("string")))
    m = files.manifest(rows, "click", ["audio_id", "start_time", "end_time"], ["event_id"])
    m = m.withColumns({"local_audio_path": F.concat(F.lit("Assets/"), F.col("audio_id"), F.lit(".wav")), "source_csv": F.replace("source_csv", F.lit("\\"), F.lit("/"))})
    return m.select("audio_id", "start_time", "end_time", "confidence", "local_audio_path", "source_csv").orderBy("audio_id", "start_time", "end_time", F.desc("confidence"))


@query(f"""with {_LOG} select count(*) as rows_read, count(*) filter (where lower(trim(model)) = 'click' and confidence > 0.5) as eligible,
count(distinct case when lower(trim(model)) = 'click' and confidence > 0.5 then audio_id || '/' || start_time end) as windows, count(distinct audio_id) as recordings from lg""")
def run_counters(spark, d):
    ok = files.eligible("click")
    window = F.when(ok, F.concat_ws("/", "audio_id", F.col("start_time").cast("string")))
    return _log(spark, d).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(ok).alias("eligible"), F.count_distinct(window).alias("windows"), F.count_distinct("audio_id").alias("recordings"))


@query("select o_custkey, count(*) as n, string_agg(cast(o_orderkey as varchar), ' ' order by o_totalprice desc, o_orderkey) as orders from orders group by 1")
def rows_per_group(spark, d):
    entry = F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(entry)).alias("e"))
    return g.select("o_custkey", "n", F.array_join(F.transform("e", lambda e: e["o_orderkey"].cast("string")), " ").alias("orders"))


_TOPS = f"tp as (select user_id, {EPOCH} // 10800 as chunk, arg_max(event_type, (value, -event_id)) as top, max(value) as best from events where value >= 3 group by 1, 2)"


def _tops(spark, d) -> DataFrame:
    """The loudest type of each chunk of each user; chunks in which nothing is loud enough have none."""
    e = _events(spark, d).where("value >= 3").withColumn("chunk", F.floor(_second() / 10800))
    return e.groupBy("user_id", "chunk").agg(F.max_by("event_type", F.struct("value", (-F.col("event_id")).alias("i"))).alias("top"), F.max("value").alias("best"))


@query(f"with {_TOPS} select top, count(*) as wins, max(best) as best from tp group by 1 order by wins desc, top limit 6")
def wins_per_type(spark, d):
    return _tops(spark, d).groupBy("top").agg(F.count(F.lit(1)).alias("wins"), F.max("best").alias("best")).orderBy(F.desc("wins"), "top").limit(6)


@query(f"with {_TOPS}, l as (select *, lag(top) over (partition by user_id order by chunk) as was from tp) select user_id, chunk, was, top from l where was <> top")
def chunk_transitions(spark, d):
    was = F.lag("top").over(W.partitionBy("user_id").orderBy("chunk"))
    return _tops(spark, d).withColumn("was", was).where("was <> top").select("user_id", "chunk", "was", "top")


@query(f"""with b as (select user_id, event_type, max(value) as best, arg_min({EPOCH} // 10800 * 3, (-value, {EPOCH} // 10800)) as at_seconds from events where value >= 3 group by 1, 2),
k as (select *, row_number() over (partition by user_id order by best desc, event_type) as k from b) select user_id, event_type, floor(best * 1000 + 0.5) / 1000 as best, at_seconds from k where k <= 12""")
def best_over_chunks(spark, d):
    e = _events(spark, d).where("value >= 3").withColumn("chunk", F.floor(_second() / 10800))
    b = e.groupBy("user_id", "event_type").agg(F.max("value").alias("best"), F.min_by(F.col("chunk") * 3, F.struct((-F.col("value")).alias("v"), "chunk")).alias("at_seconds"))
    top = select.top_per_group(b, ["user_id"], [F.desc("best"), F.col("event_type")], 12)
    return top.select("user_id", "event_type", scalar.half_up(F.col("best"), 3).alias("best"), "at_seconds")


@query(f"""with {_TOPS}, k as (select user_id, {EPOCH} // 10800 as chunk, event_type, value, row_number() over (partition by user_id, {EPOCH} // 10800 order by value desc, event_id) as k from events where value >= 3)
select user_id, chunk, string_agg(event_type || '=' || printf('%.2f', value), ' ' order by k) as species from k where k <= 3 group by 1, 2""")
def top_per_chunk(spark, d):
    e = _events(spark, d).where("value >= 3").withColumn("chunk", F.floor(_second() / 10800))
    top = select.top_per_group(e, ["user_id", "chunk"], [F.desc("value"), F.col("event_id")], 3)
    entry = F.struct("rank_in_group", F.concat("event_type", F.lit("="), F.format_string("%.2f", "value")).alias("s"))
    g = top.groupBy("user_id", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return g.select("user_id", "chunk", F.array_join(F.col("e.s"), " ").alias("species"))


@query("""with r as (select event_type as name, avg(value) as real, median(value) as control from events group by 1), t as (select *, real - control as margin, real - control >= 0.02 as passed from r)
select name, round(real, 6) as real, round(margin, 6) as margin from t where passed and (select max(real) from t where passed) - real < 0.5""")
def carried_forward(spark, d):
    from ..operators.experiments import carried

    r = _events(spark, d).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("real"), F.median("value").alias("control"))
    r = r.withColumn("margin", F.col("real") - F.col("control")).withColumn("passed", F.col("margin") >= 0.02)
    return carried(r, "real", "passed", 0.5).select("name", F.round("real", 6).alias("real"), F.round("margin", 6).alias("margin"))


@query("select event_id, coalesce(case when event_id % 5 > 0 then epoch_us(ts) // 1000 end, 0) as at_ms from events where ts <= timestamp '2024-01-05 00:00:00'")
def revealed(spark, d):
    e = _events(spark, d).where(F.col("ts").cast("timestamp") <= F.lit("2024-01-05 00:00:00").cast("timestamp"))
    at = F.coalesce(F.when(F.col("event_id") % 5 > 0, F.unix_millis(F.col("ts").cast("timestamp"))), F.lit(0))
    return e.select("event_id", at.alias("at_ms")).orderBy("at_ms", "event_id")


@query("""with o as (select o_orderkey, o_totalprice / 20000 as dur from orders), c as (select o_orderkey, dur, unnest(range(greatest(1, cast(ceil(dur / 3) as bigint)))) as chunk from o)
select o_orderkey, chunk, chunk * 3 as "start", floor(least(dur, (chunk + 1) * 3) * 1000 + 0.5) / 1000 as "end", cast(48000 * 3 as bigint) as samples from c""")
def tumbling_chunks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 20000).alias("dur"))
    c = sequence.chunks(o, "dur", 3)
    return c.select("o_orderkey", "chunk", (F.col("chunk") * 3).alias("start"), scalar.half_up(F.col("end"), 3).alias("end"), F.lit(48000 * 3).cast("long").alias("samples"))


@query("""with u as (select user_id, max(epoch_us(ts) // 1000) as last, min(epoch_us(ts) // 1000) as first from events group by 1), w as (select user_id, least(greatest(first + (last - first) // 2, first + 86400000), last) as t, first from u)
select w.user_id, count(*) as n, max(value) as best from w join events e on e.user_id = w.user_id and epoch_us(e.ts) // 1000 >= w.t - 86400000 and epoch_us(e.ts) // 1000 <= w.t group by 1""")
def scroll_window(spark, d):
    e = _events(spark, d).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    ends = e.groupBy("user_id").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    t = F.least(F.greatest(F.col("first") + F.expr("(last - first) div 2"), F.col("first") + 86400000), F.col("last"))
    inside = e.join(ends.select("user_id", t.alias("t")), "user_id").where((F.col("ms") >= F.col("t") - 86400000) & (F.col("ms") <= F.col("t")))
    return inside.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))


@query("""with s as (select l_orderkey, l_linenumber, l_discount * 8 as c, coalesce(round(sum(l_discount * 8) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 9), 0) as y from lineitem)
select l_orderkey, l_linenumber, round(least(y, 1.0), 6) as base, round(least(c, 1 - y), 6) as height from s where y < 1""")
def stacked_bars(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_discount") * 8).alias("c"))
    b = sequence.stacked(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "c", 1.0)
    return b.select("l_orderkey", "l_linenumber", F.round("base", 6).alias("base"), F.round("height", 6).alias("height"))


@query(f"""with p as (select user_id, event_id, {EPOCH} as t, value, lead({EPOCH}) over w as t2, lead(value) over w as x2 from events where event_type = 'purchase' window w as (partition by user_id order by {EPOCH}, event_id)),
q as (select event_id, user_id, {EPOCH} as t from events where event_type = 'error'), j as (select q.event_id, q.t, max((p.t, p.event_id)) as k, q.user_id from q left join p on p.user_id = q.user_id and p.t <= q.t group by 1, 2, 4)
select j.event_id, round(case when p.t2 is null then p.value else p.value + (p.x2 - p.value) * least(1.0, (j.t - p.t) / greatest(p.t2 - p.t, 0.001)) end, 6) as value from j left join p on p.event_id = j.k[2]""")
def interpolated_asof(spark, d):
    e = _events(spark, d).withColumn("t", _second())
    right = e.where("event_type = 'purchase'").select("user_id", "t", "value", F.col("event_id").alias("tie"))
    left = e.where("event_type = 'error'").select("user_id", "t", "event_id")
    return sequence.interpolated(left, right, "user_id", "t", "value", "tie").select("event_id", F.round("value", 6).alias("value"))


@query("""with a as (select 'customer' as kind, cast(c_custkey as varchar) as id, c_name as label from customer union all select 'supplier', cast(s_suppkey as varchar), s_name from supplier), n as (select kind, id, 'new ' || label as label from a where cast(id as bigint) % 50 = 0)
select kind, id, label from a where cast(id as bigint) % 50 <> 0 union all select kind, id, label from n""")
def registry_order(spark, d):
    of = lambda t, k, n: table(spark, d, t).select(F.lit(t).alias("kind"), F.col(k).cast("string").alias("id"), F.col(n).alias("label"))
    a = of("customer", "c_custkey", "c_name").unionByName(of("supplier", "s_suppkey", "s_name"))
    new = a.where(F.col("id").cast("long") % 50 == 0).withColumn("label", F.concat(F.lit("new "), F.col("label")))
    return select.upsert(a, new, ["kind", "id"]).orderBy("kind", "label", "id")


@query("select s_suppkey, s_name, 'preferred' as why from supplier order by case when s_suppkey = 999999 then 0 when s_nationkey = 7 then 1 else 2 end, s_suppkey limit 1")
def lookup_with_fallback(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    found = files.preferred(s, [F.col("s_suppkey") == 999999, F.col("s_nationkey") == 7, F.lit(True)], ["s_suppkey"])
    return found.select("s_suppkey", "s_name", F.lit("preferred").alias("why"))


@query("""with i as (select event_id, """ + _AUDIO + """ as id, props from events)
select event_id, regexp_replace(id, '_\\d{8}_\\d{6}$', '') as recorder, regexp_replace(regexp_extract('a\\b/' || id || '.tar.wav', '([^/]*)$', 1), '\\.[^.]*$', '') as stem,
substr(regexp_replace(props, '[^A-Za-z0-9_-]+', '_', 'g'), 1, 40) as clean, lpad(cast(event_id % 100 as varchar), 4, '0') as padded, split_part(id, '_', 2) as part from i""")
def string_scalars(spark, d):
    e = table(spark, d, "events").select("event_id", _audio_id().alias("id"), "props")
    return e.select(
        "event_id", F.regexp_replace("id", r"_\d{8}_\d{6}$", "").alias("recorder"), scalar.file_stem(F.concat(F.lit("a\\b/"), F.col("id"), F.lit(".tar.wav"))).alias("stem"),
        scalar.sanitised(F.col("props")).alias("clean"), F.lpad((F.col("event_id") % 100).cast("string"), 4, "0").alias("padded"), F.split_part("id", F.lit("_"), F.lit(2)).alias("part"),
    )


def _audio_id() -> Column:
    return F.concat(F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit("_"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss"))


@query(f"with i as (select event_id, {_AUDIO} as id from events) select event_id, epoch_ms(strptime(regexp_extract(id, '_(\\d{{8}}_\\d{{6}})$', 1), '%Y%m%d_%H%M%S')) + 1500 as at_ms from i")
def id_times(spark, d):
    return table(spark, d, "events").select("event_id", (scalar.id_time_ms(_audio_id()) + 1500).alias("at_ms"))


@query("""with recursive c as (select c_custkey, c_mktsegment as s, 0 as k, cast(0 as bigint) as h from customer union all select c_custkey, s, k + 1, (h * 31 + ascii(substr(s, k + 1, 1))) % 4294967296 from c where k < length(s))
select c_custkey, h % 8 as colour from c where k = length(s)""")
def palette(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.palette_index(F.col("c_mktsegment"), 8).alias("colour"))


_V = "value - 25"


@query(f"""select event_id, round(cbrt({_V}), 6) as cube, round(atan2({_V}, event_id + 1), 6) as angle, round(sqrt(({_V}) ** 2 + user_id ** 2), 6) as far, round(ln(1 + value), 6) as log1p, round(log2(value + 1), 6) as lb,
floor(({_V}) + 0.5) as digits0, floor(({_V}) * 10 + 0.5) / 10 as digits1, round(1 / (1 + exp(-({_V}) / 10)), 6) as odds, least(greatest(({_V}) / 10, -1), 1) as clamped,
round(case when value > 20 then least(50.0, 0.9 / value) else 1.0 end, 6) as gain, round(700 * (10 ** (2595 * log10(1 + value / 700) / 2595) - 1), 6) as hz from events""")
def math_scalars(spark, d):
    v, x = F.col("value") - 25, F.col("value")
    return _events(spark, d).select(
        "event_id", F.round(F.cbrt(v), 6).alias("cube"), F.round(F.atan2(v, F.col("event_id") + 1), 6).alias("angle"), F.round(F.hypot(v, F.col("user_id")), 6).alias("far"), F.round(F.log1p(x), 6).alias("log1p"),
        F.round(F.log2(x + 1), 6).alias("lb"), scalar.half_up(v).alias("digits0"), scalar.half_up(v, 1).alias("digits1"), F.round(scalar.sigmoid(v / 10), 6).alias("odds"), scalar.clamp(v / 10, -1.0, 1.0).alias("clamped"),
        F.round(F.when(x > 20, scalar.peak_gain(x)).otherwise(1.0), 6).alias("gain"), F.round(scalar.hertz(scalar.mel(x)), 6).alias("hz"),
    )


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing, '{"user":' || user_id || ',"type":"' || event_type || '"}' as document from events""")
def json_fields(spark, d):
    doc = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")))
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"), doc.alias("document"))


@query("select user_id, string_agg(event_type || '=' || printf('%.1f', floor(v * 10 + 0.5) / 10), ' ' order by event_type) as best from (select user_id, event_type, max(value) as v from events group by 1, 2) group by 1")
def map_values(spark, d):
    m = _events(spark, d).groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    entries = F.array_sort(F.map_entries(F.transform_values("m", lambda k, v: scalar.half_up(v, 1))))
    return m.select("user_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.1f", e["value"]))), " ").alias("best"))


@query("select event_id, coalesce(nullif(case when event_id % 3 = 0 then '' else event_type end, ''), nullif(case when event_id % 2 = 0 then '' else 'u' || user_id end, ''), 'unknown') as label from events")
def field_aliases(spark, d):
    first = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    second = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return _events(spark, d).select("event_id", scalar.first_filled(first, second, fallback="unknown").alias("label"))


@query("""with a as (select user_id, event_id, value from events where event_type = 'click'), b as (select user_id, event_id, value from events where event_type = 'view'), p as (select *, 'click' as rec from a union all select *, 'view' from b)
select rec, user_id, count(*) as n, round(sum(value), 4) as mass from (select *, row_number() over (partition by rec, user_id order by value desc, event_id) as k from p) where k <= 30 group by 1, 2""")
def pooled_windows(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "value", "event_type")
    of = lambda t: e.where(F.col("event_type") == t).drop("event_type").withColumn("rec", F.lit(t))
    top = select.top_per_group(of("click").unionByName(of("view")), ["rec", "user_id"], [F.desc("value"), F.col("event_id")], 30)
    return top.groupBy("rec", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("mass"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit least(100000, 25)")
def bounded_limit(spark, d):
    return select.limited(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100000, 25)


@query("with w as (select split_part(c_name, '#', 2) as base, c_custkey from customer), d as (select lpad(cast(o_custkey as varchar), 9, '0') as audio_id, o_orderkey from orders) select o_orderkey, 'wav/' || audio_id || '.wav' as local_audio_path from d join w on base = audio_id")
def basename_join(spark, d):
    w = table(spark, d, "customer").select(F.concat(F.lit("wav/"), F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit(".wav")).alias("path"))
    rows = table(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("audio_id"))
    return files.with_audio(rows, files.basename_index(w)).select("o_orderkey", "local_audio_path")
