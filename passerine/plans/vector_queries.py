"""Registered queries on vectors and signals, and on segments of events, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import matrix, select, sequence, signal, vectors
from ..sources.tables import table
from .queries import _MAG, SQL, _events, _vectors, query

#: Frequency of a bin, category weights and softmax temperature.
HZ = 22050 / 128
WEIGHTS = {
    "territorial": {"aciPerSec": 1.0, "repRate": 0.8, "dur": 0.7, "centroidRange": 0.5, "flatness": -0.6},
    "courtship": {"aciPerSec": 0.9, "pitchRange": 1.0, "bandwidth": 0.7, "dur": 0.6, "flatness": -0.5, "repRate": -0.3},
    "social": {"repRate": 0.9, "dur": -0.9, "aciPerSec": -0.7, "centroidRange": -0.6, "bandwidth": -0.4},
    "alarm": {"flatness": 0.9, "entropy": 0.9, "zcr": 0.8, "centroid": 0.6, "flux": 0.6, "dur": -0.5},
}
TEMPERATURE = 1.4
FEATURES = sorted({f for w in WEIGHTS.values() for f in w})


def _magnitudes(spark, d) -> DataFrame:
    return _vectors(spark, d).withColumn("embedding", F.transform("embedding", F.abs))


@query(f"with s as ({SQL['islands_segmentation']}) select user_id, count(*) as n, round(avg(last_row - first_row + 1), 6) as mean_rows, min(first_row) as first_row from s group by 1")
def segment_summary(spark, d):
    s = sequence.islands(_events(spark, d), "user_id", "event_id", "ts", F.col("value") > 40, 2, 2)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("last_row") - F.col("first_row") + 1), 6).alias("mean_rows"), F.min("first_row").cast("long").alias("first_row"))


@query(f"with s as ({SQL['islands_segmentation']}) select user_id, island, first_row - lag(last_row) over (partition by user_id order by first_row) - 1 as gap from s")
def segment_gaps(spark, d):
    s = sequence.islands(_events(spark, d), "user_id", "event_id", "ts", F.col("value") > 40, 2, 2)
    before = F.lag("last_row").over(W.partitionBy("user_id").orderBy("first_row"))
    return s.select("user_id", F.col("island").cast("long").alias("island"), (F.col("first_row") - before - 1).cast("long").alias("gap"))


@query("with s as (select user_id, list_sort(list(value)) v from events group by 1), t as (select user_id, v[1 + cast(floor(0.2 * (len(v) - 1)) as int)] as p from s) select event_id, value from events join t using (user_id) where value >= p")
def amplitude_filter(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "value")
    least = select.nearest_ranks(e, ["user_id"], "value", {"p": 0.2})
    return e.join(least, "user_id").where("value >= p").select("event_id", "value")


@query("select event_id, round((value - avg(value) over w) / coalesce(nullif(stddev_pop(value) over w, 0), 1), 6) as z from events window w as (partition by event_type)")
def zscore(spark, d):
    e = _events(spark, d).select("event_type", "event_id", "value")
    one = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(one, "event_type").select("event_id", F.round((F.col("value") - F.col("m")) / F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1.0)), 6).alias("z"))


@query("with r as (select user_id, event_id, ts, count(*) over w as n, avg(value * value) over w as p from events window w as (partition by user_id order by ts, event_id rows between 5 preceding and current row)) select user_id, event_id, round(sqrt(p), 6) as rms from (select *, row_number() over (partition by user_id order by round(p, 6) desc, ts, event_id) k from r where n = 6) where k = 1")
def loudest_window(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 0)
    r = _events(spark, d).select("user_id", "event_id", "ts", F.count(F.lit(1)).over(w).alias("n"), F.avg(F.col("value") * F.col("value")).over(w).alias("p")).where("n = 6")
    first = W.partitionBy("user_id").orderBy(F.desc(F.round("p", 6)), "ts", "event_id")
    return r.withColumn("k", F.row_number().over(first)).where("k = 1").select("user_id", "event_id", F.round(F.sqrt("p"), 6).alias("rms"))


@query(f"with m as (select vec_id, {_MAG} v from embeddings), u as (select vec_id, unnest(v) x, unnest(range(64)) k, list_sum(v) t from m), c as (select *, sum(x) over (partition by vec_id order by k) s from u) select vec_id, cast(min(k) as integer) as rolloff from c where s >= 0.85 * t group by 1")
def cumulative_threshold(spark, d):
    return _magnitudes(spark, d).select("vec_id", signal.rolloff_bin(F.col("embedding")).alias("rolloff"))


@query(f"with m as (select vec_id, {_MAG} v from embeddings), u as (select vec_id, unnest(v) x, unnest(range(64)) * {HZ} f from m), s as (select vec_id, sum(case when f >= 1000 and f < 2000 then x else 0 end) a, sum(case when f >= 2000 then x else 0 end) b from u group by 1), g as (select vec_id, f, 10 * log10(x + 1e-12) db from u where f >= 2000 and f <= 8000), i as (select vec_id, sum(db - lo) * {HZ / 1000} bi from (select *, min(db) over (partition by vec_id) lo from g) group by 1) select vec_id, round((b - a) / (b + a), 6) as ndsi, round(bi, 5) as bi from s join i using (vec_id)")
def soundscape_indices(spark, d):
    v = F.col("embedding")
    return _magnitudes(spark, d).select("vec_id", F.round(signal.soundscape_index(v, HZ), 6).alias("ndsi"), F.round(signal.bioacoustic_index(v, HZ), 5).alias("bi"))


_XYZ = "cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z"


def _points(spark, d) -> DataFrame:
    return _vectors(spark, d).select("vec_id", "label", *[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


@query(f"with p as (select label, {_XYZ} from embeddings) select label, round(var_pop(x), 6) as xx, round(var_pop(y), 6) as yy, round(var_pop(z), 6) as zz, round(covar_pop(x, y), 6) as xy, round(covar_pop(x, z), 6) as xz, round(covar_pop(y, z), 6) as yz from p group by 1 having count(*) >= 4")
def covariance(spark, d):
    cells = [F.round(F.covar_pop(a, b), 6).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    return _points(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *cells).where("n >= 4").drop("n")


@query(f"with p as (select vec_id, label, {_XYZ} from embeddings), c as (select *, avg(x) over w cx, avg(y) over w cy, avg(z) over w cz from p window w as (partition by label)) select label, vec_id from (select *, row_number() over (partition by label order by round((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz), 9), vec_id) k from c) where k = 1")
def representative(spark, d):
    p = _points(spark, d)
    c = p.groupBy("label").agg(*[F.avg(k).alias("c" + k) for k in "xyz"])
    far = sum(((F.col(k) - F.col("c" + k)) * (F.col(k) - F.col("c" + k)) for k in "xyz"), F.lit(0.0))
    return p.join(c, "label").groupBy("label").agg(F.min_by("vec_id", F.struct(F.round(far, 9), "vec_id")).alias("vec_id"))


@query("select round(avg(cast(a.label = b.label as int)), 6) as rate, count(*) as n from (" + SQL["knn_edges"] + ") e join embeddings a on a.vec_id = q_id join embeddings b on b.vec_id = e.vec_id where nn_rank = 1")
def nn_label_rate(spark, d):
    e = _vectors(spark, d)
    near = vectors.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 1)
    named = lambda i, n: e.select(F.col("vec_id").alias(i), F.col("label").alias(n))
    both = near.join(named("q_id", "q_label"), "q_id").join(named("vec_id", "label"), "vec_id")
    return both.agg(F.round(F.avg((F.col("label") == F.col("q_label")).cast("int")), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


_STANDARD = """s as (select k, avg(x) m, stddev_pop(x) sd from (select unnest(range(1, 65)) k, cast(unnest(embedding) as double) x from embeddings) group by k),
st as (select list(m order by k) m, list(coalesce(nullif(sd, 0), 1) order by k) sd from s),
e as (select vec_id, list_transform(range(1, 65), lambda i: (cast(embedding[i] as double) - m[i]) / sd[i]) v from embeddings, st)"""


@query(f"""with {_STANDARD},
p as (select a.vec_id i, b.vec_id j, list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k]))) d,
  list_sum(list_transform(range(1, 4), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k]))) f from e a join e b on a.vec_id <> b.vec_id),
r as (select i, row_number() over (partition by i order by d, j) o, row_number() over (partition by i order by f, j) t from p)
select round(1 - 2.0 / (n * 5 * (2 * n - 16)) * sum(greatest(o - 5, 0)), 6) as trustworthiness from r, (select count(*) n from embeddings) where t <= 5 group by n""")
def trustworthiness(spark, d):
    v = matrix.standardised(_vectors(spark, d), "embedding", 64)
    return matrix.trustworthiness(v, "vec_id", F.col("embedding"), F.slice("embedding", 1, 3)).select(F.round("trustworthiness", 6).alias("trustworthiness"))


_SCORES = ", ".join("{" + f"'c': '{c}', 'o': {k}, 's': " + " + ".join(f"{x} * v[{FEATURES.index(f) + 1}]" for f, x in w.items()) + "}" for k, (c, w) in enumerate(WEIGHTS.items()))


@query(f"with {_STANDARD}, r as (select vec_id, unnest([{_SCORES}]) t from e), m as (select vec_id, t.c as category, t.o o, t.s s, max(t.s) over (partition by vec_id) top from r), p as (select *, sum(exp((s - top) / {TEMPERATURE})) over (partition by vec_id) tot from m) select vec_id, arg_min(category, o) as category, round(1 / min(tot), 6) as probability from p where s = top group by 1")
def category_scores(spark, d):
    e = _vectors(spark, d).select("vec_id", *[F.get("embedding", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)])
    found = matrix.category_scores(e, "vec_id", FEATURES, WEIGHTS, TEMPERATURE)
    return found.withColumn("probability", F.round("probability", 6))


@query("with u as (select vec_id, cast(unnest(embedding) as double) * (0.54 - 0.46 * cos(2 * pi() * unnest(range(64)) / 63)) x, unnest(range(64)) k from embeddings) select vec_id, b as bin, round(sqrt(sum(x * cos(2 * pi() * k * b / 64)) ** 2 + sum(x * sin(2 * pi() * k * b / 64)) ** 2), 5) as magnitude from u, (select unnest(range(33)) b) group by 1, 2")
def fft_magnitude(spark, d):
    m = signal.magnitudes(_vectors(spark, d).select("vec_id", "embedding"), "embedding")
    return m.select("vec_id", F.posexplode("magnitude").alias("bin", "x")).select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("x", 5).alias("magnitude"))


@query()
def mfcc(spark, d):
    m = signal.mfcc(_vectors(spark, d).select("vec_id", "embedding"), "embedding", 16000.0)
    return m.select("vec_id", F.transform("mfcc", lambda x: F.round(x, 6)).alias("mfcc"))


@query()
def pca_embedding(spark, d):
    scores, _, _ = matrix.principal_components(_vectors(spark, d), "embedding", 64, 3)
    return scores.select("vec_id", *[F.round(F.get("embedding", F.lit(i)), 6).alias(f"pc{i + 1}") for i in range(3)])


@query()
def pca_explained(spark, d):
    _, share, _ = matrix.principal_components(_vectors(spark, d), "embedding", 64)
    return spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(share)], "component int, explained double")
