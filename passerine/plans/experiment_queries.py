"""Registered queries of experiments on embeddings; beside them their SQL where it can express them."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalar
from ..operators import experiments, inference, matrix, select, signal
from ..sources.tables import table
from . import vector_queries  # noqa: F401  (its SQL is used here)
from .queries import SQL, _vectors, query

#: Fixed value: the seed that the experiments count from.
SEED = 20260720


def _balanced(spark, d) -> DataFrame:
    """Equally many vectors of the three largest labels, 31 of each at most."""
    e = _vectors(spark, d)
    top = e.groupBy("label").count().where("count >= 2").orderBy(F.desc("count"), "label").limit(3)
    return select.balanced_sample(e.join(top.select("label"), "label", "left_semi"), "label", [F.col("vec_id")], 31)


_BALANCED = """tp as (select label, count(*) as n from embeddings group by 1 having count(*) >= 2 order by n desc, label limit 3),
bl as (select *, row_number() over (partition by label order by vec_id) as k from embeddings where label in (select label from tp)),
sm as (select vec_id, label, list_transform(embedding, lambda v: cast(v as double)) as v from bl where k <= least(31, (select min(n) from tp)))"""


@query(f"""with {_BALANCED}, p as (select a.label = b.label as same, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k])))) as d from sm a join sm b on a.vec_id < b.vec_id),
s as (select count(*) filter (where same) as sp, count(*) filter (where not same) as dp, avg(d) filter (where same) as sa, avg(d) filter (where not same) as da, median(d) filter (where same) as sd, median(d) filter (where not same) as dd from p)
select sp as same_pairs, dp as different_pairs, round(sa, 6) as same_mean, round(da, 6) as different_mean, round(sd, 6) as same_median, round(dd, 6) as different_median, round(da - sa, 6) as mean_delta, round(dd - sd, 6) as median_delta, round(sa / da, 6) as mean_ratio from s""")
def pair_statistics(spark, d):
    out = experiments.pair_statistics(_balanced(spark, d), "vec_id", "label", F.col("embedding"))
    return out.select(*[F.col(c) if c.endswith("pairs") else F.round(c, 6).alias(c) for c in out.columns])


@query()
def permutation_test(spark, d):
    out = experiments.permutation_test(_balanced(spark, d), "vec_id", "label", "embedding", 1000, SEED + 5)
    return out.select("permutations", "at_least", F.round("p_value", 6).alias("p_value"), F.round("observed", 6).alias("observed"), F.round("mean_shuffled", 6).alias("mean_shuffled"))


@query(f"""with recursive c as (select count(*) as n from supplier), g(k, s) as (select 0, cast({SEED + 1} as bigint) union all select k + 1, (1664525 * s + 1013904223) % 4294967296 from g, c where k < 6 * n),
u as (select (k - 1) // 2 as e, max(case when k % 2 = 1 then greatest(s / 4294967296.0, 1e-12) end) as a, max(case when k % 2 = 0 then s / 4294967296.0 end) as b from g where k > 0 group by 1)
select e // 3 as i, e % 3 as dim, round(sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) as x from u""")
def random_control(spark, d):
    """A control of as many rows as a table has."""
    n = table(spark, d, "supplier").count()
    c = experiments.random_control(spark, n, 3, SEED + 1).select("i", F.posexplode("v").alias("dim", "x"))
    return c.select("i", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"""with recursive c as (select count(*) as n from supplier), g(k, s) as (select 0, cast({SEED + 5} as bigint) union all select k + 1, (1664525 * s + 1013904223) % 4294967296 from g, c where k < n - 1),
st(k, l) as (select 0, range(n) from c union all select st.k + 1, list_transform(range(n), lambda p: case when p = n - 1 - st.k then l[1 + cast(floor(g.s / 4294967296.0 * (n - st.k)) as bigint)] when p = cast(floor(g.s / 4294967296.0 * (n - st.k)) as bigint) then l[n - st.k] else l[p + 1] end) from st join g on g.k = st.k + 1, c),
r as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as value from supplier)
select s_suppkey, place from r join (select unnest(range(n)) as place, unnest(l) as value from st, c where k = n - 1) using (value)""")
def shuffled(spark, d):
    return experiments.shuffled(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", SEED + 5)


#: Rounds of the UMAP layout in its query; t-SNE has its reference's.
EPOCHS = 6


def _evaluated(spark, d, method: str, **settings) -> DataFrame:
    out = experiments.evaluate(_vectors(spark, d), "vec_id", "embedding", 64, SEED + 3, partial(experiments.REDUCERS[method], **settings))
    return out.select("rows", "dims", *[F.round(c, 3).alias(c) for c in ("real", "control")], (F.col("real") > 0.5).alias("better_than_chance"))


@query()
def evaluated_umap(spark, d):
    return _evaluated(spark, d, "umap", epochs=EPOCHS)


@query()
def evaluated_tsne(spark, d):
    return _evaluated(spark, d, "tsne")


@query()
def shared_space(spark, d):
    placed = experiments.shared_space(_vectors(spark, d), "embedding", 64)
    return placed.select("vec_id", "label", *[F.round(F.get("embedding", F.lit(i)), 5).alias(c) for i, c in enumerate("xyz")])


@query()
def ellipsoids(spark, d):
    p = _vectors(spark, d).select("label", *[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
    e = matrix.ellipsoids(p, "label", ("x", "y", "z"))
    return e.select("label", *[F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("centre", "radii", "matrix")])


@query("""with p as (select label, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z from embeddings),
c as (select label, var_pop(x) xx, var_pop(y) yy, var_pop(z) zz, covar_pop(x, y) xy, covar_pop(x, z) xz, covar_pop(y, z) yz from p group by 1 having count(*) >= 4)
select label, round((xx + yy + zz) * 2.56, 5) as squares, round(sqrt(xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy) * 4.096, 5) as volume from c""")
def ellipsoid_invariants(spark, d):
    p = _vectors(spark, d).select("label", *[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
    r = matrix.ellipsoids(p, "label", ("x", "y", "z"))
    return r.select("label", F.round(scalar.total(F.transform("radii", lambda x: x * x)), 5).alias("squares"), F.round(F.aggregate("radii", F.lit(1.0), lambda s, x: s * x), 5).alias("volume"))


_FFT = SQL["fft_magnitude"].replace("round(sqrt(sum(x * cos(2 * pi() * k * b / 64)) ** 2 + sum(x * sin(2 * pi() * k * b / 64)) ** 2), 5)", "sqrt(sum(x * cos(2 * pi() * k * b / 64)) ** 2 + sum(x * sin(2 * pi() * k * b / 64)) ** 2)")


def _mel_values(size: int, rate: float) -> str:
    f = signal.mel_filters(size, rate)
    return ", ".join(f"({m}, {b}, {float(f[m, b])!r})" for m, b in zip(*np.nonzero(f)))


_MFCC = f"""mg as ({_FFT}), fl(m, bin, weight) as (values {_mel_values(64, 16000.0)}),
en as (select vec_id, m.m as m, ln(coalesce(sum(weight * magnitude * magnitude), 0) + 1e-12) as e from (select vec_id, unnest(range(26)) as m from embeddings) m left join fl on fl.m = m.m left join mg using (vec_id, bin) group by 1, 2),
cc as (select vec_id, n, sum(e * cos(pi() * n * (m + 0.5) / 26)) as c from en, (select unnest(range(13)) as n) group by 1, 2)"""


@query(f"with {_MFCC} select vec_id, n as coefficient, round(c, 4) as c from cc")
def mfcc_long(spark, d):
    m = signal.mfcc(_vectors(spark, d).select("vec_id", "embedding"), "embedding", 16000.0)
    return m.select("vec_id", F.posexplode("mfcc").alias("coefficient", "c")).select("vec_id", F.col("coefficient").cast("long").alias("coefficient"), F.round("c", 4).alias("c"))


@query(f"with {_MFCC} select label, n as coefficient, round(avg(c), 4) as mean, round(stddev_pop(c), 4) as deviation from cc join embeddings using (vec_id) group by 1, 2")
def mfcc_pooling(spark, d):
    m = signal.mfcc(_vectors(spark, d).select("vec_id", "label", "embedding"), "embedding", 16000.0)
    c = m.select("label", F.posexplode("mfcc").alias("coefficient", "c")).groupBy("label", F.col("coefficient").cast("long").alias("coefficient"))
    return c.agg(F.round(F.avg("c"), 4).alias("mean"), F.round(F.stddev_pop("c"), 4).alias("deviation"))


@query("""with p as (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as v, list_transform(lead(embedding) over (order by vec_id), lambda v: cast(v as double)) as w from embeddings where vec_id % 20 < 2)
select vec_id, round(list_dot_product(v, w) / ((sqrt(list_dot_product(v, v)) + 1e-9) * (sqrt(list_dot_product(w, w)) + 1e-9)), 6) as cosine, list_position(v, list_max(v)) - 1 as peak from p where vec_id % 20 = 0 and w is not null""")
def cosine_and_peak(spark, d):
    e = _vectors(spark, d).where("vec_id % 20 < 2")
    p = e.withColumn("w", F.lead("embedding").over(W.partitionBy(F.floor(F.col("vec_id") / 20)).orderBy("vec_id"))).where("vec_id % 20 = 0 and w is not null")
    return p.select("vec_id", F.round(scalar.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"), scalar.arg_max(F.col("embedding")).cast("long").alias("peak"))


def _linear():
    """A linear model of three labels over chunks of 16 samples, its weights from a rule."""
    import numpy as np

    weights = np.sin(np.outer(np.arange(1, 17), np.arange(1, 4)))
    return lambda chunks: chunks @ weights - 2


@query("""with c as (select vec_id, unnest(range(4)) as chunk, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings),
p as (select vec_id, chunk, x[chunk * 16 + 1 : chunk * 16 + 16] as x, list_max(list_transform(x[chunk * 16 + 1 : chunk * 16 + 16], lambda v: abs(v))) as peak from c),
l as (select *, unnest(range(3)) as label from p),
s as (select vec_id, chunk, label, 1 / (1 + exp(2 - case when peak > 1e-6 then least(50, 0.9e0 / peak) else 1 end * list_sum(list_transform(range(1, 17), lambda i: x[i] * sin(i * (label + 1)))))) as s from l)
select vec_id, chunk, chunk * 1.0e0 as start, label, round(s, 4) as confidence from s where s >= 0.03""")
def model_scores(spark, d):
    """A model as a table function: every chunk of every vector, taken as 64 samples."""
    inference.register_model(spark, "passerine_linear", 16, 1.0, _linear, "linear")
    _vectors(spark, d).select("vec_id", "embedding").createOrReplaceTempView("passerine_audio")
    return spark.sql("select vec_id, chunk, start, label, round(confidence, 4) as confidence from passerine_audio, lateral passerine_linear(embedding)")


@query("with s as (" + SQL["model_scores"].replace("round(s, 4) as confidence", "s as confidence") + """),
b as (select vec_id, label, max(confidence) as confidence, arg_min(chunk, (-round(confidence, 4), chunk)) as chunk from s group by 1, 2)
select vec_id, label, round(confidence, 4) as confidence, chunk * 1.0e0 as at, row_number() over (partition by vec_id order by round(confidence, 4) desc, label) as k from b qualify k <= 2""")
def model_detections(spark, d):
    """The two surest labels of each vector, from the same model in Arrow batches."""
    audio = _vectors(spark, d).select(F.col("vec_id").alias("audio_id"), "embedding")
    scores = inference.chunk_scores(audio, "embedding", 16, 1.0, _linear, "linear").withColumn("confidence", F.round("confidence", 4))
    best = inference.detections(scores, 2)
    w = W.partitionBy("audio_id").orderBy(F.desc("confidence"), "label")
    return best.select(F.col("audio_id").cast("long").alias("vec_id"), "label", "confidence", "at", F.row_number().over(w).cast("long").alias("k"))
