"""Registered queries of clusters and density clouds, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import clusters
from .queries import SQL, QUERIES, _vectors, query
from .vector_queries import _XYZ, _points

#: Bandwidth of the density cloud, in the units of the positions.
WIDTH = 0.1


@query("""with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings where label is not null),
p as (select a.vec_id, a.label, b.label as c, sum(list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k])))) as d, count(*) as n from e a join e b on a.vec_id <> b.vec_id group by 1, 2, 3),
s as (select vec_id, label, max(case when c = label then d / n end) as own, min(case when c <> label then d / n end) as other from p group by 1, 2)
select vec_id, label, round(own, 6) as own, round(other, 6) as other, round((other - own) / greatest(own, other), 6) as silhouette from s""")
def silhouettes(spark, d):
    found = clusters.silhouettes(_vectors(spark, d), "vec_id", "label", "embedding")
    return found.select("vec_id", "label", *[F.round(c, 6).alias(c) for c in ("own", "other", "silhouette")])


@query(f"""with k as ({SQL['category_scores']}), c as (select label, category, count(*) as n from k join embeddings using (vec_id) group by 1, 2),
s as (select sum(n) as n, sum(n * (n - 1) / 2) as b from c), x as (select sum(n * (n - 1) / 2) as x from (select sum(n) as n from c group by label)), y as (select sum(n * (n - 1) / 2) as y from (select sum(n) as n from c group by category))
select cast(n as bigint) as rows, round((b - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) as adjusted_rand from s, x, y""")
def label_agreement(spark, d):
    both = QUERIES["category_scores"](spark, d).join(_vectors(spark, d).select("vec_id", "label"), "vec_id")
    return clusters.adjusted_rand(both, "label", "category").select("rows", F.round("adjusted_rand", 6).alias("adjusted_rand"))


_CELL = ", ".join(f"floor({c} / (0.25e0 * {WIDTH}e0)) as c{c}" for c in "xyz")



def _spread(c: str) -> str:
    """One axis of the nodes around a cell; a row for each."""
    return f"unnest(range(cast(ceil(m{c} / {WIDTH}e0 - 4) as bigint), cast(floor(m{c} / {WIDTH}e0 + 4) as bigint) + 1)) as n_{c}"


@query(f"""with p as (select label, {_XYZ} from embeddings), q as (select *, {_CELL} from p),
c as (select label, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) + var_pop(y) + var_pop(z) as v from q group by label, cx, cy, cz),
a as (select *, {_spread('x')} from c), b as (select *, {_spread('y')} from a), g as (select *, {_spread('z')} from b),
f as (select *, (n_x * {WIDTH}e0 - mx) ** 2 + (n_y * {WIDTH}e0 - my) ** 2 + (n_z * {WIDTH}e0 - mz) ** 2 as far from g),
k as (select label, n_x, n_y, n_z, sum(n * exp(-far / {2 * WIDTH * WIDTH!r}e0)) as k, sum(n * v) / {2 * WIDTH * WIDTH!r}e0 as e, sum(n) as n from f where far <= {(4 * WIDTH) ** 2!r}e0 group by 1, 2, 3, 4),
t as (select label, count(*) as total from p group by 1)
select k.label, n_x, n_y, n_z, round(k / (total * {(2 * math.pi) ** 1.5 * WIDTH**3!r}), 5) as density,
round((e + (total - n) * {math.exp(-((4 - math.sqrt(3) * 0.25) ** 2) / 2)!r}) / (total * {(2 * math.pi) ** 1.5 * WIDTH**3!r}), 5) as bound from k join t on k.label is not distinct from t.label""")
def density_cloud(spark, d):
    found = clusters.density(_points(spark, d), ["label"], "xyz", WIDTH)
    return found.withColumns({c: F.round(c, 5) for c in ("density", "bound")})
