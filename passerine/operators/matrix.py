"""Statistics of a table of vectors: standardising, principal components, neighbour preservation.

Only dimension-by-dimension cells and per-dimension sums reach the driver, so
what it holds depends on the number of dimensions, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import half_up, top_labels
from ..sources.storage import written
from . import metric_index, scan

#: Up to so many dimensions all their products are added up; beyond, components come from a random range.
DENSE = 512
#: Passes for one width of the range at most, columns beyond those asked for, change of a share that ends it, merging tasks.
ROUNDS, MORE, SETTLED, MERGES = 30, 8, 1e-10, 8


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of squared deviations of several parts together."""
    n, mean, squares = parts[0]
    for m, other, more in parts[1:]:
        apart, whole = other - mean, n + m
        mean, squares, n = mean + apart * (m / whole), squares + more + apart * apart * (n * m / whole), whole
    return n, mean, squares


def _part(n: int, mean: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    wide = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean], wide), pa.array([squares], wide)], names=["n", "m", "s"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = None
    for batch in batches:
        if batch.num_rows:
            x = metric_index.stack(batch.column(0))
            mean = x.mean(axis=0)
            own = (len(x), mean, ((x - mean) ** 2).sum(axis=0))
            found = own if found is None else _merged([found, own])
    if found is not None:
        yield _part(*found)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(r["n"], np.array(r["m"]), np.array(r["s"])) for batch in batches for r in batch.to_pylist()]
    if parts:
        yield _part(*_merged(parts))


def moments(df: DataFrame, vec_col: str, dims: int) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each dimension (a deviation of 0 counts as 1); null vectors don't count.

    Each task adds up its vectors, ``MERGES`` tasks merge what they send, and the
    driver merges those: the plan is as small for 15,000 dimensions as for three.
    """
    kind = "n long, m array<double>, s array<double>"
    parts = df.select(vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(_partial, kind).repartition(MERGES).mapInArrow(_merge, kind).collect()
    if not dims or not parts:
        return [0.0] * dims, [1.0] * dims
    n, mean, squares = _merged([(r["n"], np.array(r["m"]), np.array(r["s"])) for r in parts])
    return mean.tolist(), [float(x) or 1.0 for x in np.sqrt(squares / n)]


def _mapped(df: DataFrame, vec_col: str, change) -> DataFrame:
    """``df`` with each vector replaced by a row of ``change(matrix)``; null vectors stay null."""
    at, names = df.columns.index(vec_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            some, out = column.drop_null(), pa.nulls(len(column), pa.list_(pa.float64()))
            if len(some):
                x = change(metric_index.stack(some))
                there = column.is_valid().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(there)]) * x.shape[1]
                out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], out, *batch.columns[at + 1 :]], names=names)

    kinds = dict(df.dtypes) | {vec_col: "array<double>"}
    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _scores(df: DataFrame, vec_col: str, dims: int):
    """What makes standard scores of a matrix of the table's vectors."""
    m, s = (np.array(x) for x in moments(df, vec_col, dims))
    return lambda x: (x - m) / s


def standardised(df: DataFrame, vec_col: str, dims: int) -> DataFrame:
    return _mapped(df, vec_col, _scores(df, vec_col, dims))


def _dots(x: np.ndarray, loadings: np.ndarray) -> np.ndarray:
    """Products of rows and columns, each a running sum, whatever rows come together."""
    out = np.zeros((len(x), loadings.shape[1]))
    for column, row in zip(x.T, loadings, strict=True):
        out += column[:, None] * row
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = metric_index.stack(batch.column(0))
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        i, j = np.divmod(np.arange(total.size), len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "x"])


def _range(rows: DataFrame, vec_col: str, basis: np.ndarray) -> np.ndarray:
    """X^T (X V) of all rows X: one pass; tasks send dims x width sums, ``MERGES`` tasks add them up."""
    shape = basis.shape
    wide = pa.list_(pa.float64())

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                x = metric_index.stack(batch.column(0))
                out, some = out + x.T @ (x @ basis), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], wide)], names=["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros(shape[0] * shape[1]), False
        for batch in batches:
            for row in batch.column(0):
                out, some = out + row.values.to_numpy(), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([out], wide)], names=["x"])

    sums = rows.select(vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(one, "x array<double>").repartition(MERGES).mapInArrow(add, "x array<double>").toArrow().column("x")
    return sum((row.values.to_numpy() for row in sums), np.zeros(shape[0] * shape[1])).reshape(shape)


def _subspace(rows: DataFrame, vec_col: str, dims: int, components: int | None, target: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest squared singular values of the rows, their directions, and the sum of all, by a randomised range.

    A seeded random basis goes through passes of X^T X, each made orthogonal, until
    the values asked for change by less than ``SETTLED``.  Without a number of
    components the basis doubles until it explains the target, so no number is a cap;
    products of all dimensions with each other are never formed.
    """
    squares = F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.where(F.col(vec_col).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum(squares).alias("s")).first()
    whole, most = facts["s"] or 0.0, max(1, min(dims, facts["n"]))
    width = min(most, (components or 24) + MORE)
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(dims, width)))[0]
    while True:
        before = None
        for _ in range(ROUNDS):
            passed = _range(rows, vec_col, basis)
            small = basis.T @ passed
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values = np.maximum(values[::-1], 0)
            k = components or int(np.searchsorted(np.cumsum(values) / (whole or 1.0), target) + 1)
            kept = values[: min(k, width)]
            if width == dims or before is not None and len(before) == len(kept) and np.all(np.abs(kept - before) <= SETTLED * (whole or 1.0)):
                break
            before, basis = kept, np.linalg.qr(passed)[0]
        if components or k <= max(width - MORE, 1) or width == most:
            return values, basis @ turn[:, ::-1], whole
        more = min(most, 2 * width) - width
        fresh = np.random.default_rng(width).normal(size=(dims, more))
        basis, width = np.linalg.qr(np.concatenate([basis, fresh], axis=1))[0], width + more


def principal_components(df: DataFrame, vec_col: str, dims: int, components: int | None = None, target: float = 0.95) -> tuple[DataFrame, list[float], np.ndarray]:
    """``df`` with vec_col replaced by its scores, the explained shares, and the loadings (dims x components).

    Vectors are standardised first.  Without a number of components, the first
    ones that explain ``target`` of the variance are taken.  A component's sign
    makes the sum of loading i times sin((i + 1) (c + 1)) positive.
    """
    scores = _scores(df, vec_col, dims)
    rows = _mapped(df, vec_col, scores)
    if dims > DENSE:
        values, vectors, whole = _subspace(rows, vec_col, dims, components, target)
    else:
        cells = rows.select(vec_col).mapInArrow(_products, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
        gram = np.zeros((dims, dims))
        for i, j, x in cells:
            gram[i, j] = x
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        whole = values.sum()
    share = values / (whole or 1.0)
    k = components or int(np.searchsorted(np.cumsum(share), target) + 1)
    k = min(k, dims, len(share))
    sines = np.sin(np.outer(np.arange(1, dims + 1), np.arange(1, k + 1)))
    loadings = vectors[:, :k] * np.where((vectors[:, :k] * sines).sum(axis=0) < 0, -1.0, 1.0)
    if dims > DENSE:
        return _mapped(rows, vec_col, lambda x: x @ loadings), [float(x) for x in share[:k]], loadings
    return _mapped(df, vec_col, lambda x: _dots(scores(x), loadings)), [float(x) for x in share[:k]], loadings


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, j, d of pairs i, j, v, v2: squared distances to 9 digits."""
    for batch in batches:
        if batch.num_rows:
            d = metric_index.exact(*[metric_index.stack(batch.column(c)) for c in (2, 3)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(d, 9))], names=["i", "j", "d"])


def trustworthiness(df: DataFrame, id_col: str, original: Column, embedded: Column, k: int = 5) -> DataFrame:
    """trustworthiness: one row; 1 less the scaled ranks by which embedded neighbours are not original ones.

    The k embedded neighbours of each point come from a metric index of the embedded
    vectors; how many points are as near in the original space is counted on an
    index of those, where whole rings are counted by their size.  Ties go by id.
    Points with a null vector in either space take no part.
    """
    rows = written(df.select(F.col(id_col).cast("long").alias("i"), original.alias("v"), embedded.alias("w")).where("v is not null and w is not null"))
    near = metric_index.nearest(metric_index.build(rows, "i", "w"), rows, "i", "w", k).select(F.col("q_id").alias("i"), F.col("id").alias("j"))
    ends = rows.select(F.col("i").alias("j"), F.col("v").alias("v2"))
    pairs = near.join(ends, "j").join(rows.select("i", "v"), "i").select("i", "j", "v", "v2").mapInArrow(_apart, "i long, j long, d double")
    marks = pairs.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("m"))
    marked = written(rows.select("i", "v").join(marks, "i").select("i", "v", F.col("m.d").alias("d"), F.col("m.j").alias("j")))
    ranks = metric_index.ranks(metric_index.build(rows, "i", "v"), marked, k)
    late = sum((F.greatest(F.col(f"r{c}") - k, F.lit(0)) for c in range(k)), F.lit(0))
    n = F.count(F.lit(1))
    return ranks.agg((1 - F.try_divide(F.lit(2.0), n * k * (2 * n - 3 * k - 1)) * F.sum(late)).alias("trustworthiness"))


def _scored(df: DataFrame, features: list[str], weights: dict[str, dict[str, float]]) -> tuple[dict[str, Column], list[Column]]:
    """Standard scores of the features over the whole set, and each category's weighted sum of them."""
    one = df.agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]).first()
    z = {f: F.lit(0.0) if not one[f]["s"] else (F.col(f) - one[f]["m"]) / one[f]["s"] for f in features}
    return z, [sum((z[f] * x for f, x in w.items()), F.lit(0.0)) for w in weights.values()]


def classified(df: DataFrame, id_col: str, features: list[str], weights: dict[str, dict[str, float]], temperature: float, labels: dict[str, str]) -> DataFrame:
    """id, category, confidence, scores (best first) and drivers: the up to three features that spoke for the category.

    Softmax of weighted standard scores; to 3 digits.  Ties go to what is named first.
    """
    df = written(df)
    z, scores = _scored(df, features, weights)
    each = [
        F.struct((-s).alias("s"), F.lit(k).alias("o"), F.lit(c).alias("id"), top_labels({labels[f]: F.round(z[f] * x, 9) for f, x in w.items()}, 3).alias("drivers"))
        for k, (s, (c, w)) in enumerate(zip(scores, weights.items(), strict=True))
    ]
    ordered = df.select(id_col, F.array_sort(F.array(*each)).alias("_s")).withColumn("_top", F.get("_s", F.lit(0))["s"])
    ordered = ordered.withColumn("_all", F.aggregate("_s", F.lit(0.0), lambda a, e: a + F.exp((F.col("_top") - e["s"]) / temperature)))
    share = lambda e: half_up(F.exp((F.col("_top") - e["s"]) / temperature) / F.col("_all"), 3)
    return ordered.select(
        id_col, F.get("_s", F.lit(0))["id"].alias("category"), half_up(1 / F.col("_all"), 3).alias("confidence"),
        F.transform("_s", lambda e: F.struct(e["id"].alias("id"), share(e).alias("probability"))).alias("scores"), F.get("_s", F.lit(0))["drivers"].alias("drivers"),
    )


def category_rollup(members: DataFrame, categories: list[str], id_col: str, confidence: str, position: list[str]) -> DataFrame:
    """One row for each category, empty ones too: n, members (surest first), mean_confidence (0 if empty), centre, representative.

    The representative is the member nearest to the centre, then the smallest id.
    """
    members = written(members)
    centre = members.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), *[F.avg(p).alias(f"c{p}") for p in position])
    far = sum(((F.col(p) - F.col(f"c{p}")) * (F.col(p) - F.col(f"c{p}")) for p in position), F.lit(0.0))
    placed = members.join(centre.select("category", *[f"c{p}" for p in position]), "category").groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct((-F.col(confidence)).alias("c"), F.col(id_col).alias("id")))).alias("m"), F.min_by(id_col, F.struct(F.round(far, 9), id_col)).alias("representative")
    )
    names = members.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    found = names.join(centre, "category", "left").join(placed, "category", "left")
    none = F.array().cast("array<string>")
    return found.select(
        "category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.transform("m", lambda e: e["id"].cast("string")), none).alias("members"),
        F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"), *[f"c{p}" for p in position], "representative",
    )


def category_members(members: DataFrame, id_col: str, confidence: str) -> DataFrame:
    """``members`` with place: from 1, surest first, then by id; a category of any size is ranked by all tasks.

    Ids and confidences are not null.
    """
    rows = scan.segmented(members.withColumn("_o", -F.col(confidence)), "_o")
    return scan.running_sum(rows, ["category"], ["_o", id_col], F.lit(1), "place").drop("_o", "_seg")


def with_shapes(cards: DataFrame, shapes: DataFrame, key: str = "category") -> DataFrame:
    """The cards that have members and an ellipsoid, with it."""
    return cards.where("n > 0").join(shapes, key)


def ellipsoids(points: DataFrame, key: str, position: tuple[str, str, str], sigma: float = 1.6) -> DataFrame:
    """key, centre, radii, matrix: the covariance ellipsoid of each group of four points or more.

    Covariances are grouped sums; only one small row of each group is decomposed.
    Radii ascend, and each axis points to its largest coefficient.  The matrix has
    4 x 4 numbers, column by column: the scaled axes, then the centre.
    """
    pairs = [(a, b) for k, a in enumerate(position) for b in position[k:]]
    sums = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(p).alias(f"m_{p}") for p in position], *[F.covar_pop(a, b).alias(f"v_{a}_{b}") for a, b in pairs]).where("n >= 4")
    rows = sums.select(key, F.array(*[f"m_{p}" for p in position]).alias("centre"), F.array(*[f"v_{a}_{b}" for a, b in pairs]).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            radii, matrices = [], []
            for centre, (xx, xy, xz, yy, yz, zz) in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                values, axes = np.linalg.eigh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]))
                axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
                r = sigma * np.sqrt(np.maximum(values, 1e-6))
                whole = np.eye(4)
                whole[:3, :3], whole[:3, 3] = axes * r, centre
                radii.append(r.tolist())
                matrices.append(whole.T.ravel().tolist())
            wide = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(radii, wide), pa.array(matrices, wide)], names=[key, "centre", "radii", "matrix"])

    return rows.mapInArrow(run, f"`{key}` {dict(points.dtypes)[key]}, centre array<double>, radii array<double>, matrix array<double>")


def category_scores(df: DataFrame, id_col: str, features: list[str], weights: dict[str, dict[str, float]], temperature: float) -> DataFrame:
    """id, category and probability of the best category: softmax of weighted standard scores over the whole set.

    A feature that does not vary counts 0; ties go to the category named first.
    """
    scored = df.select(id_col, F.array(*_scored(df, features, weights)[1]).alias("_s")).withColumn("_top", F.array_max("_s"))
    whole = F.aggregate("_s", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("_top")) / temperature))
    names = F.array(*[F.lit(c) for c in weights])
    return scored.select(id_col, F.element_at(names, F.array_position("_s", F.col("_top")).cast("int")).alias("category"), (1 / whole).alias("probability"))
