"""Hard-negative mining: product quantisation with stored residual norms, and an exact integer rerank.

A vector is a code for each pair of dimensions and the norm of what the codes
leave.  The score of an anchor and a row is the sum of one table entry a code,
give or take the product of the anchor's and the residual's norm.  A row whose
bounds can't put it into an anchor's answer is left out; the others are scored
exactly, in whole numbers, so the answer is exact at any quality of the codes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import LAST_ID, checkpoint, release, with_row_number

#: Dimensions of a code; centroids of a code; rows that the centroids are fitted on at most; rounds of the fit.
WIDTH, CENTROIDS, FIT_ROWS, ROUNDS = 2, 256, 4096, 8
#: Anchors and rows that meet in one step; anchors whose tables are held at once.
ANCHORS, ROWS, TABLES = 1024, 4096, 64
#: Components must be smaller than this, so that all scores are whole in double precision.
LARGEST = 1 << 20


def _subspaces(x: np.ndarray) -> np.ndarray:
    """rows x codes x WIDTH, the last code filled up with zeros."""
    n, dims = x.shape
    codes = max(1, -(-dims // WIDTH))
    return np.pad(x, ((0, 0), (0, codes * WIDTH - dims))).reshape(n, codes, WIDTH)


def _closest(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The code of each part: its nearest centroid, the first of equally near ones."""
    return np.argmin((book**2).sum(axis=1)[None, :] - 2 * parts @ book.T, axis=1)


def fit_codebooks(sample: np.ndarray) -> np.ndarray:
    """codes x CENTROIDS x WIDTH centroids in whole numbers, by Lloyd's rounds from evenly spaced rows of the sample."""
    parts = _subspaces(sample.astype(np.float64))
    books = np.zeros((parts.shape[1], CENTROIDS, WIDTH))
    for s in range(parts.shape[1]):
        distinct = np.unique(parts[:, s], axis=0)
        if not len(distinct):
            continue
        book = distinct[np.linspace(0, len(distinct) - 1, CENTROIDS).astype(int)]
        for _ in range(ROUNDS):
            code = _closest(parts[:, s], book)
            count = np.bincount(code, minlength=CENTROIDS)
            sums = np.stack([np.bincount(code, parts[:, s, w], CENTROIDS) for w in range(WIDTH)], axis=1)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
        books[s] = np.rint(book)
    return books


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x codes, one byte each) and the norms of the residuals."""
    parts = _subspaces(x.astype(np.float64))
    codes = np.stack([_closest(parts[:, s], books[s]) for s in range(len(books))], axis=1).astype(np.uint8)
    rest = parts - books[np.arange(len(books))[None, :], codes]
    return codes, np.sqrt((rest**2).sum(axis=(1, 2)))


def score_bounds(anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of anchors x rows inner products: table sums give or take the product of both norms."""
    parts = _subspaces(anchors.astype(np.float64))
    sums = np.zeros((len(anchors), len(codes)))
    for s in range(len(books)):
        sums += (parts[:, s] @ books[s].T)[:, codes[:, s]]
    reach = np.sqrt((parts**2).sum(axis=(1, 2)))[:, None] * norms[None, :] * (1 + 1e-9) + 1e-6
    return sums - reach, sums + reach


def _cells(block: pa.StructArray, name: str) -> np.ndarray:
    column = block.field(name)
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(block), -1)


def _bytes(block: pa.StructArray, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(block.field(name).to_pylist()), np.uint8).reshape(len(block), -1)


def _first(score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids, then rows."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((row[some], ids[some], -score[some]))[:k]]


def _met(anchors: DataFrame, index: DataFrame, n_anchors: int, n_rows: int, step: Callable, schema: str) -> DataFrame:
    """``step(anchor block, row block)`` for all blocks; each pair of blocks is a key of its own, so none is hot."""
    na, nb = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    pack = lambda df, n, b, to: df.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(b)).agg(F.collect_list(F.struct(*df.columns)).alias(to))
    times = lambda n, b: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(b)
    left = pack(anchors, na, "a", "anchors").select("a", times(nb, "b"), "anchors")
    right = pack(index, nb, "b", "rows").select(times(na, "a"), "b", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from step(*[batch.column(c).slice(i, 1).flatten() for c in ("anchors", "rows")])

    return left.join(right.hint("shuffle_hash"), ["a", "b"]).select("anchors", "rows").mapInArrow(run, schema)


def _step(books: np.ndarray, schema: pa.Schema, answer: Callable):
    """Bounds of all anchors of a block against its rows, a few tables at a time; ``answer`` picks and scores."""
    def step(q: pa.StructArray, b: pa.StructArray) -> Iterator[pa.RecordBatch]:
        a, x = _cells(q, "v").astype(np.float64), _cells(b, "v").astype(np.float64)
        codes, norms = _bytes(b, "codes"), b.field("norm").to_numpy()
        base = {c: b.field(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "label")}
        out = []
        for at in range(0, len(q), TABLES):
            low, high = score_bounds(a[at : at + TABLES], codes, norms, books)
            for k in range(len(low)):
                out += answer(q[at + k], a[at + k], x, base, low[k], high[k])
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return step


def _positives(most: int):
    def answer(anchor, a, x, base, low, high):
        own = (base["label"] == anchor["label"].as_py()) & (base["row"] != anchor["row"].as_py())
        if own.sum() > most:
            own &= high >= np.partition(low[own], own.sum() - most)[own.sum() - most]
        at = np.flatnonzero(own)
        score = x[at] @ a
        return [{"row": anchor["row"].as_py(), "id": int(base["id"][at[k]]), "other": int(base["row"][at[k]]), "score": int(score[k])} for k in _first(score, base["id"][at], base["row"][at], most)]

    return answer


def _negatives(most: int, least_share: int, most_share: int):
    def answer(anchor, a, x, base, low, high):
        foreign, out, exact = base["label"] != anchor["label"].as_py(), [], np.full(len(low), np.nan)
        for k, p in enumerate(anchor["scores"].as_py()):
            floor, ceiling = -(-least_share * p // 100), most_share * p // 100
            may = foreign & (high >= floor) & (low <= ceiling)
            sure = low[foreign & (low >= floor) & (high <= ceiling)]
            if len(sure) > most:
                may &= high >= np.partition(sure, len(sure) - most)[len(sure) - most]
            at = np.flatnonzero(may)
            new = at[np.isnan(exact[at])]
            exact[new] = x[new] @ a
            at = at[(exact[at] >= floor) & (exact[at] <= ceiling)]
            score = exact[at]
            out += [{"row": anchor["row"].as_py(), "k": k, "id": int(base["id"][at[j]]), "other": int(base["row"][at[j]]), "score": int(score[j])} for j in _first(score, base["id"][at], base["row"][at], most)]
        return out

    return answer


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "vector", positives: int = 5, negatives: int = 10, least_share: int = 30, most_share: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    ``vec_col`` holds whole numbers; a score is an inner product.  An anchor's
    positives are its best rows of its label; a positive's negatives are the best
    rows of other labels with a score from ``least_share`` to ``most_share`` percent
    of the positive's.  Ties go to the smaller id, a null id last, then to the
    earlier row; repeated rows are rows of their own, and an anchor is no positive of
    itself.  Rows with a null label, a null vector or a null component take no part;
    a shorter vector goes on with zeros, an empty one scores 0 everywhere.  A
    positive score below zero, and one without rows in its window, has no negatives.
    No rows or no anchors give an empty table; other columns are not looked at.  A
    component of 2**20 or more is an error, as scores would not be whole.
    """
    slim = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<long>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    numbered, number = with_row_number(slim.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda c: c.isNull()), F.lit(False))))
    facts = numbered.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    if (facts["largest"] or 0) >= LARGEST:
        raise ValueError(f"components must be smaller than {LARGEST}; one has the size {facts['largest']}")
    dims = max(1, facts["dims"] or 0)
    full = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))).cast("array<int>")
    whole = numbered.select(F.col(number).alias("row"), "id", "label", "anchor", full.alias("v"))
    sample = whole.orderBy(F.xxhash64("row")).limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    books = fit_codebooks(sample.flatten().to_numpy().reshape(-1, dims))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, norms = encode(batch.column("v").flatten().to_numpy().reshape(-1, dims), books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=[*batch.schema.names, "codes", "norm"])

    index = checkpoint(whole.mapInArrow(quantise, "row long, id long, label long, anchor boolean, v array<int>, codes binary, norm double"))
    release(numbered)
    base, heads = index.drop("anchor"), index.where("anchor").select("row", "id", "label", "v")
    kind = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
    met = _met(heads.drop("id"), base, facts["anchors"], facts["n"], _step(books, kind, _positives(positives)), "row long, id long, other long, score long")
    best = W.partitionBy("row").orderBy(F.desc("score"), "id", "other")
    found = met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives)
    pairs = checkpoint(found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((F.col("k") - 1).alias("k"), "id", "score"))).alias("p")))
    asked = heads.join(pairs, "row").select("row", "label", "v", F.col("p.score").alias("scores"))
    kind = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
    met = _met(asked, base, facts["anchors"], facts["n"], _step(books, kind, _negatives(negatives, least_share, most_share)), "row long, k int, id long, other long, score long")
    best = W.partitionBy("row", "k").orderBy(F.desc("score"), "id", "other")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = pairs.join(heads.select("row", F.col("id").alias("anchor")), "row").select("row", "anchor", F.inline("p")).withColumnsRenamed({"id": "positive", "score": "positive_score"})
    back = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return ranked.join(named, ["row", "k"]).select(
        back("anchor").alias("anchor_id"), back("positive").alias("positive_id"), "rank", back("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
