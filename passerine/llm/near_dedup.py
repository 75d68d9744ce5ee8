"""SimHash near-deduplication, verified at a five-word Jaccard similarity of 0.8.

Candidates are rows whose SimHash fingerprints, of five-word shingles, are within
``DISTANCE`` bits, found in partitions of correlated bits (``simhash.near_links``).
Pairs at the threshold differ in about ten bits of 64, more than such partitions
reach, so rows are candidates too that agree in a band of min-hashes of their shingle
sets: with ``BANDS`` bands of ``ROWS`` a pair at the threshold is missed by these with
a chance of 5 in 100,000, and a more similar one more rarely.  Every candidate is
verified on its whole set (of 64-bit shingle hashes) against all rows of the
component of rows that either way connects, whatever its size: one task takes a component
up to ``TOGETHER``, and a longer one is dealt out in pairs of blocks, which meet
all its pairs too.  A group returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .common import LAST_ID, checkpoint, release, with_row_number
from .components import connected_components

WORDS = 5
#: Bits in which fingerprints of candidates differ at most.
DISTANCE = simhash.DISTANCE
#: The similarity threshold, 4 / 5, as whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Bands of min-hashes, and how many make up a band.
BANDS, ROWS = 25, 5
#: Characters of text that are verified together: a longer component is verified in pairs of blocks, each half as long.
TOGETHER = 32 << 20


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, the empty text too."""
    import xxhash

    words = (text or "").encode().lower().split()
    line, starts = b" ".join(words), [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)], np.uint64).view(np.int64)
    return np.unique(np.array([digest(line[a : b - 1], 42) for a, b in zip(starts, starts[width:])], np.uint64).view(np.int64))


def _factors() -> np.ndarray:
    """One odd factor for each min-hash, from a fixed rule."""
    x = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(31)) | np.uint64(1)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A key for each band of each set: the least of its hashes under each of ``ROWS`` permutations, folded."""
    values = np.concatenate(sets).view(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k, f in enumerate(_factors()):
        least = np.minimum.reduceat(values * f, starts)
        key = (out[:, k // ROWS] ^ least) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k // ROWS] = key ^ key >> np.uint64(32)
    return out.view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingles: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.CHUNK):
        ones += np.unpackbits(hashes[at : at + simhash.CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, band, h: a row's fingerprint under band -1, and its keys."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            sets = [shingles(t.as_py()) for t in part.column(1)]
            keys = np.column_stack([np.array([fingerprint(s) for s in sets], np.int64), bands(sets)])
            row = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS + 1)
            band = np.tile(np.arange(-1, BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(band), pa.array(keys.ravel())], names=["row", "band", "h"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = pa.array([shingles(t.as_py()) for t in part.column(4)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], sets], names=[*part.schema.names[:4], "set"])


def _forest(rows: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within the threshold.

    A member meets those that share one of its first shingles in the group's own
    order, the rare ones first, and each of them only until it is linked.
    """
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    values, at_value, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(rows)), size)
    order = np.lexsort((at_value, counts[at_value], member))
    head = order[np.arange(len(order)) - np.repeat(ends - size, size) <= np.repeat(size - -(-size * NUMERATOR // DENOMINATOR), size)]
    own = np.searchsorted(member[head], np.arange(len(rows) + 1))
    by_value = np.argsort(at_value[head], kind="stable")
    holders, first = member[head][by_value], np.searchsorted(at_value[head][by_value], np.arange(len(values) + 1))
    left, edges = np.ones(len(rows), bool), []
    mark = np.zeros(len(values), np.int64)
    while left.any():
        front = [int(np.flatnonzero(left)[0])]
        left[front[0]] = False
        while front and left.any():
            at = front.pop()
            seen = np.zeros(len(rows), bool)
            for v in at_value[head[own[at] : own[at + 1]]].tolist():
                seen[holders[first[v] : first[v + 1]]] = True
            rest = np.flatnonzero(seen & left & (np.minimum(size, size[at]) * DENOMINATOR >= np.maximum(size, size[at]) * NUMERATOR))
            mine = at_value[ends[at] - size[at] : ends[at]]
            mark[mine] = 1
            both = np.array([mark[at_value[ends[x] - size[x] : ends[x]]].sum() for x in rest], np.int64)
            mark[mine] = 0
            near = rest[both * DENOMINATOR >= (size[rest] + size[at] - both) * NUMERATOR]
            left[near] = False
            edges += [(rows[at], rows[x]) for x in near]
            front += near.tolist()
    return edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(members: dict) -> pa.RecordBatch:
        edges = _forest(list(members), list(members.values())) if len(members) > 1 else []
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    members, last = {}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "i", "j")], axis=1)
        rows, sets = batch.column("row").to_pylist(), batch.column("set")
        cut = [0, *(np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1).tolist(), len(group)]
        for a, b in pairwise(cut):
            if last is not None and tuple(group[a]) != last:
                yield flush(members)
                members = {}
            last = tuple(group[a])
            for k in range(a, b):
                members[rows[k]] = sets[k].values.to_numpy(zero_copy_only=False)
    if members:
        yield flush(members)


def candidates(texts: DataFrame) -> DataFrame:
    """node, component: rows (columns row, text) that near fingerprints or shared bands connect; a row that has neither is left out."""
    index = checkpoint(texts.mapInArrow(_keys, "row long, band int, h long"))
    prints = index.where("band < 0").select("row", F.col("h").alias("fp"))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("row").alias("least")))
    end = lambda c: classes.select(F.col("fp").alias(f"{c}_fp"), F.col("least").alias(c))
    near = simhash.near_links(classes.select("fp"), DISTANCE).select(F.col("u").alias("u_fp"), F.col("v").alias("v_fp"))
    alike = near.join(end("u"), "u_fp").join(end("v"), "v_fp").select("u", "v")
    equal = prints.join(classes, "fp").where("row <> least").select(F.col("row").alias("u"), F.col("least").alias("v"))
    buckets = index.where("band >= 0").groupBy("band", "h").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("a"), F.bit_xor(F.xxhash64("row")).alias("c"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("d")
    ).where("n > 1")
    # of the buckets with the same members one is enough
    once = buckets.groupBy("n", "a", "c", "d").agg(F.min(F.struct("band", "h")).alias("k")).select("k.band", "k.h", "a")
    shared = index.join(once, ["band", "h"]).select(F.col("row").alias("u"), F.col("a").alias("v"))
    held = checkpoint(shared.unionByName(alike).unionByName(equal))
    release(index, classes)
    parts = checkpoint(connected_components(held).distinct())
    release(held)
    return parts


def verified(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """u, v: links that connect the same rows as all pairs within the threshold in a component do."""
    lengths = texts.select("row", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    sizes = parts.join(lengths, parts["node"] == lengths["row"]).groupBy("component").agg(F.sum("n").alias("n"))
    blocks = F.when(F.col("n") <= TOGETHER, 1).otherwise(F.ceil(2 * F.col("n") / TOGETHER)).cast("int")
    dealt = parts.join(sizes, "component").select(F.col("node").alias("row"), F.col("component").alias("h"), blocks.alias("blocks"))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    ways = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("s", k).alias("i"), F.greatest("s", k).alias("j")))
    dealt = dealt.select("row", "h", F.explode(ways).alias("p")).select("row", "h", "p.i", "p.j").join(texts, "row")
    sets = dealt.select("row", "h", "i", "j", "text").mapInArrow(_sets, "row long, h long, i int, j int, set array<long>")
    return sets.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_verify, "u long, v long")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies: that of the smallest id, null last, then the first row.

    Groups are the components of the pairs within the threshold.  Rows are told
    apart by a row number, so rows with one id are separate documents.  Null and
    empty texts are alike: one of them stays.  A very long text is read whole; an
    empty table stays empty; other columns are kept as they are.
    """
    rows, name = with_row_number(docs)
    texts = rows.select(F.col(name).alias("row"), F.col(text_col).alias("text"))
    parts = checkpoint(connected_components(verified(texts, candidates(texts))).distinct())
    ids = rows.select(F.col(name).alias("node"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(id_col).isNull().alias("none"))
    named = parts.join(ids, "node")
    first = named.groupBy("component").agg(F.min(F.struct("none", "id", "node")).alias("m")).select(F.col("m.node").alias("node"))
    drop = named.join(first, "node", "left_anti").select(F.col("node").alias(name))
    return rows.join(drop, name, "left_anti").select(*docs.columns)
