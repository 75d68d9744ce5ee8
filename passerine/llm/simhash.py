"""SimHash near-deduplication by the generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits.  Two fingerprints
within ``DISTANCE`` bits agree to within ``t`` bits in some partition whenever
the partitions' (t + 1) add up to ``DISTANCE + 1``; a dynamic program chooses
these unequal thresholds so that the estimated number of probes and candidates
is least.  Candidates are verified on the whole fingerprint, bucket by bucket;
a bucket returns a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint
from .components import connected_components

DISTANCE = 3
#: A bucket with more fingerprints is verified in pairs of blocks of this size.
BLOCK = 2048
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 16
#: Cost of verifying a candidate, as a multiple of the cost of a probe.
VERIFY = 10


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, starts = b" ".join(words), [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, 42)
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = np.array([digest(line[a : b - 1], 42) for a, b in zip(starts[at:to], starts[at + width : to + width])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long): one row per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _co_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
        for at in range(0, len(raw), CHUNK):
            bits = np.unpackbits(raw[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j (64 x 64), over all of them."""
    cells = fps.select("fp").mapInArrow(_co_occurrence, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((64, 64))
    for i, j, n in cells.collect():
        both[i, j] = n
    return fps.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups: each group is filled with the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(scale, scale)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 * (k + 1) // parts - 64 * k // parts
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left -= set(group)
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def agreement(n: int, both: np.ndarray, bits: list[int]) -> list[float]:
    """For each bit of a group, the chance that two fingerprints agree in it, given that they agree in the bit it depends on most.

    The counts of pairs of bits give the chance to agree in both of them; a group
    is a tree of such pairs, the first bit its root.
    """
    p11 = both / max(n, 1)
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    joint = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
    alone = p * p + (1 - p) * (1 - p)
    gain = joint / np.outer(alone, alone)
    out, used = [float(np.clip(alone[bits[0]], 1e-9, 1 - 1e-9))], [bits[0]]
    left = set(bits[1:])
    while left:
        b, on = max(((b, u) for b in sorted(left) for u in used), key=lambda x: gain[x])
        out.append(float(np.clip(joint[b, on] / alone[on], 1e-9, 1 - 1e-9)))
        used.append(b)
        left.discard(b)
    return out


def allocate(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold 0 or 1) of the partitions to probe, by dynamic programming on estimated candidates.

    The estimate is the chance that two fingerprints agree in a partition, or
    differ in one bit of it, with the bits' dependence on each other.
    """
    best: tuple[float, list] = (np.inf, [])
    for parts in range((distance + 2) // 2, distance + 2):
        plans: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for bits in group_bits(n, both, parts):
            same = np.array(agreement(n, both, bits))
            agree = float(np.prod(same))
            one_off = agree * float(np.sum((1 - same) / same))
            costs = {
                0: (0.0, []),
                1: (n * 1.0 + VERIFY * n * n / 2 * agree, [(bits, 0)]),
                2: (n * (2 + len(bits) / 2) + VERIFY * n * n / 2 * (agree + one_off), [(bits, 1)]),
            }
            new: dict[int, tuple[float, list]] = {}
            for had, (cost, chosen) in plans.items():
                for gain, (more, part) in costs.items():
                    to = min(distance + 1, had + gain)
                    if to not in new or cost + more < new[to][0]:
                        new[to] = (cost + more, chosen + part)
            plans = new
        if distance + 1 in plans and plans[distance + 1][0] < best[0]:
            best = plans[distance + 1]
    return [(sum(1 << b for b in bits), t) for bits, t in best[1]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(parts: list[tuple[int, int]]) -> tuple[Column, Column]:
    """Exact keys of a fingerprint, and its probes: keys with one set bit cleared."""
    fp = F.col("fp")
    entry = lambda k, key: F.struct(F.lit(k).cast("byte").alias("part"), key.alias("key"))
    exact = [entry(k, fp.bitwiseAND(F.lit(_signed(mask)))) for k, (mask, _) in enumerate(parts)]
    probes = [
        F.when(fp.bitwiseAND(F.lit(_signed(1 << b))) != 0, entry(k, fp.bitwiseAND(F.lit(_signed(mask & ~(1 << b))))))
        for k, (mask, t) in enumerate(parts)
        if t
        for b in range(64)
        if mask >> b & 1
    ]
    return F.array(*exact), F.array_compact(F.array(*probes)) if probes else F.array().cast("array<struct<part:byte,key:long>>")


def _forest(fps: np.ndarray, exact: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between exact members and all members of a bucket."""
    todo, edges = fps.view(np.uint64), []  # the bit count of a negative number would be that of its absolute value
    left = np.ones(len(fps), bool)
    while left.any():  # breadth first; each member is taken from ``left`` once and compared with what is left
        front = [int(np.flatnonzero(left)[0])]
        left[front[0]] = False
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(todo[rest] ^ todo[at]) <= distance]
            if not exact[at]:
                near = near[exact[near]]
            left[near] = False
            edges += [(int(fps[at]), int(fps[x])) for x in near]
            front += near.tolist()
    return edges


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cols) -> pa.RecordBatch:
            group, fp, exact = (np.concatenate(c) for c in zip(*cols, strict=True))
            cut = [0, *(np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1).tolist(), len(fp)]
            edges = []
            for a, b in pairwise(cut):
                if b - a > 1:
                    one, at = np.unique(fp[a:b], return_index=True)
                    edges += _forest(one, np.isin(one, fp[a:b][exact[a:b]]), distance)
            pairs = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "key", "i", "j")], axis=1)
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            exact = batch.column("exact").to_numpy(zero_copy_only=False)
            # the last group of a batch may go on in the next
            changes = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1))
            if last is not None and np.any(group[0] != last):
                yield flush(held)
                held = []
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield flush([*held, (group[:cut], fp[:cut], exact[:cut])])
                held = []
            held.append((group[cut:], fp[cut:], exact[cut:]))
            last = group[-1]
        if held:
            yield flush(held)

    return run


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: links that connect the same distinct fingerprints (column fp) as all links within ``distance`` do."""
    n, both = bit_statistics(fps)
    parts = allocate(n, both, distance)
    exact_keys, probe_keys = _keys(parts)
    exact = fps.select("fp", F.explode(exact_keys).alias("e")).select("e.part", "e.key", "fp")
    probes = fps.select("fp", F.explode(probe_keys).alias("e")).select("e.part", "e.key", "fp")
    sizes = exact.groupBy("part", "key").count()
    found = probes.join(sizes.select("part", "key"), ["part", "key"], "left_semi").withColumn("exact", F.lit(False))
    rows = checkpoint(exact.withColumn("exact", F.lit(True)).unionByName(found))
    many = rows.groupBy("part", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    held = rows.join(many, ["part", "key"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = held.select(
        "part", "key", "fp", "exact",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("b", k).alias("i"), F.greatest("b", k).alias("j")))).alias("p"),
    ).select("part", "key", "p.i", "p.j", "fp", "exact")
    dealt = paired.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return dealt.mapInArrow(_verify(distance), "u long, v long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    A null or empty text has fingerprint zero and is linked like any other.
    Equal fingerprints are one class from the start, so copies are not compared;
    the classes' links are found, and component_id is the smallest non-null id
    of the component.  Rows with equal ids are separate documents; a null id
    joins its class.  Other columns are not looked at.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(near_links(classes.select("fp"), distance))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "least"
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = checkpoint(named.join(least, "component").select("fp", "component_id"))
    return prints.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
