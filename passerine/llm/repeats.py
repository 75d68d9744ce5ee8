"""Repeated windows of consecutive symbols: the machinery of operators 3 and 8.

A symbol is a byte or a word.  The least gram of a window, by hash, is its
anchor; windows with one anchor make up one bucket, and equal windows are in one
bucket at one place.  The longest run of a text's consecutive windows around one
anchor is a compacted path of them, here a *block*: 5 to 85 windows in one row.

1. ``anchor_rows``: anchors that occur once in the table are set aside.
2. ``block_rows``: equal blocks meet by the digests of anchor and content; a
   block that is alone around its anchor is settled by that.
3. ``context_rows``: of the other blocks, one copy of each goes to its bucket with
   its symbols, where ``settle`` compares them symbol by symbol.
4. ``covers``: what was found goes back to the source coordinates in each text.

``settle`` merges the sorted shards of a bucket.  Its contexts start as one block
of an interleave; round by round, each block that is not yet split is refined by
the next symbols, and the round in which two neighbours part is their common
prefix; no context is compared twice on the same symbols.  The same is done to
the symbols that precede the anchors, the column of a Burrows-Wheeler transform,
going left.  A window of ``o`` symbols before and ``size - o`` after its anchor
is an interval of both interleaves, cut at these common prefixes.

Texts are taken in units of ``UNIT`` symbols, so a long text needs no more memory
in numpy than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LAST_ID, checkpoint, release, text_or_empty

#: A bucket with more distinct contexts than this is settled window by window, in a shuffle of its own.
HOT = 4096
#: Symbols of a unit, at least; bytes whose words are hashed at a time.
UNIT = 1 << 17
#: Contexts that are settled at a time.
HELD = 1 << 15
_LOW = np.uint64((1 << 20) - 1)
_GRAM, _RUN, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


@dataclass(frozen=True)
class Kind:
    """Windows of ``size`` symbols with anchors of ``gram`` symbols (a power of two)."""

    size: int
    gram: int
    words: bool

    @property
    def offsets(self) -> int:
        """Windows that one anchor can have."""
        return self.size - self.gram + 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GRAM))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, in one array, and where each text starts (one more at the end)."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each text (one more at the end)."""
    gap = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edges = at[1:-1]
    before[edges[edges < len(data)]] = True
    after[edges[edges > 0] - 1] = True
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, a = np.zeros(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + UNIT)))
        lo, hi = int(starts[a]), int(ends[b - 1])
        part = data[lo:hi]
        mark = np.zeros(hi - lo, np.int64)
        mark[starts[a:b] - lo] = 1
        place = np.arange(hi - lo) - (starts[a:b] - lo)[np.cumsum(mark) - 1]
        value = _BYTE[part] * _powers(_WORD, 1 << max(8, int(place.max()).bit_length()))[place]
        value[_SPACE[part]] = 0
        out[a:b] = np.add.reduceat(value, starts[a:b] - lo)
        a = b
    return mix(out + (ends - starts).astype(np.uint64))


def _doubled(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == n else np.minimum(x[: len(x) - (n - size)], x[n - size :])


def _units(at: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """First text, last text + 1, first symbol, last symbol + 1; a long text is cut at its own multiples of UNIT."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + UNIT, "right")) - 1)
        if j > i + 1 or at[j] - at[i] <= UNIT:
            yield i, j, int(at[i]), int(at[j])
        else:
            for lo in range(int(at[i]), max(int(at[i]) + 1, int(at[j]) - size + 1), UNIT):
                yield i, j, lo, min(int(at[j]), lo + UNIT + size - 1)
        i = j


@dataclass
class Blocks:
    """Blocks of some texts: text, first and last window, anchor (all places among the symbols), and digests."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    block: np.ndarray


def _unit(sym: np.ndarray, ends: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """first, last, place, anchor, block of a unit; ends: of its texts."""
    n = len(sym) - kind.size + 1
    g, size, base = sym, 1, _GRAM
    while size < kind.gram:
        g = g[:-size] * np.uint64(base) + g[size:]
        base, size = base * base % (1 << 64), size * 2
    g = mix(g)
    least = _doubled(g & ~_LOW | np.arange(len(g), dtype=np.uint64), kind.offsets)
    place = (least & _LOW).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    full = ends - begins >= kind.size
    mark = np.zeros(n + 1, np.int32)
    mark[begins[full]] = 1
    mark[np.minimum(ends[full] - kind.size + 1, n)] -= 1
    inside = np.cumsum(mark[:-1]) > 0
    change = np.ones(n + 1, bool)
    change[1:-1] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    first, last = np.flatnonzero(change[:-1] & inside), np.flatnonzero(change[1:] & inside)
    place = place[first]
    sums = np.zeros(len(sym) + 1, np.uint64)
    powers = _powers(_RUN, UNIT * 2 + kind.size)
    np.cumsum(sym * powers[: len(sym)], out=sums[1:])
    length = last - first + kind.size
    # sums of runs at different places are made alike by a common highest power
    run = (sums[first + length] - sums[first]) * powers[len(powers) - 1 - first]
    return first, last, place, g[place], mix(run + length.astype(np.uint64) * np.uint64(_WORD))


def blocks_of(sym: np.ndarray, at: np.ndarray, kind: Kind) -> Blocks:
    parts = []
    for i, j, lo, hi in _units(at, kind.size):
        if hi - lo >= kind.size:
            ends = np.minimum(at[i + 1 : j + 1], hi) - lo
            part = sym[lo:hi] if kind.words else _BYTE[sym[lo:hi]]
            first, last, place, anchor, block = _unit(part, ends, kind)
            parts.append((i + np.searchsorted(ends, first, "right"), first + lo, last + lo, place + lo, anchor.view(np.int64), block.view(np.int64)))
    if not parts:
        return Blocks(*[np.zeros(0, np.int64)] * 6)
    return Blocks(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of a column in pieces of about 8 MB of text, or of one longer text."""
    sizes = np.cumsum(np.concatenate([[0], np.diff(np.frombuffer(column.cast(pa.large_binary()).buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1])]))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + (8 << 20), "right")) - 1)
        yield a, b
        a = b


def symbols_of(column: pa.Array, kind: Kind):
    """Symbols, where each text starts, the bytes, and the words' starts and ends (None for bytes)."""
    data, at = texts_of(column)
    if not kind.words:
        return data, at, data, None, None
    starts, ends, at = word_spans(data, at)
    return word_hashes(data, starts, ends), at, data, starts, ends


def _once(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first row of each distinct key, and how many rows have it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def anchor_rows(kind: Kind):
    """Of rows (text): anchor, n; an anchor's places are counted batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                sym, at, *_ = symbols_of(batch.column(0).slice(a, b - a), kind)
                found, n = np.unique(blocks_of(sym, at, kind).anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["anchor", "n"])

    return run


def block_rows(kind: Kind):
    """Of rows (doc, h, text): anchor, block, doc, h, n, once for each block of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h = (batch.column(c).to_numpy() for c in (0, 1))
            for a, b in pieces(batch.column(2)):
                sym, at, *_ = symbols_of(batch.column(2).slice(a, b - a), kind)
                found = blocks_of(sym, at, kind)
                one, n = _once(found.text, found.block)
                text = found.text[one] + a
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.anchor[one], found.block[one], doc[text], h[text], n)], names=["anchor", "block", "doc", "h", "n"])

    return run


def _keyed(block: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(block.view(np.uint64) ^ mix(text.astype(np.uint64) + np.uint64(1)))


def _listed(column: pa.ListArray, *names: str) -> tuple[np.ndarray, list]:
    """Row number and fields of the structs in a column of lists."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), [values.field(n) for n in names]


def context_rows(kind: Kind):
    """Of rows (doc, text, wanted): anchor, block, doc, n, lead (symbols before the anchor), content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for a, b in pieces(batch.column(1)):
                sym, at, data, starts, ends = symbols_of(batch.column(1).slice(a, b - a), kind)
                found = blocks_of(sym, at, kind)
                row, (block, n) = _listed(batch.column(2).slice(a, b - a), "block", "n")
                want = _keyed(block.to_numpy(), row)
                order = np.argsort(want)
                key = _keyed(found.block, found.text)
                take = np.flatnonzero(np.isin(key, want))
                take = take[_once(key[take])[0]]
                counts = n.to_numpy()[order][np.searchsorted(want, key[take], sorter=order)]
                for lo in range(0, len(take), 4096):
                    at_ = take[lo : lo + 4096]
                    first, last = found.first[at_], found.last[at_] + kind.size
                    if kind.words:
                        content = [b" ".join(data[x:y].tobytes().split()) for x, y in zip(starts[first].tolist(), ends[last - 1].tolist(), strict=True)]
                    else:
                        content = [data[x:y].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                    cols = (found.anchor[at_], found.block[at_], doc[found.text[at_] + a], counts[lo : lo + 4096], (found.place[at_] - first).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cols], pa.array(content, pa.binary())], names=["anchor", "block", "doc", "n", "lead", "content"])

    return run


def interleave(group: np.ndarray, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``sym`` within their groups, and what each row has in common with the one before.

    sym: uint8 or uint32 rows, 0 beyond a row's size; -1 in common across groups.
    """
    m, per = len(group), 8 // sym.dtype.itemsize
    wide = np.zeros((m, -(-sym.shape[1] // per) * per), sym.dtype)
    wide[:, : sym.shape[1]] = sym
    keys = wide.astype(sym.dtype.newbyteorder(">")).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.full(m, sym.shape[1], np.int32)
    common[0] = -1
    common[1:][group[order][1:] != group[order][:-1]] = -1
    part = np.cumsum(common == -1)

    def refine(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort the places ``at`` within their parts by key; where a part splits, and the keys' difference there."""
        k = key[order[at]]
        by = np.lexsort((k, part[at]))
        order[at], k = order[at][by], k[by]
        split = np.flatnonzero((part[at][1:] == part[at][:-1]) & (k[1:] != k[:-1])) + 1
        return at[split], k[split] ^ k[split - 1]

    def unsplit() -> np.ndarray:
        more = np.ones(m + 1, bool)
        more[1:-1] = part[1:] != part[:-1]
        return np.flatnonzero(~(more[:-1] & more[1:]))

    at = unsplit()
    for round_ in range(keys.shape[1]):
        if not len(at):
            break
        cut, differ = refine(keys[:, round_], at)
        if len(cut):
            steps = range(1, per)
            same = sum((differ < np.uint64(1 << (64 - 8 * sym.dtype.itemsize * s))).astype(np.int32) for s in steps)
            common[cut] = round_ * per + same
            mark = np.zeros(m, np.int64)
            mark[cut] = 1
            part = part + np.cumsum(mark)
            at = unsplit()
    if len(at):  # the shorter of rows that agree as far as they go comes first
        refine(size.astype(np.uint64), at)
    common[1:] = np.minimum(common[1:], np.minimum(size[order][1:], size[order][:-1]))
    return order, common


def settle(group: np.ndarray, left: np.ndarray, lead: np.ndarray, right: np.ndarray, tail: np.ndarray, n: np.ndarray, doc: np.ndarray, kind: Kind):
    """For each context and each of its windows: is it repeated, and the least doc that has it (0 beyond).

    left: the symbols before the anchor, the nearest first, ``lead`` of them;
    right: the anchor's and those after it, ``tail`` of them.  n: copies of the context.
    """
    m = len(group)
    r_order, r_common = interleave(group, right, tail)
    l_order, l_common = interleave(group, left, lead)
    again, least = np.zeros((m, kind.offsets), bool), np.zeros((m, kind.offsets), np.int64)
    r_id, l_id = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(kind.offsets):
        has = np.flatnonzero((lead >= o) & (tail >= kind.size - o))
        if not len(has):
            continue
        r_id[r_order] = np.cumsum(r_common < kind.size - o)
        l_id[l_order] = np.cumsum(l_common < o)
        key = r_id[has] * (m + 1) + l_id[has]
        by = np.argsort(key)
        key, of = key[by], has[by]
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        many = np.repeat(np.add.reduceat(n[of], cut) > 1, np.diff(np.append(cut, len(of))))
        low = np.repeat(np.minimum.reduceat(doc[of], cut), np.diff(np.append(cut, len(of))))
        again[of, lead[of] - o] = many
        least[of, lead[of] - o] = low
    return again, least


def _matrices(content: list[bytes], lead: np.ndarray, kind: Kind):
    """left, right, tail of contexts; words are numbered as they are, not by a hash."""
    if kind.words:
        number: dict[bytes, int] = {}
        rows = [np.array([number.setdefault(w, len(number) + 1) for w in c.split()], np.uint32) for c in content]
    else:
        rows = [np.frombuffer(c, np.uint8) for c in content]
    kind_of = np.uint32 if kind.words else np.uint8
    left, right = np.zeros((len(rows), kind.offsets - 1), kind_of), np.zeros((len(rows), kind.size), kind_of)
    tail = np.zeros(len(rows), np.int64)
    for i, (row, k) in enumerate(zip(rows, lead.tolist(), strict=True)):
        left[i, :k] = row[:k][::-1]
        right[i, : len(row) - k] = row[k:]
        tail[i] = len(row) - k
    return left, right, tail


def settled(kind: Kind):
    """Of rows (anchor, block, doc, n, lead, content), sorted by anchor and block: anchor, block, again, least.

    ``again`` has a bit for each window of the block, ``least`` a number.
    """

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        one, _ = _once(*[t.column(c).to_numpy() for c in ("anchor", "block")])  # rows of one id and text bring theirs again
        t = t.take(pa.array(one))
        anchor, lead = t.column("anchor").to_numpy(), t.column("lead").to_numpy().astype(np.int64)
        left, right, tail = _matrices(t.column("content").to_pylist(), lead, kind)
        group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        again, least = settle(group, left, lead, right, tail, t.column("n").to_numpy(), t.column("doc").to_numpy(), kind)
        windows = lead + tail - kind.size + 1
        bits = np.packbits(again, axis=1, bitorder="little")
        where = np.arange(kind.offsets) < windows[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows)]), pa.int32()), pa.array(least[where] if kind.words else np.zeros(int(windows.sum()), np.int64)))
        return pa.RecordBatch.from_arrays([t.column("anchor").combine_chunks(), t.column("block").combine_chunks(), pa.array([x.tobytes() for x in bits], pa.binary()), lists], names=["anchor", "block", "again", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            done = 0
            for a, _ in pairwise(cut):  # settle when enough contexts are held and a bucket has ended
                if sum(x.num_rows for x in held) + a - done < HELD:
                    continue
                if a > done:
                    held.append(batch.slice(done, a - done))
                    done = a
                elif held[-1].column(0)[-1].as_py() == anchor[a]:
                    continue
                yield flush(held)
                held = []
            held.append(batch.slice(done))
        if held:
            yield flush(held)

    return run


def window_rows(kind: Kind):
    """Of contexts: anchor, block, doc, n, at (number of the window), w (its symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                wins = []
                for c in part.column("content").to_pylist():
                    c = c.split() if kind.words else c
                    wins.append([b" ".join(c[i : i + kind.size]) if kind.words else c[i : i + kind.size] for i in range(len(c) - kind.size + 1)])
                many = [len(x) for x in wins]
                cols = [pa.array(np.repeat(part.column(x).to_numpy(), many)) for x in ("anchor", "block", "doc", "n")]
                at = np.concatenate([np.arange(x) for x in many]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at), pa.array([y for x in wins for y in x], pa.binary())], names=["anchor", "block", "doc", "n", "at", "w"])

    return run


def covers(column: pa.Array, cuts: pa.ListArray, kind: Kind):
    """Which symbols are covered by repeated windows; then where texts start, bytes, and words' spans.

    cuts: for each text its blocks with a mask of their repeated windows, as bytes
    or a number; null for all of them.
    """
    sym, at, data, starts, ends = symbols_of(column, kind)
    found = blocks_of(sym, at, kind)
    row, (block, mask) = _listed(cuts, "block", "mask")
    key, want = _keyed(found.block, found.text), _keyed(block.to_numpy(), row)
    order = np.argsort(want)
    hit = np.flatnonzero(np.isin(key, want))
    of = order[np.searchsorted(want, key[hit], sorter=order)]
    whole = np.asarray(mask.is_null())[of]
    change = np.zeros(len(sym) + 1, np.int32)
    np.add.at(change, found.first[hit[whole]], 1)
    np.add.at(change, found.last[hit[whole]] + kind.size, -1)
    some, of = hit[~whole], of[~whole]
    if len(some):
        if pa.types.is_integer(mask.type):
            raw = mask.fill_null(0).to_numpy().astype("<i8")[of].view(np.uint8).reshape(-1, 8)
        else:
            raw = np.frombuffer(b"".join(mask.take(pa.array(of)).to_pylist()), np.uint8).reshape(len(of), -1)
        i, bit = np.nonzero(np.unpackbits(raw, axis=1, bitorder="little"))
        np.add.at(change, found.first[some][i] + bit, 1)
        np.add.at(change, found.first[some][i] + bit + kind.size, -1)
    return np.cumsum(change[:-1]) > 0, at, data, starts, ends


def bitmask(places: str, kind: Kind):
    """The bytes of ``again`` from a list of window numbers."""
    one = lambda k: F.aggregate(
        F.array_distinct(F.filter(places, lambda x: F.floor(x / 8) == k)), F.lit(0), lambda s, x: (s + F.pow(F.lit(2), x % 8)).cast("int")
    )
    return F.unhex(F.concat(*[F.lpad(F.hex(one(k).cast("long")), 2, "0") for k in range(-(-kind.offsets // 8))]))


def sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc (the id as a number, null last), h (digest of the text), text; equal (doc, h) are equal rows."""
    text = text_or_empty(text_col)
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def cuts(rows: DataFrame, kind: Kind, earlier: bool) -> DataFrame:
    """doc, h, cuts: the blocks of a text with repeated windows, each with the mask of these (null: all).

    A window is repeated if it starts anywhere else; with ``earlier``, if it
    starts in a text of a smaller doc.
    """
    anchors = rows.select("text").mapInArrow(anchor_rows(kind), "anchor long, n long")
    shared = checkpoint(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    found = rows.select("doc", "h", "text").mapInArrow(block_rows(kind), "anchor long, block long, doc long, h long, n long")
    blocks = checkpoint(found.join(shared, "anchor", "left_semi"))
    release(shared)
    distinct = checkpoint(
        blocks.groupBy("anchor", "block").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "h")).alias("rep"), F.max("doc").alias("most"))
    )
    buckets = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("rep.doc").alias("low"), F.max("most").alias("high"), F.sum("n").alias("all"))
    # a bucket in which nothing can be repeated goes no further
    buckets = checkpoint(buckets.where("m > 1" + (" and low < high" if earlier else "")).select("anchor", "m"))
    asked = distinct.join(buckets, "anchor").select("rep.doc", "rep.h", F.struct("block", "n").alias("w"))
    asked = checkpoint(asked.groupBy("doc", "h").agg(F.collect_set("w").alias("wanted")))
    schema = "anchor long, block long, doc long, n long, lead int, content binary"
    contexts = checkpoint(rows.select("doc", "h", "text").join(asked, ["doc", "h"]).select("doc", "text", "wanted").mapInArrow(context_rows(kind), schema))
    release(asked)
    hot = buckets.where(F.col("m") > HOT).select("anchor")
    cold = contexts.join(hot, "anchor", "left_anti").select("anchor", "block", "doc", "n", "lead", "content")
    dealt = cold.repartition("anchor").sortWithinPartitions("anchor", "block")
    solved = dealt.mapInArrow(settled(kind), "anchor long, block long, again binary, least array<long>")
    solved = solved.select("anchor", "block", "least" if earlier else "again")
    wins = checkpoint(contexts.join(hot, "anchor").dropDuplicates(["anchor", "block"]).mapInArrow(window_rows(kind), "anchor long, block long, doc long, n long, at int, w binary"))
    if not wins.isEmpty():
        each = wins.groupBy("anchor", F.col("w")).agg(F.sum("n").alias("n"), F.min("doc").alias("least"))
        each = wins.select("anchor", "block", "at", "w").join(each, ["anchor", "w"])
        if earlier:
            each = each.groupBy("anchor", "block").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("e")).select("anchor", "block", F.col("e.least").alias("least"))
        else:
            each = each.where("n > 1").groupBy("anchor", "block").agg(F.collect_list("at").alias("e")).select("anchor", "block", bitmask("e", kind).alias("again"))
        solved = solved.unionByName(each)
    solved = checkpoint(solved)
    release(contexts, wins)
    if earlier:
        alone = distinct.join(buckets, "anchor", "left_anti").where("rep.doc < most").select("anchor", "block", F.col("rep.doc").alias("one"))
        of = alone.withColumn("least", F.lit(None).cast("array<long>")).unionByName(solved.withColumn("one", F.lit(None).cast("long")))
        lower = F.aggregate(F.transform("least", lambda x, i: F.when(x < F.col("doc"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
        hits = blocks.join(of, ["anchor", "block"]).withColumn("mask", F.when(F.col("one").isNull(), lower))
        hits = hits.where("one < doc or mask <> 0")
    else:
        whole = distinct.where("n > 1").select("anchor", "block", F.lit(None).cast("binary").alias("mask"))
        part = distinct.where("n = 1").join(solved.where(F.col("again") != F.lit(bytes(-(-kind.offsets // 8)))), ["anchor", "block"])
        hits = blocks.join(whole.unionByName(part.select("anchor", "block", F.col("again").alias("mask"))), ["anchor", "block"])
    out = checkpoint(hits.groupBy("doc", "h").agg(F.collect_set(F.struct("block", "mask")).alias("cuts")))
    release(blocks, distinct, buckets, solved)
    return out
