"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items and documents are cut into lower-cased words.  Every window of 13
consecutive item words (or the whole of a shorter item) is a pattern over word
numbers; each document is scanned once, and hits are kept as word positions
and as code-point offsets of the original text.

The patterns are sent to the tasks in slices of at most ``SLICE_BYTES`` of item
text.  A benchmark larger than one slice is scanned by a chain of automata in
the same pass over the documents, so no broadcast grows with the benchmark and
no row is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, word_tokens

WINDOW = 13
SLICE_BYTES = 8 << 20
#: Words of an original text: as in the contract, with the capitals that are lower-cased there.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_built: dict[str, tuple[dict[bytes, int], object]] = {}


def _automaton(key: str, items: list[tuple[str | None, bytes]]) -> tuple[dict[bytes, int], object]:
    """Word numbers and the automaton of a slice; built once in each Python worker."""
    if key not in _built:
        import ahocorasick

        words: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [words.setdefault(w, len(words) + 1) for w in word_tokens(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                patterns.setdefault(tuple(ids[i : i + WINDOW]), set()).update(() if item is None else (item,))
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, of in patterns.items():
            found.add_word(pattern, (len(pattern), tuple(of)))
        found.make_automaton()
        _built.clear()
        _built[key] = (words, found if patterns else None)
    return _built[key]


def _covered(matches: list[tuple[int, int]]) -> list[int]:
    words: set[int] = set()
    for start, end in matches:
        words.update(range(start, end))
    return sorted(words)


def _scan(key: str, items: list[tuple[str | None, bytes]], text_name: str, names: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automaton = _automaton(key, items)
        get = numbers.get
        for batch in batches:
            old_hits, old_items = batch.column(names["hits"]), batch.column(names["items"])
            sizes, hits, named, spans = [], [], [], []
            for i, text in enumerate(batch.column(text_name)):
                text = text.as_py()
                words = word_tokens(text.encode())
                matches, of = [], set()
                if automaton is not None and words:
                    for end, (n, names_) in automaton.iter(tuple([get(w, 0) for w in words])):
                        matches.append((end - n + 1, end + 1))
                        of.update(names_)
                sizes.append(len(words))
                hits.append(sorted({*_covered(matches), *(old_hits[i].as_py() or ())}))
                named.append(sorted({*of, *(old_items[i].as_py() or ())}))
                spans.append([{"start": a, "end": b} for a, b in hit_spans(text, hits[-1])] if hits[-1] else [])
            done = {
                names["words"]: pa.array(sizes, pa.int64()), names["hits"]: pa.array(hits, pa.list_(pa.int32())), names["items"]: pa.array(named, pa.list_(pa.string())),
                names["spans"]: pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
            yield pa.RecordBatch.from_arrays([done.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return scan


def _slices(items: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items, a bounded slice at a time; the driver holds one partition of items at most."""
    now, size = [], 0
    for item, text in items.toLocalIterator():
        data = (text or "").encode()
        if now and size + len(data) > SLICE_BYTES:
            yield now
            now, size = [], 0
        now.append((None if item is None else str(item), data))
        size += len(data)
    yield now


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with four more columns, and what they are called: no column of ``docs`` is replaced.

    words: how many; hits: positions of hit words; items: names of items that
    occur; spans: code-point offsets of the hit words in the original text, runs
    joined.  A null text has no words; an item without words hits nothing.  The
    windows of an item without an id hit like all others, but it has no name to be
    listed by.  Items that share an id count once.  A very long text is scanned whole.
    """
    kinds = {"words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:long,end:long>>")}
    names = {k: free_name(docs, f"_{k}") for k in kinds}
    text = free_name(docs, "_text")
    out = docs.withColumns({text: F.coalesce(F.col(text_col), F.lit("")), **{names[k]: c for k, c in kinds.items()}})
    for items in _slices(benchmark.select(item_col, item_text)):
        key = hashlib.sha256(repr(items).encode()).hexdigest()
        out = out.mapInArrow(_scan(key, items, text, names), out.schema)
    return out.drop(text), names


def hit_spans(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of the hit words, runs joined."""
    wanted, spans, last = set(hits), [], -2
    for i, m in enumerate(WORD.finditer(text)):
        if i in wanted:
            if i == last + 1 and spans:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append((m.start(), m.end()))
            last = i
    return spans


def _contaminated(hits: Column, words: Column) -> Column:
    return (F.size(hits) > 0) & (F.size(hits) * 20 >= words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Contaminated: at least one word is hit, and hit words are 5 % of all or more.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, names = with_hits(rows, benchmark)
    words, hits, items, spans = (F.col(names[k]) for k in ("words", "hits", "items", "spans"))
    return found.select(
        "doc_id", words.alias("n_words"), F.size(hits).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), _contaminated(hits, words).alias("contaminated"), spans.alias("spans"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns; null and empty texts stay, repeated rows too."""
    found, names = with_hits(docs, benchmark, text_col)
    return found.where(~_contaminated(F.col(names["hits"]), F.col(names["words"]))).select(*docs.columns)
