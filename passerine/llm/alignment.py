"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

The ends of both token lists are merged like two pointers over the bytes: between
two ends that follow each other lies one overlap of one token of each side, a
link, and where both end at once a group is complete.  Texts are taken in blocks
of bounded size; a block has one entry for each pair of ids it holds, with the
number of its documents, so a pair that is in every document makes one row a
block and not one a document.  Spark adds the entries up, and joins the counts
and the largest count of each id back to the blocks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Fixed value: how a byte-level tokenizer of this kind cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it is visible, else the next one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level tokenizer from its vocabulary file; ranks are ids, special tokens are plain text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special, alphabet = {t["id"] for t in told["added_tokens"]}, byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in told["model"]["vocab"].items() if i not in special}
        self.bytes = np.zeros(max(ranks.values()) + 1, object)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.size = np.array([len(b) if b else 0 for b in self.bytes], np.int64)
        self.own = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.own.encode_ordinary(t), np.int64) for t in texts]


class PieceBpe:
    """A piece tokenizer with byte fallback, from its model file; it puts a space before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        own = lambda i: bytes([int(self.own.id_to_piece(i)[3:5], 16)]) if self.own.is_byte(i) else self.own.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = np.array([*(own(i) for i in range(self.own.get_piece_size())), b""], object)[:-1]
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.own.encode(texts, num_threads=1)]


@cache
def tokenizers(folder: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(f"{folder}/{BYTE_BPE}"), PieceBpe(f"{folder}/{PIECE_BPE}")


@cache
def _texts_of(n: int, ending: str) -> np.ndarray:
    return np.array([f"{i}{ending}" for i in range(n)], object)


def align(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two token lists over the same bytes: the a and b of each link, and whether a group ends with it.

    One pass of two pointers over the ends: each step takes the nearer end, or both.
    """
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    place = np.searchsorted(ends_b, ends_a)
    both = ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a
    ends = np.insert(ends_b, place[~both], ends_a[~both])
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return at_a, at_b, (ends_a[at_a] == ends) & (ends_b[at_b] == ends)


def groups_text(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, closes: np.ndarray, most: tuple[int, int]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the groups in order, with the ids of both sides."""
    last_a, last_b = at_a[closes], at_b[closes]
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    out = np.empty(len(a) + len(b), object)
    ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ends_a[last_a] = ends_b[last_b] = True
    # a token of a side comes after its own side's and, for b, after all a of its group
    spot_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
    spot_b = np.arange(len(b)) + (last_a + 1)[group_b]
    out[spot_a] = np.where(ends_a, _texts_of(most[0], "|")[a], _texts_of(most[0], ",")[a])
    out[spot_b] = np.where(ends_b, _texts_of(most[1], ";")[b], _texts_of(most[1], ",")[b])
    return "".join(out.tolist())[:-1]


_ENCODED = "row long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, links binary, pairs array<long>, docs array<int>"


def _encode_block(rows: list[int], texts: list[str | None], block: int, folder: str, whole: bool) -> pa.RecordBatch:
    one, two = tokenizers(folder)
    some = [k for k, t in enumerate(texts) if t]
    of_a, of_b = one.encode([" " + texts[k] for k in some]), two.encode([texts[k] for k in some])
    numbers = np.zeros((len(rows), 4), np.int64)
    told, links = [""] * len(rows), [np.zeros(0, np.int64)] * len(rows)
    for k, a, b in zip(some, of_a, of_b, strict=True):
        data = (" " + texts[k]).encode()
        if b"".join(one.bytes[a].tolist()) != data or b"".join(two.bytes[b].tolist()) != data:
            continue
        at_a, at_b, closes = align(a, b, one.size, two.size)
        text = groups_text(a, b, at_a, at_b, closes, (len(one.size), len(two.size)))
        told[k] = text if whole else hashlib.sha256(text.encode()).hexdigest()
        numbers[k] = len(a), len(b), closes.sum(), len(at_a)
        links[k] = a[at_a] << 32 | b[at_b]
    # each link becomes its pair's place among the block's pairs; a document's are kept in order, as differences
    pairs, place = np.unique(np.concatenate(links), return_inverse=True)
    cut = np.cumsum([len(x) for x in links])
    sorted_ = [np.sort(x) for x in np.split(place, cut[:-1])]
    docs = np.bincount(np.concatenate([x[np.diff(x, prepend=-1) > 0] for x in sorted_]), minlength=len(pairs)).astype(np.int32)
    packed = [np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in sorted_]
    none = [None] * (len(rows) - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), *[pa.array(numbers[:, c]) for c in range(4)], pa.array(told), pa.array([block] * len(rows), pa.int64()), pa.array(packed, pa.binary()),
         pa.array([pairs, *none], pa.list_(pa.int64())), pa.array([docs, *none], pa.list_(pa.int32()))],
        names=[c.split()[0] for c in _ENCODED.split(", ")],
    )


def _encoder(folder: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, texts, held = [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                size = len(text or "")
                if rows and held + size > BLOCK_BYTES:
                    yield _encode_block(rows, texts, block, folder, whole)
                    rows, texts, held, block = [], [], 0, block + 1
                rows.append(row)
                texts.append(text)
                held += size
            if rows:
                yield _encode_block(rows, texts, block, folder, whole)
                block += 1

    return run


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a block's documents: their links' counts, and how many links are the best of their a."""
    right = right.combine_chunks()
    order = np.argsort(right.column("k").to_numpy())
    n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
    sums, bests = [], []
    for packed in left.column("links").to_pylist():
        at = np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()).astype(np.int64)
        sums.append(int(n[at].sum()))
        bests.append(int(best[at].sum()))
    return left.drop_columns(["links", "block"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per document, and one per pair of ids.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the
    highest of their a, ties included), count_sum (over links), groups (their text,
    or its SHA-256 in hex without ``whole``).  Pairs: a, b, documents (how many hold
    the pair linked), best.  Null and empty texts, and those that a tokenizer does not
    give back byte by byte, have no tokens, zeros and an empty ``groups``.  Repeated
    rows, and rows without an id, are documents of their own; other columns are not
    looked at.  An empty table gives empty tables.  A very long text is tokenized
    whole, in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    encoded = checkpoint(rows.mapInArrow(_encoder(folder, whole), _ENCODED))
    held = encoded.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("k", "x")).select("block", "k", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    scored = checkpoint(counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    entries = held.select(F.col("block").alias("of"), "k", "pair").join(scored, "pair").select("of", "k", "n", "best")
    kept = encoded.drop("pairs", "docs")
    schema = "row long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    found = kept.groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(_summed, schema)
    pairs = scored.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(2**32 - 1).cast("long")).cast("int").alias("b"), F.col("n").alias("documents"), "best")
    return found.select(F.col("row").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"), pairs
