"""Sharding, alignment of tokenizers and hard negatives: against brute force, on awkward rows, and the queries on a table."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from passerine.llm import alignment, hard_negatives, queries, sharding

DATA = "/root/testdata/sf0.001"


def awkward(n=60):
    """Rows with null and repeated ids, null, empty, repeated and long texts, and columns of clashing names."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 50))), i, 7) for i in range(n)]
    return rows + [(None, "same", 1, 1)] * 40 + [(5, "same", 2, 2)] * 5 + [(70, None, None, None), (71, "", 0, 0), (72, "long " * 40_000, 3, 3)]


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_shards_of_awkward_rows(spark, tmp_path, size):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, bucket int").repartition(3)
    out = sharding.write_shards(docs, str(tmp_path / "out"), 7, 1, bucket_bytes=size)
    assert out.columns == ["doc_id", "text", "shard", "bucket", "shard_", "slot"]
    got = out.collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard_"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(7))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # the copies under one id are spread over the shards
    assert len({r["shard_"] for r in got if r["doc_id"] is None}) >= 5


def test_shards_by_brute_force(spark):
    """The two passes again, by hand, from the row numbers and hashes that Spark gives."""
    from pyspark.sql import functions as F

    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("text")).coalesce(1)
    got = {(r["shard"], r["slot"]): r["doc_id"] for r in sharding.shuffled(docs, 24, 11).collect()}
    again = {(r["shard"], r["slot"]): r["doc_id"] for r in sharding.shuffled(docs, 24, 11).collect()}
    other = {(r["shard"], r["slot"]): r["doc_id"] for r in sharding.shuffled(docs, 24, 12).collect()}
    assert got == again != other
    buckets = [[] for _ in range(24)]
    for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(11).cast("long"), F.col("doc_id")), F.lit(24)).alias("b")).collect():
        buckets[r["b"]].append(r["doc_id"])
    order = [b[k] for n, b in enumerate(buckets) for k in sharding.fisher_yates(len(b), 11, n)]
    assert got == {(p * 24 // 500, p - -(-(p * 24 // 500) * 500 // 24)): x for p, x in enumerate(order)}


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(4, s, 0)) for s in range(4800))
    assert len(seen) == 24 and sum((n - 200) ** 2 / 200 for n in seen.values()) < 60
    assert [len(sharding.fisher_yates(n, 1, 1)) for n in (0, 1, 2)] == [0, 1, 2]


def test_shards_of_few_rows(spark):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r["shard"], r["slot"]) for r in sharding.shuffled(one).collect()] == [(0, 0)]
    assert sharding.shuffled(one.where("doc_id = 2")).collect() == []


def test_shards_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op11_sharding(spark, DATA).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


TEXTS = [
    "Hello world, don't stop", "  two  spaces\n\nand lines\t", "naïve café 漢字 🎉 Ωmega", "<|endoftext|> and <s> are text", "", None, "a", " ", "\x00\x01 odd",
    "▁ is a space to one of them", "١٢٣ numbers 12345 x1y2", "Hello world, don't stop", "é combined", "same same same", "antidisestablishmentarianism " * 300, "ﬁ ligature", "'s 'll", "﻿mark",
]


def by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    letters = alignment.byte_alphabet()
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    found, held = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False) if text else None
        b = two.encode(text) if text else []
        parts = [[bytes(letters[c] for c in t) for t in a.tokens], [piece(two.id_to_piece(i)) for i in b]] if text else [[], []]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            found.append(None)
            continue
        links, groups, i, j, x, y, start = [], [], 0, 0, len(parts[0][0]), len(parts[1][0]), (0, 0)
        while True:
            links.append((a.ids[i], b[j]))
            if x == y:
                groups.append((a.ids[start[0] : i + 1], b[start[1] : j + 1]))
                start = (i + 1, j + 1)
                if i + 1 == len(b"") + len(parts[0]):
                    break
                i, j = i + 1, j + 1
                x, y = x + len(parts[0][i]), y + len(parts[1][j])
            elif x < y:
                i += 1
                x += len(parts[0][i])
            else:
                j += 1
                y += len(parts[1][j])
        held.update(set(links))
        found.append((len(a.ids), len(b), groups, links))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), told))
    return out, held


@pytest.mark.parametrize("block", [4 << 20, 30])
def test_alignment_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    want, held = by_hand(TEXTS)
    assert sum(w[0] > 0 for w in want) >= 12
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row int, block string").repartition(3)
    documents, pairs = alignment.aligned(docs)
    assert {tuple(r) for r in documents.collect()} == {(i, *w) for i, w in enumerate(want)}
    assert {(r["a"], r["b"]): r["documents"] for r in pairs.collect()} == held


def test_alignment_of_real_texts(spark):
    """The query on a whole table: ids by the file's own library, every document."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = by_hand([t for _, t in docs])[0]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    got = queries.op12_alignment(spark, DATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {tuple(r) for r in got.collect()} == {(i, *w[:-1], sha(w[-1])) for (i, _), w in zip(docs, want, strict=True)}


def test_alignment_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "Hello you"), (None, "Hello you"), (1, None)], "doc_id long, text string")
    got = [tuple(r)[:7] for r in alignment.aligned(docs)[0].collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, 0, 0, 0, 0), *[(None, 2, 2, 2, 2, 2, 4)] * 2], key=str)
    documents, pairs = alignment.aligned(docs.where("doc_id = 5"))
    assert documents.collect() == [] and pairs.collect() == []


def mined(rows, anchors, positives=5, negatives=10):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    last = lambda i: (i is None, i)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for k, (i, label, v, *_) in enumerate(rows):
        if i is None or not anchors(i):
            continue
        scores = [(-dot(v, w), last(j), n, m) for n, (j, m, w, *_) in enumerate(rows) if n != k]
        for p, at, n, m in sorted(s for s in scores if s[3] == label)[:positives]:
            ok = sorted(s for s in scores if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(i, at[1], r + 1, x[1][1], -p, -x[0]) for r, x in enumerate(ok)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_by_brute_force(spark, monkeypatch, small):
    from pyspark.sql import functions as F

    if small:
        for name, n in (("ANCHORS", 3), ("ROWS", 16), ("TABLES", 2), ("CENTROIDS", 4), ("FIT_ROWS", 20)):
            monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), [rng.randrange(-40, 40) for _ in range(7)], 1) for i in range(150)]
    rows += [(i, rng.randrange(3), [5, 5, 5, -5, 0, 1, 2], 1) for i in range(150, 220)]  # a vector that is everywhere
    rows += [(300, 1, None, 0), (301, None, [1] * 7, 0), (302, 1, [1, None], 0), (303, 2, [9, 9], 0), (310, 0, [], 0), (None, 1, [30, 1, 2, 3, 4, 5, 6], 0), (20, 1, [30, 1, 2, 3, 4, 5, 6], 0), (320, 9, [40] * 7, 0)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<int>, row int").repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    want = mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and sorted(map(tuple, got.collect()), key=repr) == want
    assert hard_negatives.mine(df, F.lit(False)).collect() == [] and hard_negatives.mine(df.where("row = 5"), F.lit(True)).collect() == []


def test_bounds_hold_and_prune(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = np.floor(np.array([r["embedding"] for r in rows], np.float64) * 256)
    books = hard_negatives.fit_codebooks(x[:256])
    codes, norms = hard_negatives.encode(x, books)
    low, high = hard_negatives.score_bounds(x[:50], codes, norms, books)
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    # the best 5 of 500 rows: most of the others are left out unseen
    assert (high >= np.partition(low, -5, axis=1)[:, -5:][:, :1]).mean() < 0.2


def test_hard_negatives_refuse_large_numbers(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="smaller"):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1 << 20])], "vec_id long, label int, vector array<int>"), F.lit(True))


def test_queries_of_new_operators_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op13_hard_negatives"])
    got = queries.op13_hard_negatives(spark, DATA)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.count() > 100
