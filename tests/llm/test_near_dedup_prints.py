"""The near-dedup stage's SimHash step by itself: without a band, near fingerprints connect rows."""

import random

from passerine.llm import near_dedup


def test_fingerprints_connect_rows(spark, monkeypatch):
    keys = near_dedup._keys

    def only_prints(batches):
        import pyarrow.compute as pc

        for batch in keys(batches):
            yield batch.filter(pc.less(batch.column(1), 0))

    monkeypatch.setattr(near_dedup, "_keys", only_prints)
    rng, texts = random.Random(6), ["", "", "one two"]
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join([f"x{k}" if k % 90 == 7 else w for k, w in enumerate(words)])]
    prints = [near_dedup.fingerprint(near_dedup.shingles(t)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= near_dedup.DISTANCE:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = [find(x) for x in range(len(texts))]
    want = {(x, g) for x, g in enumerate(groups) if groups.count(g) > 1}
    assert len(want) >= 60
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    assert {(r["node"], r["component"]) for r in near_dedup.candidates(docs).collect()} == want
