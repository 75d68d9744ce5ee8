"""Each operator against a brute-force version on small documents."""

import hashlib
import random
import re
from collections import Counter

import pytest

from passerine.llm import byte_dedup, components, decontaminate, exact_dedup, langid, licenses, mixing, pii, repeats, secret_scan, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string"
SHA = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéfgh", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(40)]
    for i in range(30):
        a, b = rng.choice(texts), rng.choice(texts)
        cut = rng.randint(0, len(a))
        texts.append(a[cut : cut + rng.randint(10, 400)] + " " + b[: rng.randint(0, 300)])
    texts += [texts[3], texts[3] + " x", texts[3].replace(" ", "\n"), None, "", "   ", "a" * 700, "ab" * 300, "a b " * 60, texts[5], "aaaa " * 2000]
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def got(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_exact(docs, rows):
    out, groups = got(exact_dedup.exact_duplicates(docs)), {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    for norm, members in groups.items():
        for _, i in members:
            r = out[i]
            assert (r["keep_id"], r["group_size"], r["text_sha256"], r["kept"]) == (min(members)[1], len(members), SHA(norm), min(members)[1] == i)
    assert exact_dedup.without_duplicates(docs).count() == len(groups)


def test_exact_weak_digest(docs, spark):
    from pyspark.sql import functions as F

    weak = got(exact_dedup.exact_duplicates(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)))
    assert weak == got(exact_dedup.exact_duplicates(docs))


@pytest.mark.parametrize("hot", [0, 4096])
def test_bytes(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    out, seen = got(byte_dedup.digests(docs)), Counter()
    data = {i: (t or "").encode() for i, t, *_ in rows}
    for d in data.values():
        seen.update(d[k : k + 200] for k in range(len(d) - 199))
    for i, d in data.items():
        gone = [False] * len(d)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(d), sum(gone), spans, SHA(bytes(b for b, g in zip(d, gone) if not g))), i


@pytest.mark.parametrize("hot", [0, 4096])
def test_substrings(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    out, first = got(substring_dedup.digests(docs)), {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) == (len(w), len(gone), SHA(kept)), i


def test_simhash(docs, rows):
    import xxhash

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: brute(t) for i, t, *_ in rows}
    out = got(simhash.near_components(docs))
    assert {i: int(r["fingerprint"], 16) for i, r in out.items()} == prints
    least = {i: i for i in prints}
    while True:  # the smallest id reachable over links
        new = {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == least:
            break
        least = new
    assert {i: r["component_id"] for i, r in out.items()} == least and len(set(least.values())) < len(least) - 3


def test_simhash_links(spark, monkeypatch):
    rng, values = random.Random(2), set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    for block in (3,):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for plan in (None, [((1 << 32) - 1, 1), ((1 << 64) - (1 << 32), 1)]):
            if plan:
                monkeypatch.setattr(simhash, "allocate", lambda *a, plan=plan: plan)
            fps = spark.createDataFrame([(simhash._signed(x),) for x in values], "fp long")
            found = components.connected_components(simhash.near_links(fps)).collect()
            parent = {x: x for x in values}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a in values:
                for b in values:
                    if (a ^ b).bit_count() <= 3:
                        parent[root(a)] = root(b)
            classes = {}
            for x in values:
                classes.setdefault(root(x), set()).add(simhash._signed(x))
            want = {x: min(c) for c in classes.values() for x in c if len(c) > 1}
            assert {r["node"]: r["component"] for r in found} == want
        monkeypatch.undo()


def test_allocation_is_a_cover():
    import numpy as np

    for n in (10, 10**5, 10**9):
        both = np.full((64, 64), n / 4) + np.eye(64) * n / 4
        plan = simhash.allocate(n, both)
        assert sum(t + 1 for _, t in plan) >= 4 and not any(a & b for i, (a, _) in enumerate(plan) for b, _ in plan[:i])


def test_decontamination(spark, docs, rows):
    source = rows[0][1] or rows[1][1]
    items = [(1, " ".join(source.split()[:20])), (2, "AB cd"), (3, None), (10, rows[8][1]), (4, "")]
    out = got(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    windows = {}
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for k, t in items:
        w = low(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(str(k))
    for i, t, *_ in rows:
        w, hit, names = low(t), set(), set()
        for win, of in windows.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    names |= of
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(names), SHA(",".join(sorted(names))))
        assert r["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w))


def test_licenses():
    rng = random.Random(1)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "under", "zzz", "x"]
    for _ in range(300):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        want = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = licenses.license_row(" ".join(w).upper())
        assert (r[0], r[1], r[2], r[3]) == (len(w), len(want), min((k for k, _ in want), default=None), max((k for k, _ in want), default=None))
        assert r[4] == ",".join(sorted({x for _, x in want}))
    assert licenses.license_row("So. Released under the MIT License. And more")[5:] == ("mit", 1.0, "mit:1:6")
    assert licenses.license_row("Licensed under the Apache License, Version 2.0.")[5] == "apache-2.0"
    assert licenses.license_row(None)[:4] == (0, 0, None, None)


def test_license_chains():
    """Matching statistics and chains against plain versions."""
    rng = random.Random(7)
    scanner = licenses.Scanner({"a": ("b c d e f g h", "x y b c d z"), "k": ("d e f b c d q r",)})
    texts = [t.split() for t in ("b c d e f g h", "x y b c d z", "d e f b c d q r")]
    number = {w: k for w, k in scanner.words.items()}
    for _ in range(150):
        w = rng.choices("b c d e f g h x y z q r n".split(), k=rng.randint(0, 25)) if rng.random() < 0.4 else []
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(texts)
            a, b = sorted(rng.choices(range(len(t) + 1), k=2))
            w += t[a:b] + rng.choices(["n", "b"], k=rng.randint(0, 2))
        # the longest template string that ends at each word
        inside = lambda x: any(t[i : i + len(x)] == x for t in texts + [p.split() for p in licenses.PHRASES] for i in range(len(t)))
        want = [max(k for k in range(i + 2) if k == 0 or inside(w[i + 1 - k : i + 1])) for i in range(len(w))]
        state = size = 0
        for i, x in enumerate(w):
            c = number.get(x.encode(), 0)
            while state and c not in scanner.sam.next[state]:
                state = scanner.sam.link[state]
                size = scanner.sam.length[state]
            if c in scanner.sam.next[state]:
                state, size = scanner.sam.next[state][c], size + 1
            else:
                state = size = 0
            assert size == want[i]
        matches = [(i + 1 - want[i], want[i]) for i in range(len(w)) if want[i] >= licenses.LEAST_MATCH and (i + 1 == len(w) or want[i + 1] <= want[i])]
        chains = {}  # template: covered, start, end, its last word
        for start, n in matches:
            for k, t in enumerate(texts):
                for last in range(n - 1, len(t)):
                    if t[last - n + 1 : last + 1] == w[start : start + n]:
                        steps = [(c[0] + min(n, last - c[3], start + n - c[2]), c[1]) for c in chains.get(k, []) if start - c[2] <= licenses.GAP and min(n, last - c[3], start + n - c[2]) > 0]
                        covered, first = max([(n, start), *steps], key=lambda x: x[0])
                        chains.setdefault(k, []).append((covered, first, start + n, last))
        best = {k: max(c[0] for c in v) / len(texts[k]) for k, v in chains.items()}
        found = scanner.scan(" ".join(w))[2]
        for label, of in (("a", (0, 1)), ("k", (2,))):
            top = max((best.get(k, 0) for k in of), default=0)
            assert abs(max((c[3] for c in found if c[0] == label), default=0) - (top if top >= licenses.LEAST_COVER else 0)) < 1e-9, w
    notice = licenses.TEMPLATES["mit"][2].split()
    assert licenses.license_row(" ".join(notice[:40] + ["permission is hereby"] + notice[40:]))[5:7] == ("mit", 1.0)
    assert licenses.license_row(licenses.TEMPLATES["mit"][3])[5] == "mit"


def test_secrets():
    rng = random.Random(3)
    parts = ["password", "API_key", "token", '"', "'", " ", ":", "=", "AKIA", "ABCD1234EFGH5678", "deadbeef0123", "é", "x", "secret", "-", "ghp_", "0123456789abcdef"]
    pattern = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for _ in range(400):
        t = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        want = [("assign", m.start(), m.end()) for m in pattern.finditer(t) if len(m[1]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert sorted(f for f in secret_scan.find_secrets(t) if f[0] in secret_scan.BASE) == sorted(want), t


def test_mixing(docs, rows):
    out, source = got(mixing.mix(docs)), {i: s for i, _, _, s in rows}
    again = got(mixing.mix(docs.repartition(5)))
    assert out == again and len(out) == len(rows)
    taken, target, size = Counter(), {}, Counter()
    for i, r in out.items():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[i]] += r["taken"]
        size[source[i]] += r["size"]
        target[source[i]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 1 and target[s] <= 2 * size[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6


def test_pii(spark):
    texts = ["mail ann.b@corp.com or +1 (743) 555-3824 from 10.2.33.4, card 4465 7583 8288 9437", "Mr. John Smith met Mrs Mary Jones; ann.b@corp.com again", None, "", "nothing here 1.2"]
    out = got(pii.with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k"))
    assert [out[i]["n_entities"] for i in range(5)] == [4, 3, 0, 0, 0] and out[4]["text"] == texts[4]
    mails = [re.findall(r"\S+@\S+", out[i]["text"])[0] for i in (0, 1)]
    assert mails[0] == mails[1] != "ann.b@corp.com"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} from \d+\.\d+\.\d+\.\d+, card (\d{4} ){3}\d{4}$", out[0]["text"])
    assert re.search(r"^Mr\. (\w+)", out[1]["text"])[1].lower() in pii.GIVEN["m"] and re.search(r"Mrs (\w+)", out[1]["text"])[1].lower() in pii.GIVEN["f"]
    values = [(f"a{i}@x.com",) for i in range(200)] + [(f"{i}.1.1.1",) for i in range(200)]
    made = pii.surrogates(spark.createDataFrame(values, "value string"), "k").collect()
    assert len({r["surrogate"] for r in made}) == 400 and not {r["surrogate"] for r in made} & {v for v, in values}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    held = langid.identify(docs.where("doc_id % 2 = 1"), model=model).select("text_language", "declared_language", "accepted").collect()
    right = sum(r["text_language"] == r["declared_language"] for r in held)
    assert right >= 0.95 * len(held) and sum(r["accepted"] for r in held) >= 0.98 * len(held)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    outs = [exact_dedup.exact_duplicates(none), byte_dedup.digests(none), substring_dedup.digests(none), simhash.near_components(none), decontaminate.contamination(none, items), licenses.scan_licenses(none), secret_scan.secrets(none), mixing.mix(none), pii.with_surrogates(none, "k"), langid.identify(none)]
    assert all(o.count() == 0 for o in outs)
