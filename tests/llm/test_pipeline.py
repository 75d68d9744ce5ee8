"""The corpus pipeline and its stages on awkward rows."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number string, _hits string, _text string, __sha string"
EXTRA = ("r", "h", "t", "s")


def words(rng, n):
    return " ".join(rng.choices("the of and river stone walks green under light many paper house over little garden".split(), k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, words(rng, 80), "en", f"s{i % 3}", 1, *EXTRA) for i in range(40)]
    out += [(40, out[3][1].replace(" ", "\n"), "en", "s0", 1, *EXTRA), (5, "another text under an id that was there " + words(rng, 60), "en", None, 1, *EXTRA)]
    near = out[7][1].split()
    near[40] = "changed"
    out += [(41, " ".join(near), None, "s1", None, *EXTRA), (None, words(rng, 70), "en", "s2", 1, *EXTRA), (42, None, "en", "s2", 0, *EXTRA), (43, "", None, None, 0, *EXTRA), (44, words(rng, 30000), "en", "s2", 1, *EXTRA)]
    out += [out[9], out[9]]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    items = [(1, words(random.Random(99), 20)), (2, None), (None, "x y")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_stages(spark, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kinds = [f.dataType for f in docs.schema.fields]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.checkpoint(stage(spark, docs, folder))
        assert docs.columns == before.columns and [f.dataType for f in docs.schema.fields] == kinds, name
        left = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "language_id":
            assert len(left) == len(rows) - 2 and (42, None) not in left and (43, "") not in left
        elif name == "exact_dedup":
            assert len(left) == len(rows) - 5 and (40, rows[40][1]) not in left and sum(d == 5 for d, _ in left) == 2 and sum(d == 9 for d, _ in left) == 1
        elif name == "simhash_near_dedup":
            assert len(left) == len(rows) - 6 and (41, rows[42][1]) not in left and sum(d == 5 for d, _ in left) == 2
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(mixed) == len(rows) - 6 and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)


def test_stages_on_nothing(spark, rows, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_decontamination_removes_what_is_contaminated(spark, folder):
    item = words(random.Random(99), 20)
    docs = spark.createDataFrame([(1, item), (2, "much else " * 300 + item), (3, "clean text"), (4, "See: " + item.upper().replace(" ", ", "))], "doc_id long, text string")
    kept = corpus_pipeline.decontaminate_benchmark(spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3]


def test_offsets_lead_back_to_the_text(spark):
    from passerine.llm import decontaminate

    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    text = "Éa — ONE, two... Three! one two"
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, _hits int")
    found, names = decontaminate.with_hits(docs, items)
    r = found.first()
    assert r["_hits"] == 5 and [text[s["start"] : s["end"]] for s in r[names["spans"]]] == ["ONE, two... Three"]
