"""Texts that no labelled language explains, and tables of many labels."""

import random

from pyspark.sql import functions as F

from passerine.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string"
FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "xkq zvbn wrtp lkjh gfds qwrt zxcv bnmp lkjhg fdsq wrtz xcvb nmlk",
]


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    clean = [tuple(r) for r in docs.where("doc_id % 2 = 1 and length(text) > 500").select("text", "lang", "source").limit(20).collect()]
    planted = [(1000 + k, t, None, clean[k][2]) for k, t in enumerate(FOREIGN)]
    mixed = spark.createDataFrame([(k, *c) for k, c in enumerate(clean)] + planted, SCHEMA)
    out = {r["doc_id"]: r for r in langid.identify(mixed, model=model).collect()}
    for k, _ in enumerate(FOREIGN):
        r = out[1000 + k]
        assert (r["language"], r["text_language"], r["accepted"]) == ("und", "und", False) and r["posterior"] < 0.5
    assert all(out[k]["accepted"] and out[k]["language"] == c[1] for k, c in enumerate(clean))
    kept = {r["doc_id"] for r in langid.accepted(mixed, model=model).collect()}
    assert kept == set(range(len(clean)))


def test_every_label_has_a_model(spark):
    rng, rows = random.Random(8), []
    for k in range(70):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 7))) for _ in range(30)]
        for _ in range(4 if k < 64 else 3):  # the last six are the rarest
            rows.append((len(rows), " ".join(rng.choices(words, k=80)), f"l{k:02}", "s"))
    out = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and all(r["language"] == r["declared_language"] and r["accepted"] for r in out)


def test_pages_are_named_by_text_markup_and_address(spark):
    data = "/root/testdata/sf0.01"
    model = langid.fit(spark.read.parquet(f"{data}/documents.parquet"))
    pages = spark.read.parquet(f"{data}/pages.parquet").where("html is not null and url is not null")
    told = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("want")).where("want <> ''")
    found = langid.identify_pages(pages, model).withColumnRenamed("doc_id", "page_id").join(told, "page_id")
    assert found.agg(F.avg((F.col("language") == F.col("want")).cast("double"))).first()[0] >= 0.98
