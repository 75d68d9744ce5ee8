"""Cases that once gave wrong rows."""

from pyspark.sql import functions as F

from passerine.llm import decontaminate, langid


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(0, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (None, "Four"), (7, "one")], "item_id long, text string")
    r = decontaminate.contamination(docs, items).first()
    assert (r["n_hit"], r["n_items"], r["contaminated"]) == (4, 1, True)
    assert decontaminate.decontaminated(docs, items.where("item_id is null")).collect() == []


def test_rows_of_one_id_and_text_are_judged_alone(spark, monkeypatch):
    rows = [(1, "same text", "good"), (1, "same text", "bad"), (None, None, "bad"), (None, "x", "good"), (None, "x", "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(langid, "identify", lambda df, number, *a, **k: df.select(F.col(number).alias("doc_id"), (F.col("source") == "good").alias("accepted")))
    got = langid.accepted(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[3]], key=repr)
