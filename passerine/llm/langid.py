"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each document:

* the text: a naive Bayes likelihood over hashed character trigrams, of the
  whole text, tempered since neighbouring trigrams are not independent;
* the declared markup language (``lang`` of a table, or the lang attribute of a
  page), by how often a declaration goes with each language in this corpus;
* the address suffix, where a country suffix speaks for a language;
* the host: a prior smoothed from the host over its domain to the corpus, all
  counted by grouped aggregation over every document.

A text may also be in no language that has labels, or be noise: that hypothesis
takes part with a likelihood of its own, between that of trigrams drawn evenly
and that which the fit sample has under its own model.

The trigram model is fitted on a bounded sample of labelled rows; everything
else is counted over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, with_row_number

#: Hashed trigrams that the model tells apart.
BINS = 1 << 14
#: Labelled rows of each language that the trigram model is fitted on, about.  Every label has a model.
FIT_ROWS = 2000
#: A text counts as this many independent trigrams at most.
TEMPER = 40.0
#: Pseudo-counts by which a host leans on its domain, and a domain on the corpus.
KAPPA = 20.0
#: A document is rejected below this posterior of its best language.
LEAST_POSTERIOR = 0.5
#: Prior of a text in no labelled language, and how far its mean log likelihood a trigram stands from even towards the fit sample's.
UNKNOWN_PRIOR, UNKNOWN_STEP = 0.01, 0.25
#: Country suffixes that speak for a language; fixed values, ISO 3166 and ISO 639-1.
SUFFIXES = {"at": "de", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "mx": "es", "nl": "nl", "pt": "pt", "uk": "en", "us": "en"}
SUFFIX_WEIGHT = 4.0


def _bins(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text, lower-cased, in blocks."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    out = np.zeros(BINS, np.int64)
    for at in range(0, max(1, len(data) - 2), 1 << 20):
        d = data[at : at + (1 << 20) + 2].astype(np.uint32)
        if len(d) > 2:
            out += np.bincount(((d[:-2] * 961 + d[1:-1]) * 31 + d[2:]) * np.uint32(2654435761) >> np.uint32(18), minlength=BINS)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by[lang] = by.get(lang, 0) + _bins(text or "")
    for lang, counts in by.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bin", "n"])


def fit(labelled: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log likelihoods (BINS x languages), from about ``rows`` hash-chosen rows of each."""
    known = labelled.where(F.col(label_col).isNotNull() & (F.col(label_col) != ""))
    counts = known.groupBy(label_col).count().collect()
    if not counts:
        return [], np.zeros((BINS, 0))
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, rows / n))])
    chosen = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 20)) < share[F.col(label_col)] * (1 << 20)
    cells = known.where(chosen).select(label_col, text_col).mapInArrow(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = cells["lang"].combine_chunks().dictionary_encode()
    order = {lang: k for k, lang in enumerate(sorted(names.dictionary.to_pylist()))}
    langs, place = list(order), np.array([order[x] for x in names.dictionary.to_pylist()], np.int64)
    model = np.full((BINS, len(langs)), 0.5)
    model[cells["bin"].to_numpy(), place[names.indices.to_numpy()]] += cells["n"].to_numpy()
    return langs, np.log(model / model.sum(axis=0))


def unknown_level(model: np.ndarray) -> float:
    """Mean log likelihood a trigram of a text in no labelled language."""
    own = float((np.exp(model) * model).sum(axis=0).min())  # of the language whose text is the least predictable
    return -np.log(BINS) + UNKNOWN_STEP * (own + np.log(BINS))


def _score(model: np.ndarray):
    level = unknown_level(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, unknown, letters = [], [], []
            for x in batch.column("_text"):
                text = x.as_py()
                counts = _bins(text)
                n = int(counts.sum())
                has = any(c.isalpha() for c in text)
                letters.append(has)
                out.append((counts @ model * (min(1.0, TEMPER / n) if n and has else 0.0)).tolist())
                unknown.append(min(n, TEMPER) * level if has else 0.0)
            cols = [*[batch.column(c) for c in batch.schema.names if c != "_text"], pa.array(out, pa.list_(pa.float64())), pa.array(unknown, pa.float64()), pa.array(letters, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*[c for c in batch.schema.names if c != "_text"], "_ll", "_unknown", "_letters"])

    return run


def host_of(address: Column) -> Column:
    """Host of an address; an address without a scheme is a host itself."""
    return F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)", 1))


def markup_language(html: Column) -> Column:
    """First two letters of the lang attribute of a page's html element, else null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]{2})", 1))
    return F.when(found != "", found)


def _pick(values: Column, langs: list[str]) -> Column:
    top = F.array_max(values)
    return F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(values, top).cast("int"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", address_col: str = "source", declared: Column | None = None, label_col: str = "lang", model=None) -> DataFrame:
    """One row per document: doc_id, language, posterior, text_language, declared_language, host, accepted, text_hash.

    A text without letters, null ones included, has no text evidence and is
    language 'und', not accepted; so is a text that no language explains better
    than the unknown one, and everything if no row is labelled.  The posterior is
    that of the best labelled language, against the others and the unknown.  A null
    declaration or address is no evidence.  Ties go to the language first in the
    alphabet.  Repeated rows are judged alike; other columns are not looked at.
    """
    langs, ll = model or fit(docs, label_col, text_col, id_col)
    declared = F.col(label_col) if declared is None else declared
    host = host_of(F.col(address_col))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), declared.cast("string").alias("declared"), host.alias("host"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
    )
    if not langs:
        return slim.select("doc_id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_language"), F.col("declared").alias("declared_language"), "host", F.lit(False).alias("accepted"), "text_hash")
    schema = f"doc_id {dict(slim.dtypes)['doc_id']}, declared string, host string, text_hash long, _ll array<double>, _unknown double, _letters boolean"
    scored = checkpoint(
        slim.mapInArrow(_score(ll), schema).withColumn("text_language", F.when(F.col("_letters") & (F.array_max("_ll") >= F.col("_unknown")), _pick(F.col("_ll"), langs)).otherwise(F.lit("und")))
        .withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*|[^.]*)$", 1))
    )
    votes = scored.where("text_language <> 'und'")
    tally = [F.sum((F.col("text_language") == x).cast("long")).cast("double") for x in langs]
    counts = lambda name: votes.groupBy(name).agg(F.array(*tally).alias(f"n_{name}"))
    corpus = votes.agg(F.array(*tally).alias("n")).first()["n"] or [0.0] * len(langs)
    base = [((x or 0.0) + 1) / (sum(y or 0.0 for y in corpus) + len(langs)) for x in corpus]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    lean = lambda n, parent: F.zip_with(n, parent, lambda x, p: (x + KAPPA * p) / (total(n) + KAPPA))
    zero, prior = F.array(*[F.lit(0.0)] * len(langs)), F.array(*[F.lit(x) for x in base])
    # domains and hosts are joined to each other first; a host's row then holds its prior
    hosts = counts("host").withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*|[^.]*)$", 1)).join(counts("domain"), "domain")
    hosts = hosts.select("host", lean(F.col("n_host"), lean(F.col("n_domain"), prior)).alias("_host"))
    said = votes.where("declared is not null").groupBy("declared").agg(F.array(*tally).alias("n_declared"))
    said = said.select("declared", F.zip_with("n_declared", prior, lambda x, p: (x + KAPPA * p) / (total(F.col("n_declared")) + KAPPA) / p).alias("_declared"))
    suffix = F.regexp_extract("host", r"\.([^.]+)$", 1)
    by_suffix = F.array(*[F.when(reduce(lambda a, b: a | b, [suffix == s for s, to in SUFFIXES.items() if to == x] or [F.lit(False)]), F.lit(SUFFIX_WEIGHT)).otherwise(F.lit(1.0)) for x in langs])
    one = F.array(*[F.lit(1.0)] * len(langs))
    joined = scored.join(hosts, "host", "left").join(said, "declared", "left").withColumn("_suffix", by_suffix)
    logs = F.transform(F.arrays_zip(F.col("_ll").alias("a"), F.coalesce("_host", prior).alias("b"), F.coalesce("_declared", one).alias("c"), F.col("_suffix").alias("d")), lambda x: x["a"] + F.log(x["b"]) + F.log(x["c"]) + F.log(x["d"]))
    fused = joined.withColumn("_log", logs).withColumn("_none", F.col("_unknown") + float(np.log(UNKNOWN_PRIOR)))
    fused = fused.withColumn("_best", F.array_max("_log")).withColumn("_top", F.greatest("_best", "_none"))
    sure = F.exp(F.col("_best") - F.col("_top")) / F.aggregate("_log", F.exp(F.col("_none") - F.col("_top")), lambda s, x: s + F.exp(x - F.col("_top")))
    return fused.select(
        "doc_id",
        F.when(F.col("_letters") & (F.col("_best") >= F.col("_none")), _pick(F.col("_log"), langs)).otherwise(F.lit("und")).alias("language"),
        F.when(F.col("_letters"), sure).otherwise(F.lit(0.0)).alias("posterior"),
        "text_language",
        F.col("declared").alias("declared_language"),
        "host",
        (F.col("_letters") & (sure >= LEAST_POSTERIOR)).alias("accepted"),
        "text_hash",
    )


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The documents whose language is found, with their columns.

    Rows are told apart by a number of their own, so of rows with one id and one
    text each is judged by its own declaration and address.  Null and empty texts
    go; a very long text is scored whole.
    """
    rows, number = with_row_number(docs)
    rejected = identify(rows, number, text_col, **names).where(~F.col("accepted")).select(F.col("doc_id").alias(number))
    return rows.join(rejected, number, "left_anti").select(*docs.columns)


def page_text(html: Column) -> Column:
    """What a page shows, about: no scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[#A-Za-z0-9]+;", " ")


def identify_pages(pages: DataFrame, model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` for raw pages: their text, the lang attribute of their markup, and the host and suffix of their address.

    ``model`` comes from ``fit`` on other, labelled rows, so a page's declaration
    is evidence that the text model has not seen.  A null page has no text.
    """
    rows = pages.select(F.col(id_col), page_text(F.col(html_col)).alias("text"), F.col(url_col).alias("address"), markup_language(F.col(html_col)).alias("lang"))
    return identify(rows, id_col, "text", "address", model=model)
