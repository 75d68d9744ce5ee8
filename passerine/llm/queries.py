"""Queries of the training-data operators: thin callables over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import alignment, byte_dedup, decontaminate, exact_dedup, hard_negatives, langid, licenses, mixing, pii, secret_scan, sharding, simhash, substring_dedup
from .common import new_path, table


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_byte_dedup(spark, sf_dir: str) -> DataFrame:
    return byte_dedup.digests(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.passerine.surrogates.key", "key for the test tables only")
    found = pii.with_surrogates(table(spark, sf_dir, "documents"), key)
    return found.withColumn("text_sha256", F.sha2("text", 256))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared_language", "host", "accepted")


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """Law ``rows``; null texts count as empty, so their checksum is 0."""
    written = sharding.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark), 24)
    text = F.coalesce("text", F.lit(""))
    return written.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), whole=False)[0].withColumnRenamed("groups", "groups_sha256")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = ~F.coalesce(F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))), F.lit(False))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives.mine(rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 100 == 0)


def licenses_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can express."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secrets_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") or k.endswith("_base")}


_OP1 = """
with t as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, length(text) as len, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') as content from t),
r as (select doc_id, content, first_value(doc_id) over w as keep_id, row_number() over w as k,
  count(*) over (partition by content) as group_size
  from n window w as (partition by content order by len desc, doc_id))
select doc_id, keep_id, group_size, k = 1 as kept, sha256(content) as text_sha256 from r
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_SLICES = "list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ' '))"

_OP2 = f"""
with t as (select doc_id, {_TOKENS} as w from documents),
b as (select doc_id, len(w) as n_words, list_concat(
  list_transform(list_filter(range(len(w) - 1), lambda i: w[i + 1] = 'cc' and w[i + 2] = 'by'), lambda i: {{'i': i, 'l': 'cc-by'}}),
  list_transform(list_filter(range(len(w) - 2), lambda i: w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license'), lambda i: {{'i': i, 'l': 'gpl'}}),
  list_transform(list_filter(range(len(w) - 2), lambda i: w[i + 1] = 'all' and w[i + 2] = 'rights' and w[i + 3] = 'reserved'), lambda i: {{'i': i, 'l': 'reserved'}})) as f from t)
select doc_id, n_words, len(f) as n_base, list_min(list_transform(f, lambda x: x.i)) as first_word, list_max(list_transform(f, lambda x: x.i)) as last_word,
array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.l))), ',') as base_labels from b
"""

_OP3 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, o, substr(h, 2 * o + 1, 2398) as s from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 1000)) as o from d)),
w as (select doc_id, o + unnest(range(length(s) // 2 - 199)) as pos, unnest(list_transform(range(length(s) // 2 - 199), lambda i: md5(substr(s, 2 * i + 1, 400)))) as win from p),
f as (select win from w group by 1 having count(*) > 1),
r as (select *, sum(case when before is null or pos > before + 200 then 1 else 0 end) over (partition by doc_id order by pos) as run from (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from w semi join f using (win))),
g as (select doc_id, min(pos) as a, max(pos) + 200 as b from r group by doc_id, run),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from g),
j as (select doc_id, count(*) as n, sum(b - a) as gone, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from k join d using (doc_id) group by 1)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join j using (doc_id)
"""

_OP4 = f"""
with d as (select doc_id, {_TOKENS} as w from documents),
i as (select cast(item_id as varchar) as item, {_TOKENS} as w from benchmark),
q as (select item, w, least(len(w), 13) as n from i where len(w) > 0),
p as (select distinct item, n, unnest({_SLICES}) as win from q),
x as (select doc_id, n, unnest({_SLICES}) as win, unnest(range(len(w) - n + 1)) as pos from d, (select distinct n from p) where len(w) >= n),
m as (select doc_id, pos, n, item from x join p using (n, win)),
h as (select doc_id, count(*) as c from (select distinct doc_id, unnest(range(pos, pos + n)) as k from (select distinct doc_id, pos, n from m)) group by 1),
g as (select doc_id, count(*) as k, sha256(string_agg(item, ',' order by item)) as s from (select distinct doc_id, item from m where item is not null) group by 1)
select doc_id, len(w) as n_words, coalesce(c, 0) as n_hit, coalesce(k, 0) as n_items, coalesce(s, sha256('')) as items_sha256, coalesce(c, 0) > 0 and 20 * coalesce(c, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join g using (doc_id)
"""

_OP6 = """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, len(list_filter(regexp_extract_all(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) as n_assign,
len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) as n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 16)) as n_hex from t
"""

_OP8 = f"""
with d as (select doc_id, {_WORDS} as w, 13 as n from documents),
x as (select doc_id, unnest({_SLICES}) as win, unnest(range(len(w) - n + 1)) as pos from d where len(w) >= n),
f as (select win, min(doc_id) as least from x group by 1),
g as (select distinct doc_id, unnest(range(pos, pos + 13)) as k from x join f using (win) where least < doc_id),
u as (select doc_id, unnest(w) as word, unnest(range(len(w))) as k from d),
r as (select doc_id, string_agg(word, ' ' order by k) as kept, count(*) as n from u anti join g using (doc_id, k) group by 1)
select doc_id, len(w) as n_words, len(w) - coalesce(r.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (doc_id)
"""

_OP9 = f"""
with s as (select doc_id, source, len({_WORDS}) as size from documents),
z as (select source, cast(sum(size) as bigint) as n, row_number() over (order by source nulls last) as r from s group by 1),
l as (select source, n, r, cast(list_extract([3, 1, 2], (r - 1) % 3 + 1) as double) as w, cast(n * 2 as double) as most from z),
v as (select *, (sum(n) over () * 1.5e0 - coalesce(sum(most) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level from l window b as (order by most / w, r rows between unbounded preceding and 1 preceding)),
c as (select *, max(case when level * w <= most then level end) over () as final from v),
t as (select source, n, least(most, coalesce(final * w, most)) as target from c),
o as (select doc_id, size, n, target, cast(round(target) as bigint) as budget, coalesce(sum(size) over (partition by s.source order by md5(coalesce(cast(doc_id as varchar), 'null') || ':0'), doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from s join t on s.source is not distinct from t.source)
select doc_id, size, n as source_size, target, cast(case when n > 0 then budget // n else 0 end * size + greatest(0, least(size, budget - case when n > 0 then budget // n else 0 end * n - before)) as bigint) as taken from o
"""


_OP13 = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.b, p.score as positive, s.b as id, s.score, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
  from p join s on p.a = s.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select a as anchor_id, b as positive_id, cast(rank as int) as rank, id as negative_id, positive as positive_score, score as negative_score from n where rank <= 10
"""


def oracle_sql() -> dict:
    return {"op13_hard_negatives": _OP13, "op1_exact_dedup": _OP1, "licenses_base": _OP2, "op3_byte_dedup": _OP3, "op4_decontamination": _OP4, "secrets_base": _OP6, "op8_substring_dedup": _OP8, "op9_mixing": _OP9}
