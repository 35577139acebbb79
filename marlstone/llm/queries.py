"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, dartminhash, exact, mixing, packing, pii, quality, repair, rpforest, urls

#: (verdict, host/path): fixed values of the URL filter's contract.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("block", "net/de/"),
    ("allow", "example.net/de/8"),
    ("block", "org/es/"),
]


def vocabulary(name: str) -> str:
    """Where a tokenizer's file lies: a folder given by TOKENIZER_DIR, or the installed package of public files."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_shards(spark, sf_dir):
    return repair.token_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_rp_forest(spark, sf_dir):
    return rpforest.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_classes(table(spark, sf_dir, "documents"))


def op4_pii_sanitise(spark, sf_dir):
    return pii.span_digest(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_warc_archive(spark, sf_dir):
    return archive.archive_digest(table(spark, sf_dir, "pages"))


def op8_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_dart_minhash(spark, sf_dir):
    return dartminhash.near_texts(table(spark, sf_dir, "documents"))


def listed_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Canonical URLs of the pages whose document (the number in the path) is labelled toxic."""
    toxic = labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct()
    number = F.regexp_extract(urls.path(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    keyed = pages.select(F.nullif(number, F.lit("")).cast("long").alias("doc_id"), urls.canonical(F.col("url")).alias("key"))
    return keyed.where("doc_id is not null").join(toxic, "doc_id", "left_semi").select("key")


def op10_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, listed_urls(pages, table(spark, sf_dir, "labels")))


def queries() -> dict:
    found = (
        op1_repair_shards, op2_rp_forest, op3_exact_dedup, op4_pii_sanitise, op5_quality,
        op6_packing, op7_warc_archive, op8_mixing, op9_dart_minhash, op10_url_filter,
    )
    return {f.__name__: f for f in found}


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base32 of RFC 4648

_EXACT = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select doc_id, keep_id, group_size,
  doc_id is not distinct from keep_id and row_number() over (partition by t.text, doc_id) = 1 as kept,
  sha256(t.text) as text_sha256
from t join g on t.text = g.text
"""

_ARCHIVE = f"""
with t as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as top from t group by html),
d as (select page_id, top, cast(strlen(t.html) as bigint) as n, sha1(t.html) as h from t join g on t.html = g.html)
select page_id, n as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('{_B32}',
    1 + cast((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31 as integer), 1)),
    'string_agg', '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from d
"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_URLS = rf"""
with r(rule, rule_host, rule_path, verdict) as (values
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'allow'),
  ('org/es/', 'org', '/es/', 'block')),
p as (select row_number() over () as n, page_id, url, {_HOST} as host, {_PATH} as path from pages),
c as (select *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') as h,
    regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') as q,
    array_to_string(list_sort(list_filter(
      string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') as args,
    try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1), '') as bigint) as doc_id from p),
k as (select *, case when h <> '' then h || q || case when args <> '' then '?' || args else '' end end as key from c),
listed as (select distinct key from k where key is not null
  and doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null)),
m as (select n, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from p join r on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)
  group by n)
select page_id, host, path, m.rule as rule,
  coalesce(m.verdict, case when listed.key is not null then 'block' else 'allow' end) as verdict
from k left join m using (n) left join listed on k.key = listed.key
"""


_MIXING = r"""
with r as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(sha256(concat_ws(':', '11', doc_id::varchar, coalesce(text, ''))), 1, 15))::bigint as h from documents),
per as (select source, sum(size)::bigint as source_size from r group by source),
w as (select *, source_size * 3.0::double as most,
    list_extract([1.0::double, 2.0, 3.0], ((row_number() over (order by source nulls last) - 1) % 3 + 1)::integer) as weight,
    row_number() over (order by source nulls last) as place from per),
lv as (select *, (sum(source_size) over () - coalesce(sum(most) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level
  from w window o as (order by most / weight, place rows between unbounded preceding and 1 preceding)),
fin as (select arg_min(level, row(most / weight, place)) as final from lv where level * weight <= most),
tg as (select source, source_size, case when source_size > 0 then least(most, coalesce(final, 'inf'::double) * weight) else 0 end as target from lv cross join fin),
q as (select r.doc_id, r.source, r.h, r.size, source_size, target,
    (sum(size) over (partition by r.source order by h, doc_id nulls first rows unbounded preceding))::bigint as upto
  from r join tg on r.source is not distinct from tg.source where size > 0),
c as (select *, (round * source_size + upto) / target as finish from q cross join (values (0), (1), (2)) t(round)),
s as (select *, sum(size) over (order by finish, source nulls first, h, doc_id nulls first, round rows unbounded preceding) as run
  from c where finish - size / (2 * target) <= 1.0),
taken as (select doc_id, source, h, sum(size)::bigint as all_taken from s
  where run - size / 2 <= (select sum(source_size) from per) group by doc_id, source, h),
e as (select *, row_number() over (partition by doc_id, source, h) as copy, count(*) over (partition by doc_id, source, h) as copies from r),
f as (select e.*, coalesce(all_taken, 0) // greatest(size, 1) as times from e left join taken t
  on e.doc_id is not distinct from t.doc_id and e.source is not distinct from t.source and e.h = t.h)
select f.doc_id, f.size, tg.source_size, tg.target, ((times // copies + (copy <= times % copies)::bigint) * size)::bigint as taken
from f join tg on f.source is not distinct from tg.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": _MIXING, "op3_exact_dedup": _EXACT, "op7_warc_archive": _ARCHIVE, "op10_url_filter": _URLS}
