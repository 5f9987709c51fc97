"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, licenses, minhash, outliers, packing, pii, rules, templates, tokenio, urls
from .common import ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary's place; another one can be named in the environment."""
    import public_tokenizers

    return os.environ.get("COLONNADE_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.score(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


def op4_token_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenio.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), 2)


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("sentence_ids", "licenses")})


_DRAWN: list[str] = []


def pii_key() -> str:
    """The key of the pseudonyms, a secret of whoever runs it, from COLONNADE_PII_KEY.

    Without one a key is drawn for this process: there is no key that others could know, and pseudonyms of
    different runs aren't linked.
    """
    if key := os.environ.get("COLONNADE_PII_KEY"):
        return key
    if not _DRAWN:
        _DRAWN.append(secrets.token_hex(32))
    return _DRAWN[0]


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key())


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 0, 2048)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_robust_outliers": op2_robust_outliers,
    "op3_site_templates": op3_site_templates,
    "op4_token_io": op4_token_io,
    "op5_url_vocabulary": op5_url_vocabulary,
    "op6_license_rules": op6_license_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_rule_ensemble": op8_rule_ensemble,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

#: Exact similarity of all pairs that share a shingle, and the closure of the links.
OP1_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles from s),
g as (select doc_id, hash(unnest(sh)) as h from s),
p as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from g a join g b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y
  where 100 * common >= 85 * (a.n_shingles + b.n_shingles - common)),
e as (select x, y from l union all select y, x from l),
reach(doc_id, other) as (
  select doc_id, doc_id from n union select r.doc_id, e.y from reach r join e on e.x = r.other)
select n.doc_id, n_shingles, min(other) as component_id, n.doc_id = min(other) as kept
from n join reach r on r.doc_id = n.doc_id group by 1, 2"""

#: All windows of items joined to all windows of documents of the same length; windows in a row are a longer match.
OP10_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
b as (select row_number() over () as rid, item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
bn as (select rid, item, ws, least(10, len(ws)) as n from b where len(ws) > 0),
bi as (select rid, item, ws, n, unnest(range(1, len(ws) - n + 2)) as j from bn),
iw as (select rid, item, j, n, array_to_string(ws[j:j + n - 1], ' ') as w from bi),
sizes as (select distinct n from bn),
di as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, sizes where len(ws) >= n),
h as (select di.doc_id, iw.rid, iw.item, di.i, iw.j, di.n from di join iw on iw.n = di.n and iw.w = array_to_string(di.ws[di.i:di.i + di.n - 1], ' ')),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as all_items from (select distinct doc_id, item from h) group by 1),
runs as (select doc_id, item, rid, n, i, j, i - row_number() over (partition by doc_id, rid, i - j order by i) as run from h),
long as (select doc_id, item, n + count(*) - 1 as longest, min(i) - 1 as pos, min(j) - 1 as item_at from runs group by doc_id, item, rid, n, i - j, run),
best as (select * from long qualify row_number() over (partition by doc_id order by longest desc, pos, item, item_at) = 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(all_items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest, 0)::bigint as longest,
  pos::bigint as longest_at, best.item as longest_item, item_at::bigint as longest_item_at
from d left join places using (doc_id) left join items using (doc_id) left join best using (doc_id)"""

ORACLES: dict[str, str] = {
    "op10_benchmark_decontamination": OP10_SQL,
    "op1_minhash_near_dedup": OP1_SQL,
    "op5_url_vocabulary": urls.oracle(URL_RULES),
    "op6_license_rules": licenses.oracle(),
}
