"""The operators' queries over whole tables, and SQL for their results where SQL has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from witnesslake.llm import align, ann, audit, bpe, decontam, htmltext, linededup, quality, secrets, shards, simhash, urls, warc
from witnesslake.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_components(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_url_filter, op3_neighbours, op4_decontamination, op5_secrets, op6_html, op7_line_dedup, op8_shards, op9_bpe, op10_simhash, op11_warc, op12_audit, op13_alignment)}

ORACLES = {
    "op11_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages), g as (select page_id, cast(strlen(h) as bigint) as n, sha1(h) as d, max(page_id) over (partition by h) as latest from p)
        select page_id, n as payload_bytes, d as payload_digest, case when n >= 1000 and page_id <> latest then 'revisit' else 'response' end as record_type, case when n >= 1000 and page_id <> latest then latest end as refers_to from g
    """,
    "op12_audit": r"""
        with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
        w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as least from d),
        q as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                case when len(ws) < 50 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end
                || case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 'C' else '' end
                || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when least < w.doc_id then 'E' else '' end as failed
              from w left join q on w.doc_id = q.doc_id),
        p as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, failed),
        l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
        o as (select a.c || b.c || c.c || d.c || e.c as filter_order from l a, l b, l c, l d, l e
              where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        s as (select filter_order, k as step, substr(filter_order, k, 1) as x, substr(filter_order, 1, k - 1) as before from o, (select unnest(range(1, 6)) as k)),
        r as (select part, filter_order, step::int as step, x,
                coalesce(sum(n) filter (translate(failed, before || x, '') = failed), 0) as kept,
                coalesce(sum(n) filter (contains(failed, x) and translate(failed, before, '') = failed), 0) as removed,
                coalesce(sum(n) filter (contains(failed, x) and translate(failed, before, '') <> failed), 0) as redundant,
                coalesce(sum(n) filter (failed = x), 0) as unique_fails,
                coalesce(sum(good) filter (contains(failed, x) and translate(failed, before, '') = failed), 0) as good_lost,
                coalesce(sum(toxic) filter (contains(failed, x) and translate(failed, before, '') = failed), 0) as toxic_lost
              from p, s group by part, filter_order, step, x)
        select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
            good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from r
    """,
    "op4_decontamination": r"""
        with tok as (select rowid as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from (select row_number() over () as rowid, doc_id, text from documents)),
        d as (select r, doc_id, coalesce(w, []) as w, len(coalesce(w, [])) as n from tok),
        b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bw as (select distinct item_id, least(13, len(w)) as k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
               from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)),
        ks as (select distinct k from bw),
        dw as (select r, k, i, array_to_string(w[i : i + k - 1], ' ') as s from (select r, w, k, unnest(range(1, n - k + 2)) as i from d, ks where n >= k)),
        hit as (select r, i, dw.k, item_id from dw join bw on dw.k = bw.k and dw.s = bw.s),
        pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from (select distinct r, i, k from hit)) group by r),
        its as (select r, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct r, cast(item_id as varchar) as x from hit) group by r)
        select doc_id, n as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= n as contaminated
        from d left join pos using (r) left join its using (r)
    """,
    "op2_url_filter": r"""
        with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as r from pages),
        parts as (select page_id,
            coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
        fits as (select *, case
            when ends_with('.' || host, '.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
            when ends_with('.' || host, '.example.com') and starts_with(path, '/en/') then 'example.com/en/'
            when ends_with('.' || host, '.net') and starts_with(path, '/es/') then 'net/es/'
            when ends_with('.' || host, '.net') and starts_with(path, '/fr/') then 'net/fr/'
            when ends_with('.' || host, '.com') and starts_with(path, '/') then 'com/' end as rule from parts)
        select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from fits
    """,
}
