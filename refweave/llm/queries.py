"""The corpus queries by name, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, htmltext, minhash, mixing, pii, quality, secrets, sentencepiece, urls, warc
from .common import prepared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.digest(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_sentencepiece, op3_warc, op4_mixing, op5_minhash, op6_neighbours, op7_secrets, op8_urls, op9_quality, op10_html)
}

OP3 = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
h as (select page_id, octet_length(b) as n, sha1(b) as x from p),
d as (select page_id, n, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(x, 1 + 5 * i, 5) as bigint) >> k) & 31)::int, 1)), '')), '') as payload_digest from h),
f as (select *, min(page_id) over (partition by payload_digest) as m from d)
select page_id, cast(n as bigint) as payload_bytes, payload_digest, case when page_id = m then 'response' else 'revisit' end as record_type,
    case when page_id = m then null else m end as refers_to from f
"""

OP4 = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
per as (select source, cast(sum(size) as bigint) as source_size from d group by source),
named as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
    row_number() over (order by source nulls last) as n, cast(2 * source_size as double) as cap, sum(source_size) over () * 1.5::double as budget from per),
runs as (select *, row_number() over (order by cap / w, n) as k,
    sum(cap) over (order by cap / w, n rows unbounded preceding) - cap as caps_before,
    sum(w) over () - sum(w) over (order by cap / w, n rows unbounded preceding) + w as w_rest from named),
lev as (select *, (budget - caps_before) / w_rest as lvl from runs),
fit as (select arg_min(lvl, k) as best from lev where lvl <= cap / w),
rates as (select source, source_size, case when best is null then cap else least(cap, w * best) end as target from lev left join fit on true),
mixed as (select d.doc_id, d.size, r.source_size, r.target, case when r.source_size > 0 then r.target / r.source_size else 0 end as rate,
    cast(('0x' || substr(md5('mix-1:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8)) as bigint) / 4294967296.0::double as u
    from d join rates r on d.source is not distinct from r.source)
select doc_id, size, source_size, target,
    cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from mixed
"""

OP9 = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
win as (select r, i, ws[i:i + 4] as g from w, unnest(range(1, len(ws) - 3)) as u(i)),
twice as (select r, i, count(*) over (partition by r, g) as n from win),
covered as (select r, i, least(5, coalesce(lead(i) over (partition by r order by i) - i, 5)) as own from twice where n > 1),
rep as (select r, cast(sum(own) as bigint) as n from covered group by r),
lines as (select r, count(*) - count(distinct x) as n from w, unnest(string_split(t, chr(10))) as u(x) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
base as (select w.r, doc_id, source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(lines.n, 0) as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from w left join rep on w.r = rep.r left join lines on w.r = lines.r),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base),
host as (select source, count(*) as n, count(*) filter (where base_failed) as failed from judged group by source),
prior as (select coalesce(avg(failed / n), 0) as m, coalesce(var_pop(failed / n), 0) as v from host),
weight as (select m, case when v > 0 then greatest(1, m * (1 - m) / v - 1) else 1 end as a from prior),
verdict as (select source, (failed + m * a) / (n + a) <= 0.5 as host_ok from host, weight)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed) and host_ok as kept
from judged join verdict on judged.source is not distinct from verdict.source
"""

ORACLES: dict[str, str] = {"op3_warc": OP3, "op4_mixing": OP4, "op9_quality": OP9}
