"""Thin queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .fuzzy_lines import fuzzy_line_dedup
from .language_model import lm_scores
from .license_scan import license_scan
from .mixing import mix
from .near_dedup import near_dedup
from .quality import quality_scores
from .token_counts import token_counts
from .warc import derivatives, responses_of_pages


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_line_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derivatives(responses_of_pages(table(spark, sf_dir, "pages")), "page_id")
    return found.withColumn("block", F.decode("block", "UTF-8")).drop("warc")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP2_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
     g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t"""

OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [2, 3, 1][(row_number() over (order by source is null, source) % 3)::int + 1]::double as w from s),
f as (select *, source_size * 2.0::double / w as full_at from w),
r as (select *, row_number() over o as i,
             1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0) as rest,
             sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0) as w_rest
      from f window o as (order by full_at, source is null, source)),
l as (select coalesce(arg_min(rest / w_rest, i) filter (where rest / w_rest <= full_at), 1e300) as lv from r),
t as (select source, source_size, least(2.0::double * source_size, lv * w) as target from r, l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
q as (select *, target - whole * source_size as need from p),
c as (select d.doc_id, d.size, q.source_size, q.target, q.whole, q.need, d.h,
             sum(d.size) over (partition by d.source order by d.h range unbounded preceding) as upto,
             sum(d.size) over (partition by d.source, d.h) as own
      from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target,
       (size * least(2, whole + case when upto <= need or (upto - own <= need and 2 * (need - (upto - own)) > own) then 1 else 0 end))::bigint as taken
from c"""

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_near_dedup, op4_lm_scoring, op5_license_scan, op6_fuzzy_lines, op7_warc_derivatives, op8_quality, op9_decontamination, op10_source_mix)}
SQL = {"op2_exact_dedup": OP2_SQL, "op10_source_mix": OP10_SQL}
