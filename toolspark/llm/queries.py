"""The queries of this subpackage, one for each operator, with production parameters over whole tables, and SQL where it can say the same.

Where SQL can say a part of an operator's result only, that part is a query of its own, read off the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolspark.llm import quality
from toolspark.llm.common import read
from toolspark.llm.fingerprints import op10_fingerprints
from toolspark.llm.html_text import op9_html_extraction
from toolspark.llm.mixing import op8_mixing
from toolspark.llm.packing import op3_packing
from toolspark.llm.private import op2_private
from toolspark.llm.quality import op4_quality_rules
from toolspark.llm.simhash import op7_simhash_near_dedup
from toolspark.llm.substring_dedup import op5_substring_dedup
from toolspark.llm.suffix_dedup import op1_suffix_dedup
from toolspark.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_private, op3_packing, op4_quality_rules, op5_substring_dedup, op6_toxicity, op7_simhash_near_dedup, op8_mixing, op9_html_extraction, op10_fingerprints)}


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed rules of operator 4."""
    return quality.assess(read(spark, sf_dir, "documents"), None).select("doc_id", *[f"quality_.{c}" for c in [*quality.BASE, "base_failed"]])


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of operator 8, and whether no document is taken too often and no source far from its target."""
    rows = op8_mixing(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    return out.select("source", "docs", "source_size", "target", (F.abs(F.col("taken") - F.col("target")) <= 64).alias("near"), (F.col("over") <= 0).alias("bounded"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of operator 10."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES |= {f.__name__: f for f in (quality_counts, mixing_targets, fingerprint_edits)}
ORACLES = {
    "quality_counts": r"""
        with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
        p as (select doc_id, unnest(range(1, len(ws) - 3)) i, ws from d where len(ws) >= 5),
        r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, array_to_string(ws[i:i + 4], ' ')) c from p) where c > 1),
        cov as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + 5)) j from r) group by doc_id),
        l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
        b as (select d.doc_id, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
                     (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from d join l using (doc_id) left join cov using (doc_id))
        select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from b""",
    "mixing_targets": r"""
        with s as (select source, count(*) docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::bigint z from documents group by source),
        w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 w from s),
        o as (select *, sum(z) over () t, sum(w) over () ww, 3 * z / w ratio, row_number() over (order by 3 * z / w, source) k from w where z > 0),
        c as (select *, (t - 3 * coalesce(sum(z) over (order by k rows between unbounded preceding and 1 preceding), 0)) / (ww - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0)) unit from o),
        u as (select arg_min(unit, k) filter (where unit <= ratio) unit from c)
        select source, docs, z source_size, round(case when z = 0 then 0.0 else least(3.0 * z, w * coalesce((select unit from u), 1e300)) end, 3)::double target, true near, true bounded from w""",
    "fingerprint_edits": """
        with n as (select doc_id, coalesce(text, '') t, coalesce(lead(coalesce(text, '')) over (order by doc_id), first_value(coalesce(text, '')) over (order by doc_id)) f from documents)
        select doc_id, length(t)::bigint n_chars, sha256(left(t, length(t) - length(t) // 4) || left(f, length(t) // 4)) edited_sha256 from n""",
    "op1_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
        p as (select doc_id, h, unnest(range(0, n - 199)) i from d where n >= 200),
        r as (select doc_id, i from (select doc_id, i, count(*) over (partition by md5(substr(h, 2 * i + 1, 400))) c from p) where c > 1),
        s as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end new from r),
        g as (select doc_id, i, sum(new) over (partition by doc_id order by i) k from s),
        spans as (select doc_id, k, min(i) a, max(i) + 200 z from g group by doc_id, k),
        gaps as (select doc_id, k, a, z, coalesce(lag(z) over (partition by doc_id order by k), 0) b from spans),
        cut as (select doc_id, sum(z - a)::bigint removed, count(*) n_spans, max(z) tail, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' order by k) head from gaps join d using (doc_id) group by doc_id)
        select doc_id, n::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) kept_sha256
        from d left join cut using (doc_id)""",
    "op5_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
        p as (select doc_id, ws, unnest(range(1, len(ws) - 33)) i from w where len(ws) >= 35),
        r as (select doc_id, i from (select doc_id, i, count(*) over (partition by array_to_string(ws[i:i + 34], ' ')) c from p) where c > 1),
        cov as (select distinct doc_id, unnest(range(i, i + 35)) j from r),
        each as (select doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) j from w)
        select w.doc_id, len(any_value(ws))::bigint n_words, count(cov.j)::bigint n_removed,
               sha256(coalesce(string_agg(word, ' ' order by each.j) filter (where cov.j is null), '')) kept_sha256
        from w left join each on w.doc_id = each.doc_id left join cov on cov.doc_id = each.doc_id and cov.j = each.j group by w.doc_id""",
}
