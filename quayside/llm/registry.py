"""Queries of the corpus operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import disclosure, fingerprints, line_dedup, merkle, merkle_sql, mixing, near_dedup, packing, page_text, quality, secret_scan, suffix_dedup, url_filter, whitening
from quayside.llm.common import tokenizer_path

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: Links of op6: 100 * intersection >= NEAR_PERCENT * union.
NEAR_PERCENT = 85


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_text.extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(table(spark, sf_dir, "documents"), from_ends=True)
    counts = [secret_scan.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.sha2(secret_scan.span_text(F.col("spans"), strong_only=True), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disclosure.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [disclosure.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    base = F.sha2(disclosure.span_text(F.col("spans"), base_only=True), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), disclosure.span_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), "clean")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "cleaned.n_lines", "cleaned.n_dropped", F.sha2("cleaned.text", 256).alias("kept_sha256"))


def op6_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=NEAR_PERCENT)


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.labels_in(spark, sf_dir), ["doc_id"]).select("doc_id", "__quality.*")


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compare(fingerprints.with_next(table(spark, sf_dir, "documents"), with_anchors=True))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "placed_edited",
        "placed_next",
        F.transform("anchors", lambda a: a["pos"]).alias("positions"),
    )


def op9_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_power_of_two(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in URL_RULES])))
    out = url_filter.match_rules(table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op11_two_stage_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_mixed_precision_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_van_emde_boas_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest_url_differencing": op1_nearest_url_differencing,
        "op2_multipart_secrets": op2_multipart_secrets,
        "op3_temperature_mixing": op3_temperature_mixing,
        "op4_disclosure": op4_disclosure,
        "op5_line_dedup": op5_line_dedup,
        "op6_setsketch_near_dedup": op6_setsketch_near_dedup,
        "op7_compression_bands": op7_compression_bands,
        "op8_closed_syncmers": op8_closed_syncmers,
        "op9_power_of_two_packing": op9_power_of_two_packing,
        "op10_url_filter": op10_url_filter,
        "op11_two_stage_suffix_dedup": op11_two_stage_suffix_dedup,
        "op12_mixed_precision_whitening": op12_mixed_precision_whitening,
        "op13_van_emde_boas_manifest": op13_van_emde_boas_manifest,
        "pipeline": pipeline,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIMMED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP_SQL = f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from split),
keyed as (select doc_id, line, pos, {_LOWER.format(_TRIMMED)} as k from lines),
common as (select k, max(doc_id) as last from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
judged as (select l.doc_id, l.line, l.pos, coalesce(l.doc_id < c.last, false) as gone from keyed l left join common c on l.k = c.k)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id"""

URL_FILTER_SQL = f"""
with rest as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
cut as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw_host from rest),
sites as (select page_id, {_LOWER.format("raw_host")} as host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from cut),
rules(rh, rp, rv) as (values {", ".join(str(r) for r in URL_RULES)}),
fit as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as rv
        from sites join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select s.page_id, s.host, s.path, f.rule, coalesce(f.rv, 'allow') as verdict from sites s left join fit f on s.page_id = f.page_id"""


def oracle_sql() -> dict[str, str]:
    """The other operators tokenise, compress, sketch or match patterns, which SQL can't express; brute force tests them."""
    return {"op5_line_dedup": LINE_DEDUP_SQL, "op10_url_filter": URL_FILTER_SQL, "op13_van_emde_boas_manifest": merkle_sql.SQL}
