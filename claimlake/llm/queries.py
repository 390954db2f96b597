"""Queries of the training-data operators, by name, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimlake.llm import bitext, codedocs, incremental, leakage, markup, packing, residue


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codedocs.own_functions(_read(spark, sf_dir, "source_files")).select("file_id", "decl_line").distinct()


def p1_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codedocs.pair_functions(_read(spark, sf_dir, "source_files"))


def p2_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.block_text(_read(spark, sf_dir, "doc_lines"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_structure(_read(spark, sf_dir, "doc_lines"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_pages(_read(spark, sf_dir, "doc_lines"))


def _p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.align_pairs(_read(spark, sf_dir, "pairs"), _read(spark, sf_dir, "pair_sentences"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3_links(spark, sf_dir).select("pair_id", "source_no", "translation_no")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.link_types(_p3_links(spark, sf_dir))


def p4_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.link_batches(_read(spark, sf_dir, "findings"), exact=False)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.link_batches(_read(spark, sf_dir, "findings")).select("kept_id", "dup_id")


def p4_baselined(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _read(spark, sf_dir, "findings")
    return incremental.baselined_check(findings, incremental.link_batches(findings))


def p6_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pack_plans"), fit=False)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pack_plans"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _read(spark, sf_dir, "pack_plans")
    return packing.fill_report(packing.pack_documents(_read(spark, sf_dir, "documents"), plans), plans)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_coverage(spark, sf_dir).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p8_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.response_scores(_read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_evidence(_read(spark, sf_dir, "documents")).select("doc_id")


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_evidence(_read(spark, sf_dir, "documents"))


QUERIES = {
    "p1_method": p1_method,
    "p1_found": p1_found,
    "p2_method": p2_method,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p4_method": p4_method,
    "p4_found": p4_found,
    "p4_baselined": p4_baselined,
    "p6_method": p6_method,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_coverage": p7_coverage,
    "p7_cleaned": p7_cleaned,
    "p8_method": p8_method,
    "p8_found": p8_found,
    "p8_reasons": p8_reasons,
}

_P4_CLAIMS = r"""
WITH named AS (
  SELECT finding_id, batch_no, repo, rule,
    regexp_replace(regexp_replace(lower(trim(replace(file, '\', '/'))), '/(\./|/)+', '/', 'g'), '^(\./+|/+)+', '') AS doc,
    regexp_replace(trim(regexp_extract(trim(regexp_replace(message, '\s+', ' ', 'g')),
      '^(?:no fact matches |reference to |could not find |the text mentions |claim )?(\S+)', 1, 'i'), '`''"*<>«»“”„‘’‚‹›.,;:'), '(\(\))+$', '') AS ref
  FROM findings),
claims AS (SELECT *, min(finding_id) OVER (PARTITION BY repo, rule, doc, ref) AS kept_id FROM named
  WHERE repo IS NOT NULL AND rule IS NOT NULL AND doc <> '' AND ref <> '')
"""

ORACLE = {
    "p4_found": _P4_CLAIMS + "SELECT kept_id, finding_id AS dup_id FROM claims WHERE kept_id < finding_id",
    "p4_baselined": _P4_CLAIMS + """
SELECT f.repo, f.batch_no, count(*) AS n_findings, count(c.finding_id) AS n_repeated, count(*) - count(c.finding_id) AS n_new
FROM findings f LEFT JOIN claims c ON c.finding_id = f.finding_id AND c.kept_id < c.finding_id GROUP BY ALL""",
}
