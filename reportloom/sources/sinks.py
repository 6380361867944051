"""Result documents and flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import overall, severity, summarize_checks


def assemble_report(findings: DataFrame) -> DataFrame:
    """SNK1: one JSON document a report: its summary, checks and findings, in order of check, severity and entity."""
    checks = summarize_checks(findings)
    listed = checks.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("check_id", "status", "n_pass", "n_error", "n_warning", "n_skipped"))).alias("checks"))
    row = F.struct("check_id", (-severity()).alias("order"), "entity", "field", "status", "source_a", "source_b")
    rows = findings.groupBy("report_id").agg(F.array_sort(F.collect_list(row)).alias("findings"))
    out = overall(checks).join(listed, "report_id").join(rows, "report_id")
    summary = F.struct("overall", "n_checks", "passed", "errors", "warnings")
    return out.select("report_id", F.to_json(F.struct("report_id", summary.alias("summary"), "checks", F.transform("findings", lambda x: x.dropFields("order")).alias("findings"))).alias("document"))


def assemble_comparison(comparisons: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """SNK2: one JSON document a pair of requirement document and report: summary, clauses, and each clause's table expansions."""
    rows = comparisons.withColumn("tables", F.lit(None).cast("array<struct<table_number:int,total:long,n_matches:long>>"))
    if tables is not None:
        each = tables.groupBy("ptr_id", "report_id", "number_str").agg(F.array_sort(F.collect_list(F.struct(F.col("table_number").cast("int").alias("table_number"), "total", "n_matches"))).alias("tables"))
        rows = comparisons.join(each, ["ptr_id", "report_id", "number_str"], "left")
    n = lambda r: F.count_if(F.col("result") == r)
    clause = F.struct("number", "number_str", "result", "comparison_status", "match_reason", "similarity", "tables")
    out = rows.groupBy("ptr_id", "report_id").agg(F.struct(n("match").alias("matches"), n("differ").alias("differs"), n("missing").alias("missing"), n("excluded").alias("excluded")).alias("summary"), F.array_sort(F.collect_list(clause)).alias("clauses"))
    return out.select("ptr_id", "report_id", F.to_json(F.struct("ptr_id", "report_id", "summary", "clauses")).alias("document"))


def export_tables(findings: DataFrame) -> dict[str, DataFrame]:
    """SNK3: flat exports: overview a report, components, items, and issues with errors before warnings."""
    issues = findings.filter(F.col("status").isin("error", "warning")).withColumn("severity", severity())
    return {
        "overview": overall(summarize_checks(findings)),
        "components": findings.filter(F.col("check_id").isin("C04", "C05", "C06")),
        "items": findings.filter(F.col("check_id").isin("C07", "C08", "C09", "C10")),
        "issues": issues.orderBy("report_id", F.desc("severity"), "check_id", "entity", "field"),
    }
