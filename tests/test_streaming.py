"""Streaming jobs against their batch forms, and sources and sinks."""

import json

from pyspark.sql import functions as F

from reportloom.operators import items, summary
from reportloom.plans import derive
from reportloom.sources import corpus, sinks
from reportloom.streaming import audit

SF = "/root/testdata/sf0.001"


def test_stream_audit_equals_batch(spark, tmp_path):
    rows = derive.source(spark, SF, "inspection_items").filter("report_id < 200").cache()
    folder = str(tmp_path / "in")
    check = lambda df: items.check_c09(df).select("report_id", "status", "n_numbers")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    stale = rows.withColumn("sequence_number", F.lit("9"))
    for part in (rows.filter("report_id < 60").unionByName(stale.filter("report_id between 60 and 119")), rows.filter("report_id >= 60")):  # 60 to 119 are delivered again
        part.coalesce(1).write.mode("append").parquet(folder)
        audit.stream_audit(spark, folder, str(tmp_path / "out"), str(tmp_path / "ckpt"), schema, check).awaitTermination()
    got = {tuple(r) for r in audit.current_findings(spark, str(tmp_path / "out")).select("report_id", "status", "n_numbers").collect()}
    assert got == {tuple(r) for r in check(rows).collect()}


def test_page_completeness(spark, tmp_path):
    kind = "report_id long, current_page int, total_pages int, ts timestamp"
    rows = spark.sql("SELECT 1L AS report_id, 1 AS current_page, 2 AS total_pages, timestamp'2026-01-01 00:00:00' AS ts UNION ALL SELECT 1L, 2, 2, timestamp'2026-01-01 00:01:00' UNION ALL SELECT 2L, 3, 3, timestamp'2026-01-01 00:00:00'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.sql("SELECT 9L AS report_id, 1 AS current_page, 1 AS total_pages, timestamp'2026-01-02 00:00:00' AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = audit.stream_page_completeness(stream).writeStream.format("memory").queryName("complete").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["report_id"]: (r["missing_pages"], r["complete"]) for r in spark.table("complete").collect()}
    assert got[1] == ([], True) and got[9] == ([], True) and got.get(2, ([1, 2], False)) == ([1, 2], False)


def test_windows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    out = audit.findings_by_window(events, by="event_type")
    assert out.agg(F.sum("n")).first()[0] == events.count()
    assert audit.findings_by_window(events, by="event_type", slide="30 minutes").agg(F.sum("n")).first()[0] == 2 * events.count()
    assert audit.findings_by_session(events, by="event_type").agg(F.sum("n")).first()[0] == events.count()


def test_sources_and_sinks(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "检 验 报 告 首 页"), (1, 2, "x" * 60), (2, 1, "照片 1")], "report_id long, page_no int, raw_text string")
    docs = spark.createDataFrame([(1, 10), (2, 10**9), (3, 5)], "report_id long, n_bytes long")
    assert {r["report_id"]: r["reject_reason"] for r in corpus.admit(docs, pages).collect()} == {1: None, 2: "too_large", 3: "no_pages"}
    assert corpus.find_anchor_page(pages).first()["page_no"] == 1 and corpus.photo_pages(pages).count() == 1
    findings = spark.createDataFrame([(1, "C01", "e", "f", "error", "a", "b"), (1, "C09", None, None, "pass", None, None)], "report_id long, check_id string, entity string, field string, status string, source_a string, source_b string")
    document = json.loads(sinks.assemble_report(findings).first()["document"])
    assert document["summary"]["errors"] == 1 and [c["check_id"] for c in document["checks"]] == ["C01", "C09"]
    assert sinks.export_tables(findings)["issues"].count() == 1
    sinks.assemble_report(findings).write.json(str(tmp_path / "out"))
    assert corpus.load_results(spark, str(tmp_path / "out")).count() == 1
    pages.withColumns({"width": F.lit(1.0), "height": F.lit(1.0), "page_header": F.lit("")}).write.parquet(str(tmp_path / "c" / "pages.parquet"))
    assert corpus.load_corpus(spark, str(tmp_path / "c"), tables=("pages",))["pages"].count() == 3
    assert summary.FINDING[0] == "report_id"
