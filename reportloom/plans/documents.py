"""Table reconstruction and clause comparison as queries over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clauses, items, pairs, summary, tables
from ..streaming import audit as audit_stream
from .checks import joined, long
from .derive import ctes, source


def grid(spark: SparkSession, d: str) -> DataFrame:
    return tables.framed(source(spark, d, "cells"))


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.header_rows(tables.densify(source(spark, d, "cells"))).select("table_id", long("row_no"))


def column_roles(spark: SparkSession, d: str) -> DataFrame:
    return tables.framed_columns(grid(spark, d)).select("table_id", long("col_no"), "key", "role")


def filled(spark: SparkSession, d: str) -> DataFrame:
    return tables.framed_cells(grid(spark, d))


def fill_down(spark: SparkSession, d: str) -> DataFrame:
    return filled(spark, d).filter("in_body").select("table_id", long("row_no"), long("col_no"), "text", "role", "source", long("from_row"))


def parameter_records(spark: SparkSession, d: str) -> DataFrame:
    out = tables.pick_value(tables.records_of(filled(spark, d).filter("in_body")))
    flat = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws("=", x["k"], x["v"])), ";")
    values = F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return out.select("table_id", "parameter_name", flat("dimensions").alias("dimensions"), values.alias("values"), joined("source_rows"), "reference_value")


def confidence(spark: SparkSession, d: str) -> DataFrame:
    return tables.framed_confidence(filled(spark, d)).select("table_id", "structure_confidence", joined("notes"), "needs_manual_review")


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_diagnostics(tables.densify(source(spark, d, "cells")))


def extracted(spark: SparkSession, d: str) -> DataFrame:
    return clauses.extract_clauses(source(spark, d, "ptr_lines"))


def extract(spark: SparkSession, d: str) -> DataFrame:
    return extracted(spark, d).select("ptr_id", "number_str", "text_content", long("level"), long("page_no"), long("line_no"))


def dedup(spark: SparkSession, d: str) -> DataFrame:
    return clauses.dedup_clauses(extracted(spark, d)).select("ptr_id", "number_str", "text_content", long("page_no"), long("line_no"))


def classify(spark: SparkSession, d: str) -> DataFrame:
    return clauses.clause_type_counts(clauses.classify_clauses(clauses.dedup_clauses(extracted(spark, d))))


def references(spark: SparkSession, d: str) -> DataFrame:
    return clauses.table_refs(clauses.dedup_clauses(extracted(spark, d))).select("ptr_id", "number_str", long("table_number"))


def markers(spark: SparkSession, d: str) -> DataFrame:
    return clauses.sub_items(clauses.dedup_clauses(extracted(spark, d))).select("ptr_id", "number_str", long("line_no"), "marker", "text")


def own_pairs(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d, "inspection_items").select(F.col("report_id").alias("ptr_id"), "report_id").distinct()


def matched(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d, "inspection_items")
    out = clauses.match_clauses(clauses.dedup_clauses(extracted(spark, d)), rows, own_pairs(spark, d))
    return out.select("ptr_id", "report_id", "number_str", long("position"), long("tier"))


def compared(spark: SparkSession, d: str) -> DataFrame:
    return clauses.compare_documents(clauses.dedup_clauses(extracted(spark, d)), source(spark, d, "inspection_items"), own_pairs(spark, d))


def compare(spark: SparkSession, d: str) -> DataFrame:
    out = clauses.diff_rows(compared(spark, d))
    return out.select("ptr_id", "report_id", "number_str", long("position"), "result", "comparison_status", "match_reason", "similarity", F.size("differences").cast("long").alias("n_differences"))


def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.summarize_comparison(compared(spark, d)).select("ptr_id", "report_id", "matches", "differs", "missing", "excluded", "evaluated", "special", joined("missing_clauses"), joined("out_of_scope"), "match_rate")


def promoted(spark: SparkSession, d: str) -> DataFrame:
    out = clauses.promote_parents(clauses.compare_documents(clauses.dedup_clauses(extracted(spark, d)), source(spark, d, "inspection_items"), own_pairs(spark, d)))
    return out.select("ptr_id", "report_id", "number_str", "result", "promoted")


def constraints(spark: SparkSession, d: str) -> DataFrame:
    """N18 over line items: a discount of 0.05±3 hundredths and a quantity of at most 25, written as texts."""
    rows = source(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("5±3").alias("e1"), F.round(F.col("l_discount") * 100).cast("long").cast("string").alias("a1"), F.lit("≤25").alias("e2"), F.col("l_quantity").cast("long").cast("string").alias("a2"))
    return rows.groupBy("l_orderkey").agg(F.count_if(text.satisfies(F.col("e1"), F.col("a1"))).alias("n_discount"), F.count_if(text.satisfies(F.col("e2"), F.col("a2"))).alias("n_quantity"), F.count("*").alias("n"))


def date_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d, "labels_ocr")
    return rows.select("report_id", "label_id", text.date_format_of("production_date").alias("form"), F.date_format(text.parse_date("production_date"), "yyyy-MM-dd").alias("parsed"))


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d, "inspection_items")
    ranges = rows.select("report_id").distinct().withColumns({"lo": F.lit(2), "hi": (F.lit(2) + F.col("report_id") % 3).cast("int")})
    return items.exclude_ranges(rows, ranges).select("report_id", long("position"), "sequence_number")


def normalized(spark: SparkSession, d: str) -> DataFrame:
    """N1 over the documents, with the length of the result and a checksum."""
    out = text.normalize_text(source(spark, d, "documents").select("doc_id", "text"), "text", "normalized")
    return out.select("doc_id", F.length("normalized").cast("long").alias("n_chars"), F.crc32(F.encode("normalized", "utf-8")).alias("checksum"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    return text.rule_audit(source(spark, d, "documents"), "text")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return text.symbol_summary(source(spark, d, "documents"), "text", "doc_id").select("symbol", "n", "n_rows", F.size("contexts").cast("long").alias("n_contexts"))


def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """U1 over the labels of each report: components and labels whose models are alike to 4/5."""
    comps, labels = source(spark, d, "components").alias("c"), source(spark, d, "labels_ocr").alias("l")
    both = comps.join(labels, "report_id").select("report_id", "component_id", "label_id", F.col("c.model_spec").alias("a"), F.col("l.model_spec").alias("b"))
    return pairs.pair_similarity(both, "a", "b", 0.8).filter("similarity >= 0.8").withColumn("similarity", F.round("similarity", 6))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """ST3 in batch form over the events."""
    out = audit_stream.findings_by_window(source(spark, d, "events"), by="event_type")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """A4 over conversations: each is a report whose turns, from 0, are its numbers."""
    rows = source(spark, d, "conversations").select(F.col("conv_id").alias("report_id"), (F.col("turn") + 1).cast("int").alias("position"), (F.col("turn") + 1).cast("string").alias("sequence_number"), *[F.lit("x").alias(c) for c in items.PAYLOAD])
    return items.check_c09(rows).select("report_id", long("first_number"), long("last_number"), "n_numbers", joined("missing_numbers"), joined("duplicate_numbers"))


QUERIES = {
    "st3_hourly": hourly, "a4_turns": turns,
    "t2_header_rows": header_rows, "t5_column_roles": column_roles, "t7_fill_down": fill_down, "t9_parameter_records": parameter_records, "t10_structure_confidence": confidence, "a18_table_diagnostics": diagnostics,
    "t19_clauses": extract, "t20_dedup_clauses": dedup, "a15_clause_types": classify, "t21_table_refs": references, "t21_sub_items": markers, "j10_match_clauses": matched, "c1_compare_documents": compare,
    "a12_comparison_summary": compare_summary, "a17_promote_parents": promoted, "n18_constraints": constraints, "n14_dates": date_forms, "j17_exclude_ranges": exclusions, "n1_normalize": normalized, "n1_rule_audit": audit, "n3_symbols": symbols, "u1_similarity": similar_names,
}

BODY = """
raw AS (SELECT table_id, row_no, arg_max(text, 1) AS x, max(CASE WHEN col_no = 0 THEN text END) AS c0, max(CASE WHEN col_no = 1 THEN text END) AS c1, max(CASE WHEN col_no = 2 THEN text END) AS c2, max(CASE WHEN col_no = 3 THEN text END) AS c3 FROM cells GROUP BY table_id, row_no),
hdr AS (SELECT table_id, row_no, CASE WHEN contains(concat(c0, c1, c2, c3), '参数') OR contains(concat(c0, c1, c2, c3), '标准设置') THEN 1
  WHEN row_no IN (1, 2) AND (c0 = '' OR c1 = '' OR c2 = '' OR c3 = '') AND concat(c0, c1, c2, c3) <> '' AND c3 <> '±5%' THEN 1 ELSE 0 END AS h FROM raw WHERE row_no < 4),
run AS (SELECT table_id, row_no, h, sum(h) OVER (PARTITION BY table_id ORDER BY row_no) AS s FROM hdr),
headers AS (SELECT table_id, row_no FROM run WHERE h = 1 AND s = row_no + 1)"""
LINES = r"""
ln AS (SELECT ptr_id, page_no, line_no, regexp_replace(line, '\s+$', '') AS line FROM ptr_lines),
op AS (SELECT *, regexp_matches(line, '^(\d+(?:\.\d+)*)(?:[.．、。]?\s*)(.+)$') AS opens FROM ln WHERE line <> '' AND NOT regexp_matches(line, '^\s*\d+\s*/\s*\d+\s*$')),
isl AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY ptr_id, page_no ORDER BY line_no) AS island FROM op),
cl AS (SELECT ptr_id, page_no, island, min(CASE WHEN opens THEN regexp_extract(line, '^(\d+(?:\.\d+)*)(?:[.．、。]?\s*)(.+)$', 1) END) AS number_str, min(line_no) AS line_no,
  trim(string_agg(CASE WHEN opens THEN regexp_extract(line, '^(\d+(?:\.\d+)*)(?:[.．、。]?\s*)(.+)$', 2) ELSE line END, chr(10) ORDER BY line_no)) AS text_content FROM isl WHERE island > 0 GROUP BY ptr_id, page_no, island),
clauses AS (SELECT ptr_id, number_str, text_content, CAST(len(string_split(number_str, '.')) AS BIGINT) AS level, CAST(page_no AS BIGINT) AS page_no, CAST(line_no AS BIGINT) AS line_no FROM cl WHERE string_split(number_str, '.')[1] = '2'),
best AS (SELECT ptr_id, number_str, text_content, row_number() OVER (PARTITION BY ptr_id, number_str ORDER BY length(regexp_replace(text_content, '\s+', '', 'g')) DESC, page_no, line_no) AS k,
  first_value(page_no) OVER w AS page_no, first_value(line_no) OVER w AS line_no FROM clauses WINDOW w AS (PARTITION BY ptr_id, number_str ORDER BY page_no, line_no)),
dd AS (SELECT ptr_id, number_str, text_content, page_no, line_no FROM best WHERE k = 1)"""
SQL = {
    "st3_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "a4_turns": """WITH b AS (SELECT conv_id, min(turn) + 1 AS lo, max(turn) + 1 AS hi, count(DISTINCT turn) AS n, list(DISTINCT turn + 1) AS ns FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS mis FROM (SELECT conv_id, ns, unnest(range(lo, hi + 1)) AS x FROM b) WHERE NOT list_contains(ns, x) GROUP BY conv_id),
d AS (SELECT conv_id, string_agg(CAST(turn + 1 AS VARCHAR), ',' ORDER BY turn) AS dup FROM (SELECT conv_id, turn FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1) GROUP BY conv_id)
SELECT conv_id AS report_id, CAST(lo AS BIGINT) AS first_number, CAST(hi AS BIGINT) AS last_number, n AS n_numbers, coalesce(mis, '') AS missing_numbers, coalesce(dup, '') AS duplicate_numbers FROM b LEFT JOIN m USING (conv_id) LEFT JOIN d USING (conv_id)""",
    "t2_header_rows": f"WITH {ctes('cells')}, {BODY} SELECT table_id, CAST(row_no AS BIGINT) AS row_no FROM headers",
    "a18_table_diagnostics": f"""WITH {ctes('cells')}, r AS (SELECT table_id, row_no, string_agg(text, '' ORDER BY col_no) AS line, count(*) FILTER (trim(text) <> '') AS filled, bool_or(col_no = 0 AND trim(text) = '') AS open, max(col_no) AS last FROM cells GROUP BY table_id, row_no),
n AS (SELECT table_id, count(*) AS row_count, CAST(max(last) + 1 AS BIGINT) AS col_count, coalesce(max(filled) FILTER (row_no = 0), 0) AS header_filled, count(*) FILTER (open) AS first_column_blanks,
 count(*) FILTER (row_no < 4 AND regexp_matches(line, '参数|型号|标准设置|允许误差|常规数值')) AS header_candidates FROM r GROUP BY table_id)
SELECT *, header_filled < greatest(1, col_count // 2) AS sparse_header, header_candidates >= 2 OR header_filled < greatest(1, col_count // 2) OR first_column_blanks >= greatest(2, row_count // 3) AS suspicious FROM n""",
    "t19_clauses": f"WITH {ctes('ptr_lines')}, {LINES} SELECT * FROM clauses",
    "t20_dedup_clauses": f"WITH {ctes('ptr_lines')}, {LINES} SELECT * FROM dd",
    "a15_clause_types": f"""WITH {ctes('ptr_lines')}, {LINES}, k AS (SELECT regexp_replace(text_content, '\\s+', '', 'g') AS t FROM dd)
SELECT CASE WHEN contains(t, '附录') THEN 'appendix' ELSE 'main_requirement' END AS clause_type, count(*) AS n FROM k GROUP BY ALL""",
    "t21_table_refs": f"WITH {ctes('ptr_lines')}, {LINES} SELECT DISTINCT ptr_id, number_str, CAST(unnest(regexp_extract_all(text_content, '表\\s*(\\d+)', 1)) AS BIGINT) AS table_number FROM dd",
    "t21_sub_items": f"""WITH {ctes('ptr_lines')}, {LINES},
e AS (SELECT ptr_id, number_str, unnest(range(0, len(string_split(text_content, chr(10))))) AS line_no, unnest(string_split(text_content, chr(10))) AS line FROM dd)
SELECT ptr_id, number_str, line_no, concat(regexp_extract(trim(line), '^([a-z])[)）]\\s*(.+)$', 1), ')') AS marker, regexp_extract(trim(line), '^([a-z])[)）]\\s*(.+)$', 2) AS text FROM e WHERE regexp_matches(trim(line), '^([a-z])[)）]\\s*(.+)$')""",
    "j10_match_clauses": f"""WITH {ctes('ptr_lines')}, {LINES},
d AS (SELECT ptr_id, ptr_id AS report_id, number_str FROM dd),
t1 AS (SELECT d.*, min(position) AS position, 1 AS tier FROM d JOIN inspection_items i ON i.report_id = d.report_id AND i.standard_clause = d.number_str GROUP BY ALL)
SELECT ptr_id, report_id, number_str, CAST(position AS BIGINT) AS position, CAST(tier AS BIGINT) AS tier FROM d LEFT JOIN t1 USING (ptr_id, report_id, number_str)""",
    "n18_constraints": "SELECT l_orderkey, count(*) FILTER (abs(CAST(round(l_discount * 100) AS BIGINT) - 5) <= 3) AS n_discount, count(*) FILTER (CAST(l_quantity AS BIGINT) <= 25) AS n_quantity, count(*) AS n FROM lineitem GROUP BY l_orderkey",
    "n14_dates": f"""WITH {ctes('labels_ocr')} SELECT report_id, label_id, CASE WHEN contains(production_date, '.') THEN 'YYYY.MM.DD' WHEN contains(production_date, '/') THEN 'YYYY/MM/DD' ELSE 'UNKNOWN' END AS form,
 strftime(try_strptime(replace(production_date, '/', '.'), '%Y.%m.%d'), '%Y-%m-%d') AS parsed FROM labels_ocr""",
    "j17_exclude_ranges": f"""WITH {ctes('inspection_items')} SELECT report_id, CAST(position AS BIGINT) AS position, sequence_number FROM inspection_items
 WHERE NOT coalesce(TRY_CAST(regexp_extract(sequence_number, '([0-9]+)', 1) AS INT) BETWEEN 2 AND 2 + report_id % 3, false)""",
    "n3_symbols": r"""WITH rules(pattern, symbol) AS (VALUES ('[+-]', '±'), ('≦|⩽', '≤'), ('≧|⩾', '≥'), ('µ', 'μ'), ('Ω', 'Ω'), ('℉', '℃')),
e AS (SELECT symbol, doc_id, len(regexp_extract_all(coalesce(text, ''), pattern)) AS n FROM documents, rules)
SELECT symbol, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_rows, least(count(*), 5) AS n_contexts FROM e WHERE n > 0 GROUP BY symbol""",
}
