"""The checks as queries over the derived tables, with their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import items, matching, pages, summary
from .derive import ctes, source


def joined(col: str, cast: str = "string"):
    return F.array_join(F.col(col).cast(f"array<{cast}>"), ",").alias(col)


def long(col: str):
    return F.col(col).cast("long").alias(col)


def c07(spark: SparkSession, d: str) -> DataFrame:
    return items.check_c07(source(spark, d, "inspection_items")).select("report_id", long("group_seq"), "sequence_number", "inspection_project", "expected", "actual", "test_result")


def c08(spark: SparkSession, d: str) -> DataFrame:
    return items.check_c08(source(spark, d, "inspection_items")).select("report_id", long("group_seq"), "sequence_number", "inspection_project", joined("empty_fields"))


def c09(spark: SparkSession, d: str) -> DataFrame:
    out = items.check_c09(source(spark, d, "inspection_items"))
    return out.select("report_id", long("first_number"), long("last_number"), "n_numbers", joined("missing_numbers"), joined("duplicate_numbers"), joined("blank_positions"), "status")


def c10(spark: SparkSession, d: str) -> DataFrame:
    out = items.check_c10(source(spark, d, "inspection_items"))
    return out.select("report_id", joined("extra_markers"), joined("missing_markers"), joined("wrong_markers"), "status")


def c11(spark: SparkSession, d: str) -> DataFrame:
    out = pages.check_c11(pages.extract_page_numbers(source(spark, d, "report_pages")))
    return out.select("report_id", "n_pages", "n_valid", long("first_number"), long("last_number"), long("last_total"), "n_totals", joined("missing_pages"), joined("duplicate_pages"), "status")


def c11_sequential(spark: SparkSession, d: str) -> DataFrame:
    return pages.check_c11_sequential(pages.extract_page_numbers(source(spark, d, "report_pages"))).select("report_id", long("page_no"), "error_code")


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract_page_numbers(source(spark, d, "report_pages")).select("report_id", long("page_no"), long("current_page"), long("total_pages"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    rows = items.sequence_groups(source(spark, d, "inspection_items"))
    return rows.groupBy("report_id", "group_seq").agg(F.count("*").alias("n_rows"), F.min("position").cast("long").alias("first_position")).select("report_id", long("group_seq"), "n_rows", "first_position")


def c07_by_clause(spark: SparkSession, d: str) -> DataFrame:
    return items.check_c07_by_clause(source(spark, d, "inspection_items")).select("report_id", long("group_seq"), "standard_clause", "expected", "actual", "error_code")


def c08_rows(spark: SparkSession, d: str) -> DataFrame:
    return items.check_c08_rows(source(spark, d, "inspection_items")).select("report_id", long("position"), "sequence_number", joined("empty_fields"))


def c09_walk(spark: SparkSession, d: str) -> DataFrame:
    return items.check_c09_walk(source(spark, d, "inspection_items")).select("report_id", long("position"), "item_number", long("previous"), "error_code")


def labels_and_components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return source(spark, d, "components"), source(spark, d, "labels_ocr")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    out = matching.component_labels(*labels_and_components(spark, d))
    return out.select("report_id", "component_id", "label_id", long("score"), long("rank"))


def c04(spark: SparkSession, d: str) -> DataFrame:
    return matching.check_c04(*labels_and_components(spark, d))


def c05(spark: SparkSession, d: str) -> DataFrame:
    out = matching.check_c05(*labels_and_components(spark, d))
    return out.select("report_id", "component_id", "component_name", "status", F.size("matched_captions").cast("long").alias("n_captions"))


def c06(spark: SparkSession, d: str) -> DataFrame:
    return matching.check_c06(*labels_and_components(spark, d))


def differences(spark: SparkSession, d: str) -> DataFrame:
    return matching.label_differences(*labels_and_components(spark, d))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    c, lab = labels_and_components(spark, d)
    return matching.component_verdict(c, lab, lab).select("report_id", "component_id", "component_name", "has_photo", "has_label", joined("issues"), "verdict")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """All checks that the derived tables feed, as one findings table."""
    rows = source(spark, d, "inspection_items")
    comps, labels = labels_and_components(spark, d)
    error = F.lit("error")
    part = summary.as_findings
    return summary.union_findings([
        part(matching.check_c04(comps, labels), "C04", F.col("component_id")), part(matching.check_c05(comps, labels), "C05", F.col("component_id")), part(matching.check_c06(comps, labels), "C06", F.col("component_id")),
        part(items.check_c07(rows), "C07", F.col("group_seq"), status=error), part(items.check_c08(rows), "C08", F.col("group_seq"), status=error), part(items.check_c09(rows), "C09"), part(items.check_c10(rows), "C10"),
        part(pages.check_c11(pages.extract_page_numbers(source(spark, d, "report_pages"))), "C11"),
    ])


def check_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.summarize_checks(findings(spark, d))


def report_overall(spark: SparkSession, d: str) -> DataFrame:
    return summary.overall(check_summary(spark, d))


def cube(spark: SparkSession, d: str) -> DataFrame:
    return summary.audit_cube(findings(spark, d))


QUERIES = {
    "a1_sequence_groups": groups, "c07_conclusion": c07, "c08_non_empty": c08, "c09_sequence": c09, "c10_continuation": c10, "n16_page_numbers": page_numbers, "c11_page_numbers": c11, "a7_page_walk": c11_sequential,
    "a8_conclusion_by_clause": c07_by_clause, "a9_non_empty_rows": c08_rows, "a10_sequence_walk": c09_walk, "j5_component_labels": candidates, "c04_component_fields": c04, "c05_photo_coverage": c05,
    "c06_label_coverage": c06, "j25_label_differences": differences, "a20_component_verdict": verdicts, "a11_check_summary": check_summary, "a11_report_overall": report_overall, "a14_audit_cube": cube,
}

# --- SQL for comparison -------------------------------------------------------------------------------------------------

FLAGS = """
f AS (SELECT *, CASE WHEN regexp_matches(trim(replace(sequence_number, '续', '')), '^[+-]?[0-9]+$') THEN CAST(trim(replace(sequence_number, '续', '')) AS INT) END AS seq,
  regexp_matches(replace(sequence_number, ' ', ''), '此处空白|以下空白') AS non_data, starts_with(sequence_number, '续') AS is_continued,
  concat(trim(inspection_project), trim(standard_clause), trim(standard_requirement), trim(test_result), trim(item_conclusion), trim(remark)) <> '' AS payload FROM inspection_items)"""
GROUPED = (
    FLAGS
    + """,
g0 AS (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_seq FROM f),
g AS (SELECT * FROM g0 WHERE group_seq IS NOT NULL AND (seq IS NOT NULL OR (NOT non_data AND trim(sequence_number) = '' AND payload)))"""
)
# the derived rows have one-token cells without full-width slashes, so the token rules reduce to these
TOKENS = (
    GROUPED
    + """,
s AS (SELECT *, count(*) OVER w > 1 OR max(CASE WHEN trim(sequence_number) = '' THEN 1 ELSE 0 END) OVER w = 1 AS structured FROM g WINDOW w AS (PARTITION BY report_id, group_seq)),
like_result AS (SELECT *, item_conclusion IN ('符合', '不符合', '符合要求', '不符合要求') AS explicit,
  regexp_matches(test_result, '^[—_/-]+$') AS ph_t, regexp_matches(item_conclusion, '^[—_/-]+$') AS ph_c, regexp_matches(remark, '^[—_/-]+$') AS ph_r FROM s),
acc AS (SELECT *, test_result <> '' AND (ph_t OR contains(test_result, '符合要求') OR test_result IN ('符合', '不符合') OR explicit) AS ok_t,
  item_conclusion <> '' AND (ph_c OR item_conclusion IN ('符合', '不符合') OR explicit) AS ok_c, remark <> '' AND (ph_r OR explicit) AS ok_r FROM like_result),
tk AS (SELECT *, CASE WHEN test_result = '' THEN list_filter([CASE WHEN ph_c OR (structured AND ok_c) THEN item_conclusion END, CASE WHEN ph_r OR (structured AND ok_r) THEN remark END], lambda x: x IS NOT NULL)
  WHEN ok_t THEN [test_result] WHEN structured THEN list_filter([CASE WHEN ok_c THEN item_conclusion END, CASE WHEN ok_r THEN remark END], lambda x: x IS NOT NULL) ELSE [] END AS tokens,
  CASE WHEN test_result = '——' THEN '/' ELSE test_result END AS t, CASE WHEN item_conclusion = '——' THEN '/' ELSE item_conclusion END AS c, CASE WHEN remark = '——' THEN '/' ELSE remark END AS r FROM acc),
a AS (SELECT report_id, group_seq, arg_min(sequence_number, (CASE WHEN seq IS NOT NULL AND NOT is_continued THEN 0 WHEN seq IS NOT NULL THEN 1 ELSE 2 END) * 1000000 + position) AS sequence_number,
  arg_min(inspection_project, (CASE WHEN seq IS NOT NULL AND NOT is_continued THEN 0 WHEN seq IS NOT NULL THEN 1 ELSE 2 END) * 1000000 + position) AS inspection_project,
  bool_or(list_bool_or(list_transform(tokens, lambda x: contains(x, '不符合要求') OR x = '不符合'))) AS fails, sum(len(tokens)) AS nt,
  sum(len(list_filter(tokens, lambda x: x IN ('——', '/', '-')))) AS nd, sum(len(list_filter(tokens, lambda x: regexp_matches(x, '^[—_/-]+$')))) AS np, bool_or(ph_t OR ph_c OR ph_r) AS marked,
  arg_min(t, position) AS ft, arg_min(c, position) AS fc, arg_min(r, position) AS fr,
  arg_min(c, position) FILTER (c IN ('符合', '不符合', '/')) AS vc, arg_min(r, position) FILTER (r IN ('符合', '不符合', '/')) AS vr, arg_min(trim(item_conclusion), position) FILTER (trim(item_conclusion) <> '') AS ac,
  coalesce(string_agg(test_result, '；' ORDER BY position) FILTER (test_result <> ''), '') AS test_result,
  bool_or(ok_t OR ((test_result = '' OR structured) AND (ph_c OR ph_r)) OR (structured AND (ok_c OR ok_r))) AS has_result, bool_or(c IN ('符合', '不符合', '/') OR r IN ('符合', '不符合', '/')) AS has_conclusion, bool_or(trim(remark) <> '') AS has_remark
  FROM tk GROUP BY report_id, group_seq)"""
)

SQL = {
    "a1_sequence_groups": f"WITH {ctes('inspection_items')}, {GROUPED} SELECT report_id, CAST(group_seq AS BIGINT) AS group_seq, count(*) AS n_rows, CAST(min(position) AS BIGINT) AS first_position FROM g GROUP BY report_id, group_seq",
    "c07_conclusion": f"""WITH {ctes('inspection_items')}, {TOKENS},
e AS (SELECT *, CASE WHEN coalesce(fails, false) THEN '不符合' WHEN nt > 0 AND nd = nt THEN '/' WHEN nt > 0 THEN '符合' WHEN marked THEN '/' ELSE '不符合' END AS expected,
 CASE WHEN nt > 0 AND np = nt AND regexp_matches(ft, '^[—_/-]+$') AND regexp_matches(fr, '^[—_/-]+$') AND fc IN ('符合', '不符合') THEN '/'
  WHEN (ft = '' OR regexp_matches(ft, '^[—_/-]+$')) AND regexp_matches(fc, '^[—_/-]+$') AND fr IN ('符合', '不符合') THEN fr
  WHEN fc IN ('符合', '不符合', '/') THEN fc WHEN fr IN ('符合', '不符合', '/') THEN fr ELSE coalesce(vc, vr, ac, '') END AS actual FROM a)
SELECT report_id, CAST(group_seq AS BIGINT) AS group_seq, sequence_number, inspection_project, expected, actual, test_result FROM e WHERE expected <> actual""",
    "c08_non_empty": f"""WITH {ctes('inspection_items')}, {TOKENS},
e AS (SELECT *, concat_ws(',', CASE WHEN NOT has_result THEN '检验结果' END, CASE WHEN NOT has_conclusion THEN '单项结论' END, CASE WHEN NOT has_remark THEN '备注' END) AS empty_fields FROM a)
SELECT report_id, CAST(group_seq AS BIGINT) AS group_seq, sequence_number, inspection_project, empty_fields FROM e WHERE empty_fields <> ''""",
    "c09_sequence": f"""WITH {ctes('inspection_items')}, {FLAGS},
k AS (SELECT report_id, position, row_number() OVER (PARTITION BY report_id ORDER BY position) AS at_row, CASE WHEN seq IS NOT NULL AND NOT is_continued THEN seq END AS n,
  seq IS NULL AND NOT non_data AND NOT (trim(sequence_number) = '' AND payload AND (trim(inspection_project) = '' OR regexp_matches(trim(inspection_project), '^([a-zA-Z][)）.、]|注|说明|其中)'))) AS blank FROM f),
b AS (SELECT report_id, min(n) AS lo, max(n) AS hi, count(DISTINCT n) AS n_numbers, list(DISTINCT n) FILTER (n IS NOT NULL) AS ns, coalesce(string_agg(CAST(at_row AS VARCHAR), ',' ORDER BY at_row) FILTER (blank), '') AS blank_positions FROM k GROUP BY report_id),
d AS (SELECT report_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS dup FROM (SELECT report_id, n FROM k WHERE n IS NOT NULL GROUP BY report_id, n HAVING count(*) > 1) GROUP BY report_id),
m AS (SELECT report_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS mis FROM (SELECT report_id, ns, unnest(range(lo, hi + 1)) AS x FROM b WHERE lo IS NOT NULL) WHERE NOT list_contains(ns, CAST(x AS INT)) GROUP BY report_id)
SELECT report_id, CAST(lo AS BIGINT) AS first_number, CAST(hi AS BIGINT) AS last_number, n_numbers, coalesce(mis, '') AS missing_numbers, coalesce(dup, '') AS duplicate_numbers, blank_positions,
  CASE WHEN lo = 1 AND mis IS NULL AND dup IS NULL AND blank_positions = '' THEN 'pass' ELSE 'error' END AS status FROM b LEFT JOIN d USING (report_id) LEFT JOIN m USING (report_id)""",
    "c10_continuation": f"""WITH {ctes('inspection_items')}, {FLAGS},
k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY position) AS at_row, min(row_index_in_page) OVER (PARTITION BY report_id, source_page) AS first_row FROM f),
o AS (SELECT *, lag(source_page) OVER (PARTITION BY report_id, seq ORDER BY position) AS prev FROM k WHERE seq IS NOT NULL),
e AS (SELECT report_id, at_row, prev IS NULL AND is_continued AS extra, prev IS NOT NULL AND NOT is_continued AND source_page <> prev AS missing, prev IS NOT NULL AND is_continued AND row_index_in_page <> first_row AS wrong FROM o),
r AS (SELECT report_id, coalesce(string_agg(CAST(at_row AS VARCHAR), ',' ORDER BY at_row) FILTER (extra), '') AS extra_markers, coalesce(string_agg(CAST(at_row AS VARCHAR), ',' ORDER BY at_row) FILTER (missing), '') AS missing_markers,
  coalesce(string_agg(CAST(at_row AS VARCHAR), ',' ORDER BY at_row) FILTER (wrong), '') AS wrong_markers FROM e GROUP BY report_id)
SELECT *, CASE WHEN concat(extra_markers, missing_markers, wrong_markers) = '' THEN 'pass' ELSE 'error' END AS status FROM r""",
}
PAGE = r"""
pn AS (SELECT report_id, page_no, CASE
  WHEN regexp_matches(raw_text, '共\s*(\d+)\s*页\s*第\s*(\d+)\s*页') THEN [regexp_extract(raw_text, '共\s*(\d+)\s*页\s*第\s*(\d+)\s*页', 2), regexp_extract(raw_text, '共\s*(\d+)\s*页\s*第\s*(\d+)\s*页', 1)]
  WHEN regexp_matches(raw_text, 'Page\s*(\d+)\s*of\s*(\d+)') THEN [regexp_extract(raw_text, 'Page\s*(\d+)\s*of\s*(\d+)', 1), regexp_extract(raw_text, 'Page\s*(\d+)\s*of\s*(\d+)', 2)]
  ELSE ['0', '0'] END AS p FROM report_pages WHERE page_no >= 3),
q AS (SELECT report_id, CAST(page_no AS BIGINT) AS page_no, CAST(p[1] AS BIGINT) AS current_page, CAST(p[2] AS BIGINT) AS total_pages FROM pn)"""
SQL |= {
    "n16_page_numbers": f"WITH {ctes('report_pages')}, {PAGE} SELECT * FROM q",
    "c11_page_numbers": f"""WITH {ctes('report_pages')}, {PAGE},
v AS (SELECT * FROM q WHERE current_page > 0),
b AS (SELECT report_id, count(*) AS n_pages, count(*) FILTER (current_page > 0) AS n_valid FROM q GROUP BY report_id),
w AS (SELECT report_id, arg_min(current_page, page_no) AS first_number, arg_max(current_page, page_no) AS last_number, arg_max(total_pages, page_no) AS last_total, count(DISTINCT total_pages) AS n_totals, max(current_page) AS hi, list(DISTINCT current_page) AS ns FROM v GROUP BY report_id),
m AS (SELECT report_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS mis FROM (SELECT report_id, ns, unnest(range(1, hi + 1)) AS x FROM w) WHERE NOT list_contains(ns, x) GROUP BY report_id),
d AS (SELECT report_id, string_agg(CAST(current_page AS VARCHAR), ',' ORDER BY current_page) AS dup FROM (SELECT report_id, current_page FROM v GROUP BY report_id, current_page HAVING count(*) > 1) GROUP BY report_id)
SELECT b.report_id, n_pages, n_valid, first_number, last_number, last_total, coalesce(n_totals, 0) AS n_totals, coalesce(mis, '') AS missing_pages, coalesce(dup, '') AS duplicate_pages,
  CASE WHEN first_number = 1 AND mis IS NULL AND dup IS NULL AND n_totals = 1 AND last_number = last_total THEN 'pass' ELSE 'error' END AS status
FROM b LEFT JOIN w USING (report_id) LEFT JOIN m USING (report_id) LEFT JOIN d USING (report_id)""",
    "a7_page_walk": f"""WITH RECURSIVE {ctes('report_pages')}, {PAGE},
o AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page_no) AS k FROM q),
walk AS (SELECT report_id, k, page_no, current_page, total_pages, 1 AS expected, 0 AS total FROM o WHERE k = 1
 UNION ALL SELECT o.report_id, o.k, o.page_no, o.current_page, o.total_pages, w.expected + CAST(w.current_page = w.expected AS INT), CASE WHEN w.total = 0 AND w.current_page > 0 THEN w.total_pages ELSE w.total END FROM walk w JOIN o ON o.report_id = w.report_id AND o.k = w.k + 1)
SELECT report_id, page_no, unnest(list_filter([CASE WHEN current_page = 0 THEN 'PAGE_NUMBER_001' WHEN current_page <> expected THEN 'PAGE_NUMBER_002' END, CASE WHEN total > 0 AND total_pages <> total AND current_page > 0 THEN 'PAGE_NUMBER_003' END], lambda x: x IS NOT NULL)) AS error_code FROM walk""",
    "a9_non_empty_rows": f"""WITH {ctes('inspection_items')}, {FLAGS},
g0 AS (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gs, last_value(nullif(trim(standard_clause), '') IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gc FROM f),
g1 AS (SELECT *, CASE WHEN gs IS DISTINCT FROM lag(gs) OVER (PARTITION BY report_id ORDER BY position) OR gc IS DISTINCT FROM lag(gc) OVER (PARTITION BY report_id ORDER BY position) THEN 1 ELSE 0 END AS fresh FROM g0 WHERE gs IS NOT NULL AND NOT non_data),
g2 AS (SELECT *, sum(fresh) OVER (PARTITION BY report_id ORDER BY position) AS run FROM g1),
g3 AS (SELECT *, fresh = 1 AND trim(test_result) = '' AND EXISTS (SELECT 1 FROM g2 b WHERE b.report_id = g2.report_id AND b.run = g2.run AND b.position > g2.position AND trim(b.test_result) <> '') AS title FROM g2),
g4 AS (SELECT *, list_filter([CASE WHEN trim(test_result) = '' THEN 'test_result' END, CASE WHEN trim(item_conclusion) = '' THEN 'item_conclusion' END, CASE WHEN trim(remark) = '' THEN 'remark' END], lambda x: x IS NOT NULL) AS empty FROM g3 WHERE NOT title)
SELECT report_id, CAST(position AS BIGINT) AS position, sequence_number, array_to_string(empty, ',') AS empty_fields FROM g4 WHERE len(empty) > 0""",
    "a8_conclusion_by_clause": f"""WITH {ctes('inspection_items')}, {FLAGS},
g0 AS (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_seq FROM f),
c AS (SELECT report_id, group_seq, standard_clause, bool_or(contains(test_result, '不符合')) AS fails, bool_and(test_result IN ('——', '/', '-', '—', '')) AS idle, coalesce(arg_min(item_conclusion, position) FILTER (item_conclusion <> ''), '') AS actual
  FROM g0 WHERE group_seq IS NOT NULL AND NOT non_data GROUP BY report_id, group_seq, standard_clause),
e AS (SELECT *, CASE WHEN fails THEN '不符合' WHEN idle THEN '/' ELSE '符合' END AS expected FROM c)
SELECT report_id, CAST(group_seq AS BIGINT) AS group_seq, standard_clause, expected, actual, CASE WHEN actual = '' THEN 'CONCLUSION_004' WHEN expected = '不符合' THEN 'CONCLUSION_001' WHEN expected = '/' THEN 'CONCLUSION_002' ELSE 'CONCLUSION_003' END AS error_code
FROM e WHERE expected <> actual AND NOT (expected = '/' AND actual = '符合')""",
    "a10_sequence_walk": f"""WITH {ctes('inspection_items')}, {FLAGS},
n0 AS (SELECT *, last_value(nullif(trim(replace(sequence_number, '续', '')), '') IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM f WHERE NOT non_data),
b AS (SELECT *, lag(source_page) OVER w AS page, lag(item) OVER w AS before FROM n0 WHERE item IS NOT NULL WINDOW w AS (PARTITION BY report_id ORDER BY position)),
o AS (SELECT report_id, item, min(position) AS position, try_cast(regexp_extract(item, '([0-9]+)', 1) AS INT) AS k FROM b GROUP BY report_id, item),
p AS (SELECT *, lag(k) OVER (PARTITION BY report_id ORDER BY position) AS previous FROM o),
e AS (SELECT report_id, position, '' AS item_number, NULL AS previous, 'SERIAL_NUMBER_ERROR_002' AS error_code FROM n0 WHERE item IS NULL
 UNION ALL SELECT report_id, position, item, previous, 'SERIAL_NUMBER_ERROR_001' FROM p WHERE k > 0 AND previous > 0 AND k <> previous + 1
 UNION ALL SELECT report_id, position, item, NULL, 'CONTINUATION_MARK_ERROR_001' FROM b WHERE source_page <> page AND item = before AND row_index_in_page = 0 AND NOT is_continued
 UNION ALL SELECT report_id, position, item, NULL, 'CONTINUATION_MARK_ERROR_002' FROM b WHERE is_continued AND row_index_in_page <> 0)
SELECT report_id, CAST(position AS BIGINT) AS position, item_number, CAST(previous AS BIGINT) AS previous, error_code FROM e""",
}
# names of the derived components are plain ASCII, so matching names are the names themselves
CAND = """
lab AS (SELECT *, component_name AS main_name FROM labels_ocr JOIN (SELECT report_id AS rid, component_id AS cid, component_name FROM components) n ON n.rid = report_id AND n.cid = label_id),
cand AS (SELECT c.report_id, c.component_id, l.label_id, c.component_name, c.model_spec AS cm, c.serial_lot AS cs, c.production_date AS cd, l.model_spec AS lm, l.batch_number AS lb, l.production_date AS ld, l.raw_caption, c.remark,
  replace(l.main_name, ' ', '') AS ln,
  coalesce(translate(upper(c.model_spec), 'OIL|SB', '011158') = translate(upper(l.model_spec), 'OIL|SB', '011158') OR (CASE WHEN length(c.model_spec) = length(l.model_spec) THEN hamming(upper(c.model_spec), upper(l.model_spec)) END = 1
    AND regexp_extract(c.model_spec, '[0-9]{3,}$') <> '' AND regexp_extract(c.model_spec, '[0-9]{3,}$') = regexp_extract(l.model_spec, '[0-9]{3,}$') AND length(regexp_replace(c.model_spec, '[0-9]{3,}$', '')) >= 5), false) AS mm, l.batch_number <> '' AND translate(upper(c.serial_lot), 'OIL|SB', '011158') = translate(upper(l.batch_number), 'OIL|SB', '011158') AS bm,
  contains(replace(c.component_name, ' ', ''), replace(l.main_name, ' ', '')) OR contains(replace(l.main_name, ' ', ''), replace(c.component_name, ' ', '')) AS nm
  FROM components c JOIN lab l ON c.report_id = l.report_id),
ranked AS (SELECT *, CASE WHEN mm AND bm THEN 3 WHEN mm THEN 2 ELSE 1 END AS score FROM cand WHERE mm OR nm),
r AS (SELECT *, row_number() OVER (PARTITION BY report_id, component_id ORDER BY score DESC, bm DESC, length(ln) DESC, label_id) AS rank FROM ranked)"""
CELLS = """
cell AS (SELECT report_id, component_id, label_id, rank, component_name, unnest([{'field': '规格型号', 'a': cm, 'b': lm, 'fits': mm}, {'field': '序列号批号', 'a': cs, 'b': lb, 'fits': bm}, {'field': '生产日期', 'a': cd, 'b': ld, 'fits': regexp_replace(cd, '[^0-9]', '', 'g') = regexp_replace(ld, '[^0-9]', '', 'g')}, {'field': '失效日期', 'a': '', 'b': '', 'fits': true}]) AS x FROM r)"""
SQL |= {
    "j5_component_labels": f"WITH {ctes('labels_ocr')}, {CAND} SELECT report_id, component_id, label_id, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank FROM r",
    "c04_component_fields": f"""WITH {ctes('labels_ocr')}, {CAND}, {CELLS},
flat AS (SELECT report_id, component_id, rank, x.field AS field, x.b AS b, x.fits AS fits FROM cell),
agg AS (SELECT report_id, component_id, field, bool_or(fits) AS fits, arg_min(b, CASE WHEN fits THEN 0 ELSE 1 END * 1000000 + rank) AS b FROM flat GROUP BY report_id, component_id, field),
every AS (SELECT report_id, component_id, component_name, unnest([{{'field': '规格型号', 'a': model_spec}}, {{'field': '序列号批号', 'a': serial_lot}}, {{'field': '生产日期', 'a': production_date}}, {{'field': '失效日期', 'a': ''}}]) AS x FROM components)
SELECT e.report_id, e.component_id, component_name, x.field AS field, x.a AS source_a, coalesce(agg.b, 'N/A') AS source_b, CASE WHEN agg.b IS NULL THEN 'warning' WHEN agg.fits THEN 'pass' ELSE 'error' END AS status
FROM every e LEFT JOIN agg ON agg.report_id = e.report_id AND agg.component_id = e.component_id AND agg.field = e.x.field""",
    "c05_photo_coverage": f"""WITH {ctes('labels_ocr')}, {CAND},
n AS (SELECT report_id, component_id, count(*) AS k FROM cand WHERE nm GROUP BY report_id, component_id)
SELECT c.report_id, c.component_id, c.component_name, CASE WHEN contains(remark, '本次检测未使用') THEN 'skipped' WHEN k > 0 THEN 'pass' ELSE 'error' END AS status, CASE WHEN contains(remark, '本次检测未使用') THEN 0 ELSE coalesce(k, 0) END AS n_captions
FROM components c LEFT JOIN n USING (report_id, component_id)""",
    "j25_label_differences": f"""WITH {ctes('labels_ocr')}, {CAND}, {CELLS}
SELECT report_id, component_id, label_id, x.field AS field, x.a AS source_a, x.b AS source_b, CASE WHEN x.b = '' THEN 'missing_in_ocr' ELSE 'mismatch' END AS difference FROM cell WHERE rank = 1 AND x.a <> '' AND NOT x.fits""",
}
