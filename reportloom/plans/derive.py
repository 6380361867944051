"""Report-like corpus tables derived from the given tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The tables that the checks are compared on.
SQL: dict[str, str] = {
    "inspection_items": """
SELECT l_orderkey AS report_id, CAST(pos AS INT) AS position,
 CAST(3 + floor((pos - 1) / 4) AS INT) AS source_page,
 CAST((pos - 1) % 4 AS INT) AS row_index_in_page,
 CASE WHEN l_partkey % 17 = 0 THEN '' WHEN l_partkey % 13 = 0 THEN '以下空白'
      WHEN pos > 1 AND (pos - 1) % 4 = 0 AND l_suppkey % 2 = 0 THEN concat('续', CAST(l_linenumber AS STRING))
      ELSE CAST(l_linenumber AS STRING) END AS sequence_number,
 concat('项目', CAST(l_partkey % 50 AS STRING)) AS inspection_project,
 concat('2.', CAST(l_linenumber AS STRING), '.', CAST(l_suppkey % 4 + 1 AS STRING)) AS standard_clause,
 concat('应不大于', CAST(CAST(l_quantity AS INT) AS STRING), 'V') AS standard_requirement,
 CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '不符合要求' WHEN l_returnflag = 'A' THEN '——'
      WHEN l_partkey % 11 = 0 THEN '' ELSE '符合要求' END AS test_result,
 CASE WHEN l_suppkey % 5 = 0 THEN '/' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '不符合' ELSE '符合' END AS item_conclusion,
 CASE WHEN l_partkey % 7 = 0 THEN '' ELSE '/' END AS remark
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem) t
""",
    "report_pages": """
SELECT o.report_id, p.page_no,
 CASE WHEN (o.report_id + p.page_no) % 29 = 0 THEN '检验报告'
      WHEN (o.report_id + p.page_no) % 31 = 0 THEN concat('Page ', CAST(p.page_no - 2 AS STRING), ' of ', CAST(o.n AS STRING))
      WHEN (o.report_id + p.page_no) % 37 = 0 THEN concat('共', CAST(o.n + 1 AS STRING), '页 第', CAST(p.page_no - 2 AS STRING), '页')
      WHEN (o.report_id + p.page_no) % 41 = 0 THEN concat('共', CAST(o.n AS STRING), '页 第', CAST(p.page_no - 1 AS STRING), '页')
      ELSE concat('共 ', CAST(o.n AS STRING), ' 页 第 ', CAST(p.page_no - 2 AS STRING), ' 页') END AS raw_text
FROM (SELECT o_orderkey AS report_id, CAST(2 + o_orderkey % 5 AS INT) AS n FROM orders) o
JOIN (SELECT DISTINCT CAST(l_linenumber + 2 AS INT) AS page_no FROM lineitem) p ON p.page_no <= o.n + 2
""",
    "components": """
SELECT ps.report_id, p.p_partkey AS component_id, p.p_name AS component_name,
 concat('M', CAST(p.p_size AS STRING), '-', replace(p.p_brand, 'Brand#', 'B0')) AS model_spec,
 concat('LOT', CAST(p.p_partkey % 97 AS STRING)) AS serial_lot,
 ymd AS production_date,
 CASE WHEN p.p_partkey % 19 = 0 THEN '本次检测未使用' ELSE '/' END AS remark
FROM (SELECT DISTINCT l_orderkey AS report_id, l_partkey, concat(CAST(1995 + l_partkey % 5 AS STRING), '.0', CAST(1 + l_partkey % 9 AS STRING), '.1', CAST(l_partkey % 9 AS STRING)) AS ymd FROM lineitem) ps
JOIN part p ON p.p_partkey = ps.l_partkey
""",
    "labels_ocr": """
SELECT report_id, component_id AS label_id,
 concat('№', CAST(component_id % 200 AS STRING), ' ', component_name, ' 中文标签') AS raw_caption,
 CASE WHEN component_id % 6 = 0 THEN replace(model_spec, '0', 'O') WHEN component_id % 23 = 0 THEN concat(model_spec, 'X') ELSE model_spec END AS model_spec,
 CASE WHEN component_id % 8 = 0 THEN '' ELSE serial_lot END AS batch_number,
 CASE WHEN component_id % 10 = 0 THEN replace(production_date, '.', '/') ELSE production_date END AS production_date
FROM components WHERE (report_id + component_id) % 9 <> 0
""",
    "cells": """
SELECT report_id AS table_id, CAST(0 AS INT) AS row_no, c.col_no, CASE c.col_no WHEN 0 THEN '参数' WHEN 1 THEN '型号' WHEN 2 THEN '标准设置' ELSE '允许误差' END AS text
FROM (SELECT DISTINCT report_id FROM inspection_items) i CROSS JOIN (SELECT CAST(col AS INT) AS col_no FROM (VALUES (0), (1), (2), (3)) v(col)) c
UNION ALL
SELECT report_id AS table_id, position AS row_no, c.col_no, CASE
 WHEN position % 6 = 0 THEN CASE c.col_no WHEN 0 THEN '参数' WHEN 1 THEN '型号' WHEN 2 THEN '标准设置' ELSE '允许误差' END
 WHEN c.col_no = 0 THEN CASE WHEN position > 1 AND length(inspection_project) = 3 THEN '' ELSE inspection_project END
 WHEN c.col_no = 1 THEN CASE WHEN position % 3 = 2 THEN '' ELSE concat('M', CAST(position AS STRING)) END
 WHEN c.col_no = 2 THEN CASE WHEN remark = '' THEN '' ELSE standard_requirement END
 ELSE CASE WHEN test_result = '' THEN '' ELSE '±5%' END END AS text
FROM inspection_items i CROSS JOIN (SELECT CAST(col AS INT) AS col_no FROM (VALUES (0), (1), (2), (3)) v(col)) c
""",
    "report_cells": """
SELECT report_id, page_no, CAST(1 AS INT) AS table_no, CAST(0 AS INT) AS row_no, c.col_no,
 CASE c.col_no WHEN 0 THEN '序 号' WHEN 1 THEN '检验项目' WHEN 2 THEN '标准条款' WHEN 3 THEN '标准要求' WHEN 4 THEN '检验结果' WHEN 5 THEN CASE WHEN report_id % 11 = 0 THEN '结论' ELSE '单项结论' END ELSE '备注' END AS text,
 report_id % 3 <> 0 AS has_headers
FROM (SELECT DISTINCT report_id, source_page AS page_no FROM inspection_items) i CROSS JOIN (SELECT CAST(col AS INT) AS col_no FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) v(col)) c
UNION ALL
SELECT report_id, source_page AS page_no, CAST(1 AS INT) AS table_no, CAST(row_index_in_page + 1 AS INT) AS row_no, c.col_no,
 CASE c.col_no WHEN 0 THEN concat(' ', sequence_number) WHEN 1 THEN CASE WHEN position % 5 = 4 THEN '' WHEN position % 7 = 6 THEN concat('a) ', inspection_project) ELSE inspection_project END
  WHEN 2 THEN standard_clause WHEN 3 THEN standard_requirement WHEN 4 THEN test_result WHEN 5 THEN item_conclusion ELSE remark END AS text,
 report_id % 3 <> 0 AS has_headers
FROM inspection_items i CROSS JOIN (SELECT CAST(col AS INT) AS col_no FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) v(col)) c
""",
    "sample_cells": """
SELECT report_id, CAST(2 AS INT) AS page_no, CAST(1 AS INT) AS table_no, CAST(0 AS INT) AS row_no, c.col_no,
 CASE c.col_no WHEN 0 THEN '序号' WHEN 1 THEN CASE WHEN report_id % 13 = 0 THEN '说明' WHEN report_id % 2 = 0 THEN ' 部件名称' ELSE '产品名称' END WHEN 2 THEN CASE WHEN report_id % 3 = 0 THEN '型号' ELSE '规格型号' END
  WHEN 3 THEN CASE WHEN report_id % 5 = 0 THEN 'LOT' ELSE '序列号/批号' END WHEN 4 THEN '生产日期' WHEN 5 THEN CASE WHEN report_id % 17 = 0 THEN '生产日期' ELSE '其他' END ELSE '备注' END AS text
FROM (SELECT DISTINCT report_id FROM components) r CROSS JOIN (SELECT CAST(col AS INT) AS col_no FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) v(col)) c
UNION ALL
SELECT report_id, CAST(2 AS INT) AS page_no, CAST(1 AS INT) AS table_no, CAST(component_id AS INT) AS row_no, c.col_no,
 CASE c.col_no WHEN 0 THEN CAST(component_id AS STRING) WHEN 1 THEN CASE WHEN component_id % 29 = 0 THEN ' ' ELSE component_name END WHEN 2 THEN concat(model_spec, ' ') WHEN 3 THEN serial_lot WHEN 4 THEN production_date WHEN 5 THEN 'x' ELSE remark END AS text
FROM components i CROSS JOIN (SELECT CAST(col AS INT) AS col_no FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) v(col)) c
""",
    "label_texts": """
SELECT report_id, label_id, concat(raw_caption, '\n', CASE label_id % 3 WHEN 0 THEN '规格型号：' WHEN 1 THEN 'Model ' ELSE '型号规格\n' END, model_spec, '\n',
 CASE WHEN batch_number = '' THEN '批号：-' WHEN label_id % 4 = 0 THEN concat('LOT: ', batch_number) ELSE concat('生产批号：', batch_number) END, '\n生产日期 ', replace(replace(production_date, '.', '-'), '/', '-'),
 '\n(21)SN', CAST(label_id AS STRING), '(17)', CASE WHEN label_id % 2 = 0 THEN '281231' ELSE '289931' END, '(10)B', CAST(report_id AS STRING)) AS text
FROM labels_ocr l
""",
    "ptr_lines": """
SELECT report_id AS ptr_id, source_page AS page_no, CAST(row_index_in_page * 3 + k.n AS INT) AS line_no, CASE k.n
 WHEN 0 THEN concat(CASE WHEN position % 7 = 0 THEN '3.1' ELSE standard_clause END, CASE WHEN position % 2 = 0 THEN ' ' ELSE '．' END, CASE WHEN (report_id + position) % 23 = 0 THEN '附录 ' WHEN (report_id + position) % 29 = 0 THEN '注：' WHEN (report_id + position) % 31 = 0 THEN '图1 ' ELSE '' END, inspection_project)
 WHEN 1 THEN CASE WHEN position % 4 = 3 THEN concat('2/', CAST(source_page AS STRING)) ELSE concat(standard_requirement, '，见表', CAST(position % 3 + 1 AS STRING)) END
 ELSE CASE WHEN position % 5 = 0 THEN '' ELSE concat('a) ', standard_requirement) END END AS line
FROM inspection_items CROSS JOIN (SELECT CAST(n AS INT) AS n FROM (VALUES (0), (1), (2)) v(n)) k
""",
    "bundle_items": """
SELECT DISTINCT report_id, CAST(0 AS INT) AS position, '9' AS sequence_number, '' AS inspection_project, '' AS standard_clause, '2.1.1 尺寸应符合要求。' AS standard_requirement, '' AS test_result, '' AS item_conclusion, '' AS remark FROM inspection_items i
UNION ALL
SELECT report_id, position, '' AS sequence_number, '' AS inspection_project, CASE WHEN report_id % 17 = 0 AND position = 4 THEN '2.1.9' ELSE '' END AS standard_clause,
 CASE WHEN report_id % 7 = 0 AND position = 3 THEN '' WHEN position % 3 = 1 THEN '外径±0.5mm' WHEN position % 3 = 2 THEN '连接线长度' ELSE '有效长度' END AS standard_requirement,
 CASE WHEN position % 3 = 1 THEN concat(regexp_extract(standard_requirement, '([0-9]+)', 1), 'mm') ELSE concat(regexp_extract(standard_requirement, '([0-9]+)', 1), 'mm±2mm') END AS test_result,
 CASE WHEN (report_id + position) % 13 = 0 THEN '' WHEN (report_id + position) % 11 = 0 THEN '+0.9' WHEN position % 2 = 0 THEN '-0.2~+0.3' ELSE '-0.1' END AS item_conclusion, '' AS remark
FROM inspection_items i
UNION ALL
SELECT DISTINCT report_id, CAST(100 AS INT) AS position, '' AS sequence_number, '' AS inspection_project, '' AS standard_clause, '2.1.2 连接牢固度' AS standard_requirement, '' AS test_result, '+9' AS item_conclusion, '' AS remark FROM inspection_items i
""",
    "row_texts": """
SELECT report_id AS ref_id, report_id AS table_id, concat(inspection_project, '：', standard_requirement, '；允许误差：±5%') AS report_text FROM inspection_items WHERE position = 1
""",
    "table_fragments": """
SELECT report_id AS ptr_id, CAST(position AS BIGINT) AS table_id, CAST(position + CASE WHEN report_id % 5 = 0 AND position > 3 THEN 1 ELSE 0 END AS INT) AS page_no, CAST(CASE WHEN position % 4 = 3 THEN 400 ELSE 50 END AS DOUBLE) AS y0,
 CAST(CASE WHEN position % 5 = 2 THEN 300 ELSE 780 END AS DOUBLE) AS y1, CAST(800 AS DOUBLE) AS height, CAST(CASE WHEN position % 3 = 1 THEN CASE WHEN position > 4 AND report_id % 2 = 0 THEN 2 ELSE 1 END END AS INT) AS table_number,
 CAST(CASE WHEN (report_id + position) % 11 = 0 THEN 7 WHEN (report_id + position) % 13 = 0 THEN 5 ELSE 4 END AS INT) AS n_cols,
 split(CASE WHEN (report_id + position) % 7 = 0 THEN '甲,乙,丙,允许误差' WHEN (report_id + position) % 7 = 3 THEN '参数,型号,标准设置,常规数值' ELSE '参数,型号,标准设置,允许误差' END, ',') AS headers,
 split(CASE WHEN position % 2 = 0 THEN '参数,型号,标准设置' ELSE '参数,型号,丁' END, ',') AS paths, (report_id + position) % 7 <> 0 AS is_parameter
FROM inspection_items i
""",
    "ragged_rows": """
SELECT report_id, source_page AS page_no, CAST(1 AS INT) AS table_no, row_index_in_page AS row_no, split('序号;检验项目;标准条款;标准要求;检验结果;单项结论;备注', ';') AS headers, split(CASE (report_id + position) % 5
 WHEN 0 THEN concat(sequence_number, ';', inspection_project, ';', standard_clause, ';分类;', standard_requirement, ';', test_result, ';', item_conclusion, ';', remark)
 WHEN 1 THEN concat(sequence_number, ';', inspection_project, ';', standard_clause, ';', standard_requirement, ';', test_result, ';', item_conclusion)
 WHEN 2 THEN concat(standard_requirement, ';', test_result) WHEN 3 THEN concat(sequence_number, ';', CASE WHEN position % 2 = 0 THEN '' ELSE inspection_project END, ';;', standard_requirement, ';', test_result, ';', item_conclusion, ';', remark)
 ELSE concat(sequence_number, ';', inspection_project, ';', standard_clause, ';', standard_requirement, ';', test_result, ';', item_conclusion, ';', remark) END, ';') AS cells
FROM inspection_items i
""",
    "home_fields": """
SELECT c.report_id, component_name AS sample_name, CASE WHEN c.report_id % 9 = 0 THEN '见样品描述栏' ELSE model_spec END AS model_spec, CASE WHEN c.report_id % 9 = 0 THEN CASE WHEN c.report_id % 2 = 0 THEN '见“样品描述”栏' ELSE '见样品描述栏' END ELSE concat(production_date, 'A') END AS production_date,
 CASE WHEN c.report_id % 9 = 0 OR c.report_id % 7 = 0 THEN '见样品描述栏' ELSE serial_lot END AS product_id_batch
FROM (SELECT report_id, min(component_id) AS component_id FROM components GROUP BY report_id) m JOIN components c ON c.report_id = m.report_id AND c.component_id = m.component_id
""",
    "home_labels": """
SELECT c.report_id, CAST(c.component_id * 3 + v.n AS BIGINT) AS label_id, concat(c.component_name, ' 样') AS subject_name, CASE WHEN v.n = 2 AND c.report_id % 4 = 0 THEN '' WHEN v.n = (c.report_id + c.component_id) % 3 THEN concat(model_spec, 'Z') ELSE model_spec END AS model_spec,
 CASE WHEN (c.report_id + v.n) % 5 = 0 THEN 'none' WHEN c.component_id % 10 = 0 THEN concat(replace(production_date, '.', '/'), 'A') ELSE concat(production_date, 'A') END AS production_date, CASE WHEN v.n = 0 THEN '' ELSE concat('X', serial_lot) END AS batch_number, CASE WHEN c.report_id % 2 = 0 THEN '' ELSE 'SN' END AS serial_number
FROM components c CROSS JOIN (SELECT CAST(n AS INT) AS n FROM (VALUES (0), (1), (2)) w(n)) v
""",
    "ptr_tables": """
SELECT report_id AS ptr_id, CAST(position AS BIGINT) AS table_id, CAST(1 + position % 2 AS INT) AS table_number, position AS page_no, CAST(CASE WHEN position % 3 = 0 THEN NULL ELSE position END AS INT) AS page_end, '' AS caption,
 split(CASE WHEN (report_id + position) % 4 = 0 THEN '甲,乙' WHEN (report_id + position) % 9 = 0 THEN '该产品和植入式系统属于磁共振安全医疗器械，在规定的条件下可以接受磁共振检查，详细条件见说明书的相应章节和附录' ELSE '参数,型号,标准设置,允许误差' END, ',') AS headers,
 split(inspection_project, ',') AS first_cells, CAST(length(standard_requirement) + position AS INT) AS n_rows, CAST(2 + position % 3 AS INT) AS n_cols, CAST(length(standard_requirement) AS INT) AS n_filled
FROM inspection_items i
""",
    "table_references": """
SELECT report_id AS ptr_id, report_id, CASE WHEN report_id % 3 = 0 THEN '3.1' ELSE '2.1' END AS number_str, CAST(1 + report_id % 3 AS INT) AS table_number, CASE WHEN report_id % 5 = 0 THEN '见表' ELSE '应符合表1中的数值' END AS text_content, inspection_project AS project, '' AS requirement, test_result AS result FROM inspection_items WHERE position = 1
""",
    "path_refs": """
SELECT report_id * 10 + position AS ref_id, CASE position % 4 WHEN 0 THEN 'canonical_path_unavailable' WHEN 1 THEN 'no_records' WHEN 2 THEN 'invalid_column_roles' END AS canonical_reason FROM inspection_items i
""",
    "path_rows": """
SELECT report_id * 10 + position AS ref_id, s.source, concat(s.source, inspection_project) AS parameter, (report_id + position + length(s.source)) % 5 < 2 AS matches
FROM inspection_items i CROSS JOIN (SELECT source FROM (VALUES ('canonical'), ('legacy'), ('continuation')) v(source)) s WHERE (report_id + position * length(s.source)) % 3 <> 0
""",
    "clause_items": """
SELECT report_id, position, CASE WHEN position % 6 = 2 THEN concat('续 ', standard_clause) WHEN position % 6 = 3 THEN concat(standard_clause, '.7') WHEN position % 6 = 5 THEN concat(standard_clause, ' 移位的要求文本') ELSE sequence_number END AS sequence_number, inspection_project,
 CASE WHEN position % 6 = 0 THEN substring(standard_clause, 1, 3) WHEN position % 6 = 1 THEN concat('条款 ', standard_clause, ' 及其他') ELSE '' END AS standard_clause,
 CASE WHEN position % 6 = 4 THEN concat('按 ', standard_clause, ' 执行') ELSE standard_requirement END AS standard_requirement, test_result, item_conclusion, remark
FROM inspection_items i
""",
}
NEEDS = {"inspection_items": ["lineitem"], "report_pages": ["orders", "lineitem"], "components": ["lineitem", "part"], "labels_ocr": ["components"], "cells": ["inspection_items"], "ptr_lines": ["inspection_items"], "report_cells": ["inspection_items"], "sample_cells": ["components"], "label_texts": ["labels_ocr"], "bundle_items": ["inspection_items"], "row_texts": ["inspection_items"], "table_fragments": ["inspection_items"], "clause_items": ["inspection_items"], "ptr_tables": ["inspection_items"], "table_references": ["inspection_items"], "path_refs": ["inspection_items"], "path_rows": ["inspection_items"], "ragged_rows": ["inspection_items"], "home_fields": ["components"], "home_labels": ["components"]}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one over the given tables."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))  # lets local Python workers import this package
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name]
    for need in NEEDS[name]:
        text = text.replace(f"FROM {need} ", f"FROM {{{need}}} ").replace(f"FROM {need})", f"FROM {{{need}}})").replace(f"JOIN {need} ", f"JOIN {{{need}}} ")
    return spark.sql(text, **{need: source(spark, sf_dir, need) for need in NEEDS[name]})


def ctes(*names: str) -> str:
    """The derived tables as common table expressions for an oracle, those they need first."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name in SQL and name not in done:
            done.append(name)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in done)
