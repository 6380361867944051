"""Intake and evidence jobs on literal fixtures: empty tables, nulls, blank rows, chains of rows, labels in all forms."""

from pyspark.sql import functions as F

from reportloom.operators import evidence, intake

CELL = "report_id long, page_no int, table_no int, row_no int, col_no int, text string, has_headers boolean"
HEADER = ["序 号", "检验项目", "标准条款", "标准要求", "检验结果", "单项结论", "备注"]
ITEM = "report_id long, position int, sequence_number string, inspection_project string, standard_clause string, standard_requirement string, test_result string, remark string"


def cells(spark, tables):
    """tables: (report, page, table, has_headers): rows."""
    return spark.createDataFrame([(*key[:3], r, c, x, key[3]) for key, rows in tables.items() for r, row in enumerate(rows) for c, x in enumerate(row)], CELL)


def test_inspection_tables_and_rows(spark):
    given = {
        (1, 3, 1, True): [HEADER, ["1", "外观", "2.1", "a", "ok", "符合", "/"], ["", "", "", "more", "", "", ""], ["", "a) 甲", "2.2", "b", "", "", ""], ["", "乙", "2.3", "c", "", "", ""], ["", "", "", "late", "", "", ""], ["", " ", None, "", "", "", ""]],
        (1, 4, 1, True): [HEADER, ["", "", "", "x", "", "", ""], ["续1", "丙", "2.1", "d", "", "", ""], ["", "丁", "2.1", "e", "", "", ""], ["2"]],
        (1, 5, 1, False): [["序号", "检验项目"], ["3", "戊"]],
        (1, 6, 1, True): [["序号", "检验项目", "结论"], ["4", "己"]],
        (2, 1, 1, False): [["别的"], ["序号检验项目"]],
    }
    df = cells(spark, given)
    assert {tuple(r) for r in intake.inspection_tables(df).collect()} == {(1, 3, 1, True), (1, 4, 1, True), (1, 5, 1, False)}
    got = [(r["position"], r["source_page"], r["row_index_in_page"], r["sequence_number"], r["standard_requirement"], r["is_continued"]) for r in intake.inspection_items(df).orderBy("position").collect()]
    assert got == [
        (1, 3, 1, "1", "a", False), (2, 3, 2, "", "more", True), (3, 3, 3, "", "b", True), (4, 3, 4, "", "c", False), (5, 3, 5, "", "late", False), (6, 4, 1, "", "x", False), (7, 4, 2, "续1", "d", True),
        (8, 4, 3, "", "e", True), (9, 4, 4, "2", "", False), (10, 5, 0, "序号", "", False), (11, 5, 1, "3", "", False),
    ]
    assert intake.inspection_items(df.limit(0)).count() == 0


def test_components(spark):
    given = {
        (1, 2, 1, True): [["序号", " 部件名称", "型号", "备注", "规格"], ["1", "主机 ", "M1", "/", "S1"], ["2", " ", "M2", "/", ""], ["3", "电极", None, "x"]],
        (1, 2, 2, True): [["序号", "型号"], ["1", "M"]],
        (1, 3, 1, True): [["名称"], ["探头"]],
        (1, 2, 3, False): [["名称"], ["探头"]],
    }
    pages = spark.createDataFrame([(1, 2, "二、样品描述"), (1, 3, None)], "report_id long, page_no int, raw_text string")
    df = cells(spark, given)
    rows = intake.components(pages, df).orderBy("row_no").collect()
    assert [(r["row_no"], r["component_name"], r["model_spec"], r["remark"], r["serial_lot"]) for r in rows] == [(1, "主机", "S1", "/", ""), (3, "电极", "", "x", "")]
    assert {(r["field"], r["col_no"]) for r in intake.sample_columns(pages, df).collect()} == {("sequence_number", 0), ("component_name", 1), ("model_spec", 4), ("remark", 3)}
    assert intake.components(pages, df.limit(0)).count() == 0


def fields(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [{f: r[f] for f in intake.LABELS if r[f] is not None} for r in intake.extract_label_fields(df, "t").orderBy("id").collect()]


def test_label_fields(spark):
    got = fields(
        spark, None, "", "产品名称：起搏器\n规格型号:RMD01\n批号：B123\n生产日期：2025-01-02\n失效日期 2027.01.01\n注册人名称：甲公司\n注册人住所：某路\n1号\n联系 无\n产品名称 x", "产品名称\n一次性导管\n规格型号：\nRMD-01\nSN\nAB1234567\n生产日期\n2025 01 02",
        "20250102 和 2024年01月05日，2026/12/31", "REF: ABC-12\nLOT 77X1", "REF\n!!\nAB12\n产品批号\nQ1W2", "XY1234567 ABCD12345678", "注册人：某住所\n批号：12\n型号：—/",
    )
    assert got[0] == got[1] == {}
    assert got[2] == {"product_name": "起搏器", "model_spec": "RMD01", "batch_number": "B123", "production_date": "2025-01-02", "expiration_date": "2027.01.01", "registrant": "甲公司", "registrant_address": "某路1号联系 无"}
    assert got[3] == {"product_name": "一次性导管", "model_spec": "RMD-01", "serial_number": "AB1234567", "production_date": "2025 01 02"}
    assert got[4] == {"production_date": "20250102", "expiration_date": "2026-12-31"}
    assert got[5] == {"model_spec": "ABC-12", "batch_number": "77X1"} and got[6] == {"model_spec": "AB12", "batch_number": "Q1W2"}
    assert got[7] == {"serial_number": "ABCD12345678"} and got[8] == {}


def test_barcodes(spark):
    df = spark.createDataFrame([("(01)069(10) LOT-7 (11)250102(17)259931(21)SN9",), (None,)], "t string")
    rows = [tuple(r)[1:] for r in intake.extract_gs1(df, "t").collect()]
    assert rows == [("LOT-7", "2025-01-02", None, "SN9"), (None,) * 4]


def test_reference_types(spark):
    given = [("外观应光滑", "direct_requirement"), ("具体要求见表1", "table_summary_reference"), ("脉冲宽度见表1", "table_parameter_reference"), ("应符合表 2 的规定，详见表2", "table_parameter_reference"), ("表3", "table_parameter_reference"), (None, "direct_requirement")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(given)], "id int, text_content string")
    assert [r["reference_type"] for r in evidence.reference_type(df).orderBy("id").collect()] == [k for _, k in given]


def test_table_items(spark):
    c = spark.createDataFrame([(1, "2.1", "甲"), (1, "2.2", "乙"), (1, "2.3", "丙"), (1, "2.4", "外壳应光滑"), (1, "2.5", "没有")], "ptr_id long, number_str string, text_content string")
    rows = [(1, 0, "9", "x", "第2.1条", "", "", ""), (1, 1, "2.2", "y", "", "", "", ""), (1, 2, "2.3.1", "z", "", "", "", ""), (1, 3, "8", "外壳", "", "", "", "")]
    got = {r["number_str"]: (r["tier"], r["position"]) for r in evidence.match_table_items(c, spark.createDataFrame(rows, ITEM), spark.createDataFrame([(1, 1)], "ptr_id long, report_id long")).collect()}
    assert got == {"2.1": (1, 0), "2.2": (2, 1), "2.3": (3, 2), "2.4": (4, 3), "2.5": (None, None)}


def test_block_texts(spark):
    rows = [(1, 0, "", "p0", "", "r0", "", ""), (1, 1, "1", "p1", "", "r1", "v1", "/"), (1, 2, "", "p 1", "", "r2", None, ""), (1, 3, "续1", "p3", "", "r1", "", ""), (1, 4, "2", "p4", "", "r4", "", ""), (1, 5, "见2.1条的全部要求。", "", "", "", "", "")]
    got = {r["position"]: r["block_text"] for r in evidence.block_text(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {0: "r0\np0", 1: "r1\nv1\np1\n/\nr2\np3", 2: "r2\np 1", 3: "r1\np3", 4: "r4\np4\n见2.1条的全部要求。", 5: "见2.1条的全部要求。"}


def test_clause_slices(spark):
    text = "2.1 甲\n乙\n2.10 丙\n2.1.1 丁\n2.2 戊"
    df = spark.createDataFrame([(text, "2.1"), (text, "2.10"), (text, "2.2"), (text, "2.3"), (None, "2.1"), (text, None)], "t string, n string")
    assert [r["slice"] for r in evidence.clause_slice(df, "t", "n").collect()] == ["甲\n乙", "丙", "戊", None, None, None]
    assert evidence.clause_slice(df.limit(0), "t", "n").filter(F.col("slice").isNotNull()).count() == 0


def test_parameter_row_repair(spark):
    given = {
        1: [(["参数", "型号", "值", "误差"], True), (["幅度", "Evia DR", "5", "±1"], False), (["Evia SR-T", "6", "±2"], False), (["", "x", "7", ""], False), (["", "", "", ""], False), (["宽度", "全部型号", "1", "2"], False)],
        2: [(["Evia DR", "1", "2", "3"], False), (["Evia SR", "4", "5", "6"], False)], 3: [(["a", "b"], False), (["", "c"], False)],
    }
    df = spark.createDataFrame([(t, k, v, h) for t, rows in given.items() for k, (v, h) in enumerate(rows)], "table_id long, row_no int, values array<string>, is_header boolean")
    got = {}
    for r in evidence.repair_parameter_rows(df).orderBy("table_id", "row_no").collect():
        got.setdefault(r["table_id"], []).append(r["values"])
    assert got == {
        1: [["参数", "型号", "值", "误差"], ["幅度", "Evia DR", "5", "±1"], ["幅度", "Evia SR-T", "6", "±2"], ["幅度", "x", "7", ""], ["", "", "", ""], ["宽度", "全部型号", "1", "2"]],
        2: [["Evia DR", "1", "2", "3"], ["Evia DR", "Evia SR", "4", "5"]], 3: [["a", "b"], ["", "c"]],
    }


def test_conditions_and_summaries(spark):
    df = spark.createDataFrame([(1, "前言\n@240Ω\n单位：V\n5.1\n5.2\nms\n负载：大\n7\n500Ω 时\n\n8"), (2, None), (3, "温度：高\n单位：V")], "id int, t string")
    assert [tuple(r) for r in evidence.condition_rows(df, "id", "t").orderBy("nth").collect()] == [(1, 1, "@240Ω", "5.1\n5.2"), (1, 2, "负载：大", "7"), (1, 3, "500Ω 时", "8")]
    texts = spark.createDataFrame([("前言\n见表1\na\nb\n" + "长" * 41 + "\n" + "长" * 41 + "项目\nc\nd\ne\nf",), ("x\ny",), (None,)], "t string")
    assert [r["summary_rows"] for r in evidence.inline_summary_rows(texts, "t").collect()] == [["见表1", "a", "b", "长" * 41 + "项目", "c", "d"], ["x", "y"], []]
    table = spark.createDataFrame([(1, r, c, x) for r, row in enumerate([["a", "", "b", "c", "d", "e"], ["", ""], ["f"], ["g"], ["h"], ["i"]]) for c, x in enumerate(row)], "table_id int, row_no int, col_no int, text string")
    assert [tuple(r) for r in evidence.table_summary_rows(table).orderBy("row_no").collect()] == [(1, 0, "a / b / c / d"), (1, 2, "f"), (1, 3, "g"), (1, 4, "h")]


def test_summary_items_and_continuations(spark):
    refs = spark.createDataFrame([(1, 1, "2.1", 3, "脉冲宽度：见表3", 0), (1, 1, "2.9", 8, "别的", 2), (1, 9, "2.1", 3, "x", 7)], "ptr_id long, report_id long, number_str string, table_number int, text_content string, fallback int")
    rows = [(1, 0, "1", "脉冲宽度", "2.2", "", "", ""), (1, 1, "2", "脉冲宽度", "2.1", "符合表3", "", ""), (1, 2, "3", "y", "2.1", "", "", "")]
    got = {(r["report_id"], r["number_str"]): (r["position"], r["score"]) for r in evidence.best_summary_item(refs, spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {(1, "2.1"): (1, 20), (1, "2.9"): (0, 0), (9, "2.1"): (7, None)}
    good = "脉冲幅度 标准设置 5"
    tables = [(1, 1, 2, 3, 1, "x"), (1, 2, 4, None, None, good), (1, 3, 5, None, None, "文字"), (1, 4, 6, None, 2, "x"), (1, 5, 6, None, None, good), (1, 6, 9, None, None, good), (1, 7, 10, None, None, good), (2, 8, 4, None, None, good)]
    found = evidence.continuation_candidates(spark.createDataFrame(tables, "ptr_id long, table_id long, page_no int, page_end int, table_number int, blob string")).collect()
    assert {tuple(r) for r in found} == {(1, 1, 2), (1, 4, 6)}
