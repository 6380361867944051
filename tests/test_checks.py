"""Checks on literal fixtures, and every query with SQL against DuckDB on the smallest tables."""

import re
from difflib import SequenceMatcher
from functools import reduce

import pytest
from compare import oracle_rows, spark_rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom import registry
from reportloom.functions import text
from reportloom.operators import bundles, clauses, items, matching, pages, pairs, summary, tables
from reportloom.plans import documents

SF = "/root/testdata/sf0.001"
ITEM = "report_id long, position int, sequence_number string, inspection_project string, standard_clause string, standard_requirement string, test_result string, item_conclusion string, remark string, source_page int, row_index_in_page int"


def rows(spark, *given):
    """(sequence, result, conclusion, remark, page, row) with defaults."""
    full = [(1, i + 1, g[0], f"项目{g[0]}", f"2.{i + 1}", "应符合", *(list(g[1:4]) + ["符合要求", "符合", "/"][len(g[1:4]) :]), *(g[4:6] if len(g) > 4 else (3, i))) for i, g in enumerate(given)]
    return spark.createDataFrame(full, ITEM)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == oracle_rows(registry.oracle_sql()[name], SF)


def test_conclusions(spark):
    good = rows(spark, ("1", "符合要求", "符合"), ("2", "不符合要求", "不符合"), ("3", "——", "/"))
    assert items.check_c07(good).count() == 0
    bad = items.check_c07(rows(spark, ("1", "符合要求", "不符合"), ("2", "", "", ""), ("3", "——", "符合", "/"))).collect()
    assert {(r["group_seq"], r["expected"], r["actual"]) for r in bad} == {(1, "符合", "不符合"), (2, "不符合", "")}
    assert [r["empty_fields"] for r in items.check_c08(rows(spark, ("1", "", "", ""), ("2",))).collect()] == [["检验结果", "单项结论", "备注"]]


def test_sequence(spark):
    one = items.check_c09(rows(spark, *[(s,) for s in ("1", "2", "4", "6", "8", "9", "10")])).first()
    assert one["missing_numbers"] == [3, 5, 7] and one["status"] == "error"
    assert items.check_c09(rows(spark, *[(s,) for s in ("1", "2", "2", "3")])).first()["duplicate_numbers"] == [2]
    assert items.check_c09(rows(spark, *[(str(s),) for s in range(2, 11)])).first()["status"] == "error"
    fine = items.check_c09(rows(spark, ("1",), ("续1",), ("",), ("2",), ("以下空白",))).first()
    assert fine["blank_positions"] == [3] and fine["last_number"] == 2


def test_continuation(spark):
    ok = items.check_c10(rows(spark, ("1", "", "", "", 3, 0), ("续1", "", "", "", 4, 0), ("2", "", "", "", 4, 1))).first()
    assert ok["status"] == "pass"
    assert items.check_c10(rows(spark, ("1", "", "", "", 0, 0), ("1", "", "", "", 0, 0))).first()["missing_markers"] == [2]
    assert items.check_c10(rows(spark, ("续1", "", "", "", 3, 0))).first()["extra_markers"] == [1]


def test_page_numbers(spark):
    forms = spark.createDataFrame([("共5页 第1页", 1, 5), ("共 5 页 第 1 页", 1, 5), ("3/10", 3, 10), ("Page 2 of 7", 2, 7), ("第2页/共9页", 2, 9), ("none", 0, 0)], "t string, c int, n int")
    assert all((r["p"]["current_page"], r["p"]["total_pages"]) == (r["c"], r["n"]) for r in forms.withColumn("p", pages.page_number(F.col("t"))).collect())
    numbers = lambda *n: spark.createDataFrame([(1, i, c, len(n)) for i, c in enumerate(n)], "report_id long, page_no int, current_page int, total_pages int")
    assert pages.check_c11(numbers(1, 2, 3, 4, 5)).first()["status"] == "pass"
    assert pages.check_c11(numbers(1, 3, 4)).first()["missing_pages"] == [2] and pages.check_c11(numbers(1, 2, 2)).first()["duplicate_pages"] == [2]
    assert [(r["page_no"], r["error_code"]) for r in pages.check_c11_sequential(numbers(1, 0, 3)).orderBy("page_no").collect()] == [(1, "PAGE_NUMBER_001"), (2, "PAGE_NUMBER_002")]


def test_constraints(spark):
    given = [("≤2.0mL", "1.1mL", True), ("≤2.0mL", "2.5mL", False), ("20~350", "180", True), ("20-350", "10", False), ("100±20%", "120", True), ("100±20%", "130", False), ("2.5±0.1", "+0.03", True), ("2.5±0.1", "-0.02~+0.06", True), ("≥10", "17~46", True)]
    df = text.eval_constraint(spark.createDataFrame(given, "e string, a string, want boolean"), "e", "a")
    assert [r["satisfied"] for r in df.collect()] == [g[2] for g in given]
    assert text.values_match(spark.createDataFrame([("/", "——")], "a string, b string"), "a", "b").first()["match_rule"] == "placeholder"


def test_normalizer(spark):
    given = [("导 管 外 观", "导管外观"), ("绝缘电阻>5MQ", "绝缘电阻>5MΩ"), ("电阻值≦10Ω，电流≥0.5A", "电阻值<=10Ω,电流>=0.5A"), ("KMnO₄", "KMnO4"), ("，！？", ",!?"), ("脚踏开关脚踏开关应符合", "脚踏开关应符合"), (None, "")]
    df = spark.createDataFrame(given, "raw string, want string")
    assert [r["x"] for r in df.select(text.normalize("raw").alias("x")).collect()] == [g[1] for g in given]
    assert [r["x"] for r in text.normalize_text(df, "raw", "x").collect()] == [g[1] for g in given]


def test_codes_and_dates(spark):
    given = [("2BL010", "28L010", True), ("NavAEPP1206", "NOVAEPP1206", True), ("RF-2000", "RF-3000", False), ("RF-2000", "", False)]
    df = spark.createDataFrame(given, "a string, b string, want boolean").select(matching.field_values_match(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in df.collect()] == [g[2] for g in given]
    dates = spark.createDataFrame([("2026.01.08", "2026/01/08"), ("2025-12-03", "20251203")], "a string, b string")
    assert all(r["x"] for r in dates.select(matching.field_values_match(F.col("a"), F.col("b")).alias("x")).collect())
    fixed = text.normalize_dates(spark.createDataFrame([("20251508",), ("250230",), ("2025.1.5",), ("x",)], "d string"), "d").collect()
    assert [(r["normalized"], r["changed"]) for r in fixed] == [("2025-10-08", True), ("2025-02-28", True), ("2025-01-05", False), (None, False)]


def test_scope_and_ranges(spark):
    assert spark.createDataFrame([("a、b（c、d），e, a",)], "s string").select(text.split_scope("s").alias("x")).first()["x"] == ["a", "b（c、d）", "e"]
    p = spark.createDataFrame([(1, 3, "序号9"), (1, 4, "序号2~序号5 和 序号7～9"), (1, 5, "序号1")], "report_id long, page_no int, raw_text string")
    assert {(r["lo"], r["hi"]) for r in text.exclusion_ranges(p).collect()} == {(2, 5), (7, 9)}


def test_similarity_and_diff(spark):
    df = spark.createDataFrame([("abcd", "abed"), ("same", "same"), ("abc", "xyz"), (None, "")], "a string, b string")
    assert [r["similarity"] for r in pairs.pair_similarity(df, "a", "b", 0.5).collect()] == [0.75, 1.0, 0.0, 1.0]
    parts = pairs.diff_pairs(df, "a", "b").first()["differences"]
    assert [(x["text"], x["type"]) for x in parts] == [("ab", "same"), ("c", "removed"), ("e", "added"), ("d", "same")]


def test_label_assignment(spark):
    comps = spark.createDataFrame([(1, 1, "泵", "", "A1"), (1, 2, "泵", "", "A1"), (1, 3, "阀", "V9", "")], "report_id long, component_id long, component_name string, model_spec string, serial_lot string")
    labels = spark.createDataFrame([(1, 10, "№1 泵 中文标签", "", "A1"), (1, 11, "№2 阀 中文标签", "V9", "")], "report_id long, label_id long, raw_caption string, model_spec string, batch_number string")
    got = {r["component_id"]: (r["status"], r["label_id"]) for r in matching.check_c06(comps, labels).collect()}
    assert got == {1: ("pass", 10), 2: ("error", None), 3: ("pass", 11)}
    assert {(r["component_id"], r["status"]) for r in matching.check_c05(comps, labels).collect()} == {(1, "pass"), (2, "pass"), (3, "pass")}


def test_fields_against_labels(spark):
    kind = "report_id long, client string, client_address string, sample_name string, model_spec string, production_date string, product_id_batch string"
    first = spark.createDataFrame([(1, "甲公司", "乙路1号", "导管", "RF-2000", "", "")], kind)
    third = spark.createDataFrame([(1, "甲公司", "乙路1号", "导管X", "RF-2000", "2025.01.02", "B77")], kind)
    labels = spark.createDataFrame([(1, 5, "№1 导管 中文标签", "RF-2OOO", "B77", "2025/01/02")], "report_id long, label_id long, raw_caption string, model_spec string, batch_number string, production_date string")
    assert {r["field"]: r["status"] for r in matching.check_c01(first, third).collect()} == {"client": "pass", "sample_name": "pass", "model_spec": "pass"}
    assert {r["field"]: r["status"] for r in matching.check_c02(third, labels, first).collect()} == {"型号规格": "pass", "生产日期": "error", "产品编号/批号": "pass", "委托方": "pass", "委托方地址": "pass"}
    assert matching.check_c03(third, labels).first()["reason"] == "format"


def cells(spark, *lines):
    return tables.densify(spark.createDataFrame([(1, r, c, t) for r, line in enumerate(lines) for c, t in enumerate(line)], "table_id long, row_no int, col_no int, text string"))


def test_header_paths(spark):
    grid = cells(spark, ["参数", "心房", "", "心室", ""], ["", "常规数值", "标准设置", "常规数值", "标准设置"], ["脉宽", "0.4", "0.5", "0.6", "0.7"])
    headers = tables.header_rows(grid)
    paths = {r["col_no"]: r["labels"] for r in tables.column_paths(grid, headers).collect()}
    assert paths == {0: ["参数"], 1: ["心房", "常规数值"], 2: ["心房", "标准设置"], 3: ["心室", "常规数值"], 4: ["心室", "标准设置"]}
    assert {r["row_no"] for r in headers.collect()} == {0, 1}


def test_fill_down_and_records(spark):
    grid = cells(spark, ["参数", "型号", "标准设置", "允许误差"], ["脉宽", "全部", "0.4", "±20"], ["", "全部", "0.5", ""], ["参数", "型号", "标准设置", "允许误差"])
    headers = tables.header_rows(grid)
    columns = tables.column_paths(grid, headers)
    filled = tables.fill_down(tables.drop_repeated_headers(tables.body_cells(grid, headers), columns), columns)
    got = {(r["row_no"], r["col_no"]): (r["text"], r["source"]) for r in filled.collect()}
    assert got[2, 0] == ("脉宽", "inferred") and got[2, 3] == ("", "native") and (3, 0) not in got
    record = tables.parameter_records(filled, columns).collect()
    assert len(record) == 1 and record[0]["values"] == {"标准设置": "0.4", "允许误差": "±20"} and record[0]["source_rows"] == [1, 2]


def test_clauses(spark):
    text_ = "2 性能要求\n2.1 外观\n应光滑，见表1\na) 无毛刺\n2/8\n3.1 方法\n不取\n2.10 尺寸\n应为5mm"
    lines = clauses.page_lines(spark.createDataFrame([(1, 1, text_)], "ptr_id long, page_no int, raw_text string"))
    found = clauses.extract_clauses(lines)
    assert {r["number_str"]: r["text_content"] for r in found.collect()} == {"2": "性能要求", "2.1": "外观\n应光滑，见表1\na) 无毛刺", "2.10": "尺寸\n应为5mm"}
    assert [(r["number_str"], r["table_number"]) for r in clauses.table_refs(found).collect()] == [("2.1", 1)]
    assert [r["marker"] for r in clauses.sub_items(found).collect()] == ["a)"]
    assert tuple(clauses.chapter_range(lines).first()) == (1, 1, 1)


def test_verdicts(spark):
    c = spark.createDataFrame([(1, [2], "2", "要求", 1, 1, 0), (1, [2, 1], "2.1", "应光滑无毛刺且表面清洁完整", 2, 1, 1), (1, [2, 2], "2.2", "长度≤20mm", 2, 1, 2), (1, [2, 3], "2.3", "应有标识", 2, 1, 3)], "ptr_id long, number array<int>, number_str string, text_content string, level int, page_no int, line_no int")
    i = spark.createDataFrame([(1, 1, "1", "外观", "2.1", "应光滑无毛刺且表面清洁完整", "符合要求", "符合", "/", 3, 0), (1, 2, "2", "长度", "2.2", "长度不大于20", "18mm", "符合", "/", 3, 1)], ITEM.replace("position int, ", "position int, "))
    i = i.select("report_id", "position", "sequence_number", "inspection_project", "standard_clause", "standard_requirement", "test_result", "item_conclusion", "remark", "source_page", "row_index_in_page")
    pair = spark.createDataFrame([(1, 1)], "ptr_id long, report_id long")
    got = {r["number_str"]: (r["result"], r["match_reason"]) for r in clauses.compare_documents(c, i, pair).collect()}
    assert got == {"2.1": ("match", "exact"), "2.2": ("match", "numeric"), "2.3": ("missing", "missing")}


CLAUSE = "ptr_id long, number array<int>, number_str string, text_content string, level int, page_no int, line_no int"
ROW = "report_id long, position int, sequence_number string, inspection_project string, standard_clause string, standard_requirement string, test_result string"
PAIR = "ptr_id long, report_id long"


def clause_rows(spark, texts):
    return spark.createDataFrame([(1, [int(x) for x in n.split(".")], n, t, n.count(".") + 1, 1, k) for k, (n, t) in enumerate(texts.items())], CLAUSE)


def test_heading_equivalences(spark):
    given = {  # number: clause, project, requirement, reason
        "2.1": ("脉冲宽度误差要求，见表1", "甲", "脉冲宽度，见表2的规定", "table_reference"),
        "2.2": ("绝缘电阻应见表1", "甲", "外壳强度应见表1", "differ"),
        "2.3": ("2.3 起搏参数：脉冲宽度应符合表1中的数值", "甲", "脉冲宽度应符合表 1 中的数值，常规数值0.4，允许误差20", "table_parameter"),
        "2.4": ("脉冲宽度应符合表1中的数值", "甲", "灵敏度应符合表1中的数值，常规数值2", "differ"),
        "2.5": ("外观应当光滑没有毛刺啊", "外观应当光滑没有毛刺啊", "别的", "differ"),
        "2.6": ("外观应当光滑没有毛刺", "外观应当光滑没有毛刺", "别的", "heading"),
        "2.7": ("标志", "标志和说明", "别的", "differ"),
    }
    c = clause_rows(spark, {n: g[0] for n, g in given.items()})
    i = spark.createDataFrame([(1, k, str(k), g[1], n, g[2], "/") for k, (n, g) in enumerate(given.items())], ROW)
    pair = spark.createDataFrame([(1, 1)], PAIR)
    got = {r["number_str"]: r["match_reason"] for r in clauses.compare_documents(c, i, pair, similarity=False).collect()}
    assert got == {n: g[3] for n, g in given.items()}
    loose = {r["number_str"]: r["match_reason"] for r in clauses.compare_documents(c, i, pair, strict=False, similarity=False).collect()}
    assert loose["2.7"] == "heading"


def test_scope(spark):
    fields = spark.createDataFrame([(1, ["2.1.1~2.1.3、2.4", "2.5至2.6（详见另一份检测报告）", "2.7（除灭菌性能、包装）", "2.8 待补证", ""]), (2, ["全部项目，不包括标签"]), (3, None)], "report_id long, inspection_items array<string>")
    rules = clauses.scope_rules(fields)
    got = {(r["report_id"], r["rule_no"], tuple(r["lo"] or ()), tuple(r["hi"] or ()), r["status"], r["topic"]) for r in rules.collect()}
    ext = "external_reference"
    assert got == {
        (1, 0, (2, 1, 1), (2, 1, 3), None, None), (1, 0, (2, 4), (2, 4), None, None), (1, 1, (2, 5), (2, 6), ext, None), (1, 2, (2, 7), (2, 7), None, None), (1, 3, (2, 8), (2, 8), "pending_evidence", None),
        (1, 2, (), (), None, "灭菌性能"), (1, 2, (), (), None, "包装"), (2, 0, (), (), None, "标签"),
    }
    texts = {"2.1.2": "甲", "2.2.2": "甲", "2.4.1": "甲", "2.5": "甲", "2.6.1": "甲", "2.7": "应有灭菌性能并按规定的方法逐一验证", "2.7.1": "甲", "2.8": "甲", "2.9": "甲", "2.10": "标签应清楚", "2.11": "甲"}
    c = clause_rows(spark, texts)
    i = spark.createDataFrame([(1, 0, "1", "x", "条款2.11.1", "甲", "/")], ROW)
    pair = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], PAIR)
    at = {(r["report_id"], r["number_str"]): (r["in_scope"], r["rule_status"]) for r in clauses.resolve_scope(c, rules, i, pair).collect()}
    want = {"2.1.2": (True, None), "2.2.2": (False, None), "2.4.1": (True, None), "2.5": (True, ext), "2.6.1": (True, ext), "2.7": (False, None), "2.7.1": (True, None), "2.8": (True, "pending_evidence"), "2.9": (False, None), "2.10": (False, None), "2.11": (True, None)}
    assert {n: v for (r, n), v in at.items() if r == 1} == want
    assert {n: v for (r, n), v in at.items() if r == 2} == {n: (n != "2.10", None) for n in texts} and all(at[3, n] == (True, None) for n in texts)
    out = {r["number_str"]: (r["result"], r["comparison_status"]) for r in clauses.compare_documents(c, i, pair.filter("report_id = 1"), rules, similarity=False).collect()}
    assert out["2.5"] == ("match", ext) and out["2.7"] == ("excluded", "out_of_scope_in_current_report") and out["2.4.1"] == ("missing", None)


def test_marker_is_a_whole_number(spark):
    c = clause_rows(spark, {"2.1": "甲", "2.10": "乙"})
    rows = [(1, 0, "1", "x", "", "按 2.10 的要求", "/"), (1, 1, "2", "x", "", "其他\n2.1 规定", "/"), (1, 2, "3", "x", "", "2.1、规定", "/"), (1, 3, "4", "x", "", "12.1 规定", "/")]
    got = {r["number_str"]: (r["tier"], r["position"], r["score"]) for r in clauses.match_clauses(c, spark.createDataFrame(rows, ROW), spark.createDataFrame([(1, 1)], PAIR), similarity=False).collect()}
    assert got == {"2.1": (4, 2, 4.0), "2.10": (4, 0, 1.0)}


def test_special_status(spark):
    given = {"该项本报告范围外": ("out_of_scope_in_current_report", "本报告范围外"), "待 补 证": ("pending_evidence", "待补证"), "结果在另一份报告": ("external_reference", "另一份报告"), "详见 2024-1 号报告": ("external_reference", "详见2024-1号报告"), "待补证，见外部报告": ("pending_evidence", "待补证"), "见附件": None, "不适用": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in given], "t string").select("t", clauses.special_status(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] and tuple(r["s"]) for r in df.collect()} == given


def test_group_clauses(spark):
    texts = {"2.1": "测试布图如下", "2.1.1": "甲", "2.2": "参数应符合，见表1", "2.2.1": "乙", "2.3": "不应超过，见表1", "2.3.1": "丙", "2.4": "见表1", "2.5": "短", "2.5.1": "丁"}
    assert {r["number_str"] for r in clauses.group_clauses(clause_rows(spark, texts)).collect()} == {"2.1", "2.2"}


def test_match_tiers(spark, monkeypatch):
    texts = {"2.1": "甲要求", "2.2": "乙要求", "2.3.1": "丙要求", "2.4": "丁要求", "2.5.1.1": "戊要求", "2.6": "外壳应光滑无毛刺", "2.7": "完全没有对应的一行", "2.1.3": "己要求", "2.8.1": "庚要求", "2.9": "辛要求", "2.1.1.2": "导丝外观 表面平整无缺陷", "2.11": "壬要求"}
    given = [
        ("1", "x", "2.1 颜色", "a"), ("续 2.2", "x", "", "b"), ("2.3", "x", "", "c"), ("4", "x", "", "见 2.4 所列"), ("5", "x", "第2.5条", "d"), ("5", "x", "2.5.1", "e"), ("6", "", "", "外壳应光滑无毛刺刺"), ("7", "", "", "外壳不光滑"),
        ("8", "x", "2.1.30", "f"), ("9", "x", "", "甲\n2.1.3 己"), ("10", "x", "2.8.1.5", "g"), ("2.9.4", "x", "", "h"), ("2.1.1.2 导丝外观 表面平整无缺陷", "符合要求", "", ""), ("2.1", "x", "4.2", "z"),
    ]
    c = clause_rows(spark, texts)
    i = spark.createDataFrame([(1, k, seq, proj, cl, req, "/") for k, (seq, proj, cl, req) in enumerate(given)], ROW)

    def brute(n, text_):
        found = []
        for k, (seq, proj, cl, req) in enumerate(given):
            dotted = re.search(r"\d+(?:\.\d+)+", cl)
            column, sequence = dotted[0] if dotted else "", re.sub(r"\s+", "", seq.replace("续", ""))
            if column == n:
                found.append((1, -1.0, k))
            if re.fullmatch(r"\d+(?:\.\d+)+", sequence):
                if sequence == n:
                    found.append((2, -1.0, k))
                if sequence.startswith(n) or n.startswith(sequence):
                    found.append((3, -1.0, k))
            elif re.search(r"\d+(?:\.\d+)+", seq):
                req = f"{req}\n{seq}".strip()
            e = re.escape(n)
            score = next((s for p, s in ((rf"^\s*{e}(?:[.．、]|\s|$)", 4), (rf"(?:^|\n)\s*{e}(?:[.．、]|\s|$)", 3), (rf"(?<![\d.]){e}(?:[.．、]|\s|$)", 1)) if re.search(p, req)), 0)
            if score:
                found.append((4, -float(score), k))
            if column and n.startswith(column + "."):
                found.append((5, -float(len(column)), k))
            if not column:
                other = req or proj
                score = SequenceMatcher(None, text_, other, autojunk=False).ratio() + (0.2 if text_ in other or other in text_ else 0)
                if score >= 0.55:
                    found.append((6, -score, k))
        return min(found)[::2] if found else (None, None)

    want = {n: brute(n, t) for n, t in texts.items()}
    assert {t for t, _ in want.values()} >= {1, 2, 3, 4, 5, 6, None}
    # a parent's column never stands for a number that only begins alike, and the nearest ancestor decides
    assert want["2.1.3"][1] == 13 and want["2.5.1.1"] == (5, 5) and want["2.1"] == (1, 0)
    own = spark.createDataFrame([(1, 1)], PAIR)
    assert {r["number_str"]: (r["tier"], r["position"]) for r in clauses.match_clauses(c, i, own).collect()} == want
    # the registered queries use all tiers
    monkeypatch.setattr(documents, "extracted", lambda spark, d: c)
    monkeypatch.setattr(documents, "source", lambda spark, d, name: i)
    monkeypatch.setattr(documents, "own_pairs", lambda spark, d: own)
    assert {r["number_str"]: (r["tier"], r["position"]) for r in documents.matched(spark, "").collect()} == want


def item_rows(spark, *rows, report=1):
    """Rows by the columns that are given; all others are empty."""
    names = ("sequence_number", "inspection_project", "standard_clause", "standard_requirement", "test_result", "item_conclusion", "remark")
    return spark.createDataFrame([(report, k, *[r.get(c, "") for c in names]) for k, r in enumerate(rows)], "report_id long, position int, " + ", ".join(f"{c} string" for c in names))


def verdicts(spark, cases, **more):
    """Each case (texts of clauses by number, rows) as a pair of documents of its own: {(case, number): row}."""
    both = {k: (clause_rows(spark, texts).withColumn("ptr_id", F.lit(k).cast("long")), item_rows(spark, *rows, report=k)) for k, (texts, rows) in enumerate(cases)}
    c, i = (reduce(DataFrame.unionByName, [b[side] for b in both.values()]) for side in (0, 1))
    out = clauses.compare_documents(c, i, spark.createDataFrame([(k, k) for k in both], PAIR), **more)
    return {(r["ptr_id"], r["number_str"]): r for r in out.collect()}


def need(text_, result="", conclusion="", **more):
    return {"standard_requirement": text_, "test_result": result, "item_conclusion": conclusion, **more}


SIZES = [need("管身直径（外径）", "2.5mm±0.1mm", "+0.03"), need("电极宽度", "2.5mm±0.1mm", "-0.02～+0.06"), need("电极间距", "4mm±0.5mm", "-0.4～-0.2"), need("环形圈最小直径", "20mm±10%", "-5%～+3%"), need("环形圈最大直径", "25mm±10%", "-6%～+2%"), need("有效长度", "115cm±3cm", "+0～+1")]
SIZE_TEXT = "当用通用量具测量时，导管管身直径（外径）、电极宽度、电极间距、环形圈直径、有效长度应符合产品型号/规格及其划分说明表中尺寸要求。"


def test_bundles(spark):
    start, stop = need("2.1.2.1 当用通用量具测量时，导管尺寸应符合要求。", sequence_number="157"), need("2.1.2.2 导管头端部分可调弯，调弯角度180±20°。")
    text_ = "尺寸 当用通用量具测量时，导管连接线外径、长度应符合导管连接线型号/规格表中尺寸要求。"
    split = [need(f"2.7.2 {text_}"), need("连接线长度±0.05m", "2m 单位：m", "+0.02"), need("外径±0.5mm", "6.5mm 单位：mm", "-0.2～+0.0"), need("2.7.3 连接牢固度")]
    # all hold; one row does not, one name is not covered, a blank row ends the rows, a clause in the column; blanks before the first row are passed over
    given = [SIZES, [*SIZES[:2], need("电极间距", "4mm±0.5mm", "+0.7"), *SIZES[3:]], SIZES[:5], [*SIZES[:3], need(""), *SIZES[3:]], [*SIZES[:3], need("电极间距", "4mm±0.5mm", "+0.1", standard_clause="2.2"), *SIZES[3:]], [need(""), *SIZES]]
    got = verdicts(spark, [*[({"2.1.2.1": SIZE_TEXT}, [start, *rows, stop]) for rows in given], ({"2.7.2": text_}, split)])
    assert [got[k, "2.1.2.1"]["match_reason"] for k in range(6)] == ["measurement_bundle", "differ", "differ", "differ", "differ", "measurement_bundle"] and got[0, "2.1.2.1"]["result"] == "match"
    assert got[6, "2.7.2"]["match_reason"] == "measurement_bundle"


def test_bundle_of_segments(spark):
    rows = [
        need("2.1.3 断裂力 各试验段的断裂力应符合下表的规定。", sequence_number="续157", standard_clause="2.1"), need("试验段", "断裂力（N）"), need("环形圈头端与环形圈管身", "≥10", "17～46"), need("环形圈管身与可调弯管身", "≥15", "50～55"),
        need("可调弯管与外管管身", "≥15", "37～57"), need("外管管身", "≥15", "186～213"), need("外管管身与手柄", "≥15", "173～228"), need("2.1.4 调节机构的操控性"),
    ]
    matched = clause_rows(spark, {"2.1.3": "断裂力 各试验段的断裂力应符合下表的规定。"}).withColumns({"report_id": F.lit(1).cast("long"), "position": F.lit(0)})
    (got,) = bundles.bundle_match(matched, item_rows(spark, *rows)).collect()
    assert got["bundle"] == "segments" and len(got["rows"]) == 5 and got["rows"][0].asDict() == {"item": "环形圈头端与环形圈管身", "requirement": ">=10", "actual": "17~46"} or got["rows"][0]["actual"] in ("17～46", "17~46")
    assert not bundles.bundle_match(matched, item_rows(spark, rows[0], rows[1], need("外管管身", "≥15", "3～9"), rows[3])).collect()
    assert not bundles.bundle_match(matched, item_rows(spark, rows[0], rows[2], rows[-1])).collect()  # one segment is not enough


def test_bundle_of_split_tolerances(spark):
    rows = [need("2.7.2 尺寸 当用通用量具测量时，导管连接线外径、长度应符合导管连接线型号/规格表中尺寸要求。"), need("连接线长度±0.05m", "2m 单位：m", "+0.02"), need("外径±0.5mm", "6.5mm 单位：mm", "-0.2～+0.0"), need("2.7.3 连接牢固度")]
    text_ = "尺寸 当用通用量具测量时，导管连接线外径、长度应符合导管连接线型号/规格表中尺寸要求。"
    matched = clause_rows(spark, {"2.7.2": text_}).withColumns({"report_id": F.lit(1).cast("long"), "position": F.lit(0)})
    (got,) = bundles.bundle_match(matched, item_rows(spark, *rows)).collect()
    assert (got["bundle"], [r["item"] for r in got["rows"]], [r["requirement"] for r in got["rows"]]) == ("measurement", ["连接线长度", "外径"], ["2m±0.05m", "6.5mm±0.5mm"])


def test_verdict_details(spark):
    cases = [
        ({"2.1": "将测试系统按图1进行安装 图B1测试布图 注：箭头方向代表数据传输方向", "2.1.1": "外表面"}, [need("2.1.1 外表面", sequence_number="157", standard_clause="2.1", inspection_project="物理性能及结构")]),
        ({"2.1": "基本电性能指标及允许误差 见表1参数表", "2.1.1": "脉冲幅度应符合表1中的数值。"}, [need("脉冲幅度应符合表1中的数值。", sequence_number="1", standard_clause="2.1.1")]),
        ({"2.5.1": "各电极与连接器对应芯脚之间的导线的直流电阻不应超过20Ω。"}, [need("各电极与连接器对应芯脚之间的导线的直流电阻值≤20Ω。", "≤20Ω", "符合", sequence_number="57", standard_clause="2.5.1")]),
        ({"2.1.6": "干扰转复频率应符合表1中的数值。"}, [need("基础频率应符合表1中的数值。", sequence_number="40", standard_clause="2.1.4"), need("灵敏度应符合表1中的数值。", sequence_number="42", standard_clause="2.1.7")]),
        ({"2.1.1.1": "导管外观"}, [need("风险管理过程", sequence_number="2", standard_clause="4.2"), need("导管外观", sequence_number="157", standard_clause="2.1")]),
        ({"2.1.1.1": "导管外观 有效长度外表面应清洁"}, [need("2.1.1. 外观\n2.1.1.1. 导管外观 有效长度外表面应清洁\n2.1.1.2. 导丝外观 表面应平整", sequence_number="157", standard_clause="2.1")]),
        ({"2.1.1.2": "导丝外观 表面平整无缺陷"}, [need("2.1.1.1 导管外观 表面平整无缺陷", sequence_number="157", standard_clause="2.1", inspection_project="物理性能"), need("", sequence_number="2.1.1.2 导丝外观 表面平整无缺陷", inspection_project="符合要求")]),
        # a row that says it is out of scope matches with that status; a number among the excluded ones; a project's name leads
        ({"2.3": "应有标识"}, [need("应有标识", "本报告范围外", standard_clause="2.3")]),
        ({"2.3": "应有标识"}, [need("应有标识", standard_clause="2.3")]),
        ({"2.3": "标识 应清楚可辨"}, [need("应清楚可辨", standard_clause="2.3", inspection_project="标识", sequence_number="5"), need("，且不易脱落", sequence_number="续5")]),
    ]
    got = verdicts(spark, cases, excluded=spark.createDataFrame([(8, "2.3"), (8, "2.3"), (8, "7")], "report_id long, sequence_number string"))
    assert {k: (r["result"], r["comparison_status"], r["match_reason"]) for k, r in got.items()} == {
        (0, "2.1"): ("excluded", "group_clause", "group_clause"), (0, "2.1.1"): ("match", None, "exact"), (1, "2.1"): ("excluded", "group_clause", "group_clause"), (1, "2.1.1"): ("match", None, "exact"), (2, "2.5.1"): ("match", None, "numeric"),
        (3, "2.1.6"): ("missing", None, "missing"), (4, "2.1.1.1"): ("match", None, "exact"), (5, "2.1.1.1"): ("match", None, "exact"), (6, "2.1.1.2"): ("match", None, "exact"), (7, "2.3"): ("match", "out_of_scope_in_current_report", "out_of_scope_in_current_report"),
        (8, "2.3"): ("excluded", "excluded", "excluded_number"), (9, "2.3"): ("differ", None, "differ"),
    }
    assert (got[4, "2.1.1.1"]["position"], got[6, "2.1.1.2"]["position"]) == (1, 1) and got[5, "2.1.1.1"]["requirement"] == "导管外观 有效长度外表面应清洁" and got[9, "2.3"]["requirement"] == "标识 应清楚可辨\n，且不易脱落"
    fields = spark.createDataFrame([(0, ["2.1～2.8（除生物相容性、电磁兼容性）"])], "report_id long, inspection_items array<string>")
    scope = [({"2.5.3": "电磁兼容应符合YY 9706.102-2021要求。", "3.1": "说明"}, [need("2.5.3 电磁兼容应符合YY 9706.102-2021要求。", "/", sequence_number="161", inspection_project="安全要求")])]
    found = verdicts(spark, scope, rules=clauses.scope_rules(fields), fields=fields)[0, "2.5.3"]
    assert (found["result"], found["comparison_status"]) == ("excluded", "out_of_scope_in_current_report")


def test_clause_types(spark):
    rows = [([2], "性能"), ([2, 1], "注：见下"), ([2, 2], "按附录A试验"), ([2, 3], "试验方法"), ([2, 3, 1], "图1 甲"), ([3, 1], "方法"), ([4, 1], "图B1 布置"), ([4, 2], "标签"), ([4, 2, 1], "清楚"), ([4, 9, 1], "甲"), ([4, 3, 1], "说明：乙"), ([3, 2], "附录")]
    c = spark.createDataFrame([(1, n, ".".join(map(str, n)), t, len(n), 1, k) for k, (n, t) in enumerate(rows)], CLAUSE)
    got = {r["number_str"]: r["clause_type"] for r in clauses.classify_clauses(c).collect()}
    main, info = "main_requirement", "informational"
    # 4.2.1 has the type of 4.2, the last clause of level 2 with that second number
    assert got == {"2": info, "2.1": main, "2.2": "appendix", "2.3": main, "2.3.1": main, "3.1": "test_method", "4.1": info, "4.2": info, "4.2.1": info, "4.9.1": main, "4.3.1": info, "3.2": "appendix"}


def test_structure_confidence(spark):
    good = cells(spark, ["参数", "型号", "标准设置"], ["脉宽", "全部", "0.4"])
    odd = cells(spark, ["1", "2", "3"], ["4", "5", "6"]).withColumn("table_id", F.lit(2).cast("long"))
    grid = tables.densify(good.unionByName(odd))
    headers = tables.header_rows(grid)
    columns = tables.column_paths(grid, headers)
    got = {r["table_id"]: (r["structure_confidence"], r["notes"], r["needs_manual_review"]) for r in tables.structure_confidence(grid, headers, columns).collect()}
    assert got[1] == (1.0, [], False) and got[2][1][0] == "header_not_detected" and got[2][2]
    # only header rows, four of them, and more cells that took their label from the left than there are columns
    four = cells(spark, ["参数", "", ""], ["型号", "", ""], ["标准设置", "", ""], ["允许误差", "x", "y"])
    heads = spark.createDataFrame([(1, k) for k in range(4)], "table_id long, row_no int")
    found = tables.structure_confidence(tables.densify(four), heads, tables.column_paths(tables.densify(four), heads)).first()
    assert found["notes"] == ["too_many_header_rows", "body_rows_empty", "heavy_header_propagation"] and found["structure_confidence"] == 0.6


def test_row_walks(spark):
    names = "report_id long, position int, sequence_number string, inspection_project string, standard_clause string, standard_requirement string, test_result string, item_conclusion string, remark string, source_page int, row_index_in_page int"
    given = [("", 3, 0, ""), ("1", 3, 1, "x"), ("", 3, 2, "x"), ("3", 3, 3, "x"), ("续3", 4, 0, "x"), ("续3", 4, 1, "x"), ("", 5, 0, "x"), ("4", 5, 1, "——"), ("2", 5, 2, "x"), ("以下空白", 5, 3, "")]
    i = spark.createDataFrame([(1, k + 1, s, "p", "2.1", "q", res, "/", "-", page, row) for k, (s, page, row, res) in enumerate(given)], names)
    got = sorted((r["position"], r["error_code"], r["item_number"], r["previous"]) for r in items.check_c09_walk(i).collect())
    jump, blank, missing, misplaced = "SERIAL_NUMBER_ERROR_001", "SERIAL_NUMBER_ERROR_002", "CONTINUATION_MARK_ERROR_001", "CONTINUATION_MARK_ERROR_002"
    assert got == [(1, blank, "", None), (4, jump, "3", 1), (6, misplaced, "3", None), (7, missing, "3", None), (9, jump, "2", 4)]
    # a title row is the first of its number and clause, without a result, above any result, be it a dash; another clause starts anew
    given = [("1", "2.1", ""), ("", "2.1", "——"), ("", "2.1", ""), ("2", "2.2", ""), ("", "2.3", "x"), ("3", "2.4", "/")]
    i = spark.createDataFrame([(1, k + 1, s, "p", c, "q", res, "/", "-", 3, k) for k, (s, c, res) in enumerate(given)], names)
    assert [(r["position"], r["empty_fields"]) for r in items.check_c08_rows(i).orderBy("position").collect()] == [(3, ["test_result"]), (4, ["test_result"])]


def test_summary(spark):
    f = spark.createDataFrame([(1, "C01", None, "a", "warning", "", ""), (1, "C01", None, "b", "pass", "", ""), (1, "C09", None, None, "error", "", "")], "report_id long, check_id string, entity string, field string, status string, source_a string, source_b string")
    assert {r["check_id"]: r["status"] for r in summary.summarize_checks(f).collect()} == {"C01": "warning", "C09": "error"}
    assert {r["check_id"]: r["status"] for r in summary.summarize_checks(f, compat=True).collect()} == {"C01": "pass", "C09": "error"}
    assert summary.overall(summary.summarize_checks(f)).first()["overall"] == "error" and summary.only_failures(f).count() == 2
