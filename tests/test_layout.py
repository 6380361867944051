"""Layout and parameter jobs on literal fixtures."""

from pyspark.sql import functions as F

from reportloom.operators import layout, parameters


def test_regions_and_numbers(spark):
    blocks = spark.createDataFrame([(1, 1, 1, "表 3 参数", 10.0, 80.0, 90.0, 95.0), (1, 1, 2, "型号", 10.0, 200.0, 40.0, 210.0), (1, 1, 3, "RF-1", 100.0, 205.0, 140.0, 215.0), (1, 1, 4, "far", 900.0, 900.0, 950.0, 950.0)], "report_id long, page_no int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([(1, 1, 7, 0.0, 100.0, 200.0)], "report_id long, page_no int, table_id long, x0 double, y0 double, x1 double")
    assert layout.table_numbers(tables, blocks).first()["table_number"] == 3
    pages = spark.createDataFrame([(1, 1, "text\n批号 9\nmore", 800.0), (2, 1, "x\n批号 9\nmore", 800.0)], "report_id long, page_no int, raw_text string, height double")
    regions = {r["report_id"]: r["region_text"] for r in layout.label_region(blocks, pages).collect()}
    assert regions == {1: "型号", 2: "批号 9\nmore"}
    keys = spark.createDataFrame([("型号",)], "key string")
    assert layout.nearest_value(blocks, keys).first()["value"] == "RF-1"
    assert layout.page_headers(pages, blocks).filter("report_id = 1").first()["header_class"] is None


def test_nearest_value_of_many_keys(spark):
    n = 1200
    names = [f"{chr(0x4E00 + k % 40)}名{k}号" for k in range(n)]
    rows = [x for k, t in enumerate(names) for x in ((k, 1, 1, f"第 {t}：", 10.0, 200.0, 40.0, 210.0), (k, 1, 2, f"V-{k}", 100.0, 205.0, 140.0, 215.0))]
    rows += [(n, 1, 1, "the Z:", 10.0, 200.0, 40.0, 210.0), (n, 1, 2, "one", 100.0, 205.0, 140.0, 215.0), (n + 1, 1, 1, None, 10.0, 200.0, 40.0, 210.0), (n + 2, 1, 1, "", 10.0, 200.0, 40.0, 210.0)]
    blocks = spark.createDataFrame(rows, "report_id long, page_no int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    keys = spark.createDataFrame([(t,) for t in [*names, "Z", "不在"]], "key string")
    got = {(r["report_id"], r["key"]): r["value"] for r in layout.nearest_value(blocks, keys).collect()}
    assert got == {(k, t): f"V-{k}" for k, t in enumerate(names)} | {(n, "Z"): "one"}


def test_multiline(spark):
    pages = spark.createDataFrame([(1, 1, "名称：甲\n乙丙\n型号 X")], "report_id long, page_no int, raw_text string")
    assert layout.multiline_value(pages, "名称", "型号|批号").first()["value"] == "甲乙丙"


def test_continuations(spark):
    kind = "ptr_id long, table_id long, page_no int, y0 double, y1 double, height double, table_number int, n_cols int, headers array<string>, paths array<string>, is_parameter boolean"
    h = ["参数", "标准设置"]
    rows = [(1, 1, 3, 500.0, 780.0, 800.0, 1, 2, h, h, True), (1, 2, 4, 50.0, 200.0, 800.0, None, 2, h, h, True), (1, 3, 6, 50.0, 200.0, 800.0, None, 2, h, h, True)]
    assessed = layout.assess_continuation(spark.createDataFrame(rows, kind))
    assert {r["table_id"]: r["reason"] for r in assessed.collect()} == {1: "first", 2: "alike", 3: "pages_apart"}
    merged = {r["table_id"]: (r["pages"], r["n_fragments"]) for r in layout.merge_continuations(assessed).collect()}
    assert merged == {1: ([3, 4], 2), 3: ([6], 1)}
    # one document a case: the table before, the table itself, and the reason
    cases = {
        "no_columns": ({}, {"n_cols": 0}), "columns_differ": ({}, {"n_cols": 4}), "numbers_differ": ({"table_number": 1}, {"table_number": 2}), "same_number": ({"table_number": 1}, {"table_number": 1, "headers": ["x"]}),
        "own_number": ({}, {"table_number": 2}), "alike_overlapping": ({"headers": list("abcd")}, {"headers": list("abcde"), "y0": 500.0}), "placed_overlapping": ({"headers": list("ab")}, {"headers": list("abcd")}),
        "placed_parameters": ({"headers": list("abcdefg")}, {"headers": list("abcdhijk"), "paths": list("pqr"), "is_parameter": True}), "placed_paths": ({"headers": list("abc"), "paths": list("pqr")}, {"headers": list("abde"), "paths": list("pqrs"), "is_parameter": False}),
        "no_number": ({"headers": ["a"]}, {"headers": ["z"], "paths": ["y"]}), "no_evidence": ({"headers": ["a"], "table_number": 3}, {"headers": ["z"], "paths": ["y"]}),
    }
    base = {"y0": 50.0, "y1": 780.0, "height": 800.0, "table_number": None, "n_cols": 2, "headers": h, "paths": ["p"], "is_parameter": True}
    docs = [(k, 2 * k + j, 3 + j, *({**base, **change}[c] for c in base)) for k, pair in enumerate(cases.values()) for j, change in enumerate(pair)]
    reasons = {r["table_id"]: (r["reason"], r["continues"]) for r in layout.assess_continuation(spark.createDataFrame(docs, kind)).collect()}
    got = {name: reasons[2 * k + 1] for k, name in enumerate(cases)}
    for name in ("no_columns", "columns_differ", "numbers_differ", "own_number", "no_number", "no_evidence"):
        assert got[name] == (name, False)
    assert got["same_number"] == ("same_number", True) and got["alike_overlapping"] == ("alike_overlapping", True) and got["placed_overlapping"][1]
    samples = spark.createDataFrame([(1, 1, 4, 1, 5, False), (1, 2, 4, 6, 9, False), (1, 3, 3, 10, 12, False)], "report_id long, table_no int, n_cols int, first_no int, last_no int, repeats_header boolean")
    assert [r["merged_id"] for r in layout.merge_sample_tables(samples).orderBy("table_no").collect()] == [1, 1, 2]


def test_topics_and_values(spark):
    df = spark.createDataFrame([("脉冲宽度(ms)：应为0.4",), (None,)], "t string")
    got = [r["topics"] for r in parameters.extract_topics(df, "t").collect()]
    assert "脉冲宽度" in got[0] and got[1] == []
    one = spark.createDataFrame([("常规数值：0.4，标准设置：0.5；允许误差：±20",)], "t string").select(parameters.labelled_values("t").alias("v")).first()["v"]
    assert one == {"常规数值": "0.4", "标准设置": "0.5", "允许误差": "±20"}
    values = parameters.parameter_value(spark.createDataFrame([("幅度: 5V", "幅度"), ("幅度\n7V", "幅度"), ("none", "幅度")], "t string, n string"), "t", "n").collect()
    far = parameters.parameter_value(spark.createDataFrame([("x" * 1_200_000 + " 幅度: 5V", "幅度"), ("幅 度" + "x" * 1_200_000 + "7V", "幅度")], "t string, n string"), "t", "n").collect()
    assert [(r["value_rule"], r["value"]) for r in far] == [("line", "5V"), ("number", "7V")]
    assert [(r["value_rule"], r["value"]) for r in values] == [("line", "5V"), ("next_line", "7V"), (None, None)]


def test_parameter_comparison(spark):
    params = spark.createDataFrame([(1, 1, "2.1", 3, "脉冲宽度", "RF-1", "0.4"), (1, 1, "2.1", 3, "脉冲宽度", "ZZ-9", "0.9"), (1, 1, "2.1", 3, "灵敏度", "RF-1", "2")], "ptr_id long, report_id long, number_str string, table_number int, parameter_name string, model string, reference_value string")
    items = spark.createDataFrame([(1, "2.1", "脉冲宽度", "RF-1 的脉冲宽度：0.4", "0.4")], "report_id long, number_str string, inspection_project string, standard_requirement string, test_result string")
    out = parameters.compare_parameters(params, items).collect()
    assert [(r["parameter_name"], r["model"]) for r in out] == [("脉冲宽度", "RF-1")]
    texts = spark.createDataFrame([(1, 1, "测得 30V"), (1, 2, "测得 18V")], "report_id long, position int, text string")
    want = spark.createDataFrame([(1, 1, "2.1", "≤20V")], "ptr_id long, report_id long, number_str string, expected string")
    assert parameters.numeric_evidence(want, texts).select(F.col("evidence")).first()[0] == "18V"


FRAGMENTS = "ptr_id long, table_id long, page_no int, y0 double, y1 double, height double, table_number int, n_cols int, headers array<string>, paths array<string>, is_parameter boolean"
NAMES = ["参数", "型号", "常规数值", "标准设置", "允许误差"]


def fragment(doc, table_id, page, number=None, headers=(), paths=(), n_cols=5, y0=50.0, y1=780.0, parameter=True):
    return (doc, table_id, page, y0, y1, 800.0, number, n_cols, list(headers), list(paths), parameter)


def test_accumulated_fragments(spark):
    docs = [
        # a number that an earlier fragment had: its neighbour has none
        fragment(1, 1, 3, 1, NAMES), fragment(1, 2, 4, None, NAMES), fragment(1, 3, 5, 1, ["x"]), fragment(1, 4, 6, 2, ["x"]),
        # headers that the first fragment lends to all: the second has none of its own, but the paths agree
        fragment(2, 1, 8, 1, NAMES, NAMES), fragment(2, 2, 9, None, [*NAMES[:3], "甲", "乙"], NAMES), fragment(2, 3, 10, None, NAMES, []), fragment(2, 4, 12, None, NAMES, NAMES),
        # the number comes with the second fragment; a page's end counts, not its start; two fragments of one page
        fragment(3, 1, 1, None, NAMES), fragment(3, 2, 2, None, NAMES), fragment(3, 3, 2, None, NAMES, y0=400.0), fragment(3, 4, 3, None, [*NAMES[:4], "别"], n_cols=6),
        fragment(4, 1, 1, None, [], [], n_cols=0), fragment(4, 2, 2, None, [], []),
    ]
    tables = spark.createDataFrame(docs, FRAGMENTS)
    folded = layout.fold_continuations(tables)
    got = {(r["ptr_id"], r["table_id"]): (r["reason"], r["continues"]) for r in folded.collect()}

    def share(a, b, least):
        both, most = set(a) & set(b), set(a) | set(b)
        whole = (min(len(set(a)), len(set(b))) if a and b else 0) if least else len(most)
        return len(both) / whole if whole else 0.0

    def brute(rows):
        out, base = {}, None
        for r in sorted(rows, key=lambda r: (r[2], r[3])):
            doc, tid, page, y0, y1, h, number, cols, heads, paths, par = r
            if base is None:
                reason = "first"
            elif not 0 <= page - base["page"] <= 1:
                reason = "pages_apart"
            elif min(cols, base["cols"]) == 0:
                reason = "no_columns"
            elif abs(cols - base["cols"]) > 1:
                reason = "columns_differ"
            elif number is not None and base["number"] is not None:
                reason = "same_number" if number == base["number"] else "numbers_differ"
            elif number is not None:
                reason = "own_number"
            else:
                e = {"alike": share(heads, base["heads"], False), "paths": share(paths, base["paths"], True), "placed": y0 < 0.25 * h and base["y1"] > 0.7 * h, "parameters": par and base["par"]}
                e["overlap"] = max(share(heads, base["heads"], True), e["paths"])
                reason = next((n for n, asked in layout.GOES_ON if all(e[k] >= v for k, v in asked.items())), "no_number" if base["number"] is None else "no_evidence")
            out[doc, tid] = reason
            if reason in layout.JOINS:
                same = page == base["first"]
                base |= {"page": max(page, base["page"]), "y1": max(base["y1"], y1) if same else base["y1"], "number": base["number"] if base["number"] is not None else number, "cols": max(cols, base["cols"]), "heads": base["heads"] or heads, "paths": base["paths"] or paths, "par": base["par"] if base["heads"] else par}
            else:
                base = {"first": page, "page": page, "y1": y1, "number": number, "cols": cols, "heads": heads, "paths": paths, "par": par}
        return out

    want = {k: v for doc in (1, 2, 3, 4) for k, v in brute([d for d in docs if d[0] == doc]).items()}
    assert {k: v[0] for k, v in got.items()} == want
    assert got[1, 3] == ("same_number", True) and got[1, 4] == ("numbers_differ", False) and got[2, 3][1]
    # the neighbour alone gives another answer
    lagged = {(r["ptr_id"], r["table_id"]): r["reason"] for r in layout.assess_continuation(tables).collect()}
    assert lagged[1, 3] == "own_number" and lagged[2, 3] != got[2, 3][0]
    merged = {(r["ptr_id"], r["table_id"]): (r["table_number"], r["pages"], r["headers"]) for r in layout.merge_continuations(folded).collect()}
    assert merged[1, 1] == (1, [3, 4, 5], NAMES) and merged[1, 4][0] == 2 and merged[2, 1] == (1, [8, 9, 10], NAMES)
    assert layout.fold_continuations(tables.limit(0)).count() == 0


def test_merged_cells(spark):
    texts = {1: [NAMES, ["脉冲宽度(ms)", "全部型号", "0.1...(0.1)...1.5", "0.4", "±20μs"]], 2: [[n + " " for n in NAMES], ["基础频率(bpm)", "全部型号", "30...(5)...200", "60", "±20ms"]], 3: [["别", "", "", "", None]]}
    cells = spark.createDataFrame([(7, t, i + 5, j, x) for t, rows in texts.items() for i, r in enumerate(rows) for j, x in enumerate(r)], "ptr_id long, table_id long, row_no int, col_no int, text string")
    folded = layout.fold_continuations(spark.createDataFrame([fragment(7, 1, 3, 1, NAMES), fragment(7, 2, 4, None, NAMES), fragment(7, 3, 9, None, NAMES)], FRAGMENTS))
    out = layout.merge_cells(folded, cells).collect()
    first = {(r["row_no"], r["page_no"], r["from_row"]): r["text"] for r in out if r["table_id"] == 1 and r["col_no"] == 0}
    assert first == {(0, 3, 5): "参数", (1, 3, 6): "脉冲宽度(ms)", (2, 4, 6): "基础频率(bpm)"}  # the repeated header of the second fragment is gone
    assert {(r["row_no"], r["text"]) for r in out if r["table_id"] == 3} == {(0, "别"), (0, ""), (0, None)} and layout.merge_cells(folded, cells.limit(0)).count() == 0
