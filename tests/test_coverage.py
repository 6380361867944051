"""Coverage of parameter rows by report texts, on literal fixtures."""

from pyspark.sql import functions as F

from reportloom.operators import coverage

HEADERS = ["参数", "型号", "常规数值", "标准设置", "允许误差"]
CELLS = "table_id long, row_no int, col_no int, header string, text string"
REFS = "ref_id long, table_id long, topics array<string>, report_text string"
TEXT = "脉冲宽度应符合表1中的数值。脉冲宽度(ms)（心房）常规数值：0.1 ...(0.1) ... 0.5 ...(0.25) ... 1.5；标准设置：0.4；允许误差：±20μs 或 ±10%中取较大值；并给出@240Ω/@500Ω/@2000Ω等附加测试结果。"


def table(spark, *rows, headers=HEADERS):
    return spark.createDataFrame([(1, i, j, h, t) for i, r in enumerate(rows) for j, (h, t) in enumerate(zip(headers, r, strict=True))], CELLS)


def test_row_coverage(spark):
    row = ["脉冲宽度(ms)", "全部型号", "0.1...(0.1)...0.5...(0.25)...1.5", "0.4", "±20μs或±10%中取较大值"]
    cases = [
        (row, TEXT, True), ([*row[:3], "0.9", row[4]], TEXT, False), (["灵敏度", *row[1:]], TEXT, False),  # a value, a name that the text does not have
        (["x", "全部型号", "0.5...0.1...(0.25)", "", ""], "x 0.1...(0.25)...0.5", False), (["脉宽", "/", "—", "", "N/A"], "脉 宽", True),  # numbers out of order; cells that say nothing
        (["", "全部型号", "", "", ""], TEXT, None), (row, "", False), (row, None, False), (["电阻", "", "", "≤20Ω", ""], "电阻 实测 18Ω", True), (["电阻", "", "", "≤20Ω", ""], "电阻 实测 28Ω", False),  # no cell counts; no text; a demand
    ]
    cells = spark.createDataFrame([(k, 0, j, h, t) for k, (r, _, _) in enumerate(cases) for j, (h, t) in enumerate(zip(HEADERS, r, strict=True))], CELLS)
    refs = spark.createDataFrame([(k, k, [], text_) for k, (_, text_, _) in enumerate(cases)], REFS)
    got = {r["ref_id"]: r["covered"] for r in coverage.row_coverage(cells, refs).collect()}
    assert {k: got.get(k) for k in range(len(cases))} == {k: want for k, (_, _, want) in enumerate(cases)}


def test_in_order(spark):
    given = [(["1", "2"], "1 2"), (["2", "1"], "1 2"), (["1", "1"], "1"), (["1", "1"], "11"), ([], ""), (["12", "2"], "123 2"), (["12", "2"], "12")]
    df = spark.createDataFrame(given, "n array<string>, t string").select("n", "t", coverage.in_order(F.col("n"), F.col("t")).alias("ok"))

    def brute(numbers, text_):
        at = 0
        for n in numbers:
            at = text_.find(n, at)
            if at < 0:
                return False
            at += len(n)
        return True

    assert [r["ok"] for r in df.collect()] == [brute(*g) for g in given]


def test_compare_rows(spark):
    row = ["脉冲宽度(ms)", "全部型号", "0.1...(0.1)...0.5...(0.25)...1.5", "0.4", "±20μs或±10%中取较大值"]
    rows = [HEADERS, row, ["灵敏度", "DR-T", "", "2", ""], ["灵敏度", "SR", "", "3", ""], ["基础频率", "", "", "60", ""], ["", "", "", "", ""]]
    cells = table(spark, *rows)
    refs = spark.createDataFrame([
        (1, 1, ["脉冲宽度"], TEXT), (2, 1, ["灵敏度"], "DR 型 灵敏度 2"), (3, 1, ["基础频率"], "基础频率：60"), (4, 1, ["基础频率"], "基础频率：61"), (5, 1, ["不应期"], TEXT),
        (6, 1, [], "该项详见另一份报告"), (7, 1, ["灵敏度"], "灵敏度 3"), (8, 2, [], TEXT), (9, 1, ["灵敏度"], None),
    ], REFS)
    got = {}
    for r in coverage.compare_rows(cells, refs).collect():
        got.setdefault(r["ref_id"], []).append((r["row_no"], r["matches"], r["path"], r["comparison_status"]))
    got = {k: sorted(v) for k, v in got.items()}
    assert got[1] == [(1, True, "coverage", None)] and got[2] == [(2, True, "coverage", None)]  # the text names one of the two models
    assert got[3] == [(4, True, "coverage", None)] and got[4] == [(4, False, "value", None)] and 5 not in got and 8 not in got
    assert [x[0] for x in got[6]] == [1, 2, 3, 4] and {x[1:] for x in got[6]} == {(True, "special", "external_reference")}
    assert got[7] == [(2, False, "value", None), (3, True, "coverage", None)] and got[9] == [(2, False, "value", None), (3, False, "value", None)]


def test_evidence(spark):
    texts = {
        1: "脉冲宽度应符合表1中的数值。\n脉冲宽度(ms)（心房）\n常规数值：0.1...(0.1)...1.5\n标准设置：0.4\n@240Ω 0.1ms：\n±20μs\n脉冲宽度(ms)（右室）\n常规数值：0.1...(0.1)...1.5\n@500Ω\n±10%\n单位：ms\n@2000Ω\n±20μs",
        2: "灵敏度\n 2mV \n其他", 3: "无关\n内容", 4: "", 5: None, 6: "阻抗：500Ω", 7: "幅度\n幅度",
    }
    asked = {1: "脉冲宽度(ms)", 2: "灵敏度", 3: "灵敏度", 4: "灵敏度", 5: "灵敏度", 6: "阻抗", 7: "幅度"}
    params = spark.createDataFrame(list(asked.items()), "ref_id long, parameter string")
    docs = spark.createDataFrame(list(texts.items()), "ref_id long, report_text string")
    got = {}
    for r in coverage.evidence_rows(params, docs).orderBy("ref_id", "nth").collect():
        got.setdefault(r["ref_id"], []).append((r["label"], r["content"].count("\n") + 1))
    assert got == {1: [("脉冲宽度(ms)（心房）", 4), ("脉冲宽度(ms)（右室）", 6)], 2: [("灵敏度", 2)], 6: [("阻抗：500Ω", 1)]}
    values = {r["ref_id"]: r["value"] for r in coverage.evidence_value(params, docs).collect()}
    assert values == {1: "±20μs；±10%（@240Ω 0.1ms：/@500Ω/@2000Ω）", 2: "2m", 3: None, 4: None, 5: None, 6: "500Ω", 7: "幅度"}
