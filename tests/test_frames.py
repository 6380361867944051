"""Tables by rows (framed) against the operators over cells, and how often their cells are shuffled."""

import pytest

from reportloom.operators import tables
from reportloom.plans import documents

CELLS = "table_id long, row_no int, col_no int, text string"
TABLES = {
    1: [["参数", "型号", "标准设置", "标准设置"], ["", "", "上限", "下限"], ["脉宽", "M1", "1", ""], ["", "M2", "2", "3"], ["参数", "型号", "标准设置/上限", "标准设置/下限"], ["幅度", "", "", ""], ["", "", "4", "5"]],
    2: [["1", "2"], ["3", "4"]],
    3: [["参数", None, "备注"], [" 频率 ", "a", None]],
    4: [["参数", "型号", "允许误差"], ["参数", "型号", "允许误差"], ["参数", "型号", "允许误差"], ["参数", "型号", "允许误差"], ["x", "", "±5%"], ["", "y", "±6%"]],
    5: [["说明文字很长很长很长很长很长", "x"], ["参数", ""], ["", "值"], ["脉宽", "1"]],
    6: [["参数"]],
}


def cells_of(spark):
    rows = [(t, r, c, x) for t, lines in TABLES.items() for r, line in enumerate(lines) for c, x in enumerate(line) if x is not None]
    return spark.createDataFrame([*rows, (7, 2, 1, "b"), (7, 2, 1, "a"), (8, 0, 0, None), (8, 2, 0, "z")], CELLS).repartition(3)


def same(left, right):
    names = sorted(left.columns)
    return sorted(map(repr, left.select(*names).collect())) == sorted(map(repr, right.select(*names).collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_dense_cells(spark):
    cells = cells_of(spark)
    got = {(r["table_id"], r["row_no"], r["col_no"]): r["text"] for r in tables.densify(cells).collect()}
    want = {(t, r, c): (x or "").strip() for t, lines in TABLES.items() for r, line in enumerate(lines) for c, x in enumerate(line)}
    want |= {(7, r, c): "" for r in range(3) for c in range(2)} | {(7, 2, 1): "a", (8, 0, 0): "", (8, 1, 0): "", (8, 2, 0): "z"}
    assert got == want
    assert exchanges(tables.densify(cells)) == 1


def test_frames_are_as_cells_have_it(spark):
    cells = tables.densify(cells_of(spark))
    headers = tables.header_rows(cells)
    columns = tables.column_paths(cells, headers)
    filled = tables.fill_down(tables.drop_repeated_headers(tables.body_cells(cells, headers), columns), columns)
    rows = tables.framed(cells_of(spark))
    met = tables.framed_cells(rows)
    assert same(rows.filter("is_header").select("table_id", "row_no"), headers)
    assert same(tables.framed_columns(rows), columns)
    assert same(met.filter("in_body").select(*filled.columns), filled)
    assert same(tables.records_of(met.filter("in_body")), tables.parameter_records(filled, columns))
    assert same(tables.framed_confidence(met), tables.structure_confidence(cells, headers, columns, filled))
    for df in (rows, met, tables.records_of(met), tables.framed_confidence(met)):
        assert exchanges(df) == 1  # one by table, and none after it


@pytest.mark.parametrize("name", ["t5_column_roles", "t7_fill_down", "t9_parameter_records", "t10_structure_confidence"])
def test_queries_shuffle_line_items_only(spark, name):
    assert exchanges(documents.QUERIES[name](spark, "/root/testdata/sf0.001")) == 2
