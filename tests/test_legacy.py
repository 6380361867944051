"""Rows of varying width and the majority of labels, on literal fixtures."""

from reportloom.operators import legacy

HEADERS = ["序 号", "检验项目", "标准条款", "标准要求", "检验结果", "单项结论", "备注"]
ROWS = "report_id long, page_no int, table_no int, row_no int, cells array<string>, headers array<string>"


def test_ragged_rows(spark):
    given = [  # page, cells
        (3, HEADERS), (3, ["1", "外观", "2.1", "光滑", "符合要求", "符合", "/"]), (3, ["", "外观 二", "", "平整", "——", "/", ""]), (3, ["子类", "要求", "结果"]), (3, ["x"]), (3, ["2", "尺寸", "2.2", "分类", " 长 度", "5mm", "符合", "/"]),
        (4, ["续2", "", "2.3", "宽度", "6mm", "符合", None]), (4, ["3", "强度", "2.4", "要求", "/", "备注甲"]), (4, ["4", "硬度", "2.5", "要求", "9N", "符合"]), (4, ["色泽", "2.6", "要求", "结果", "符合", "备"]), (4, ["a", "b", "c", "d", "e"]),
        (5, ["续 9", "另", "", "要求", "结果", "符合", "/"]),
    ]
    df = spark.createDataFrame([(1, page, 1, k, c, HEADERS) for k, (page, c) in enumerate(given)], ROWS)
    got = [(r["item_number"], r["item_name"], r["clause_number"], r["requirement"], r["result"], r["conclusion"], r["remark"], r["original_number"], r["marked"], r["first_in_page"]) for r in legacy.map_ragged_rows(df).orderBy("position").collect()]
    assert got == [
        ("序 号", "检验项目", "标准条款", "标准要求", "检验结果", "单项结论", "备注", "序 号", False, True), ("1", "外观", "2.1", "光滑", "符合要求", "符合", "/", "1", False, False), ("1", "外观 二", "2.1", "平整", "——", "/", "", "", False, False),
        ("2", "尺寸", "2.2", "分类 长 度", "5mm", "符合", "/", "2", False, False), ("2", "尺寸", "2.3", "宽度", "6mm", "符合", "", "续2", True, True), ("3", "强度", "2.4", "要求", "", "/", "备注甲", "3", False, False), ("4", "硬度", "2.5", "要求", "9N", "符合", "", "4", False, False),
        ("4", "色泽", "2.6", "要求", "结果", "符合", "备", "", False, False), ("9", "另", "2.6", "要求", "结果", "符合", "/", "续 9", True, True),
    ]
    # columns in another order, by their headers; a table without a row that counts
    turned = spark.createDataFrame([(1, 3, 1, 0, ["外观", "7", "2.1", "要求", "结果", "符合", "/"], ["检验项目", "序号", *HEADERS[2:]]), (2, 3, 1, 0, ["", ""], HEADERS)], ROWS)
    assert [(r["report_id"], r["item_number"], r["item_name"]) for r in legacy.map_ragged_rows(turned).collect()] == [(1, "7", "外观")]
    assert legacy.map_ragged_rows(df.limit(0)).count() == 0


def test_majority(spark):
    third = spark.createDataFrame([
        (1, "起搏 器", "RF-1", "2024.01.02", "LOT7"), (2, "导管", "RF-1", "2024.01.02B", "LOT7"), (3, "甲", "见样品描述栏", "见样品描述栏", "见样品描述栏"), (4, "甲", "见样品描述栏", "见“样品描述”栏", "见样品描述栏"),
        (5, "甲", "RF-1", "", "见样品描述栏"), (6, "无", "RF-1", "", ""), (7, None, "RF-1", "", ""), (8, "乙", "RF-1", "2024/1/2X", "L9"),
    ], "report_id long, sample_name string, model_spec string, production_date string, product_id_batch string")
    labels = spark.createDataFrame([
        (1, 1, "起搏器 A", "RF-2", "", "", ""), (1, 2, "起搏器", "RF-1", "", "XLOT7Y", ""), (1, 3, "起搏", "RF-1", "", "", "LOT7"), (1, 4, "别的", "RF-9", "", "", ""), (1, 5, "别的", "RF-9", "", "", ""), (1, 6, "别的", "RF-9", "", "", ""),
        (2, 1, "导管", "RF-2", "2024/01/02", "", ""), (2, 2, "导管", "RF-1", "2024.01.02B", "LOT8", ""), (2, 3, "导管", "", "2024.01.02B", "LOT8", ""), (5, 1, "甲", "", "", "", ""), (6, 1, "有", "RF-1", "", "", ""), (7, 1, "有", "RF-1", "", "", ""),
        (8, 1, "乙", "RF-1", "unknown", "L9", ""), (8, 2, "乙", "RF-1", "2024/1/2X", "L9", ""),
    ], "report_id long, label_id long, subject_name string, model_spec string, production_date string, batch_number string, serial_number string")
    got = {(r["report_id"], r["field"]): (r["source_b"], r["n_labels"], r["status"], r["reason"]) for r in legacy.check_third_page_majority(third, labels).collect()}
    model, date, code = (f for f, _, _ in legacy.MAJORITY_FIELDS)
    ref = "见样品描述栏"
    assert got == {
        (1, model): ("RF-1", 3, "pass", None), (1, code): ("XLOT7Y", 2, "pass", None),  # the date has no letter; of equally frequent codes the first counts, a part of it is enough
        (2, model): ("RF-2", 2, "error", "mismatch"), (2, date): ("2024.01.02B", 3, "error", "date_format"), (2, code): ("LOT8", 2, "error", "mismatch"),
        **{(3, f): (ref, 0, "pass", None) for f in (model, date, code)}, **{(4, f): (ref if f != date else "见“样品描述”栏", 0, "error", "inconsistent_reference") for f in (model, date, code)},
        (5, model): ("", 0, "error", "mismatch"), (8, model): ("RF-1", 2, "pass", None), (8, date): ("unknown", 2, "error", "mismatch"), (8, code): ("L9", 2, "pass", None),
    }
