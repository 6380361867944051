"""Texts that normalisation leaves as they are, values prepared once a row, and how often reports are shuffled."""

import random

from pyspark.sql import functions as F

from reportloom.functions import text
from reportloom.operators import matching


def test_plain_texts_are_what_every_step_leaves(spark):
    rng = random.Random(7)
    bits = ["ml", "u l", "ul", "ms", "ns", "M Q", "ohm", "Ohm", "a", "hz", "V", "电极", "应", "单位", "欧姆", "导线", " ", " ", "  ", "\n", "1", "电阻值", "c", "p", "Q", "图", "\t", "（", "=", "2"]
    given = ["", " ", "red ring", "u l", "a\n", "电 极", "lead 电极", "MS", "plums", "x ml", "x mlx", "中文标签", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(3000)]]
    df = spark.createDataFrame([(x,) for x in given], "t string")
    odd = df.select("t", text.normalize("t").alias("a"), text.strip(text.every_step("t")).alias("b")).filter("a <> b or a is null").collect()
    assert odd == []


def test_one_shuffle_a_side_and_equal_rows_kept(spark):
    comps = spark.createDataFrame([(1, 1, "泵", "A1", "/"), (1, 2, "泵", "A1", "/"), (1, 3, "泵", "A1", "本次检测未使用"), (1, 4, "管", "B2", "/"), (1, 4, "管", "B2", "/"), (2, 1, "泵", "", "/")], "report_id long, component_id long, component_name string, model_spec string, remark string")
    labels = spark.createDataFrame([(1, 7, "№1 泵 中文标签", "A1"), (1, 8, "№2 泵 标签", "A1"), (1, 9, "№3 管 标签", "B2"), (3, 1, "泵", "A1")], "report_id long, label_id long, raw_caption string, model_spec string")
    found = {
        "c04": matching.check_c04(comps, labels), "c05": matching.check_c05(comps, labels), "c06": matching.check_c06(comps, labels), "j25": matching.label_differences(comps, labels), "j5": matching.component_labels(comps, labels),
        "a20": matching.component_verdict(comps.filter("component_id < 4"), labels, labels),
    }
    for name, df in found.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(report_id") <= (5 if name == "a20" else 2), name
    c06 = sorted((r["report_id"], r["component_id"], r["status"], r["label_id"]) for r in found["c06"].select("report_id", "component_id", "status", F.coalesce("label_id", F.lit(0)).alias("label_id")).collect())
    assert c06[:3] == [(1, 1, "pass", 7), (1, 2, "pass", 8), (1, 3, "skipped", 0)] and [r[:2] for r in c06[3:]] == [(1, 4), (1, 4), (2, 1)] and c06[5][2] == "error"
    assert found["c05"].count() == 6 and found["c04"].filter("field = '规格型号'").count() == 6
    assert {(r["component_id"], r["verdict"]) for r in found["a20"].filter("report_id = 1").collect()} == {(1, "pass"), (2, "pass"), (3, "warning")}
