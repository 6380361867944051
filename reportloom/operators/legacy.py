"""Rows of varying width (T13) and the home page's fields against the labels' majority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import compact, computed, has_alnum, said, strip

# The columns of an inspection table, what their headers say, and where they are if no header says it.
COLUMNS = {"item_number": "序号", "item_name": "检验项目", "clause_number": "标准条款", "requirement": "标准要求", "result": "检验结果", "conclusion": "单项结论", "remark": "备注"}
CONCLUSIONS = ("符合", "不符合", "/", "")
#: A row of so many cells or fewer is the lower part of a merged row; one of WITH_CONCLUSION cells has a conclusion, one of ONE_LESS lacks a column.
LOWER_PART, WITH_CONCLUSION, ONE_LESS = 4, 5, 6


def cell(at: Column | int) -> Column:
    """A cell of the row, trimmed; empty where the row has none."""
    return strip(F.coalesce(F.get("cells", at if isinstance(at, Column) else F.lit(at)), F.lit("")))


def together(first: Column | int, n: Column) -> Column:
    """The texts of n cells from a place on, with a blank between them."""
    taken = F.slice("cells", (first if isinstance(first, Column) else F.lit(first)) + 1, F.greatest(n, F.lit(0)))
    return F.array_join(F.filter(F.transform(taken, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""), " ")


def mapped_cells() -> Column:
    """A row's cells by the names of COLUMNS, by the row's width against its table's."""
    width, full = F.size("cells"), F.size("headers")
    tight = F.transform("headers", compact)
    under = lambda word: F.array_max(F.transform(tight, lambda h, i: F.when(F.contains(h, F.lit(word)), i)))
    place = {n: F.coalesce(under(word), F.lit(k)) for k, (n, word) in enumerate(COLUMNS.items())}
    row = lambda **known: F.struct(*[known.get(n, F.lit("")).alias(n) for n in COLUMNS])
    standard = row(**{n: cell(place[n]) for n in COLUMNS})
    extra = width - full
    wider = row(item_number=cell(0), item_name=cell(1), clause_number=cell(2), requirement=together(place["requirement"], extra + 1), **{n: cell(place[n] + extra) for n in ("result", "conclusion", "remark")})
    lower = row(requirement=together(0, width - 1), result=cell(width - 1))
    five = row(requirement=together(0, width - 2), result=cell(width - 2), conclusion=cell(width - 1))
    numbered = F.rlike(cell(0), F.lit(r"^\d+$|续"))
    head = {"item_number": cell(0), "item_name": cell(1), "clause_number": cell(2), "requirement": cell(3)}
    no_result = row(**head, conclusion=cell(4), remark=cell(5))
    no_remark = row(**head, result=cell(4), conclusion=cell(5))
    unnumbered = row(item_name=cell(0), clause_number=cell(1), requirement=cell(2), result=cell(3), conclusion=cell(4), remark=cell(5))
    six = F.when(numbered & cell(4).isin(*CONCLUSIONS), no_result).when(numbered, no_remark).otherwise(unnumbered)
    return F.when(width == full, standard).when(width > full, wider).when(width <= LOWER_PART, lower).when(width == WITH_CONCLUSION, five).when(width == ONE_LESS, six).otherwise(row())


def map_ragged_rows(rows: DataFrame) -> DataFrame:
    """Rows of inspection tables, of any width, as report_id, position, page_no, COLUMNS, original_number, marked (with 续) and first_in_page.

    rows has report_id, page_no, table_no, row_no, cells and headers (arrays). Rows of fewer than two cells, and those without a number (or with the header's) and
    without a name, are left out. A row without a number goes on with the last one's; one without a name has that of the first row of its number, if it
    goes on with it or has none of its own; one without a clause has the last clause.
    """
    out = computed(rows.filter(F.size("cells") > 1), {"_mapped": mapped_cells()}).select("report_id", "page_no", "table_no", "row_no", "_mapped.*")
    out = out.filter(~(F.col("item_number").isin("", COLUMNS["item_number"]) & (F.col("item_name") == "")))
    going_on = F.regexp_extract("item_number", r"续\s*(\d+)", 1)
    out = out.withColumns({"original_number": F.col("item_number"), "marked": going_on != "", "item_number": F.when(going_on != "", going_on).otherwise(F.col("item_number"))})
    order = W.partitionBy("report_id").orderBy("page_no", "table_no", "row_no")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.coalesce(F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(upto), F.lit(""))
    out = out.withColumns({"item_number": last("item_number"), "clause_number": last("clause_number")})
    out = out.withColumn("_run", F.sum((F.col("item_number") != F.coalesce(F.lag("item_number").over(order), F.lit(""))).cast("int")).over(upto))
    run = W.partitionBy("report_id", "_run").orderBy("page_no", "table_no", "row_no")
    named = F.when(F.col("_run") > 0, F.first("item_name").over(run)).otherwise("")
    out = out.withColumn("item_name", F.when(F.col("item_name") == "", named).otherwise(F.col("item_name")))
    first = F.row_number().over(W.partitionBy("report_id", "page_no", "table_no").orderBy("row_no")) == 1
    return out.withColumns({"position": F.row_number().over(order), "first_in_page": first}).select("report_id", "position", "page_no", *COLUMNS, "original_number", "marked", "first_in_page")


# The home page's extended fields, their columns here and on a label (the first that has text), and forms of dates, in order.
MAJORITY_FIELDS = (("型号规格", "model_spec", ("model_spec",)), ("生产日期", "production_date", ("production_date",)), ("产品编号/批号", "product_id_batch", ("batch_number", "serial_number")))
DATE_FIELD, CODE_FIELD = "生产日期", "产品编号/批号"
DATE_FORMS = tuple((rf"^\d{{4}}{a}\d{{1,2}}{b}", name) for a, b, name in (
    (r"\.", r"\.\d{1,2}", "YYYY.MM.DD"), ("/", r"/\d{1,2}", "YYYY/MM/DD"), ("-", r"-\d{1,2}", "YYYY-MM-DD"), ("年", r"月\d{1,2}日", "YYYY年MM月DD日"),
    (r"\.", "", "YYYY.MM"), ("/", "", "YYYY/MM"), ("-", "", "YYYY-MM"), ("年", "月", "YYYY年MM月"),
))


def date_form(col: Column) -> Column:
    text = strip(col)
    return F.coalesce(*[F.when(F.rlike(text, F.lit(p)), F.lit(name)) for p, name in DATE_FORMS])


def refers_to_samples(col: Column) -> Column:
    """Whether a value only points to the description of samples."""
    return reduce(lambda a, b: a & b, [F.contains(col, F.lit(w)) for w in ("见", "样品描述", "栏")])


def check_third_page_majority(third: DataFrame, labels: DataFrame) -> DataFrame:
    """The home page's extended fields against what most matching labels say: report_id, field, source_a, source_b, n_labels, status, reason.

    A label matches whose name holds the sample's, or the other way round, white space aside. Of equally frequent values the one that comes first (by label_id) counts. If all
    three fields point to the description of samples they must be equal; else fields that point to it, or do not have both a letter and a digit, are not compared, and
    nothing is without a matching label. A date's form is compared with that of the first label whose form is known, before its value; a number may be a part of the label's.
    """
    value = lambda c: strip(said(c)) if c in third.columns else F.lit("")
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("field"), value(mine).alias("source_a")) for k, (name, mine, _) in enumerate(MAJORITY_FIELDS)])
    rows = third.select("report_id", compact("sample_name").alias("_sample"), cells.alias("_cells"))
    rows = rows.withColumn("_all", ~F.exists("_cells", lambda c: ~refers_to_samples(c["source_a"])))
    same = F.size(F.array_distinct(F.transform("_cells", lambda c: c["source_a"]))) == 1
    pointed = rows.filter("_all").select("report_id", same.alias("_same"), F.explode("_cells").alias("_cell"))
    pointed = pointed.select("report_id", "_cell.field", "_cell.source_a", F.col("_cell.source_a").alias("source_b"), F.lit(0).cast("long").alias("n_labels"), F.when(F.col("_same"), "pass").otherwise("error").alias("status"), F.when(~F.col("_same"), "inconsistent_reference").alias("reason"))

    said_by = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(*[F.nullif(said(c), F.lit("")) for c in theirs if c in labels.columns], F.lit("")).alias("value")) for k, (_, _, theirs) in enumerate(MAJORITY_FIELDS)])
    named = labels.select("report_id", "label_id", compact("subject_name").alias("_subject"), said_by.alias("_said")).filter("_subject <> ''")
    met = rows.filter("not _all and _sample <> ''").join(named, "report_id").filter(F.contains("_sample", F.col("_subject")) | F.contains("_subject", F.col("_sample")))
    matching = met.select("report_id", "label_id", F.explode("_said").alias("_vote")).select("report_id", "label_id", "_vote.*")
    votes = matching.filter("value <> ''").groupBy("report_id", "k", "value").agg(F.count("*").alias("n"), F.min("label_id").alias("first"), F.min_by(date_form(F.col("value")), "label_id").alias("form"))
    best = votes.groupBy("report_id", "k").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("source_b"), F.sum("n").alias("n_labels"), F.min_by("form", F.when(F.col("form").isNotNull(), F.col("first"))).alias("_form"))
    asked = met.select("report_id", "_cells").groupBy("report_id").agg(F.first("_cells").alias("_cells")).select("report_id", F.explode("_cells").alias("_cell")).select("report_id", "_cell.*")
    asked = asked.filter(~refers_to_samples(F.col("source_a")) & has_alnum("source_a"))
    out = asked.join(best, ["report_id", "k"], "left").withColumns({"source_b": F.coalesce("source_b", F.lit("")), "n_labels": F.coalesce("n_labels", F.lit(0).cast("long"))})
    a, b = compact("source_a"), compact("source_b")
    fits = (a == b) | ((F.col("field") == CODE_FIELD) & (F.contains(a, b) | F.contains(b, a)))
    form = (F.col("field") == DATE_FIELD) & (F.col("source_b") != "") & F.coalesce(date_form(F.col("source_a")) != F.col("_form"), F.lit(False))
    reason = F.when(form, "date_format").when(~fits, "mismatch")
    return out.select("report_id", "field", "source_a", "source_b", "n_labels", F.when(reason.isNull(), "pass").otherwise("error").alias("status"), reason.alias("reason")).unionByName(pointed)
