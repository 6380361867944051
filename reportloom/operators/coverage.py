"""What a report's text says of parameters: coverage of a table's rows (J20: every cell that counts is met by a number or stands in the text, its numbers in order) and pieces of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NUMBER, agree, candidates, compact, computed, normalize, replaced, said, strip, topic_label
from .clauses import special_status
from .evidence import CONDITION, MEASURE, condition_rows
from .parameters import ALIAS, parameter_value, topics, topics_meet

# Cells that say nothing, what makes a cell a model, and what makes it a numeric demand.
EMPTY_CELLS = ("", "/", "／", "-", "—", "——", "N/A", "NA")
MODEL_HEADER, ALL_MODELS, MODEL_NAME = "型号", "全部型号", r"Edora|(?i:SR|DR)"
MODEL_CODE = r"^[A-Za-z]{1,8}\d{2,}[A-Za-z0-9\-_/]*$"
DEMAND = r"<=|>=|<|>|±|~|～|至|到|[-+]\d|(?i:mL|EU|套|Ω|ohm|mm|cm|m|°|N|V|A|Hz|kg|g)"
#: Columns that hold a row's expected value, the first that has one counts.
VALUE_HEADERS = ("标准设置", "常规数值", "允许误差")


def coverage_compact(col: Column | str) -> Column:
    """A text for the test of coverage: normalised, without white space, with one sign for micro, dashes and per cent."""
    return replaced(F.translate(compact(normalize(col)), "µ﹣－–—％", "μ----%"), [(r"(?i)(?<=\d)u(?=s(?![\p{L}\p{N}_]))", "μ"), (r"(?i)u(?=g/)", "μ")])


def math_symbols(col: Column | str) -> Column:
    """A text for reading constraints: one form of comparison signs, ohms, micro and dashes, blanks single."""
    rules = [("[≤≦⩽]", "<="), ("[≥≧⩾]", ">="), (r"(?i)(?<![\p{L}\p{N}_])ohm(?![\p{L}\p{N}_])|欧姆", "Ω"), (r"(?<=[<>])\s*=\s*", "="), (r"([<>]=?)\s+(?=\d)", "$1"), (r"(?<=\d)\s+(?=Ω)", ""), (r"(?<=\d)\s*2(?=Ω)", ""), (r"(?U)\s+", " ")]
    return replaced(F.translate(strip(said(col)), "＜＞Ωµ—–−", "<>Ωμ---"), rules)


def names_model(cell: Column) -> Column:
    """Whether a cell names a model."""
    return F.contains(compact(normalize(cell)), F.lit(ALL_MODELS)) | F.rlike(cell, F.lit(MODEL_NAME)) | F.rlike(strip(cell), F.lit(MODEL_CODE))


def demands_number(cell: Column) -> Column:
    text = math_symbols(cell)
    return F.rlike(text, F.lit(r"\d")) & F.rlike(text, F.lit(DEMAND))


def in_order(numbers: Column, text: Column) -> Column:
    """Whether all numbers, as strings, stand in the text one behind the other: a fold whose state is the place behind the last one found, 0 once one is not."""

    def step(at: Column, number: Column) -> Column:
        found = F.call_function("locate", number, text, at)
        return F.when((at == 0) | (found == 0), 0).otherwise(found + F.length(number)).cast("int")

    return F.aggregate(numbers, F.lit(1), step) > 0


def cell_covered(cell: Column, text: Column) -> Column:
    """Whether a cell, both sides as coverage_compact gives them, stands in the text: whole, or all its words and, in order, all its numbers."""
    words, numbers = (F.regexp_extract_all(cell, F.lit(f"({p})"), F.lit(1)) for p in ("[一-鿿]+|[A-Za-z]{2,}", NUMBER))
    apart = ~F.exists(words, lambda w: ~F.contains(text, w)) & in_order(numbers, text) & (F.size(words) + F.size(numbers) > 0)
    return (cell == "") | F.contains(text, cell) | apart


def required_cells(cells: DataFrame) -> DataFrame:
    """cells (table_id, row_no, col_no, header, text) that a report must cover: not blank, not of a model's column and not a model's name."""
    text = strip(said("text"))
    blank = compact(text).isin(*EMPTY_CELLS)
    return cells.withColumn("text", text).filter(~blank & ~F.contains(compact(normalize("header")), F.lit(MODEL_HEADER)) & ~names_model(text))


def row_coverage(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(ref_id, table_id, row_no, n_required, covered) of every row of the table that each reference compares.

    cells has table_id, row_no, col_no, header and text; texts has ref_id, table_id and report_text. A cell is covered by a number of the text that meets it, if
    it is a numeric demand, or by cell_covered. A row without a cell that counts, or a text of nothing, covers nothing. Cells are rows of their own, judged
    apart, and met again by one aggregate a row.
    """
    required = computed(required_cells(cells), {"_cell": coverage_compact("text"), "_want": normalize("text"), "_numeric": demands_number(F.col("text"))})
    ready = computed(texts.select("ref_id", "table_id", "report_text"), {"_text": coverage_compact("report_text"), "_values": candidates(math_symbols("report_text"))})
    met = required.select("table_id", "row_no", "_cell", "_want", "_numeric").join(ready.drop("report_text"), "table_id")
    by_number = F.col("_numeric") & F.exists("_values", lambda v: agree(F.col("_want"), v))
    met = met.withColumn("_ok", (F.col("_text") != "") & (by_number | cell_covered(F.col("_cell"), F.col("_text"))))
    return met.groupBy("ref_id", "table_id", "row_no").agg(F.count("*").alias("n_required"), F.min("_ok").alias("covered"))


def cell_under(row: Column, header: str, default: int) -> Column:
    """The text of a row's first cell whose header has a word; without such a header that of the column with the given number."""
    under = F.get(F.filter(row, lambda x: F.contains(x["head"], F.lit(header))), F.lit(0))["text"]
    return F.coalesce(under, F.get(F.filter(row, lambda x: x["col_no"] == default), F.lit(0))["text"], F.lit(""))


def expected_cell(row: Column) -> Column:
    """The value that a row expects: of the first column of VALUE_HEADERS that has text, else of the first but column 0; a model's name in column 1 does not count."""
    usable = F.filter(row, lambda x: (x["text"] != "") & ~((x["col_no"] == 1) & F.rlike(x["text"], F.lit(rf"(?i){MODEL_NAME}|{ALL_MODELS}"))))
    named = [F.get(F.filter(usable, lambda x: F.contains(x["head"], F.lit(word))), F.lit(0))["text"] for word in VALUE_HEADERS]
    return F.coalesce(*named, F.get(F.filter(usable, lambda x: x["col_no"] > 0), F.lit(0))["text"], F.lit(""))


def compare_rows(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """Every row of a referenced flat table against the report's text: ref_id, table_id, row_no, parameter, model, expected, matches, path, comparison_status.

    refs has ref_id, table_id, topics (array) and report_text. Headers that are repeated as rows are left out. Only rows of the clause's topics count, if it has
    any; of these only rows whose model the text names, if there are such. path says what decided: a special status of the text, coverage, or the value behind the
    parameter's name in the text.
    """
    heads = computed(cells.select("table_id", "row_no", "col_no", "header", "text"), {"head": normalize("header"), "text": strip(said("text"))})
    rows = heads.groupBy("table_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "head", "text"))).alias("_row"))
    joined = F.array_join(F.transform("_row", lambda x: compact(normalize(x["text"]))), "")
    repeated = joined == F.array_join(F.transform("_row", lambda x: compact(x["head"])), "")
    titles = F.contains(joined, F.lit("参数")) & F.contains(joined, F.lit("型号")) & F.rlike(joined, F.lit("标准设置|允许误差"))
    rows = rows.filter(~(repeated | titles) & F.exists("_row", lambda x: x["text"] != ""))
    rows = computed(rows, {"parameter": cell_under(F.col("_row"), "参数", 0), "model": cell_under(F.col("_row"), "型号", 1), "expected": expected_cell(F.col("_row"))}).drop("_row")
    rows = computed(rows, {"_topics": F.array_union(topics("parameter"), F.array(topic_label("parameter"))), "_names": names_model(F.col("model")) & ~compact("model").isin(*EMPTY_CELLS)})
    met = rows.join(refs.select("ref_id", "table_id", "topics", "report_text"), "table_id")
    met = met.filter((F.size(F.coalesce("topics", F.array())) == 0) | topics_meet(F.col("_topics"), F.col("topics")))
    bare = compact("model")
    met = met.withColumn("_here", F.col("_names") & (F.contains(compact("report_text"), bare) | F.contains(compact("report_text"), F.regexp_replace(bare, "-T$", ""))))
    met = met.withColumn("_any", F.max(F.col("_here").cast("int")).over(W.partitionBy("ref_id", "table_id"))).filter("(_here or _any = 0) and parameter <> ''").drop("_here", "_any", "_topics", "_names", "topics")
    met = met.join(row_coverage(cells, refs).drop("n_required"), ["ref_id", "table_id", "row_no"], "left")
    met = parameter_value(met.withColumn("_status", special_status(F.col("report_text"))["status"]), "report_text", "parameter")
    covered = F.coalesce("covered", F.lit(False))
    same = agree(normalize("expected"), normalize("value"))
    path = F.when(F.col("_status").isNotNull(), "special").when(covered, "coverage").otherwise("value")
    return met.select("ref_id", "table_id", "row_no", "parameter", "model", "expected", (F.col("_status").isNotNull() | covered | same).alias("matches"), path.alias("path"), F.col("_status").alias("comparison_status"))


# Aliases that are units only, what makes a piece of evidence say more, and headings that say nothing.
UNIT_ALIASES = ("ms", "mv", "bpm", "hz", "v", "a", "ω", "kω", "ppm")
TELLING, BRACKETED, GENERAL = ("（", "(", "心房", "右室", "左室", "房室", "负载", "@", "240Ω", "500Ω", "2000Ω"), r"(?i)^[（(][A-Za-z0-9μΩ°/%\-.]+[）)]$", "应符合表"


def aliases_of(col: Column | str) -> Column:
    """Names of a parameter or line, of two characters or more: its topic, the names in brackets, and all of it without white space."""
    every = F.concat(F.array(topic_label(col)), F.regexp_extract_all(said(col), F.lit(ALIAS), F.lit(1)), F.array(compact(normalize(col))))
    return F.array_distinct(F.filter(every, lambda a: F.length(a) > 1))


def evidence_rows(params: DataFrame, texts: DataFrame) -> DataFrame:
    """The pieces of a report's text that speak of a parameter: ref_id, parameter, nth, label, content.

    params has ref_id and parameter, texts ref_id and report_text. A line that shares a name with the parameter (one holds the other) opens a piece, which ends at
    the next such line; its first line is the label, the others the content (the label, if there is none). Pieces that say more than the parameter's name come first: of these
    those whose label is not a bracketed unit or general, and of these those that name a condition or have several lines; each only if there are any. Lines are cut and named once
    a text, then met by reference.
    """
    lines = texts.select("ref_id", F.posexplode(F.filter(F.transform(F.split(said("report_text"), "\n", -1), strip), lambda x: x != "")).alias("line_no", "line"))
    lines = computed(lines, {"_names": aliases_of("line")})
    asked = computed(params.select("ref_id", "parameter").distinct(), {"_aliases": F.filter(aliases_of("parameter"), lambda a: ~F.lower(a).isin(*UNIT_ALIASES)), "_bare": compact(normalize("parameter"))}).filter(F.size("_aliases") > 0)
    met = asked.join(lines, "ref_id")
    opens = F.exists("_aliases", lambda a: F.exists("_names", lambda b: F.contains(a, b) | F.contains(b, a)))
    key = ["ref_id", "parameter"]
    met = computed(met, {"_opens": opens.cast("int")}).withColumn("nth", F.sum("_opens").over(W.partitionBy(*key).orderBy("line_no"))).filter("nth > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    found = met.groupBy(*key, "nth").agg(parts.alias("_lines"), F.first("_bare").alias("_bare"))
    label = F.get("_lines", F.lit(0))
    found = found.withColumns({"label": label, "content": F.when(F.size("_lines") == 1, label).otherwise(F.array_join(F.slice("_lines", 2, F.size("_lines")), "\n"))})
    specific = (compact(normalize("label")) != F.col("_bare")) | (compact(normalize("content")) != compact(normalize("label")))
    has = lambda c: F.exists(F.array(*[F.lit(w) for w in TELLING]), lambda w: F.contains(F.col(c), w))
    found = computed(found.drop("_lines"), {"_specific": specific, "_plain": ~F.rlike(strip(F.col("label")), F.lit(BRACKETED)) & ~F.contains("label", F.lit(GENERAL)), "_telling": has("label") | F.contains("content", F.lit("\n")) | has("content")}).filter("_specific")
    whole = W.partitionBy(*key)
    found = found.withColumn("_any", F.max("_plain").over(whole)).filter("_plain or not _any")
    found = found.withColumn("_any", F.max("_telling").over(whole)).filter("_telling or not _any")
    return found.select(*key, F.row_number().over(whole.orderBy("nth")).alias("nth"), "label", "content")


def evidence_value(params: DataFrame, texts: DataFrame) -> DataFrame:
    """Each parameter with its pieces' value: what their conditions result in (each once, in order, with the conditions), else the last number of the first piece that has one and is no condition, else the value behind the parameter's name."""
    pieces = evidence_rows(params, texts)
    keyed = pieces.withColumn("_key", F.struct("ref_id", "parameter", F.col("nth").alias("piece")))
    cases = condition_rows(keyed, "_key", "content").select("_key.ref_id", "_key.parameter", F.struct("_key.piece", "nth").alias("at"), "condition", "result")
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]))
    by_case = cases.groupBy("ref_id", "parameter").agg(ordered("result").alias("_r"), ordered("condition").alias("_c"))
    by_case = by_case.select("ref_id", "parameter", F.concat(F.array_join("_r", "；"), F.lit("（"), F.array_join("_c", "/"), F.lit("）")).alias("_by_case"))
    numbers = F.filter(candidates(math_symbols("content")), lambda v: ~F.rlike(compact(v), F.lit(CONDITION)) & ~F.rlike(v, F.lit(MEASURE)))
    number = pieces.select("ref_id", "parameter", "nth", F.get(numbers, F.size(numbers) - 1).alias("v")).filter("v is not null")
    by_number = number.groupBy("ref_id", "parameter").agg(F.min_by("v", "nth").alias("_by_number"))
    out = params.select("ref_id", "parameter").distinct().join(by_case, ["ref_id", "parameter"], "left").join(by_number, ["ref_id", "parameter"], "left").join(texts.select("ref_id", "report_text"), "ref_id", "left")
    out = parameter_value(out, "report_text", "parameter")
    return out.select("ref_id", "parameter", F.coalesce("_by_case", "_by_number", "value").alias("value"))
