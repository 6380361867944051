"""Evidence for clauses in a report's rows: kind of a reference, rows of table references, texts of a sequence and of a clause within them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import compact, normalize, said, strip
from .parameters import SUFFIXES, topics

# What says that a clause takes a table's parameters, and what only points to one.
PARAMETER_MARKS = ("应符合表", "符合表中的数值", "符合表中的规定", "符合下表中的数值", "符合下表中的规定")
SUMMARY_MARKS = ("具体要求见表", "详细要求见表", "详见表", "见下表", "见表")


def says_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def reference_type(clauses: DataFrame, text_col: str = "text_content", report_cols: tuple[str, ...] = ()) -> DataFrame:
    """clauses with reference_type: direct_requirement without a table, table_parameter_reference if the clause or its report row takes parameters or the clause names one,
    else table_summary_reference if they only point to a table, else table_parameter_reference. Null texts are empty: direct."""
    text = compact(normalize(F.concat_ws("\n", text_col, *report_cols)))
    refers = F.rlike(said(text_col), F.lit(r"表\s*\d+"))
    named = F.exists(topics(text_col), lambda t: F.rlike(t, F.lit(SUFFIXES)))
    kind = F.when(~refers, "direct_requirement").when(says_any(text, PARAMETER_MARKS) | named, "table_parameter_reference").when(says_any(text, SUMMARY_MARKS), "table_summary_reference")
    return clauses.withColumn("reference_type", F.coalesce(kind, F.lit("table_parameter_reference")))


def match_table_items(clauses: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """The inspection row of each clause that refers to a table (nulls where none fits) and the tier: 1 equal number in the clause column, 2 equal sequence,
    3 a sequence that begins with the number, 4 one normalised text in the other. The first row wins. Tiers 1 and 2 join by number, the rest within the report."""
    key = ["ptr_id", "report_id", "number_str"]
    docs = clauses.join(pairs, "ptr_id").select(*key, F.col("text_content"))
    rows = items.select("report_id", "position", F.regexp_extract(said("standard_clause"), r"(\d+(?:\.\d+)+)", 1).alias("clause"), said("sequence_number").alias("sequence"), said("inspection_project").alias("project"))
    best = lambda df: df.groupBy(*key).agg(F.min(F.struct("tier", "position")).alias("b")).select(*key, "b.tier", "b.position")
    numbers = rows.select("report_id", "position", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("clause").alias("number_str")), F.struct(F.lit(2).alias("tier"), F.col("sequence").alias("number_str")))).alias("n"))
    done = best(docs.join(numbers.select("report_id", "position", "n.*").filter("number_str <> ''"), ["report_id", "number_str"]))
    left = docs.join(done.select(*key), key, "left_anti").withColumn("_a", normalize("text_content"))
    seen = left.join(rows.withColumn("_b", normalize("project")), "report_id")
    tier = F.when(F.startswith("sequence", "number_str"), 3).when(F.contains("_a", "_b") | F.contains("_b", "_a"), 4)
    done = done.unionByName(best(seen.withColumn("tier", tier).filter("tier is not null")))
    return docs.select(*key).join(done, key, "left")


def sequence_index(col: Column | str) -> Column:
    """The number of a sequence such as 39 or 续39; empty for anything else."""
    return F.regexp_extract(F.regexp_replace(compact(col), "续", ""), r"^(\d+)$", 1)


def is_shifted(col: Column | str) -> Column:
    """Whether the sequence column holds a requirement that slipped into it."""
    text, tight = strip(said(col)), compact(col)
    plain = (text == "") | (sequence_index(col) != "") | F.rlike(tight, F.lit(r"^\d+(?:\.\d+)+$"))
    long = (F.length(text) >= 8) & F.rlike(text, F.lit("[\n。：；]"))
    return ~plain & (long | (F.rlike(text, F.lit(r"\d+(?:\.\d+)+")) & (F.length(text) > 10)))


def block_text(items: DataFrame) -> DataFrame:
    """report_id, position and block_text of every row: the texts of it and the rows after it up to the next that has another number, each text once (white space aside), in order.

    Rows are first cut into islands that begin where the number changes, so a row's block is the rest of its island (a row without a number has the rest of the
    unnumbered rows). A text's first place from a row on is what counts, so every text of the rest is taken at the row that has it first.
    """
    order = W.partitionBy("report_id").orderBy("position")
    number = F.nullif(sequence_index("sequence_number"), F.lit(""))
    rows = items.withColumn("_n", number)
    before = F.last("_n", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_starts", F.col("_n").isNotNull() & (before.isNull() | (F.col("_n") != before)))
    rows = rows.withColumn("_island", F.sum(F.col("_starts").cast("int")).over(order))
    shifted = F.when(is_shifted("sequence_number"), F.col("sequence_number"))
    texts = F.filter(F.transform(F.array("standard_requirement", "test_result", "inspection_project", "remark", shifted), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    rows = rows.withColumn("_texts", texts)
    rest = W.partitionBy("report_id", "_island").orderBy("position").rowsBetween(0, W.unboundedFollowing)
    # a row without a number ends at the next numbered row, a numbered one at the next other number
    blank = F.sum(F.col("_n").isNotNull().cast("int")).over(W.partitionBy("report_id", "_island").orderBy("position"))
    rows = rows.withColumn("_run", blank)
    run = W.partitionBy("report_id", "_island", "_run").orderBy("position").rowsBetween(0, W.unboundedFollowing)
    whole, within = F.flatten(F.collect_list("_texts").over(rest)), F.flatten(F.collect_list("_texts").over(run))
    rows = rows.withColumn("_all", F.when(F.col("_n").isNotNull(), whole).otherwise(within))
    tight = F.transform("_all", lambda x: compact(x))
    first = F.transform(F.array_distinct(tight), lambda k: F.get(F.col("_all"), (F.array_position(tight, k) - 1).cast("int")))
    return rows.select("report_id", "position", F.array_join(first, "\n").alias("block_text"))


def clause_slice(df: DataFrame, text_col: str, number_col: str, out: str = "slice") -> DataFrame:
    """Df with the part of a text that belongs to a clause: from behind its number at a line's start to the next line that starts with a dotted number; null if the text does not have it."""
    bare = F.replace(said(number_col), F.lit("."), F.lit(r"\."))
    begin = F.regexp_instr(said(text_col), F.concat(F.lit(r"(?m)^\s*"), bare, F.lit(r"(?![\d])(?!\.\d)")))
    rest = F.regexp_replace(F.substring(said(text_col), begin, F.length(said(text_col))), r"^\s*\d+(?:\.\d+)*[.．、]?\s*", "")
    return df.withColumn(out, F.when((said(number_col) != "") & (begin > 0), strip(F.regexp_replace(rest, r"(?m)^\s*\d+(?:\.\d+)+[\s\S]*", ""))))


# What makes the first cell a model, labels of conditions, and units that stand alone.
MODEL_CELL = r"全部型号|Edora|(?i:SR|DR)(?i:-T)?$"
CONDITION = r"^@|^(?:条件|负载|工况|模式|温度|频率|压力|流量)[:：@]"
MEASURE = r"(?i)^@?[-+]?\d+(?:\.\d+)?(?:Ω|ohm|V|A|Hz|kHz|MHz|ms|μs|℃|°C|N|g|kg)(?![\p{L}\p{N}_])"
UNIT_LINE = r"(?i)^(?:单位[:：])?(?:μs|ms|s|Ω|V|A|Hz|kHz|MHz|℃|°C|N|g|kg|mL|mm|cm)$"
PARAMETER_WORDS, SETTING_WORDS = "频率|灵敏度|不应期|间期|阻抗|空白期|模式|幅度|宽度|保护", "(?i)标准设置|允许误差|AUTO|不适用|Edora|全部型号|ms|mV|bpm|Ω"


def repair_parameter_rows(rows: DataFrame) -> DataFrame:
    """Rows (table_id, row_no, values, is_header) of parameter tables with shifted rows repaired and all rows of the table's width.

    A row that starts with a model below a parameter has lost its first cell: it moves right by one and gets the last parameter. A row with a blank first cell and
    any other text gets it too. Header rows, and tables of fewer than four columns, stay as they are. The last parameter is carried by a window, so rows go one by one nowhere.
    """
    table, order = W.partitionBy("table_id"), W.partitionBy("table_id").orderBy("row_no")
    width = F.max(F.size("values")).over(table)
    padded = F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: strip(F.coalesce(F.get("values", i), F.lit(""))))
    out = rows.withColumn("_w", width).withColumn("_v", padded)
    first = F.get("_v", F.lit(0))
    out = out.withColumn("_first", F.when(~F.col("is_header") & (first != ""), first))
    seen = F.last("_first", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).isNotNull()
    model = F.rlike(compact("_first"), F.lit(MODEL_CELL))
    out = out.withColumn("_shifts", F.coalesce(model & seen, F.lit(False)))
    above = F.last(F.when(~F.col("_shifts"), F.col("_first")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rest = F.slice("_v", F.lit(2), F.col("_w"))
    lost = F.col("_first").isNull() & ~F.col("is_header") & above.isNotNull() & F.exists(rest, lambda x: x != "")
    fixed = F.when(F.col("_shifts"), F.concat(F.array(above), F.slice("_v", F.lit(1), F.col("_w") - 1))).when(lost, F.concat(F.array(above), rest)).otherwise(F.col("_v"))
    return out.withColumn("values", F.when(F.col("_w") < 4, F.col("values")).otherwise(fixed)).drop("_w", "_v", "_first", "_shifts")


def condition_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, nth, condition, result): each condition of a text and the lines below it up to the next, without units; conditions without a result, and what stands before the first, are left out."""
    lines = texts.select(id_col, F.posexplode(F.filter(F.transform(F.split(said(text_col), "\n", -1), strip), lambda x: x != "")).alias("line_no", "line"))
    label = F.rlike(compact("line"), F.lit(CONDITION)) | F.rlike("line", F.lit(MEASURE))
    order = W.partitionBy(id_col).orderBy("line_no")
    rows = lines.withColumn("_label", label).withColumn("nth", F.sum(F.col("_label").cast("int")).over(order)).filter("nth > 0")
    kept = ~F.col("_label") & ~F.contains("line", F.lit("单位")) & ~F.rlike(compact("line"), F.lit(UNIT_LINE))
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct("line_no", "line"))))
    out = rows.groupBy(id_col, "nth").agg(F.max(F.when(F.col("_label"), F.col("line"))).alias("condition"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("result"))
    return out.filter("result <> ''").withColumn("nth", F.row_number().over(W.partitionBy(id_col).orderBy("nth")))


def inline_summary_rows(df: DataFrame, text_col: str, out: str = "summary_rows", rows: int = 6) -> DataFrame:
    """Df with the first few lines of a text from the first that says 表 on (from its start without one); long lines count only if they name a table, a component or an item."""
    lines = F.filter(F.transform(F.split(said(text_col), "\n", -1), lambda x: strip(normalize(x))), lambda x: x != "")
    begin = F.greatest(F.array_position(F.transform("_l", lambda x: F.contains(x, F.lit("表"))), True), F.lit(1)).cast("int")
    short = lambda x: (F.length(compact(x)) <= 40) | F.rlike(x, F.lit("表|组件|项目"))
    kept = F.filter(F.slice("_l", begin, F.size("_l") + 1), short)
    return df.withColumn("_l", lines).withColumn(out, F.slice(kept, 1, rows)).drop("_l")


def table_summary_rows(cells: DataFrame, rows: int = 5, width: int = 4) -> DataFrame:
    """(table_id, row_no, summary) of the first few rows of each table: their first few cells with a text, normalised. cells: table_id, row_no, col_no, text; rows without text are left out but count."""
    nth = F.dense_rank().over(W.partitionBy("table_id").orderBy("row_no"))
    filled = cells.withColumn("_nth", nth).filter(F.col("_nth") <= rows).filter(strip(said("text")) != "")
    line = F.array_sort(F.collect_list(F.struct("col_no", normalize("text").alias("t"))))
    return filled.groupBy("table_id", "row_no").agg(F.array_join(F.transform(F.slice(line, 1, width), lambda x: x["t"]), " / ").alias("summary"))


def best_summary_item(refs: DataFrame, items: DataFrame) -> DataFrame:
    """The report row of each table reference (refs: ptr_id, report_id, number_str, table_number, text_content, fallback) with the highest score, the first of equals; the fallback if the report has no rows.

    Scores: 10 equal clause column, 8 its number in the texts, 4 the table's label, 3 the title in the texts, 2 the title is the project, 1 the texts begin with it.
    The title is the clause's first topic, else its first line. References meet the rows of their report only.
    """
    title = compact(F.coalesce(F.get(topics("text_content"), F.lit(0)), F.get(F.split(normalize("text_content"), "\n"), F.lit(0))))
    key = ["ptr_id", "report_id", "number_str", "table_number"]
    asked = refs.select(*key, "fallback", title.alias("_title"))
    text = F.concat_ws("\n", *[F.nullif(said(c), F.lit("")) for c in ("inspection_project", "standard_requirement", "test_result")])
    rows = items.select("report_id", "position", F.regexp_extract(said("standard_clause"), r"(\d+(?:\.\d+)+)", 1).alias("_clause"), compact(normalize(text)).alias("_text"), compact("inspection_project").alias("_project"))
    met = asked.join(rows, "report_id")
    named = F.col("_title") != ""
    points = (
        (F.col("_clause") == F.col("number_str"), 10), (F.contains("_text", "number_str"), 8), (F.contains("_text", F.concat(F.lit("表"), F.col("table_number").cast("string"))), 4),
        (named & F.contains("_text", "_title"), 3), (named & (F.col("_project") == F.col("_title")), 2), (F.startswith("_text", "_title"), 1),
    )
    score = sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))
    best = met.withColumn("score", score).groupBy(*key).agg(F.max(F.struct("score", (-F.col("position")).alias("p"))).alias("b"))
    return asked.select(*key, "fallback").join(best, key, "left").select(*key, F.coalesce(-F.col("b.p"), F.col("fallback")).alias("position"), F.col("b.score").alias("score"))


def continuation_candidates(tables: DataFrame, pages: int = 3) -> DataFrame:
    """(ptr_id, base_id, table_id): unnumbered parameter tables on the few pages after a numbered one and before the next numbered table.

    tables: ptr_id, table_id, page_no, page_end, table_number, blob (the table's text). The page of the next number comes from a window, so tables meet only over the few pages.
    """
    t = tables.withColumn("_end", F.coalesce("page_end", "page_no"))
    base = t.filter("table_number is not null")
    later = base.select("ptr_id", F.col("page_no").alias("_next")).distinct()
    reach = F.explode(F.sequence(F.col("_end") + 1, F.col("_end") + pages)).alias("page_no")
    spans = base.select("ptr_id", F.col("table_id").alias("base_id"), "_end", reach)
    stop = spans.join(later.withColumnRenamed("_next", "page_no"), ["ptr_id", "page_no"], "left_semi").groupBy("ptr_id", "base_id").agg(F.min("page_no").alias("_stop"))
    open_pages = spans.join(stop, ["ptr_id", "base_id"], "left").filter("_stop is null or page_no < _stop")
    blob = compact("blob")
    fits = t.filter("table_number is null").filter(F.rlike(blob, F.lit(PARAMETER_WORDS)) & F.rlike(said("blob"), F.lit(SETTING_WORDS)))
    return open_pages.join(fits.select("ptr_id", "table_id", "page_no"), ["ptr_id", "page_no"]).select("ptr_id", "base_id", "table_id")
