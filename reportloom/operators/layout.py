"""Jobs over page layout: regions, numbers above tables, headers, values beside names, values over several lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import compact, said

PAGE = ("report_id", "page_no")
# Words that anchor a label, and known page headers from the longest on.
ANCHORS = "产品名称|器械名称|品名|规格型号|型号规格|型号|批号|LOT|序列号|生产日期|失效日期|MFG|MFD|注册人"
HEADERS = ("检验报告照片页", "检验报告首页", "检验报告附页", "检验报告")


def label_region(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """region_text of each page: the box of the anchor blocks, grown by 24 (220 below), and the blocks within 12 of it in reading order; without anchors up to 14 lines from the first line that has one."""
    anchored = F.rlike(said("text"), F.lit(ANCHORS))
    box = blocks.filter(anchored).groupBy(*PAGE).agg(
        (F.greatest(F.lit(0.0), F.min("x0") - 24) - 12).alias("bx0"), (F.greatest(F.lit(0.0), F.min("y0") - 24) - 12).alias("by0"), (F.max("x1") + 36).alias("bx1"), (F.max("y1") + 232).alias("by1")
    )
    inside = blocks.join(box, [*PAGE]).filter("x0 >= bx0 and x1 <= bx1 and y0 >= by0 and y1 <= by1 and trim(text) <> ''")
    region = inside.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", F.trim("text").alias("t")))), lambda b: b["t"]), "\n").alias("region"))
    lines = F.filter(F.transform(F.split(said("raw_text"), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    start = F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit(ANCHORS))), True)
    fallback = F.when(start > 0, F.array_join(F.slice(lines, F.greatest(start.cast("int"), F.lit(1)), 14), "\n")).otherwise(said("raw_text"))
    return pages.join(region, [*PAGE], "left").select(*PAGE, F.coalesce("region", fallback).alias("region_text"))


def table_numbers(tables: DataFrame, blocks: DataFrame, band: float = 50.0) -> DataFrame:
    """The number of each table (report_id, page_no, table_id, x0, y0, x1) from the text in the band above it: 表N, Table N, 附表N."""
    above = blocks.select(*PAGE, F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1"), "text")
    near = tables.join(above, [*PAGE]).filter(f"by1 > y0 - {band} and by0 < y0 and bx1 > x0 and bx0 < x1")
    joined = near.groupBy(*PAGE, "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("by0", "bx0", "text"))), lambda b: b["text"]), "\n").alias("_t"))
    number = F.coalesce(*[F.nullif(F.regexp_extract("_t", p, 1), F.lit("")) for p in (r"表\s*(\d+)", r"(?i)Table\s*(\d+)", r"附表\s*(\d+)")])
    return tables.join(joined, [*PAGE, "table_id"], "left").withColumn("table_number", number.cast("int")).drop("_t")


def page_headers(pages: DataFrame, blocks: DataFrame, share: float = 0.15) -> DataFrame:
    """header class of each page: the longest known header in the text of its top."""
    top = pages.join(blocks.select(*PAGE, "x0", "y0", "text"), [*PAGE]).filter(F.col("y0") < F.lit(share) * F.col("height"))
    text = top.groupBy(*PAGE).agg(compact(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda b: b["text"]), "")).alias("_t"))
    known = F.coalesce(*[F.when(F.contains("_t", F.lit(h)), F.lit(h)) for h in HEADERS])
    return pages.join(text, [*PAGE], "left").withColumn("header_class", known).drop("_t")


def blocks_with_keys(blocks: DataFrame, keys: DataFrame, few: int = 1000) -> DataFrame:
    """blocks with each key that their text contains. At most `few` keys are broadcast; more meet the texts by their first two characters."""
    holds = F.contains("text", "key")
    if keys.limit(few + 1).count() <= few:
        return blocks.join(F.broadcast(keys), holds)
    text = F.col("text")
    places = F.sequence(F.lit(1), F.length(text))
    one, two = (F.transform(places, f) for f in (lambda i: F.substring(text, i, F.lit(1)), lambda i: F.substring(text, i, F.lit(2))))
    pieces = F.when(F.length(text) > 0, F.concat(one, two)).otherwise(F.array().cast("array<string>"))
    cut = blocks.filter("text is not null").withColumn("_head", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), pieces))))
    return cut.join(keys.withColumn("_head", F.substring("key", 1, 2)), "_head").filter(holds).drop("_head")


def nearest_value(blocks: DataFrame, keys: DataFrame, right: float = 50.0, down: float = 100.0) -> DataFrame:
    """For each key block (its text has the key): the nearest block more than `right` to the right and less than `down` apart in height, else the next block. keys: key."""
    named = blocks_with_keys(blocks, keys.select("key").distinct())
    b = blocks.select(*PAGE, F.col("block_no").alias("v_no"), F.col("x0").alias("vx"), F.col("y0").alias("vy"), F.col("text").alias("value"))
    pairs = named.join(b, [*PAGE]).filter("v_no <> block_no")
    beside = (F.col("vx") - F.col("x0") > right) & (F.abs(F.col("vy") - F.col("y0")) < down)
    pairs = pairs.withColumn("_rank", F.when(beside, F.struct(F.lit(0).alias("a"), (F.abs(F.col("vy") - F.col("y0")) + F.col("vx") - F.col("x0")).alias("d"), F.col("v_no").alias("n"))).when(F.col("v_no") == F.col("block_no") + 1, F.struct(F.lit(1).alias("a"), F.lit(0.0).alias("d"), F.col("v_no").alias("n"))))
    return pairs.filter("_rank is not null").groupBy(*PAGE, "key", "block_no").agg(F.min_by("value", "_rank").alias("value"))


def multiline_value(pages: DataFrame, label: str, stops: str) -> DataFrame:
    """On each page the text from the first line that starts with the label to the first later line that starts with a stop label, joined."""
    lines = pages.select(*PAGE, F.posexplode(F.split(said("raw_text"), "\n", -1)).alias("line_no", "line"))
    order = W.partitionBy(*PAGE).orderBy("line_no")
    begins = F.rlike(F.trim("line"), F.lit("^" + label))
    rows = lines.withColumn("began", F.sum(begins.cast("int")).over(order)).filter("began >= 1")
    stopped = F.sum(F.rlike(F.trim("line"), F.lit(f"^({stops})")).cast("int")).over(order)
    rows = rows.withColumn("stopped", stopped).filter("stopped = 0").withColumn("part", F.trim(F.regexp_replace(F.trim("line"), rf"^{label}\s*[:：]?\s*", "")))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "").alias("value"))


def merge_sample_tables(tables: DataFrame) -> DataFrame:
    """The table (merged_id) that each sample table belongs to. tables: report_id, table_no, n_cols, first_no, last_no, repeats_header; one goes on if it has as many columns and starts after the last number or repeats the header."""
    order = W.partitionBy("report_id").orderBy("table_no")
    goes_on = (F.col("n_cols") == F.lag("n_cols").over(order)) & ((F.col("first_no") == F.lag("last_no").over(order) + 1) | F.col("repeats_header"))
    rows = tables.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    return rows.withColumn("merged_id", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def structure(a: Column, b: Column) -> Column:
    """Shared over all."""
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# What lets a table without a number go on from the one before, in order: the least likeness of headers, the least overlap of headers or paths, the least
# overlap of paths, whether one must end low on its page and the other start high, and whether both must be parameter tables.
GOES_ON = (
    ("alike", {"alike": 0.88}), ("alike_overlapping", {"alike": 0.78, "overlap": 0.55}), ("placed_overlapping", {"alike": 0.4, "overlap": 0.55, "placed": True}),
    ("placed_parameters", {"alike": 0.35, "overlap": 0.45, "placed": True, "parameters": True}), ("placed_paths", {"alike": 0.35, "paths": 0.7, "placed": True}),
)
HIGH, LOW = 0.25, 0.7  # shares of a page's height


FRAGMENT = ("page_no", "y0", "y1", "height", "table_number", "n_cols", "headers", "paths", "is_parameter")
JOINS = ("same_number", *[name for name, _ in GOES_ON])


def continuation_reason(before: Column, here: Column) -> Column:
    """Why a fragment (struct of FRAGMENT) goes on from the table before it, or why not; before is null for the first."""
    b, h = (lambda c, side=side: side[c] for side in (before, here))
    evidence = {
        "alike": structure(h("headers"), b("headers")), "paths": overlap(h("paths"), b("paths")), "placed": (h("y0") < HIGH * h("height")) & (b("y1") > LOW * b("height")),
        "overlap": F.greatest(overlap(h("headers"), b("headers")), overlap(h("paths"), b("paths"))), "parameters": h("is_parameter") & b("is_parameter"),
    }
    holds = lambda asked: reduce(lambda x, y: x & y, [evidence[k] if least is True else evidence[k] >= least for k, least in asked.items()])
    joined = F.coalesce(*[F.when(holds(asked), F.lit(name)) for name, asked in GOES_ON])
    gap, number, had = h("page_no") - b("page_no"), h("table_number"), b("table_number")
    parted = {
        "first": before.isNull(), "pages_apart": ~gap.between(0, 1), "no_columns": F.least(h("n_cols"), b("n_cols")) == 0, "columns_differ": F.abs(h("n_cols") - b("n_cols")) > 1,
        "numbers_differ": number != had,
    }
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in parted.items()], F.when(number == had, "same_number"), F.when(number.isNotNull(), "own_number"), joined, F.when(had.isNull(), "no_number").otherwise("no_evidence"))


def assess_continuation(tables: DataFrame) -> DataFrame:
    """Whether each table goes on from the one before it in its document (continues), and the reason.

    tables: ptr_id, table_id, page_no, y0, y1, height, table_number, n_cols, headers, paths, is_parameter. A table goes on at most to the next page and by one column more or less;
    equal numbers join, different ones or a number of its own part, and without numbers the first rule of GOES_ON that holds joins.
    """
    order = W.partitionBy("ptr_id").orderBy("page_no", "y0")
    rows = tables.withColumn("p", F.lag(F.struct(*FRAGMENT)).over(order)).withColumn("h", F.struct(*FRAGMENT))
    return rows.withColumn("reason", continuation_reason(F.col("p"), F.col("h"))).withColumn("continues", F.col("reason").isin(*JOINS)).drop("p", "h")


def fold_continuations(tables: DataFrame) -> DataFrame:
    """Tables, as for assess_continuation, with reason and continues, each held against the table *merged so far*, not against its neighbour.

    A fragment that joins lends the merged table its number, headers and paths if that has none, its columns if it has more, and its last page; the place on
    the page stays the first fragment's, but for fragments of one page. So a number that an earlier fragment had still counts behind one without. The fold runs over the slim list of a document's fragments, inside one
    row of a document; cells are not touched.
    """
    fields = [f for f in tables.schema if f.name in ("table_id", *FRAGMENT)]
    kind = lambda name: next(f.dataType.simpleString() for f in fields if f.name == name)
    merged_type = "struct<first_page:int," + ",".join(f"{n}:{kind(n)}" for n in FRAGMENT) + ">"
    start = F.struct(F.lit(None).cast(merged_type).alias("table"), F.array().cast(f"array<struct<table_id:{kind('table_id')},reason:string>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        def decided(reason: Column) -> Column:
            b, joins = acc["table"], reason.isin(*JOINS)
            same_page = x["page_no"] == b["first_page"]
            filled = {
                "page_no": F.greatest(b["page_no"], x["page_no"]), "y0": F.when(same_page, F.least(b["y0"], x["y0"])).otherwise(F.coalesce(b["y0"], x["y0"])), "y1": F.when(same_page, F.greatest(b["y1"], x["y1"])).otherwise(F.coalesce(b["y1"], x["y1"])),
                "height": b["height"], "table_number": F.coalesce(b["table_number"], x["table_number"]), "n_cols": F.greatest(b["n_cols"], x["n_cols"]), "headers": F.when(F.size(b["headers"]) > 0, b["headers"]).otherwise(x["headers"]),
                "paths": F.when(F.size(b["paths"]) > 0, b["paths"]).otherwise(x["paths"]), "is_parameter": F.when(F.size(b["headers"]) > 0, b["is_parameter"]).otherwise(x["is_parameter"]),
            }
            table = F.struct(F.when(joins, b["first_page"]).otherwise(x["page_no"]).cast("int").alias("first_page"), *[F.when(joins, filled[n]).otherwise(x[n]).cast(kind(n)).alias(n) for n in FRAGMENT])
            return F.struct(table.alias("table"), F.concat(acc["done"], F.array(F.struct(x["table_id"].alias("table_id"), reason.alias("reason")))).alias("done"))

        return F.get(F.transform(F.array(continuation_reason(acc["table"], x)), decided), F.lit(0))

    place = F.struct("page_no", "y0", "table_id", F.struct("table_id", *FRAGMENT).alias("fragment"))
    listed = tables.groupBy("ptr_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["fragment"]).alias("fragments"))
    found = listed.select("ptr_id", F.explode(F.aggregate("fragments", start, step)["done"]).alias("_done")).select("ptr_id", "_done.*")
    return tables.join(found, ["ptr_id", "table_id"]).withColumn("continues", F.col("reason").isin(*JOINS))


def merge_cells(assessed: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells of merged tables: ptr_id, table_id (the first fragment's), row_no (counted through), col_no, text, page_no and from_row.

    assessed is what fold_continuations or assess_continuation gives; cells has ptr_id, table_id, row_no, col_no and text. A later fragment's first row goes if
    it repeats the merged table's headers, white space aside.
    """
    order = W.partitionBy("ptr_id").orderBy("page_no", "y0", "table_id")
    parts = assessed.withColumn("island", F.sum((~F.col("continues")).cast("int")).over(order))
    within = W.partitionBy("ptr_id", "island").orderBy("page_no", "y0", "table_id")
    whole = within.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    headers = F.first(F.when(F.size("headers") > 0, F.array_join(F.transform("headers", compact), "|")), ignorenulls=True).over(whole)
    parts = parts.select("ptr_id", "table_id", "page_no", "island", F.first("table_id").over(whole).alias("_base"), headers.alias("_headers"), F.row_number().over(within).alias("_part"))
    rows = cells.groupBy("ptr_id", "table_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("_row"))
    rows = rows.join(parts, ["ptr_id", "table_id"])
    first = F.row_number().over(W.partitionBy("ptr_id", "table_id").orderBy("row_no")) == 1
    said_row = F.array_join(F.transform("_row", lambda x: compact(F.coalesce(x["text"], F.lit("")))), "|")
    rows = rows.withColumn("_again", first & (F.col("_part") > 1) & F.coalesce(said_row == F.col("_headers"), F.lit(False))).filter("not _again")
    rows = rows.withColumn("_row_no", (F.row_number().over(W.partitionBy("ptr_id", "island").orderBy("_part", "row_no")) - 1).cast("int"))
    return rows.select("ptr_id", F.col("_base").alias("table_id"), F.col("_row_no").alias("row_no"), F.explode("_row").alias("_cell"), "page_no", F.col("row_no").alias("from_row")).select("ptr_id", "table_id", "row_no", "_cell.col_no", "_cell.text", "page_no", "from_row")


def merge_continuations(assessed: DataFrame) -> DataFrame:
    """Merged tables of fold_continuations (or assess_continuation): the first fragment's id, the pages, and the first number and headers that a fragment has."""
    order = W.partitionBy("ptr_id").orderBy("page_no", "y0", "table_id").rowsBetween(W.unboundedPreceding, 0)
    rows = assessed.withColumn("island", F.sum((~F.col("continues")).cast("int")).over(order))
    place = F.struct("page_no", "y0", "table_id")
    return rows.groupBy("ptr_id", "island").agg(
        F.min_by("table_id", place).alias("table_id"), F.array_sort(F.collect_set("page_no")).alias("pages"), F.count("*").alias("n_fragments"),
        F.min_by("table_number", F.when(F.col("table_number").isNotNull(), place)).alias("table_number"), F.min_by("headers", F.when(F.size("headers") > 0, place)).alias("headers"),
    ).drop("island")
