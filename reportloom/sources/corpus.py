"""Reading extracted corpora and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of an extracted corpus; text columns may be missing or null, which counts as empty.
SCHEMAS = {
    "pages": "report_id long, page_no int, width double, height double, raw_text string, page_header string",
    "text_blocks": "report_id long, page_no int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double",
    "cells": "table_id long, row_no int, col_no int, row_span int, col_span int, text string",
    "inspection_items": "report_id long, position int, source_page int, row_index_in_page int, sequence_number string, inspection_project string, standard_clause string, standard_requirement string, test_result string, item_conclusion string, remark string",
    "components": "report_id long, component_id long, component_name string, model_spec string, serial_lot string, production_date string, expiration_date string, remark string",
    "labels": "report_id long, label_id long, raw_caption string, product_name string, model_spec string, batch_number string, serial_number string, production_date string, expiration_date string, registrant string, registrant_address string, confidence double",
}


def load_corpus(spark: SparkSession, folder: str, form: str = "parquet", tables: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """SRC1: the corpus's tables with their fixed schemas; Parquet prunes the columns that a check doesn't read."""
    return {t: spark.read.schema(SCHEMAS[t]).format(form).load(f"{folder}/{t}.{form}") for t in tables}


def admit(documents: DataFrame, pages: DataFrame, max_bytes: int = 50 * 1024 * 1024, max_pages: int = 200) -> DataFrame:
    """SRC2: documents (report_id, n_bytes) with n_pages and reject_reason, null for those within the limits."""
    counts = pages.groupBy("report_id").agg(F.count("*").alias("n_pages"))
    out = documents.join(counts, "report_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    return out.withColumn("reject_reason", F.when(F.col("n_bytes") > max_bytes, "too_large").when(F.col("n_pages") > max_pages, "too_many_pages").when(F.col("n_pages") == 0, "no_pages"))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: nested result documents, doubles of the top level rounded to six places so that runs compare."""
    df = spark.read.option("multiLine", True).json(path)
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema if f.dataType.simpleString() == "double"}) if df.columns else df


def scanned_pages(pages: DataFrame, blocks: DataFrame, least_text: int = 50, least_font: float = 3.0) -> DataFrame:
    """each page with scanned (little text, or tiny mean font) and document_scanned (more than half of the document's pages are)."""
    fonts = blocks.groupBy("report_id", "page_no").agg(F.avg("font_size").alias("_font"))
    out = pages.join(fonts, ["report_id", "page_no"], "left")
    scanned = (F.length(F.trim(F.coalesce("raw_text", F.lit("")))) < least_text) | F.coalesce(F.col("_font") < least_font, F.lit(False))
    out = out.withColumn("scanned", scanned).drop("_font")
    share = out.groupBy("report_id").agg((F.count_if("scanned") * 2 > F.count("*")).alias("document_scanned"))
    return out.join(share, "report_id")


def find_anchor_page(pages: DataFrame, needle: str = "检验报告首页") -> DataFrame:
    """the first page of each report whose text, white space aside, has the needle."""
    has = F.contains(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"(?U)\s+", ""), F.lit(needle))
    return pages.filter(has).groupBy("report_id").agg(F.min("page_no").alias("page_no"))


def photo_pages(pages: DataFrame, legacy: bool = False) -> DataFrame:
    """photo pages, by words of the text, or by the page header."""
    if legacy:
        return pages.filter(F.contains(F.coalesce("page_header", F.lit("")), F.lit("检验报告照片页")))
    return pages.filter(F.rlike(F.lower(F.coalesce("raw_text", F.lit(""))), F.lit("照片|中文标签|photo|图片")))
