"""What the training-data operators share: cut tables, document keys, reading a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))  # lets local Python workers import this package
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local session without one gets its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loom-{sc.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, made: dict[str, Column], drop: list[str]) -> DataFrame:
    """df without drop and with the columns made, computed once a row: a filter on them is not pushed into their expressions, as it would be through a projection."""
    rest = [c for c in df.columns if c not in made and c not in drop]
    once = df.select(*[F.col(f"`{c}`") for c in rest], F.explode(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))).alias("_made"))
    return once.select(*[F.col(f"`{c}`") for c in rest], "_made.*")


def packed(df: DataFrame, *more: Column | str) -> DataFrame:
    """df's rows as one column _row, and more columns beside it, so that no name of df can clash with a working column; _row.* unpacks them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *more)


BROADCAST_BYTES = 16 << 20


def value_bytes(field: StructField) -> Column:
    """What a value takes beyond its slot in the row."""
    kind = field.dataType.typeName()
    bulk = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if kind in ("string", "binary"):
        return bulk(F.col(field.name))
    if kind != "array":
        return F.lit(0)
    slots = 8 * F.greatest(F.coalesce(F.size(field.name), F.lit(0)), F.lit(0))
    if field.dataType.elementType.typeName() not in ("string", "binary"):
        return slots
    return slots + F.coalesce(F.aggregate(field.name, F.lit(0).cast("long"), lambda a, x: a + bulk(x)), F.lit(0).cast("long"))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a cut table, marked for broadcast if its values, as Spark holds them, take at most so many bytes; beyond that joins shuffle it."""
    width = sum((value_bytes(f) for f in df.schema), F.lit(16 + 8 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most else df


def release(spark: SparkSession) -> None:
    """Delete the cut tables of this application. Call it once all results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row; a fold over it does not carry it along."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def document_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """doc_key and text_key: rows that repeat both an id and a text are one document; a null id is a value like others."""
    return [F.coalesce(F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull()), F.lit(0)).alias("doc_key"), F.xxhash64(text_of(text_col)).alias("text_key")]
