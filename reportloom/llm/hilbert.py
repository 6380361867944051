"""Sharding by a Hilbert curve over several metadata dimensions (operator 5).

Each dimension is quantised to the same number of bits at its quantiles, so cells keep its order and hold like numbers of
rows. The cell's index on the curve orders the rows, and the order is cut into runs of equal row counts. Neighbours on the
curve are neighbours in every dimension, so each shard's minimum and maximum (zone_map) let a reader skip files by any of
them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, packed, small, text_of

ROW_BITS = 33  # monotonically_increasing_id keeps a row's place in its partition in the low 33 bits


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state), both indexed by state * 2^dims + corner, of the Hilbert curve in that many dimensions.

    A state is an entry corner and a direction. A corner is brought to the standard orientation by an exclusive or and
    a rotation; its rank on the Gray code is the digit, and the sub-cube's own entry and direction give the next state.
    """
    size = 1 << dims
    mask = size - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & mask

    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    trailing = lambda i: (i ^ (i + 1)).bit_length() - 1
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    heading = [0] + [trailing(i - 1 if i % 2 == 0 else i) % dims for i in range(1, size)]
    digits, following = [], []
    for state in range(size * dims):
        corner, axis = divmod(state, dims)
        for cell in range(size):
            i = rank[turn(cell ^ corner, axis + 1)]
            digits.append(i)
            following.append((corner ^ turn(entry[i], dims - axis - 1)) * dims + (axis + heading[i] + 1) % dims)
    return digits, following


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """The index on the curve of a cell given by one integer of so many bits in each dimension."""
    n = len(cells)
    digits, following = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(n))

    def step(acc: Column, level: Column) -> Column:
        corner = sum(((F.call_function("shiftright", c, level).bitwiseAND(F.lit(1))) * (1 << k) for k, c in enumerate(cells)), F.lit(0)).cast("int")
        at = acc["state"] * (1 << n) + corner
        return F.struct((acc["index"] * (1 << n) + F.get(digits, at)).alias("index"), F.get(following, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["index"]


def string_bounds(df: DataFrame, col: str, cells: int) -> list[str]:
    """At most so many strings that cut the distinct values of a column into runs of like numbers: each run's least, but for the first. Only these come to the driver."""
    values = df.select(F.col(f"`{col}`").alias("v")).filter("v is not null").distinct()
    runs = values.repartitionByRange(cells, "v").groupBy(F.spark_partition_id().alias("run")).agg(F.min("v").alias("v"))
    return sorted((r["v"] for r in runs.collect()), key=str.encode)[1:]


def quantise(df: DataFrame, dims: Sequence[str], bits: int) -> list[Column]:
    """Each dimension's cell among 2^bits: how many of its bounds a value reaches. A null is in cell 0.

    A number's bounds are its quantiles over all rows; a string's, quantiles of its distinct values, in the order of their bytes. They come to the driver,
    2^bits - 1 a dimension.
    """
    cells = 1 << bits
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    texts = {c for c in dims if isinstance(df.schema[c].dataType, StringType)}
    numbers = [c for c in dims if c not in texts]
    found = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, F.lit(20 * cells)).alias(f"q{i}") for i, c in enumerate(numbers)]).first() if numbers else None
    out = []
    for c in dims:
        value = F.col(f"`{c}`") if c in texts else F.col(f"`{c}`").cast("double")
        bounds = string_bounds(df, c, cells) if c in texts else sorted(set(found[f"q{numbers.index(c)}"] or []))
        reached = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= value)) if bounds else F.lit(0)  # noqa: B023
        out.append(F.when(value.isNull(), F.lit(0)).otherwise(reached).cast("int"))
    return out


def hilbert_shards(df: DataFrame, dims: Sequence[str], tie: Sequence[str], shards: int = 40, bits: int = 6) -> DataFrame:
    """df with hilbert, shard and slot: shards of row counts at most one apart, each a run of the curve over dims (numbers or strings).

    tie orders rows of one cell. The rows are sorted by range over all tasks and written once, so every row's place is its partition's offset plus its
    place in the partition; only one count a partition comes to the driver. Rows alike in all these columns, repeated ones too, get consecutive places.
    Nulls share the lowest cell. An empty table gives an empty result. Columns named hilbert, shard or slot are replaced, all others kept.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("hilbert", "shard", "slot")])
    cells = quantise(df, dims, bits)
    work = packed(df, *[c.alias(f"cell{i}") for i, c in enumerate(cells)], *[F.col(f"`{c}`").alias(f"tie{i}") for i, c in enumerate(tie)])
    placed = work.withColumn("hilbert", hilbert_index([F.col(f"cell{i}") for i in range(len(cells))], bits))
    order = ["hilbert", *[f"tie{i}" for i in range(len(tie))]]
    parts = max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = cut(ranged.select("_row", "hilbert", F.monotonically_increasing_id().alias("_at")), "hilbert")
    part = F.shiftrightunsigned("_at", ROW_BITS)
    counts = {r["p"]: r["n"] for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    total, offsets = 0, {}
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), part) if offsets else F.lit(0)
    rank = (offset + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).cast("long")
    ranked = ranked.withColumn("_rank", rank)
    # integer arithmetic: the run of shard s starts at ceil(s * total / shards)
    shard = F.expr(f"(_rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long"))
    return out.select("_row.*", "hilbert", "shard", "slot")


def zone_map(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Each shard's rows and the extremes of each dimension, for pruning files: a filter on a dimension needs no shard whose extremes exclude it. Nulls count for no extreme."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(F.col(f"`{c}`")).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))])


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Place documents on the curve of size, language and source. Equal texts stand together, whatever their languages and sources: in one shard, or across one cut.

    A null text has 16 bytes and checksum 0; null languages and sources count as empty. Where equal texts differ in language or source, all
    are placed by the least of each. Only ids and measures are sorted, the texts stay where they are.
    """
    key = F.xxhash64(text_of()).alias("text_key")
    slim = docs.select("doc_id", (F.octet_length(text_of()) + 16).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), key, *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    slim = cut(slim, "measures")
    same = ["size", "text_crc32", "text_key"]
    groups = slim.groupBy(*same).agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source") for n, f in (("least", F.min), ("most", F.max))])
    mixed = small(cut(groups.filter("least_lang <> most_lang or least_source <> most_source").drop("most_lang", "most_source"), "mixed"))
    slim = slim.join(mixed, same, "left").withColumns({c: F.coalesce(f"least_{c}", c) for c in ("lang", "source")})
    placed = hilbert_shards(slim, ["size", "lang", "source"], [*same, "doc_id"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
