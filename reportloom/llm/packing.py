"""Packing documents into sequences of bounded length, as a cutting-stock problem solved by column generation (operator 12).

Documents are tokenised; what is longer than a sequence gives whole sequences first. What is left of each document falls into a class by its length,
rounded up to WIDTH tokens. A linear program over patterns (so many documents of each class in one sequence) asks for the fewest sequences; it starts with
one pattern a class, and a knapsack by dynamic programming, over the program's prices, finds the next pattern that helps, until none does. The patterns'
numbers are rounded down and what that leaves goes into greedy patterns. Documents have a rank in their class, and by it the patterns' places are dealt
out: plain arithmetic, whatever the number of documents.

Rounding to classes leaves gaps. The sequences that the patterns fill least are taken apart again, just as many as it takes to fill all other gaps: their
documents, laid end to end, are cut where a gap ends. So most documents stay whole and no sequence needs padding: what is left over at the end is cut at
powers of two.

Tasks number their own rows; only counts by class, the sums of at most BUCKETS runs of sequences and the program's patterns are on the driver.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from .common import cut, small, text_of

CAPACITY, WIDTH = 4_096, 32  # tokens of a sequence, and of a class
END = 2  # the id behind every document
REMEMBERED = 250_000  # words, in each of two generations
TEXTS = 200  # that a task encodes at once
BUCKETS = 4_096
STRETCH = 16_384  # tokens of the stream of cut documents that are matched to gaps at once
RANK_BITS = 55


def word_pattern(config: dict) -> str | None:
    """The pattern of the words that a tokenizer encodes one by one, if no word spans white space and case and Unicode form are all that it changes before."""
    steps = (config.get("normalizer") or {}).get("normalizers") or []
    before = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = before[0]
    kinds = [s["type"] for s in steps], [s["type"] for s in before[1:]]
    plain = kinds == (["NFC", "Replace", "Lowercase"], ["ByteLevel"]) and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
    if not plain or config.get("post_processor") or any(re.search(r"\s", t["content"]) for t in config["added_tokens"]):
        return None
    return split["pattern"]["Regex"]


class Remembered:
    """Values by key in two generations: when the younger has REMEMBERED, the older goes."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not known; all that are stand in young from now on."""
        if len(self.young) + len(keys) > REMEMBERED:
            self.young, self.old = {}, self.young
        left = [k for k in keys if k not in self.young]
        self.young.update((k, self.old[k]) for k in left if k in self.old)
        return [k for k in left if k not in self.old]


class Coder:
    """Ids of texts as bytes, so many a token. Texts are encoded by word where they are plain; what stands between blanks and is not plain is encoded whole."""

    #: What is not printable ASCII, a line feed or a precomposed Latin letter: for all these, no rule of Unicode joins, reorders or takes apart any.
    ODD = re.compile(r"[^ -~\nÀ-įĲ-ſ]")
    LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"  # all letters among them; their only digits are ASCII's
    WHOLE = "\0"  # leads the key of what is encoded whole
    TOGETHER = 256  # words that are encoded as one text

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        config = json.loads(file)
        self.tokenizer = Tokenizer.from_str(file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        pattern, suffix = word_pattern(config), config["model"].get("end_of_word_suffix")
        classes = ((r"\p{L}", self.LETTERS), (r"\p{N}", "0-9"))
        self.pattern = re.compile(reduce(lambda p, c: p.replace(*c), classes, pattern)) if pattern and suffix else None
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.special = [t["content"] for t in config["added_tokens"]]
        self.known = Remembered()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def odd(self, text: str) -> bool:
        return self.ODD.search(text) is not None or any(x in text for x in self.special)

    def keys(self, text: str) -> list[str]:
        """What a text is encoded by: its words in lower case, and parts to be encoded whole."""
        if not self.odd(text):
            return self.pattern.findall(text.lower())
        out: list[str] = []
        for part in text.replace("\n", " ").split(" "):
            if self.odd(part):
                out.append(self.WHOLE + part)
            else:
                out += self.pattern.findall(part.lower())
        return out

    def learn(self, keys: set[str]) -> None:
        """Words are encoded many at a time; the marks of word ends tell their ids apart."""
        new = self.known.missing(keys)
        found, words = self.known.young, [k for k in new if not k.startswith(self.WHOLE)]
        found.update((k, self.whole(k[1:])) for k in new if k.startswith(self.WHOLE))
        groups = [words[k : k + self.TOGETHER] for k in range(0, len(words), self.TOGETHER)]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype=self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                raw, cuts = ids.tobytes(), (ends * self.kind.itemsize).tolist()
                found.update((w, raw[i:j]) for w, i, j in zip(group, [0, *cuts], cuts, strict=False))
            else:
                found.update((w, self.whole(w)) for w in group)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.pattern is None:
            return [self.whole(t) for t in texts]
        keys = [self.keys(t) for t in texts]
        self.learn(set().union(*keys))
        known = self.known.young.__getitem__
        return [b"".join(map(known, k)) for k in keys]


@lru_cache(maxsize=2)
def coder(file: str) -> Coder:
    return Coder(file)


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


TOKENS = "part int, at long, n long, cls int, place long, blocks array<long>, blocks_before long, rest_crc long, wide int, ids binary"


def tokenise(df: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY, width: int = WIDTH, end: int | None = END) -> DataFrame:
    """A written table of df's rows without the text, as _row, and their tokens; the driver reads the tokenizer's file.

    part and at name a row; n counts its ids, the end id included; blocks has the checksum of each whole sequence in it; cls is the class of the rest (0:
    none), place the rows of that class before it in its part, blocks_before likewise. A null text counts as empty.
    """
    with open(path, encoding="utf-8") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest], *([] if rest else [F.lit(True).alias("_")])).alias("_row"), text_of(f"`{text_col}`").alias("text"))
    schema = StructType([rows.schema["_row"], *StructType.fromDDL(TOKENS)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = coder(file.value), TaskContext.get().partitionId()
        close = b"" if end is None else np.array([end], dtype=made.kind).tobytes()
        at = whole = 0
        places: dict[int, int] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                some = batch.slice(begin, TEXTS)
                out: list[tuple] = []
                for coded in made.encode(some.column(1).to_pylist()):
                    raw = coded + close
                    ids = np.frombuffer(raw, dtype=made.kind)
                    n = len(ids)
                    full = n // capacity
                    cls = -(-(n % capacity) // width)
                    sums = [checksum(ids[k * capacity : (k + 1) * capacity]) for k in range(full)]
                    out.append((part, at, n, cls, places.get(cls, 0), sums, whole, checksum(ids[full * capacity :]), made.kind.itemsize, raw))
                    places[cls] = places.get(cls, 0) + 1
                    at, whole = at + 1, whole + full
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow[1:], strict=True)]], names)

    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    arrow = [pa.field("_row", pa.null()), *[pa.field(n, kinds[k]) for n, k in (x.split(" ", 1) for x in TOKENS.split(", "))]]
    return cut(rows.mapInArrow(run, schema), "tokens")


# ---- the linear program ------------------------------------------------------------------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of highest price: an unbounded knapsack by dynamic programming over the room."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    use = np.flatnonzero(prices > 0)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fits = use[sizes[use] <= c]
        if len(fits):
            worth = prices[fits] + best[c - sizes[fits]]
            k = int(worth.argmax())
            if worth[k] > best[c]:
                best[c], choice[c] = worth[k], fits[k]
    pattern, c = np.zeros(len(sizes), dtype=np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), pattern


def times(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A matrix times a vector, without the threads of a linear-algebra library: these can hang in a driver that has started a JVM."""
    return (a * v).sum(axis=1)


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse, by elimination with the largest pivot of each column."""
    n = len(a)
    work = np.hstack([a.astype(float), np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0.0
        work -= others[:, None] * work[k]
    return work[:, n:]


def fewest(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 50, tiny: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each) of the linear program: sequences of so much room for all of demand, by the revised simplex method.

    Patterns are priced in when the knapsack finds one worth more than a sequence. At most rounds a class are tried: any stage is a valid answer.
    """
    m = len(sizes)
    patterns = np.diag(room // sizes)
    inverse = np.diag(1.0 / (room // sizes))
    often = demand / (room // sizes)
    for turn in range(1, rounds * m + 1):
        worth, pattern = best_pattern(sizes, inverse.sum(axis=0), room)
        if worth <= 1 + tiny:
            break
        step = times(inverse, pattern)
        up = step > tiny
        ratios = np.where(up, often / np.where(up, step, 1.0), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        patterns[:, out] = pattern
        if turn % 100:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        else:
            inverse = inverted(patterns)
        often = np.maximum(times(inverse, demand), 0.0)
    return patterns, often


def whole_patterns(sizes: np.ndarray, demand: list[int], room: int) -> list[tuple[list[int], int]]:
    """(documents of each class, sequences): whole numbers that meet demand exactly, fullest patterns first."""
    patterns, often = fewest(sizes, np.array(demand, dtype=float), room)
    left, found = list(demand), []
    for column, x in zip(patterns.T.tolist(), often.tolist(), strict=True):
        number = min([int(x + 1e-6), *[left[i] // a for i, a in enumerate(column) if a]])
        if number:
            left = [have - number * a for have, a in zip(left, column, strict=True)]
            found.append((column, number))
    order = sorted(range(len(left)), key=lambda i: -sizes[i])
    while any(left):  # what rounding left: largest first
        column, space = [0] * len(left), room
        for i in order:
            column[i] = min(left[i], space // int(sizes[i]))
            space -= column[i] * int(sizes[i])
        number = min(left[i] // a for i, a in enumerate(column) if a)
        left = [have - number * a for have, a in zip(left, column, strict=True)]
        found.append((column, number))
    return sorted(found, key=lambda p: -int(np.dot(p[0], sizes)))


@dataclass(frozen=True)
class Places:
    """For runs of ranks of each class: where a run begins, documents a sequence, and its first sequence."""

    key: np.ndarray  # class and first rank
    each: np.ndarray
    sequence: np.ndarray
    total: int

    @staticmethod
    def of(demand: dict[int, int], room: int) -> Places:
        classes = sorted(demand)
        entries, sequence, taken = [], 0, dict.fromkeys(classes, 0)
        for column, number in whole_patterns(np.array(classes), [demand[c] for c in classes], room) if classes else []:
            for c, a in zip(classes, column, strict=True):
                if a:
                    entries.append(((c << RANK_BITS) + taken[c], a, sequence))
                    taken[c] += a * number
            sequence += number
        columns = zip(*sorted(entries), strict=True) if entries else ((), (), ())
        return Places(*[np.array(c, dtype=np.int64) for c in columns], sequence)

    def find(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        key = (cls.astype(np.int64) << RANK_BITS) + rank
        at = np.searchsorted(self.key, key, "right") - 1
        return self.sequence[at] + (key - self.key[at]) // self.each[at]


# ---- the jobs ----------------------------------------------------------------------------------------------------------------------------------------


def starts_by_part(tokens: DataFrame) -> DataFrame:
    """(part, cls, before, n): documents of each class, and for class 0 whole sequences, in earlier parts and in this one."""
    counts = tokens.groupBy("part", "cls").agg(F.count("*").alias("n"), F.sum(F.size("blocks")).alias("b"))
    counts = cut(counts, "counts")
    each = counts.filter("cls > 0").select("part", "cls", "n").unionByName(counts.groupBy("part").agg(F.sum("b").alias("n")).select("part", F.lit(0).alias("cls"), "n"))
    return cut(each.selectExpr("part", "cls", "sum(n) OVER (PARTITION BY cls ORDER BY part) - n AS before", "n"), "starts")


def place_rests(tokens: DataFrame, starts: DataFrame, places: Places, capacity: int) -> DataFrame:
    """A written table of the rests of documents: _row, part, at, n, r (ids of the rest), rest_crc, sequence and rank."""
    slim = tokens.filter("cls > 0").join(small(starts.drop("n")), ["part", "cls"])
    slim = slim.select("_row", "part", "at", "n", F.col("n") % capacity, "rest_crc", "cls", F.col("before") + F.col("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column(6).to_numpy(), batch.column(7).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(places.find(cls, rank)), pa.array((cls.astype(np.int64) << RANK_BITS) + rank)], names)

    schema = StructType([tokens.schema["_row"], *StructType.fromDDL("part int, at long, n long, r long, rest_crc long, sequence long, rank long")])
    names = schema.names
    return cut(slim.mapInArrow(run, schema), "rests")


def over_stretches(df: DataFrame, kind: str, moving: list[str]) -> DataFrame:
    """Rows (pos, len, ...) as events of every stretch that they touch; the fields that move with the place start later there."""
    first, last = F.expr(f"pos div {STRETCH}"), F.expr(f"(pos + len - 1) div {STRETCH}")
    each = df.withColumn("stretch", F.explode(F.sequence(first, last)))
    later = F.greatest(F.col("stretch") * STRETCH - F.col("pos"), F.lit(0))
    fields = [c for c in df.columns if c != "len"]
    moved = F.struct(*[(F.col(c) + later if c in (*moving, "pos") else F.col(c)).alias(c) for c in fields])
    return each.select("stretch", moved.alias(kind)).withColumn("pos", F.col(f"{kind}.pos"))


def cut_stream(docs: DataFrame, gaps: DataFrame, total: int) -> DataFrame:
    """Pieces (part, at, start, length, sequence, offset): documents laid end to end (pos, len, part, at, start), cut where the gaps (pos, len, sequence, offset) end.

    Both cover 0 to total. Within a stretch every place where either begins is an event; the last document and gap up to it are what a piece is made of.
    """
    events = over_stretches(docs, "doc", ["start"]).unionByName(over_stretches(gaps, "gap", ["offset"]), allowMissingColumns=True)
    upto = Window.partitionBy("stretch").orderBy("pos")
    end = F.coalesce(F.lead("pos").over(upto), F.least((F.col("stretch") + 1) * STRETCH, F.lit(total)))
    met = events.select("pos", F.last("doc", True).over(upto).alias("doc"), F.last("gap", True).over(upto).alias("gap"), (end - F.col("pos")).alias("length")).filter("length > 0")
    ahead = lambda side: F.col("pos") - F.col(f"{side}.pos")
    return met.select("doc.part", "doc.at", (F.col("doc.start") + ahead("doc")).alias("start"), "length", "gap.sequence", (F.col("gap.offset") + ahead("gap")).alias("offset"))


def powers(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def loose_gaps(spark: SparkSession, start: int, tokens: int, sequence: int, capacity: int) -> tuple[DataFrame, int]:
    """New sequences for the stream's last tokens, as gaps (pos, len, sequence, offset), and their number: full ones, then powers of two."""
    full = tokens // capacity
    whole = spark.range(full).selectExpr(f"{start} + id * {capacity} AS pos", f"cast({capacity} AS bigint) AS len", f"{sequence} + id AS sequence", "0L AS offset")
    tail, at = [], start + full * capacity
    for k, size in enumerate(powers(tokens % capacity)):
        tail.append((at, size, sequence + full + k, 0))
        at += size
    last = spark.createDataFrame(tail, "pos long, len long, sequence long, offset long")
    return whole.unionByName(last), full + len(tail)


PIECE = ["_row", "part", "at", "start", "length", "ids_crc32", "n", "sequence", "offset"]


def cut_checksums(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces of cut documents with their checksums: each document's cuts meet its ids once."""
    cuts = cut(pieces.groupBy("part", "at").agg(F.collect_list(F.struct("start", "length", "sequence", "offset")).alias("cuts")), "cuts")
    met = tokens.select("_row", "part", "at", "n", "wide", "ids").join(small(cuts), ["part", "at"]).select("_row", "part", "at", "n", "wide", "ids", "cuts")
    schema = StructType([tokens.schema["_row"], *StructType.fromDDL("part int, at long, n long, cuts array<struct<start: long, length: long, sequence: long, offset: long>>, sums array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for wide, raw, cuts in zip(*[batch.column(i).to_pylist() for i in (4, 5, 6)], strict=True):
                ids = np.frombuffer(raw, dtype=f"<u{wide}")
                sums.append([checksum(ids[c["start"] : c["start"] + c["length"]]) for c in cuts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(6), pa.array(sums, pa.list_(pa.int64()))], schema.names)

    each = met.mapInArrow(run, schema).select("_row", "part", "at", "n", F.explode(F.arrays_zip("cuts", "sums")).alias("c"))
    return each.select("_row", "part", "at", "c.cuts.start", "c.cuts.length", F.col("c.sums").alias("ids_crc32"), "n", "c.cuts.sequence", "c.cuts.offset")


def pack(tokens: DataFrame, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """The pieces of all rows of tokens (see tokenise): _row, part, at, start, length, ids_crc32, n (of the document), sequence, offset.

    Sequences are numbered from 0 without gaps and hold capacity ids, but the last few, which hold powers of two. An empty table gives no pieces. Equal
    rows are packed one by one.
    """
    spark = tokens.sparkSession
    starts = starts_by_part(tokens)
    by_class = {r["cls"]: r["n"] for r in starts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    places = Places.of({c: n for c, n in by_class.items() if c}, capacity // width)
    blocks = tokens.filter(F.size("blocks") > 0).join(small(starts.filter("cls = 0").select("part", "before")), "part")
    blocks = blocks.select("_row", "part", "at", "n", (F.col("before") + F.col("blocks_before")).alias("first"), F.posexplode("blocks").alias("k", "ids_crc32"))
    first_block = 0
    out = None
    if places.total:
        rests = place_rests(tokens, starts, places, capacity)
        span = -(-places.total // BUCKETS)
        rests = rests.withColumn("bucket", F.expr(f"sequence div {span}"))
        used = {r["bucket"]: r["r"] for r in rests.groupBy("bucket").agg(F.sum("r").alias("r")).collect()}
        holds = lambda b: min(span, places.total - b * span) * capacity
        gap, stream, receivers = sum(map(holds, used)) - sum(used.values()), 0, max(used) + 1
        while stream < gap or receivers == max(used) + 1 and gap:  # take apart the last runs of sequences until they fill the gaps of the others
            receivers -= 1
            stream += used[receivers]
            gap -= holds(receivers) - used[receivers]
        kept, gap_at, doc_at = min(receivers * span, places.total), 0, 0
        bases = []
        for b in sorted(used):
            bases.append((b, gap_at if b < receivers else doc_at))
            gap_at, doc_at = (gap_at + holds(b) - used[b], doc_at) if b < receivers else (gap_at, doc_at + used[b])
        base = F.broadcast(spark.createDataFrame(bases, "bucket long, base long"))  # at most BUCKETS rows
        inside = Window.partitionBy("bucket", "sequence").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        stay = rests.filter(F.col("bucket") < receivers).repartition("bucket")
        stay = stay.withColumn("offset", F.coalesce(F.sum("r").over(inside), F.lit(0)))
        out = stay.select("_row", "part", "at", (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), F.col("rest_crc").alias("ids_crc32"), "n", "sequence", "offset")
        before = Window.partitionBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        running = lambda size, *order: F.col("base") + F.coalesce(F.sum(size).over(before.orderBy(*order)), F.lit(0))
        filled = stay.groupBy("bucket", "sequence").agg(F.sum("r").alias("offset")).withColumn("len", capacity - F.col("offset"))
        gaps = filled.join(base, "bucket").select(running("len", "sequence").alias("pos"), "len", "sequence", "offset").filter("len > 0")
        loose = rests.filter(F.col("bucket") >= receivers).join(base, "bucket")
        loose = loose.select(running("r", "sequence", "rank").alias("pos"), F.col("r").alias("len"), "part", "at", (F.col("n") - F.col("r")).alias("start"))
        more, n_more = loose_gaps(spark, gap, stream - gap, kept, capacity)
        if stream:
            out = out.unionByName(cut_checksums(tokens, cut_stream(loose, gaps.unionByName(more), stream)))
        first_block = kept + n_more
    whole = blocks.select("_row", "part", "at", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "n", (F.lit(first_block).cast("long") + F.col("first") + F.col("k")).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    return (whole if out is None else whole.unionByName(out)).select(*PIECE)


def piece_ids(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces with ids (array<int>): each document's ids, cut by all its pieces."""
    met = pieces.drop("_row").join(tokens.select("part", "at", "wide", "ids"), ["part", "at"])
    names = [c for c in met.columns if c not in ("wide", "ids")]
    schema = StructType([*[met.schema[c] for c in names], *StructType.fromDDL("ids array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = zip(*[batch.column(names_all.index(c)).to_pylist() for c in ("ids", "wide", "start", "length")], strict=True)
            ids = [np.frombuffer(raw, dtype=f"<u{wide}")[start : start + n].astype(np.int32) for raw, wide, start, n in raws]
            yield pa.RecordBatch.from_arrays([*[batch.column(names_all.index(c)) for c in names], pa.array(ids, pa.list_(pa.int32()))], schema.names)

    names_all = met.columns
    return met.mapInArrow(run, schema)


def packing_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document; a null text is the end id alone."""
    found = pack(tokenise(docs.select("doc_id", "text"), path))
    return found.select("_row.doc_id", "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")
