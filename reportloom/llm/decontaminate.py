"""Benchmark decontamination by a prefix-filtered set join (operator 2).

A benchmark item gives windows of 13 words (one of all its words if it has fewer). A document holds a window only if it
holds all its words, so one word is a necessary prefix: the rarest, by counts over the whole corpus. The join is on that
word alone. A pair then has to pass the bounds of position (the window must lie inside the document, which also bounds the
length) and the hash of the words at the window's place, and is verified word by word.

Windows, their counts and prefix words are tables that tasks make. The index goes to the scan in blocks of at most
BLOCK_WINDOWS windows, one at a time, so what the driver and a broadcast hold is bounded however large the benchmark; each
block is a pass over the documents, and the hits are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, document_key, packed, small, text_of
from .textnum import ALNUM, U, Words, blocks, sequence_hash

WINDOW = 13
BLOCK_WINDOWS = 100_000
FILTER_BITS = 18
MOST_POSTS = 500_000  # places that are compared at once


class Member:
    """Which of many hashes are in a fixed set, and where in its sorted order."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.bits[self.keys >> U(64 - FILTER_BITS)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into h of members, and their places among the keys."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[h >> U(64 - FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], at[hit]


class Index:
    """Some windows, posted under their prefix words. rows: words, their hashes, prefix (hash), back (place of the prefix in the window) and items."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["prefix"] & (1 << 64) - 1, r["words"]))
        prefix = np.array([r["prefix"] for r in rows], dtype=np.int64).view(np.uint64)
        self.prefix = Member(prefix)
        self.first = np.append(np.searchsorted(prefix, self.prefix.keys), len(rows))
        self.back = np.array([r["back"] for r in rows], dtype=np.int64)
        self.sizes = np.array([len(r["words"]) for r in rows], dtype=np.int64)
        self.words = [[w.encode() for w in r["words"]] for r in rows]
        self.items = [r["items"] for r in rows]
        self.hash = np.array([sequence_hash(np.array(r["h"], dtype=np.int64).view(np.uint64), np.zeros(1, dtype=np.int64), len(r["h"]))[0] for r in rows], dtype=np.uint64)

    def hits(self, words: Words, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word within the block, window) of every occurrence of a window, in no order. Prefix places are taken in parts of bounded postings."""
        at, key = self.prefix.find(h)
        upto = np.cumsum(self.first[key + 1] - self.first[key])
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + MOST_POSTS, "right")))
            yield from self.compared(words, h, at[begin:end], key[begin:end])
            begin = end

    def compared(self, words: Words, h: np.ndarray, at: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int, int]]:
        posts = self.first[key + 1] - self.first[key]
        window = np.repeat(self.first[key], posts) + np.arange(posts.sum()) - np.repeat(np.cumsum(posts) - posts, posts)
        start = np.repeat(at, posts) - self.back[window]
        text = words.text[np.repeat(at, posts)]
        inside = (start >= words.first[text]) & (start + self.sizes[window] <= words.first[text + 1])
        window, start, text = window[inside], start[inside], text[inside]
        for size in np.unique(self.sizes[window]):
            some = np.flatnonzero(self.sizes[window] == size)
            some = some[sequence_hash(h, start[some], int(size)) == self.hash[window[some]]]
            for i in some.tolist():
                if all(words.word(int(start[i]) + j) == x for j, x in enumerate(self.words[window[i]])):
                    yield int(text[i]), int(start[i]), int(window[i])


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(id, words, h, items): the distinct windows of all items, their words and the words' hashes, and the sorted ids of the items that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                words = block.lowered().words(ALNUM)
                h = words.hashes().view(np.int64)
                for i in range(block.n):
                    first, n = int(words.first[i]), int(words.count[i])
                    size = min(window, n)
                    each = [words.word(k).decode() for k in range(first, first + n)]
                    starts = range(n - size + 1) if n else ()
                    for part in range(0, len(starts), 1000):
                        some = starts[part : part + 1000]
                        columns = [pa.array([ids[block.at + i]] * len(some), pa.string()), pa.array([each[k : k + size] for k in some], pa.list_(pa.string())), pa.array([h[first + k : first + k + size] for k in some], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(columns, ["item", "words", "h"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_of("text").alias("text"))
    found = named.mapInArrow(run, "item string, words array<string>, h array<long>")
    return found.groupBy("words").agg(F.first("h").alias("h"), F.sort_array(F.collect_set("item")).alias("items")).withColumn("id", F.struct(F.xxhash64("words"), F.hash("words")))


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): how often each word, by its hash, occurs in all documents; tasks add up their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block.lowered().words(ALNUM).hashes() for block in blocks(batch.column(0))]
            word, n = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def window_index(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int) -> DataFrame:
    """The item windows with prefix (hash of the word that the corpus has least) and back (its place in the window)."""
    windows = cut(item_windows(benchmark, window), "windows")
    each = windows.select("id", F.posexplode("h").alias("back", "word"))
    counts = cut(corpus_counts(docs, text_col).join(each.select("word").distinct(), "word", "left_semi"), "counts")
    rarest = each.join(counts, "word", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "back")).alias("p"))
    return cut(windows.join(rarest, "id").select("id", "words", "h", "items", F.col("p.word").alias("prefix"), F.col("p.back").alias("back")), "index")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row a document: id, doc_key, text_key, n_words, n_hit, n_items, items (ids as sorted strings) and contaminated.

    benchmark has item_id and text. A null text has no words; neither it nor an empty item or benchmark hits anything.
    An item whose id is null counts under the name "null"; items that repeat an id count once. Rows that repeat an id and a text get equal rows.
    An empty table of documents gives none. The id keeps its name unless another output has it; then it is called id.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"), *document_key(f"`{id_col}`", f"`{text_col}`"))
    index = window_index(slim, benchmark, "text", window)
    n_blocks = max(1, -(-index.count() // block_windows))
    kind = slim.schema["id"].dataType.simpleString()

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                counts, hits, items = [], [], []
                for block in blocks(batch.column(1)):
                    words = block.lowered().words(ALNUM)
                    counts.append(words.count)
                    covered: list[set[int]] = [set() for _ in range(block.n)]
                    named: list[set[str]] = [set() for _ in range(block.n)]
                    for text, start, w in index.hits(words, words.hashes()):
                        first = start - int(words.first[text])
                        covered[text].update(range(first, first + int(index.sizes[w])))
                        named[text].update(index.items[w])
                    hits += [sorted(x) for x in covered]
                    items += [sorted(x) for x in named]
                n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["id", "doc_key", "text_key", "n_words", "hit", "items"])

        return slim.mapInArrow(run, f"id {kind}, doc_key long, text_key long, n_words long, hit array<int>, items array<string>")

    out, merged = None, None
    for k in range(n_blocks):
        rows = index.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == k).select("words", "h", "items", "prefix", "back").collect()  # about block_windows rows
        found = scan(spark.sparkContext.broadcast(Index(rows)))
        if n_blocks > 1:
            some = cut(found.filter((F.size("hit") > 0) | F.lit(k == 0)), "hits")
            out = some if k == 0 else out
            merged = some if k == 0 else merged.unionByName(some)
        else:
            out = found
    if merged is not None:
        lists = merged.filter(F.size("hit") > 0).groupBy("doc_key", "text_key").agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit", "items")])
        out = out.drop("hit", "items").join(lists, ["doc_key", "text_key"], "left").withColumns({"hit": F.coalesce("hit", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.size("hit").cast("long")
    name = id_col if id_col not in ("doc_key", "text_key", "n_words", "n_hit", "n_items", "items", "contaminated") else "id"
    return out.select(F.col("id").alias(name), "doc_key", "text_key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: counts, the digest of its items and whether it is contaminated. A null text has no words, hits nothing and is clean."""
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones. Rows that repeat an id and a text go or stay together."""
    bad = contamination(docs, benchmark, id_col, text_col).filter("contaminated").select(F.col("doc_key").alias("_doc_key"), F.col("text_key").alias("_text_key")).distinct()
    bad = small(cut(bad, "contaminated"))
    doc_key, text_key = document_key(id_col, text_col)
    keyed = packed(docs, doc_key.alias("_doc_key"), text_key.alias("_text_key"))
    return keyed.join(bad, ["_doc_key", "_text_key"], "left_anti").select("_row.*")


#: The digest for DuckDB.
DIGEST_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
