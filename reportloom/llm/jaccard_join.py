"""N-gram Jaccard join by parity sketches (operator 10).

A document's set is its distinct five-word shingles. Its parity sketch divides the shingles by hash among P parts and
keeps the exclusive or of each part's hashes. Two sketches differ in at most as many parts as their sets differ in
elements, so their Hamming distance is a lower bound of the symmetric difference, and sets with a Jaccard index of 3/4
or more differ in at most (|A| + |B|) / 7 <= |A| / 3 = d elements. P is fixed in a band of sizes; a set near the upper end of
its band is sketched for the next one too, so that both sets of a pair meet in the band of the larger.

Pigeonhole: with N non-empty parts in the fuller sketch, at least T = N - d parts are equal and not empty. Of each sketch the
d + 1 + x smallest part keys in one order common to all are therefore enough to share 1 + x keys (or T, if fewer). A set that has too
few parts (N <= d) is sketched with one shingle a part as well; a pair of which both sets are such meets there.

Keys are joined by shuffle. A pair is checked by the number of keys it shares, by size, by the Hamming distance of a
512-bit parity sketch, and by the exact sets. Links are found in two steps, neither of which emits all pairs of a group:
1. members of a key that share enough keys with its smallest member are compared with it, and linked sets become components;
2. each set leaves out the x of its keys that most sets have (passages that many documents share); by the count above, linked
   sets still share a key. Only sets that still share one with a set of another component are sketched again, now with one
   shingle a part and parts in order of rarity, and their pairs are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, cut, document_key, packed, small, text_of
from .textnum import ODD, SOLID, U, Block, blocks, mix, sequence_hash

SHINGLE = 5
BAND = 4  # a band's largest size is so many times its smallest
LEAST_PARTS = 256
SPARE = 8  # x is the size over this
SALTS = 16  # parts of a key that very many sets have
HOT_SHARE = 2_000  # such a key is in one of so many sets, or more
LONGS = 8  # of the 512-bit sketch


def block_sets(block: Block, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text of the block the sorted distinct hashes of its shingles; one of all words if it has fewer, none without words."""
    words = block.lowered().words(SOLID)
    h = words.hashes()
    whole = sequence_hash(h, np.arange(max(0, len(h) - size + 1)), size)
    sets = []
    for i in range(block.n):
        first, n = int(words.first[i]), int(words.count[i])
        if n >= size:
            sets.append(np.unique(whole[first : first + n - size + 1]))
        else:
            sets.append(sequence_hash(h, np.array([first]), n) if n else np.zeros(0, dtype=np.uint64))
    return sets


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for block in blocks(column):
        yield from block_sets(block)


def allowance(n: int) -> tuple[int, int]:
    """d and x of a set of n shingles."""
    return n // 3, n // SPARE


def salt(lowest: int, i: int) -> np.uint64:
    return U(lowest * int(ODD[i]) & (1 << 64) - 1)


def part_keys(s: np.ndarray, lowest: int) -> tuple[np.ndarray, int]:
    """The set's part keys in the band from size lowest on, in order, as far as they are emitted; how many of its heaviest keys may be left out."""
    d, x = allowance(len(s))
    parts = max(2 * lowest, LEAST_PARTS)
    where = ((s >> U(32)) * U(parts)) >> U(32)  # s is sorted, so parts are runs
    begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    sketch = np.bitwise_xor.reduceat(mix(s ^ ODD[3]), begin)
    keys = np.sort(mix(sketch + where[begin] * ODD[4] + salt(lowest, 5)))
    if len(keys) <= d:
        alone = np.sort(mix(s + salt(lowest, 6)))[: d + 1]
        return np.concatenate([keys, alone]), 0
    spare = min(len(keys) - d - 1, allowance(3 * len(s) // 4)[1], x)
    return keys[: d + 1 + x], spare


def bands(n: int) -> list[int]:
    """Lowest sizes of the bands in which a set of n shingles is sketched."""
    lowest = 1
    while lowest * BAND <= n:
        lowest *= BAND
    return [lowest, lowest * BAND] if 4 * n // 3 >= lowest * BAND else [lowest]


def node_of(s: np.ndarray) -> int:
    """64 bits that stand for the set."""
    both = np.array([np.bitwise_xor.reduce(s), s.sum(dtype=np.uint64), len(s)], dtype=np.uint64)
    return int(sequence_hash(both, np.array([0]), 3)[0].view(np.int64)) if len(s) else 0


def parity_sketch(s: np.ndarray) -> list[int]:
    bits = np.bincount((mix(s ^ ODD[7]) >> U(55)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


SKETCH = [f"p{i}" for i in range(LONGS)]
FACTS = "n_shingles int, node long, spare int, " + ", ".join(f"{p} long" for p in SKETCH) + ", frequent array<struct<key:long,n:int>>"


def frequent_keys(keys: list[np.ndarray]) -> list[dict]:
    """Keys that a twentieth of these sets, and sixteen of them or more, have, and how many have them."""
    if len(keys) < 16:
        return []
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    often = n >= max(16, len(keys) // 20)
    return [{"key": k, "n": c} for k, c in zip(key[often].view(np.int64).tolist(), n[often].tolist(), strict=True)]


def set_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: its id, keys, and its set's size, node, spare and parity sketch. The first row of a block of texts also has the block's frequent keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, frequent = [], []
            for block in blocks(batch.column(1)):
                fresh: dict[int, np.ndarray] = {}
                for s in block_sets(block):
                    each, node = [part_keys(s, b) for b in bands(len(s))] if len(s) else [], node_of(s)
                    if each:
                        fresh[node] = np.concatenate([k for k, _ in each])
                    rows.append((len(s), node, min((x for _, x in each), default=0), *parity_sketch(s)))
                frequent += [frequent_keys(list(fresh.values())), *[None] * (block.n - 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (3 + LONGS)
            kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.int64()] * LONGS
            found = pa.array(frequent, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], found], [id_col, "doc_key", "text_key", "n_shingles", "node", "spare", *SKETCH, "frequent"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("_text"), *document_key(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, doc_key long, text_key long, {FACTS}")


def hot_keys(facts: DataFrame) -> np.ndarray:
    """Keys that one of HOT_SHARE sets or more have, by the counts of the blocks in which they are frequent: at most HOT_SHARE times a set's keys."""
    found = facts.select(F.explode("frequent").alias("f")).groupBy("f.key").agg(F.sum("f.n").alias("n"))
    return np.sort(found.filter(F.col("n") >= facts.count() // HOT_SHARE).select("key").toPandas()["key"].to_numpy(dtype=np.int64).view(np.uint64))


def emitted_keys(docs: DataFrame, text_col: str, hot: np.ndarray) -> DataFrame:
    """(key, part, node) of every set; copies within a task are emitted once. Hot keys have several parts, which deal their nodes out, others -1."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def batch_of(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.repeat(np.array(nodes, dtype=np.int64), [len(k) for k in keys])
        part = np.full(len(key), -1, dtype=np.int32)
        if len(shared.value):
            at = np.minimum(np.searchsorted(shared.value, key), len(shared.value) - 1)
            is_hot = shared.value[at] == key
            part[is_hot] = node[is_hot] & (SALTS - 1)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part), pa.array(node)], ["key", "part", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, size = [], [], 0
            for s in shingle_sets(batch.column(0)):
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                for b in bands(len(s)):
                    k = part_keys(s, b)[0]
                    keys.append(k)
                    nodes.append(node)
                    size += len(k)
                if size > 200_000:
                    yield batch_of(keys, nodes)
                    keys, nodes, size = [], [], 0
            if keys:
                yield batch_of(keys, nodes)

    return docs.select(text_of(text_col).alias("_text")).mapInArrow(run, "key long, part int, node long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, node, low, members) of the keys that several nodes have: low is the smallest of them, members their number.

    A key's nodes meet in one window; a hot key's parts are dealt out as keys of their own, and their extremes are then put together.
    """
    each = W.partitionBy("key", "part")
    found = keys.withColumns({"low": F.min("node").over(each), "high": F.max("node").over(each), "members": F.count("*").over(each)})
    found = cut(found.filter("part >= 0 or low <> high").dropDuplicates(["key", "part", "node"]), "shared")
    hot = small(cut(found.filter("part >= 0").groupBy("key").agg(F.min("low").alias("hot_low"), F.max("high").alias("hot_high"), F.count("*").alias("hot_members")), "hot"))
    met = found.join(hot, "key", "left")
    whole = [F.coalesce(f"hot_{c}", c).alias(c) for c in ("low", "high", "members")]
    return met.select("key", "node", *whole).filter("low <> high").select("key", "node", "low", "members")


def sets_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select(text_of(text_col).alias("_text")).mapInArrow(run, "node long, shingles array<long>")


def close_enough(prefix_a: str = "a_", prefix_b: str = "b_") -> Column:
    """The bounds by size and by parity sketch that a pair with a Jaccard index of 3/4 meets."""
    a, b = F.col(f"{prefix_a}n_shingles"), F.col(f"{prefix_b}n_shingles")
    distance = sum((F.bit_count(F.col(f"{prefix_a}p{i}").bitwiseXOR(F.col(f"{prefix_b}p{i}"))) for i in range(LONGS)), F.lit(0))
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b)) & (7 * distance <= a + b)


def sets_of_nodes(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, each from one document that has the set."""
    keys = small(cut(nodes.join(wanted, "node", "left_semi").select("doc_key", "text_key"), "wanted"))
    chosen = docs.select(F.col(text_col), *document_key("_id", text_col)).join(keys, ["doc_key", "text_key"], "left_semi")
    return cut(sets_of(chosen, text_col).dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, sets: DataFrame | None = None) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose sets have a Jaccard index of 3/4 or more. sets: sets_of_nodes of them, read from docs if not given."""
    facts = nodes.select("node", "n_shingles", *SKETCH)
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in facts.columns[1:]]), side)
    pairs = cut(pairs.filter(close_enough()).select("a", "b"), "pairs")
    if sets is None:
        sets = sets_of_nodes(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), text_col)
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.filter(100 * both >= 75 * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def undecided(shared: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the sets that may be linked with one of another component.

    Sets of two components share keys that members of both have. Each set leaves out the `spare` of these with most members: of the more
    than `spare` keys that linked sets share, the one with fewest members is left out by neither. A key's roots are compared by a partial
    aggregate, so a key that very many sets have goes through no single task.
    """
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("key", "node", "root", "members")
    for step in range(2):
        mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
        rooted = rooted.join(small(cut(mixed, "mixed")), "key", "left_semi")
        if step == 0:
            heaviest = F.row_number().over(W.partitionBy("node").orderBy(F.desc("members"), "key"))
            rooted = cut(rooted.withColumn("nth", heaviest).join(nodes.select("node", "spare"), "node").filter("nth > spare").select("key", "node", "root"), "lighter")
    return rooted.select("node", "root").distinct()


def met_shingles(sets: DataFrame) -> DataFrame:
    """(node, shingle, members) of the shingles that several of these sets have; members is their number."""
    rows = sets.select("node", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("members")).filter("members > 1")
    return cut(rows.join(shared, "shingle"), "met")


def hub_pairs(open_nodes: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each open set with the most central set that has one of its shingles, where that is of another component.

    A set is the more central the more sets have its shingles, on average: in a family of near copies that is the one with fewest edits, to which
    most of the others are linked. So a family becomes one component by as many pairs as it has members, times the hubs of its shingles.
    """
    central = met.groupBy("node").agg(F.sum("members").alias("m")).join(open_nodes, "node").select("node", "root", (F.col("m") / F.col("n")).alias("central"))
    central = small(cut(central, "central"))
    hub = met.join(central, "node").groupBy("shingle").agg(F.max(F.struct("central", "node", "root")).alias("hub")).select("shingle", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root"))
    pairs = met.select("node", "shingle").join(hub, "shingle").filter("node <> hub").select("node", "hub", "hub_root").distinct().join(central, "node").filter("root <> hub_root")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def rare_pairs(open_nodes: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that share one of their rarest shingles, by the number of these sets that have them.

    Linked sets share o >= 3/7 (|A| + |B|) shingles, so the first that they share, in order of rarity, is among the first |A| - o + 1 of A and
    |B| - o + 1 of B: a seventh and one of the smaller set, a quarter and one of the larger. They meet within classes of sizes. Shingles that only
    one component has come first in that order, and their number is all that is needed of them.
    """
    open_nodes = small(cut(open_nodes, "roots"))
    mixed = met.join(open_nodes, "node").groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("shingle")
    each = W.partitionBy("node")
    rows = met.join(mixed, "shingle", "left_semi").withColumns({"k": F.row_number().over(each.orderBy("members", "shingle")), "in_all": F.count("*").over(each)})
    rows = rows.join(open_nodes, "node").withColumn("nth", F.col("n") - F.col("in_all") + F.col("k"))
    kept = cut(rows.filter("nth <= n div 4 + 1").select("shingle", "node", "root", "n", "nth"), "rare")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(4 / 3)) + 1e-9)
    named = lambda x, cls: kept.select("shingle", cls.alias("size_class"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "nth")])
    small_side = named("a", F.explode(F.array(size_class, size_class + 1))).filter("nth_a <= n_a div 7 + 1")
    within = "root_a <> root_b and (n_a < n_b or (n_a = n_b and node_a < node_b)) and 4 * n_a >= 3 * n_b and 7 * (n_a - nth_a + 1) >= 3 * (n_a + n_b) and 7 * (n_b - nth_b + 1) >= 3 * (n_a + n_b)"
    pairs = small_side.join(named("b", size_class), ["shingle", "size_class"]).filter(within)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def enough(pairs: DataFrame, slack: DataFrame) -> DataFrame:
    """The pairs (a, b) that share more keys (n) than the larger slack of their nodes, as the count of pigeons asks of linked ones."""
    for side in ("a", "b"):
        pairs = pairs.join(slack.select(F.col("node").alias(side), F.col("slack").alias(f"slack_{side}")), side)
    return pairs.filter(F.col("n") > F.greatest("slack_a", "slack_b")).select("a", "b")


def with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """edges with the m of their u. Of few edges least is broadcast; else a hub's edges are dealt out by the other end, and least, a row a node, goes to each of the SALTS parts."""
    if few:
        return edges.join(F.broadcast(least), "u")
    part = F.pmod(F.xxhash64("v"), F.lit(SALTS))
    return edges.withColumn("part", part).join(least.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))), ["u", "part"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: root is the smallest node that links reach. Alternates large and small stars until only stars are left: no node has two roots or is one beside having one."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    few = edges.count() * 64 <= BROADCAST_BYTES  # no step makes more edges
    end = lambda c, low: F.struct(F.col(c).alias("node"), F.lit(low).alias("low"), F.lit(1 - low).alias("top"))
    ends = lambda e: e.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("x")).select("x.*")
    while not ends(edges).groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top")).filter("low > 1 or (low = 1 and top = 1)").isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_least(both.filter("v > u"), least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = with_least(large, least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(star.filter("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row a document (id, keys, n_shingles, node), and (node, root) of the nodes that are linked with others."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col))
    facts = cut(set_facts(docs, "_id", text_col), "facts")
    hot = hot_keys(facts)
    shared = shared_keys(emitted_keys(docs, text_col, hot))
    nodes = cut(facts.filter("n_shingles > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n_shingles", "spare", *SKETCH)], F.min(F.struct("doc_key", "text_key")).alias("k")).select("*", "k.*").drop("k"), "nodes")
    slack = nodes.select("node", F.col("spare").alias("slack"))
    stars = shared.filter("node <> low").groupBy(F.col("low").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    stars = cut(enough(stars, slack), "stars")
    links = cut(verified(stars, nodes, docs, text_col), "links")
    roots = components(links)
    left = cut(undecided(shared, roots, nodes).join(nodes.select("node", F.col("n_shingles").alias("n")), "node"), "undecided")
    sets = sets_of_nodes(docs, nodes, left.select("node"), text_col)
    met = met_shingles(sets)
    for find in (hub_pairs, rare_pairs):
        more = cut(verified(find(left, met), nodes, docs, text_col, sets), "links")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
            left = left.select("node", "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    return facts, roots


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, doc_key, text_key, n_shingles and component_id (the smallest id that links reach, itself included).

    Null and wordless texts have no shingles and are linked with nothing, not even with each other. Rows of equal sets are one class
    and always linked. Nulls among the ids count for nothing in component_id, which is null only where no id is reached. Texts of any length are taken whole.
    """
    facts, roots = linked(docs, id_col, text_col)
    ids = cut(facts.filter("n_shingles > 0").groupBy("node").agg(F.min("_id").alias("low")), "ids")
    tops = roots.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    least = ids.join(roots.unionByName(tops), "node").groupBy("root").agg(F.min("low").alias("m"))
    few = roots.count() * 64 <= BROADCAST_BYTES
    below = with_least(roots.select(F.col("root").alias("u"), F.col("node").alias("v")), least.withColumnRenamed("root", "u"), few).select(F.col("v").alias("node"), "m")
    linked_ids = below.unionByName(least.select(F.col("root").alias("node"), "m"))
    named = ids.join(linked_ids, "node", "left").select("node", F.coalesce("m", "low").alias("component_id"))
    out = facts.join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), "doc_key", "text_key", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"))


def near_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; one without shingles, as of a null text, is alone."""
    return near_components(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id. Documents without shingles all stay, as do all rows that repeat the kept id and text."""
    near = near_components(docs, id_col, text_col)
    best = near.filter("n_shingles > 0 and component_id is not null").groupBy("component_id").agg(F.min(F.struct(F.col(id_col), F.col("doc_key"), F.col("text_key"))).alias("k"))
    kept = best.select(F.col("k.doc_key").alias("_doc_key"), F.col("k.text_key").alias("_text_key"))
    kept = kept.unionByName(near.filter("n_shingles = 0 or component_id is null").select(F.col("doc_key").alias("_doc_key"), F.col("text_key").alias("_text_key"))).distinct()
    doc_key, text_key = document_key(id_col, text_col)
    keyed = packed(docs, doc_key.alias("_doc_key"), text_key.alias("_text_key"))
    return keyed.join(small(cut(kept, "kept")), ["_doc_key", "_text_key"], "left_semi").select("_row.*")
