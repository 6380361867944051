"""Merkle manifest of a dataset by time-forward processing (operator 13).

Rows are leaves. Within each group, in order, every ARITY consecutive nodes become their parent until one is left; the groups' tops then form a tree of
their own. Both sweeps are time-forward processing: a node's label is (last leaf below it, level), so children come before their parents. Going up, a
priority queue ordered by label holds the digests that were sent to parents not yet reached; going down, in falling order of labels, it holds the steps
of the proofs that parents sent to their children.

The external part of the queue is Spark's sorted shuffle: a group is cut into blocks of 3^LEVELS neighbouring nodes, each a whole subtree, so a group that
holds most rows is dealt to many tasks, which keep one block at a time. The tops of a round's blocks are the nodes of the next round, and on the way back
the steps of a block's top are a row that sorts before the block's nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, packed, small

ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
SIZE = 32  # bytes of a digest
ROW_BITS = 33  # monotonically_increasing_id keeps a row's place in its partition in the low 33 bits


def field(col: Column) -> Column:
    """A value so that no two lists of values read alike: its UTF-8 byte count, a colon and itself; a null is a dash."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Binary sha256 of a row's fields."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def parent_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def height(size: int) -> int:
    """Levels above size nodes until one is left."""
    levels = 0
    while ARITY**levels < size:
        levels += 1
    return levels


def last_leaf(level: int, index: int, n: int) -> int:
    return min((index + 1) * ARITY**level, n) - 1


def sweep_up(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """The digests of every level, leaves first: each node sends its digest to its parent's label."""
    n = len(leaves)
    found: list[list[bytes]] = [[] for _ in range(levels + 1)]
    queue: list[tuple[int, int, int, bytes]] = []

    def made(level: int, index: int, digest: bytes) -> None:
        found[level].append(digest)
        if level < levels:
            heappush(queue, (last_leaf(level + 1, index // ARITY, n), level + 1, index, digest))

    for i, leaf in enumerate(leaves):
        made(0, i, leaf)
        while queue and queue[0][0] == i:
            level, children = queue[0][1], []
            while queue and queue[0][:2] == (i, level):
                children.append(heappop(queue)[3])
            made(level, i // ARITY**level, parent_digest(children))
    return found


def sweep_down(found: list[list[bytes]], steps: bytes) -> list[bytes]:
    """The proof of each leaf: its steps up to the top, then those given. A step is the place among the run's nodes, the number of siblings, and these."""
    n, out = len(found[0]), [b""] * len(found[0])
    queue: list[tuple[int, int, int, bytes]] = [(-last_leaf(len(found) - 1, 0, n), 1 - len(found), 0, steps)]
    while queue:
        _, level, index, steps = heappop(queue)
        level = -level
        if not level:
            out[index] = steps
            continue
        run = found[level - 1][ARITY * index : ARITY * (index + 1)]
        for k in range(len(run)):
            child = ARITY * index + k
            heappush(queue, (-last_leaf(level - 1, child, n), 1 - level, child, bytes([k, len(run) - 1]) + b"".join(run[:k] + run[k + 1 :]) + steps))
    return out


def proof_steps(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(proof):
        place, count = proof[at], proof[at + 1]
        yield place, [proof[k : k + SIZE] for k in range(at + 2, at + 2 + count * SIZE, SIZE)]
        at += 2 + count * SIZE


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and a proof lead to."""
    for place, siblings in proof_steps(proof):
        leaf = parent_digest([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df, written, with idx (place in its group, by order) and size (rows of the group).

    Rows are sorted by range over all tasks; a group's offset in each partition comes from one count a group and partition. Rows equal in group and order
    are dealt by where they were read, so that many of them do not meet in one task.
    """
    sort = [group, *order, "_tie"]
    sorted_rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = cut(sorted_rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_at", ROW_BITS).alias("_part")
    counts = rows.groupBy(part, group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    counts = cut(counts, f"{name}-counts")
    starts = cut(counts.selectExpr("_part", f"`{group}`", "_first", f"sum(_n) OVER (PARTITION BY `{group}` ORDER BY _part) - _n AS _before", f"sum(_n) OVER (PARTITION BY `{group}`) AS size"), f"{name}-starts")
    met = rows.withColumn("_part", part).join(small(starts), ["_part", group])
    return met.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group and block (columns 0 and 1) that stand together, as one batch."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        begin = 0
        for i, here in enumerate(keys):
            if here != key:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.concat_batches(held)
                held, key, begin = [], here, i
        if len(keys) > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.concat_batches(held)


def block_of(col: str = "idx") -> Column:
    return F.expr(f"{col} div {BLOCK}").alias("block")


def climb(nodes: DataFrame) -> DataFrame:
    """The tops of the blocks of nodes (g, idx, size, digest), as nodes of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in runs(batches):
            size = rows.column(2)[0].as_py()
            top = sweep_up(rows.column(3).to_pylist(), min(LEVELS, height(size)))[-1][0]
            out.append((rows.column(0)[0].as_py(), rows.column(1)[0].as_py(), -(-size // BLOCK), top))
            if len(out) == 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names, kinds = ["g", "idx", "size", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    dealt = nodes.select("g", block_of(), "size", "digest", "idx").repartition("g", "block").sortWithinPartitions("g", "block", "idx")
    return dealt.mapInArrow(run, "g string, idx long, size long, digest binary")


def descend(nodes: DataFrame, sent: DataFrame, finish: Callable[[pa.RecordBatch, list[bytes], list[bytes]], list[pa.Array]], schema: str) -> DataFrame:
    """finish's columns for every node, with the node's _row.

    nodes has g, idx, size, digest, claimed and _row; sent has (g, idx of the block's top, top, steps). finish gets a block's nodes, the top's name and the
    proof of each node.
    """
    none = F.lit(None)
    row = nodes.schema["_row"]
    rows = nodes.select("g", block_of(), "idx", "size", "digest", "claimed", "_row", none.cast("binary").alias("steps"))
    heads = sent.select("g", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), none.cast("long").alias("size"), F.col("top").alias("digest"), none.cast("binary").alias("claimed"), none.cast(row.dataType).alias("_row"), "steps")
    out_schema = StructType([row, *StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches):
            top, steps = block.column(4)[0].as_py(), block.column(7)[0].as_py()
            here = block.slice(1)
            found = sweep_up(here.column(4).to_pylist(), min(LEVELS, height(here.column(3)[0].as_py())))
            yield pa.RecordBatch.from_arrays([here.column(6), *finish(here, top, sweep_down(found, steps))], out_schema.names)

    dealt = rows.unionByName(heads).repartition("g", "block").sortWithinPartitions("g", "block", "idx")
    return dealt.mapInArrow(run, out_schema)


def pass_on(block: pa.RecordBatch, top: bytes, proofs: list[bytes]) -> list[pa.Array]:
    """The steps of every node of an upper round, for the blocks below."""
    n = len(proofs)
    return [block.column(0), block.column(2), pa.array([top] * n, pa.binary()), pa.array(proofs, pa.binary())]


class Tree:
    """The rounds of one forest: for each group of nodes (g, idx, size, digest, claimed, _row) its top, and the way back."""

    def __init__(self, nodes: DataFrame, name: str):
        self.rounds, self.done, self.name = [nodes], [], name
        while True:
            tops = cut(climb(self.rounds[-1]), f"{name}-tops{len(self.done)}")
            self.done.append(tops.filter("size = 1"))
            more = tops.filter("size > 1")
            if more.isEmpty():
                break
            self.rounds.append(more.withColumns({"claimed": F.lit(None).cast("binary"), "_row": F.struct(F.lit(True).alias("upper"))}))

    def tops(self) -> DataFrame:
        """(g, digest), one row a group."""
        out = self.done[0]
        for more in self.done[1:]:
            out = out.unionByName(more)
        return out.select("g", "digest")

    def proofs(self, sent: DataFrame, finish: Callable, schema: str) -> DataFrame:
        """finish's columns for every leaf; sent has (g, top, steps) of every group."""
        below = None
        for nodes, done in zip(reversed(self.rounds), reversed(self.done), strict=True):
            here = sent.join(done.select("g", "idx"), "g").select("g", "idx", "top", "steps")
            here = here if below is None else here.unionByName(below)
            if nodes is self.rounds[0]:
                return descend(nodes, here, finish, schema)
            below = cut(descend(nodes, here, pass_on, "g string, idx long, top binary, steps binary").drop("_row"), f"{self.name}-steps")
        raise AssertionError("a tree has a first round")


def source_steps(block: pa.RecordBatch, top: bytes, proofs: list[bytes]) -> list[pa.Array]:
    return [pa.array(proofs, pa.binary())]


def verdicts(root: bytes) -> Callable:
    """For every leaf: leaf, subroot, root, the proof, its hash, and the root that the claimed leaf leads to."""

    def finish(block: pa.RecordBatch, top: bytes, proofs: list[bytes]) -> list[pa.Array]:
        folded = [fold(x, p) for x, p in zip(block.column(5).to_pylist(), proofs, strict=True)]
        shown = [hashlib.sha256(b"".join(s for _, each in proof_steps(p) for s in each).hex().encode()).hexdigest() for p in proofs]
        n, names = len(proofs), [x.hex() for x in block.column(4).to_pylist()]
        columns = [names, [top.hex()] * n, [root.hex()] * n, shown, [x.hex() for x in folded]]
        return [*[pa.array(c, pa.string()) for c in columns], pa.array(np.array([x == root for x in folded], dtype=bool)), pa.array(proofs, pa.binary())]

    return finish


MADE = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"


def manifest(df: DataFrame, group: Column, order: list[Column], leaf: Column, claimed: Column | None = None) -> DataFrame:
    """df's rows with leaf, subroot, root, proof (see sweep_down), proof_sha256, folded_root and verified.

    Leaves of a group ascend by order, nulls first, then by digest; groups ascend by their UTF-8 bytes, the null group first. claimed is the leaf that the
    proof is tried on (by default the row's own). Equal rows have places of their own. An empty table gives none. Columns named like the new ones are
    replaced, all others kept.
    """
    made = [f.name for f in StructType.fromDDL(MADE)]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made])
    g = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    work = packed(df, g.alias("g"), *[c.alias(f"o{i}") for i, c in enumerate(order)], leaf.alias("digest"), (leaf if claimed is None else claimed).alias("claimed"))
    nodes = ranked(work, "g", [*[f"o{i}" for i in range(len(order))], "digest"], "leaves")
    groups = Tree(nodes, "groups")
    sources = groups.tops().withColumnRenamed("g", "name").withColumns({"g": F.lit(""), "claimed": F.lit(None).cast("binary")})
    upper = Tree(ranked(sources.withColumn("_row", F.struct("name", F.col("digest").alias("top"))), "g", ["name"], "sources"), "root")
    root = upper.tops().first()
    if root is None:
        return df.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(MADE)])
    start = df.sparkSession.createDataFrame([("", bytes(root["digest"]), b"")], "g string, top binary, steps binary")
    sent = cut(upper.proofs(start, source_steps, "steps binary").select(F.col("_row.name").alias("g"), F.col("_row.top").alias("top"), "steps"), "sent")
    return groups.proofs(sent, verdicts(bytes(root["digest"])), MADE).select("_row.*", *made)


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    The claimed leaf of documents whose id has an even checksum is made of the text without its line feeds; a null id has no checksum.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    own = leaf_digest(*fields, text)
    work = docs.select("doc_id", "source", own.alias("own"), F.when(tampered, leaf_digest(*fields, F.replace(text, F.lit("\n"), F.lit("")))).alias("other"))
    found = manifest(work, F.col("source"), [F.col("doc_id")], F.col("own"), F.coalesce("other", "own"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field_sql(col: str) -> str:
    return f"coalesce(octet_length(encode({col}::varchar)) || ':' || {col}, '-')"


def _climb_sql(name: str, start: str, key: str) -> str:
    """The levels of every tree: nodes (key, lvl, i, d, n), where n counts the level's nodes."""
    return f"""{name} AS (
  {start} UNION ALL
  SELECT {key}, lvl + 1, i // {ARITY}, sha256(string_agg(d, '' ORDER BY i)), (n + {ARITY - 1}) // {ARITY} FROM {name} WHERE n > 1 GROUP BY {key}, lvl, i // {ARITY}, n)"""


def _walk_sql(name: str, start: str, nodes: str, key: str) -> str:
    """Every leaf's way up: f is what its claimed digest folds to, sib the siblings so far."""
    return f"""{name} AS (
  {start} UNION ALL
  SELECT w.r, w.source, w.at // {ARITY}, w.lvl + 1, sha256(string_agg(CASE WHEN c.i = w.at THEN w.f ELSE c.d END, '' ORDER BY c.i)),
    w.sib || coalesce(string_agg(c.d, '' ORDER BY c.i) FILTER (WHERE c.i <> w.at), '')
  FROM {name} w JOIN {nodes} c ON {key} AND c.lvl = w.lvl AND c.n > 1 AND c.i // {ARITY} = w.at // {ARITY} GROUP BY w.r, w.source, w.at, w.lvl, w.f, w.sib)"""


_HEAD = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))
#: An id's checksum is even: the parity of its CRC-32, bit by bit of its decimal digits.
_EVEN = """list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k) & 1)::bigint))),
  lambda x, b: xor(x >> 1, 3988292384 * (xor(x, b) & 1))) % 2 = 1"""
DIGEST_SQL = f"""WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256({_HEAD} || {_field_sql("text")}) AS leaf,
    sha256({_HEAD} || {_field_sql(f"(CASE WHEN {_EVEN} THEN replace(text, chr(10), '') ELSE text END)")}) AS claimed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM docs),
{_climb_sql("nodes", "SELECT source, 0 AS lvl, i, leaf AS d, n FROM leaves", "source")},
subs AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_climb_sql("tops", "SELECT 0 AS k, 0 AS lvl, i, d, n FROM subs", "k")},
{_walk_sql("walk", "SELECT r, source, i AS at, 0 AS lvl, claimed AS f, '' AS sib FROM leaves", "nodes", "c.source IS NOT DISTINCT FROM w.source")},
met AS (SELECT w.r, w.source, s.i AS at, 0 AS lvl, w.f, w.sib FROM walk w JOIN nodes t ON t.source IS NOT DISTINCT FROM w.source AND t.lvl = w.lvl AND t.n = 1 JOIN subs s ON s.source IS NOT DISTINCT FROM w.source),
{_walk_sql("rise", "SELECT * FROM met", "tops", "c.k = 0")}
SELECT l.doc_id, l.leaf, s.d AS subroot, t.d AS root, sha256(v.sib) AS proof_sha256, v.f AS folded_root, v.f = t.d AS verified
FROM rise v JOIN tops t ON t.n = 1 AND t.lvl = v.lvl JOIN leaves l ON l.r = v.r JOIN subs s ON s.source IS NOT DISTINCT FROM l.source"""
