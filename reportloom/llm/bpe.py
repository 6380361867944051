"""Byte-level BPE encoding and decoding (operator 6).

A text is cut into overlapping chunks, which tasks pre-tokenise. Pre-tokens depend on nothing before their start, so two
chunks agree from the first boundary on that both have: there they are stitched. Should an overlap have no common
boundary, the text from the last sure boundary on is pre-tokenised again until one is met. Then the pieces between the
stitched boundaries are encoded. A text of one chunk needs no stitch and no shuffle. Decoding concatenates the ids' bytes.

The ranks are read on the driver and broadcast, so executors need no file; their size is the vocabulary's. The merges of a
piece are remembered per task, in two generations of bounded size, and forgotten at its end: Python workers stay alive between
tasks and stages, and what they hold counts as the executor's memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import let, packed, text_of

CHUNK, OVERLAP = 8_192, 256  # characters
REMEMBERED = 50_000  # pieces in each of two generations
RECENT = 8  # long texts and chunks whose ids and lengths a task remembers
AHEAD = 3  # characters that a pre-token's choice may look at beyond its start: the longest contraction


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(ranks, pattern)


class Tokenizer:
    """Ranks (lines of a token in base64 and its rank), pattern and the remembered ids of pieces."""

    def __init__(self, ranks: bytes, pattern: str):
        rank_of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=rank_of, special_tokens={}).encode_ordinary  # one piece at a time
        self.bytes_of = {rank: token for token, rank in rank_of.items()}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def starts(self, text: str) -> np.ndarray:
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), dtype=np.int64)

    def ids(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= REMEMBERED:  # pieces not met for a generation are forgotten, frequent ones stay
                self.known, self.older = {}, self.known
            found = self.known[piece] = self.older.get(piece) or self.merge(piece)
        return found

    def encode(self, pieces: Iterator[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            out += self.known.get(piece) or self.ids(piece)
        return out

    def forget(self) -> None:
        """Give back what was remembered, and the memory of Arrow batches that are gone."""
        self.known, self.older = {}, {}
        pa.default_memory_pool().release_unused()

    def pieces(self, text: str, chunks: list[np.ndarray] | None, chunk: int, overlap: int) -> Iterator[str]:
        """The pre-tokens of a text: of its only chunk, or by the starts that its chunks have."""
        if chunks is None:
            return iter(self.pattern.findall(text))
        cuts = stitched(chunks, text, self.pattern, chunk, overlap)
        return (text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def stitched(chunks: list[np.ndarray], text: str, pattern: regex.Pattern, chunk: int, overlap: int) -> list[int]:
    """The starts of all pre-tokens of a text, from those of its overlapping chunks (places in the text, in order)."""
    out: list[int] = []
    at = 0  # a sure boundary
    for k, here in enumerate(chunks):
        while at < len(text) and len(here) and at <= here[-1]:  # no boundary of this chunk yet: pre-tokenise on from the sure one
            i = int(np.searchsorted(here, at))
            if here[i] == at:
                break
            out.append(at)
            at = pattern.match(text, at).end()
        else:
            continue
        if k + 1 == len(chunks):
            return out + here[i:].tolist()
        # what the chunk's end may have changed: its last pre-token, and those that could have looked beyond it
        sure = min(len(here) - 1, int(np.searchsorted(here, (k + 1) * chunk + overlap - AHEAD, "right")))
        later = here[i : sure + 1]
        later = later[later >= (k + 1) * chunk]
        met = later[np.isin(later, chunks[k + 1])]
        end = int(np.searchsorted(here, met[0])) if len(met) else max(sure, i)
        out += here[i:end].tolist()
        at = int(here[end])
    while at < len(text):
        out.append(at)
        at = pattern.match(text, at).end()
    return out


TOKENS = "ids array<int>, decoded binary"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def results(ids: list[list[int]], tok: Tokenizer, digest: bool) -> list[pa.Array]:
    decoded = [tok.decode(x) for x in ids]
    if not digest:
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(byte_form(x)) for x in ids], pa.string()), pa.array([sha(x) for x in decoded], pa.string())]


def read_ranks(spark: SparkSession, path: str):
    """The rank file, which the driver reads, for all tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def packed_lengths(starts: np.ndarray, end: int) -> bytes:
    """The lengths of the pre-tokens between the starts and the end, one byte each if they fit, else four."""
    lengths = np.diff(np.append(starts, end))
    wide = len(lengths) and lengths.max() > 255
    return (b"\4" if wide else b"\1") + lengths.astype("<u4" if wide else "u1").tobytes()


def unpacked_starts(lengths: bytes, begin: int) -> np.ndarray:
    each = np.frombuffer(lengths, dtype="<u4" if lengths[0] == 4 else "u1", offset=1).astype(np.int64)
    return begin + np.cumsum(each) - each


def chunk_starts(texts: DataFrame, ranks, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(k0, k1, chunks) of each different text that is longer than a chunk: for each chunk, in order, the lengths of its pre-tokens. The overlap is a chunk at most.

    Each chunk is a row, and chunks are dealt out to tasks, so a very long text is pre-tokenised by many. Copies of a chunk meet in one task, which pre-tokenises one of them; a partial aggregate makes them one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value, pattern)
        recent: dict[str, bytes] = {}
        for batch in batches:
            lengths = []
            for part in batch.column(3).to_pylist():
                if part not in recent:  # copies of a chunk meet in one task
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent[part] = packed_lengths(tok.starts(part), len(part))
                lengths.append(recent[part])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths, pa.binary())], ["k0", "k1", "k", "lengths"])
        tok.forget()

    if overlap > chunk:
        raise ValueError("an overlap is not longer than a chunk")
    # cut in one pass over the text; each chunk then takes the overlap from the start of the next
    whole = F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{chunk}}})"), F.lit(1))
    parts = let(whole, lambda cs: F.transform(cs, lambda c, k: F.struct(k.alias("k"), F.concat(c, F.coalesce(F.substring(F.get(cs, k + 1), 1, overlap), F.lit(""))).alias("part"))))
    rows = texts.select("k0", "k1", F.explode(parts).alias("p")).select("k0", "k1", "p.k", "p.part")
    dealt = rows.repartition("k0", "k1", "k").mapInArrow(run, "k0 long, k1 long, k int, lengths binary")
    once = dealt.groupBy("k0", "k1", "k").agg(F.first("lengths").alias("lengths"))
    return once.groupBy("k0", "k1").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "lengths"))), lambda x: x["lengths"]).alias("chunks"))


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """The columns of df without the text, and ids (array<int>) and decoded (binary, the ids' bytes); with digest, their number and hashes instead.

    A null or empty text has no ids. Repeated rows are repeated. Columns named like the new ones are replaced; an empty table gives none. Chunks of longer
    texts, by the text's hash (128 bits), are pre-tokenised as rows of their own; their boundaries then meet the text again.
    """
    made = [x.split()[0] for x in (DIGESTS if digest else TOKENS).split(", ")]
    rest = [c for c in df.columns if c != text_col and c not in made]
    ranks = read_ranks(df.sparkSession, path)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.lit(True).alias("row"), text_of(text_col).alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value, pattern)
        recent: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                chunks = part.column(2).to_pylist() if part.num_columns > 2 else [None] * part.num_rows
                starts = [x and [unpacked_starts(c, k * chunk) for k, c in enumerate(x)] for x in chunks]
                ids = []
                for t, x in zip(part.column(1).to_pylist(), starts, strict=True):
                    if x is None:
                        ids.append(tok.encode(tok.pieces(t, x, chunk, overlap)))
                        continue
                    if t not in recent:  # copies of a long text often stand together
                        if len(recent) >= RECENT:
                            recent.clear()
                        recent[t] = tok.encode(tok.pieces(t, x, chunk, overlap))
                    ids.append(recent[t])
                yield pa.RecordBatch.from_arrays([part.column(0), *results(ids, tok, digest)], ["row", *made])
        tok.forget()

    long = rows.filter(F.length("text") > chunk).withColumns({"k0": F.xxhash64("text"), "k1": F.xxhash64(F.length("text"), "text")})
    met = long.join(chunk_starts(long, ranks, pattern, chunk, overlap), ["k0", "k1"]).select("row", "text", "chunks")
    schema = StructType([rows.schema["row"], *StructType.fromDDL(DIGESTS if digest else TOKENS)])
    out = rows.filter(F.length("text") <= chunk).mapInArrow(run, schema).unionByName(met.mapInArrow(run, schema))
    return out.select(*(["row.*"] if rest else []), *made)


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded: the bytes of the ids, one after another. Null ids count as none; a column named decoded is replaced."""
    ranks = read_ranks(df.sparkSession, path)
    rows = packed(df.select(*[F.col(f"`{c}`") for c in df.columns if c != "decoded"]), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tok.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["_row", "decoded"])

    return rows.mapInArrow(run, StructType([rows.schema["_row"], *StructType.fromDDL("decoded binary")])).select("_row.*", "decoded")


def byte_form(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


def token_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded bytes of every document; a null text counts as empty."""
    return encode_texts(docs.select("doc_id", "text"), path, pattern, digest=True)
