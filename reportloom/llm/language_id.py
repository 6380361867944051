"""Language identification by prediction by partial matching (operator 8).

For each language, a context tree of bytes of up to three preceding bytes is counted and then frozen. A byte's code length is that of the longest
context in which it was seen, plus an escape for every longer context that the language's tree knows (method C: a context
seen n times with q different followers gives the escape q / (n + q)). A text's code length is the sum over its bytes, in bits; the language
with the shortest one is predicted, and the score is that language's share of the summed probabilities 2^-length at equal priors.

Each language has a tree of its own, as sorted arrays: for every order the codes of the (context, byte) it has seen and their
code lengths, with all escapes resolved, and its contexts with their escapes. A tree is as large as the four-byte strings of
its sample, and there is one for every language; none is cut. A block of texts is scored by its distinct four-byte strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, small, text_of
from .textnum import Block, blocks

DEPTH = 3
SAMPLE = 3_000  # labelled documents a language, about
EVIDENCE = 16  # bytes: a text's code lengths are scaled to so many for its score, as its bytes do not stand for themselves


def found_in(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each sought code is among the sorted keys, and its place."""
    at = np.minimum(np.searchsorted(keys, sought), max(len(keys) - 1, 0))
    return (keys[at] == sought if len(keys) else np.zeros(len(sought), dtype=bool)), at


class ContextTree:
    """Frozen statistics of one language. codes: four bytes as one integer, the newest lowest, zero bytes before a text's start; n: their counts."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.seen: list[np.ndarray] = []  # by order: (context, byte)
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []  # by order
        self.escape: list[np.ndarray] = []
        for order in range(DEPTH + 1):
            code, where = np.unique(codes & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            count = np.bincount(where, weights=n)
            context, inside = np.unique(code >> 8, return_inverse=True)
            total, kinds = np.bincount(inside, weights=count), np.bincount(inside)
            self.seen.append(code)
            self.cost.append(np.log2((total + kinds)[inside] / count))
            self.contexts.append(context)
            self.escape.append(np.log2((total + kinds) / kinds))

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the newest byte of each code, after the others."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(DEPTH, -1, -1):
            code = codes[left] & (1 << 8 * (order + 1)) - 1
            hit, at = found_in(self.seen[order], code)
            out[left[hit]] += self.cost[order][at[hit]]
            left, code = left[~hit], code[~hit]
            known, at = found_in(self.contexts[order], code >> 8)
            out[left[known]] += self.escape[order][at[known]]
        out[left] += 8  # a byte that the language never had: one of 256
        return out


def text_lengths(block: Block, trees: list[ContextTree]) -> np.ndarray:
    """Bits of each text (rows) in each language."""
    out = np.zeros((block.n, len(trees)))
    full = np.flatnonzero(np.diff(block.off) > 0)
    if len(full):
        codes, where = np.unique(four_bytes(block), return_inverse=True)
        for k, tree in enumerate(trees):
            out[full, k] = np.add.reduceat(tree.lengths(codes)[where], block.off[full], dtype=np.float64)
    return out


def shifted(s: np.ndarray, off: np.ndarray, by: int) -> np.ndarray:
    """Each place's symbol so many places before in the same text, 0 before its start."""
    out = np.zeros_like(s)
    out[by:] = s[:-by]
    for k in range(by):
        at = off[:-1] + k
        at = at[at < off[1:]]
        out[at] = 0
    return out


def four_bytes(block: Block) -> np.ndarray:
    s = block.data.astype(np.int64)
    return sum((shifted(s, block.off, k) if k else s) << (8 * k) for k in range(DEPTH + 1))


def training_rows(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of about so many labelled documents a language, chosen by a hash of their id and text."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.octet_length(text_of()) > 0)).select("doc_id", "lang", "text")
    counts = small(cut(known.groupBy("lang").agg(F.count("*").alias("n")), "languages"))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    return known.join(counts, "lang").filter(draw < F.lit(sample) / F.col("n")).select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, ContextTree]:
    """The tree of every language of the documents outside the held-out fifth that have a language and a text, by the number of bytes learned from, most first.

    sample bounds what is learned from: about so many documents a language. Their four-byte strings are counted by tasks; a language's counts, one row for each
    distinct string, come to the driver together with the others'. An empty table gives no tree.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, language = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            for block in blocks(batch.column(1)):
                each = np.repeat(language[block.at : block.at + block.n].astype(np.int64), np.diff(block.off))
                code, n = np.unique((each << 32) | four_bytes(block), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[code >> 32], pa.string()), pa.array(code & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    counted = training_rows(docs, sample).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    trees = {lang: (g["n"].sum(), ContextTree(g["code"].to_numpy(dtype=np.int64), g["n"].to_numpy(dtype=np.float64))) for lang, g in counted.groupby("lang")}
    return {lang: trees[lang][1] for lang in sorted(trees, key=lambda x: (-trees[x][0], x))}


def predict(docs: DataFrame, trees: dict[str, ContextTree], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, held_out, lang_pred and score of every document.

    Null texts, texts without a letter and all texts if nothing was learned are "und" with score 0. Ties go to the language learned from more bytes.
    An empty table gives none. The id keeps its name unless another output has it; then it is called id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema[id_col].dataType.simpleString()
    name = id_col if id_col not in ("held_out", "lang_pred", "score") else "id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, trees = list(shared.value), list(shared.value.values())
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False)
            names = np.full(batch.num_rows, "und", dtype=object)
            score = np.zeros(batch.num_rows)
            for block in blocks(batch.column(2)) if trees else ():
                bits = text_lengths(block, trees)
                best, size = bits.argmin(axis=1), np.maximum(np.diff(block.off), EVIDENCE)[:, None]
                share = 1 / np.exp2((bits.min(axis=1, keepdims=True) - bits) * EVIDENCE / size).sum(axis=1)
                for i in np.flatnonzero(letters[block.at : block.at + block.n]):
                    names[block.at + i], score[block.at + i] = languages[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], [name, "held_out", "lang_pred", "score"])

    text = text_of(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(f"`{id_col}`").alias("held_out"), text.alias("text"), F.rlike(text, F.lit(r"\p{L}")).alias("letters"))
    return slim.mapInArrow(run, f"`{name}` {kind}, held_out boolean, lang_pred string, score double")


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by trees of the documents outside the held-out fifth; null texts are "und"."""
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, train(docs))
