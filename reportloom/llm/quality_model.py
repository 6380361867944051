"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader (operator 9).

Features are hashed n-grams of words: unigrams and bigrams of the words as they stand and, as most of those are too rare to learn from, unigrams to
trigrams of the words reduced to their shape (kind of each run of characters, and whether a word repeats the one before), hashed to 2^BITS weights; a
feature's value is its share of the text's n-grams of that kind. Training is FTRL-proximal with per-weight learning rates, one row after another over a
bounded sample, whose feature vectors tasks make. A score is a sparse dot product, added up over all n-grams of the whole text at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, small, text_of
from .textnum import ODD, SOLID, U, Block, blocks, mix, sequence_hash

BITS = 18
SAMPLE = 8_000  # labelled documents that are learned from, about
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
THRESHOLD = 0.3
SCALE = 10.0
#: Kind of each byte: other letter, capital, digit, mark of a sentence, bracket or quote, any other mark.
KIND = np.full(256, 6, dtype=np.uint8)
KIND[97:123], KIND[128:], KIND[65:91], KIND[48:58] = 1, 1, 2, 3
KIND[[44, 46, 58, 59, 63]] = 4
KIND[[34, 39, 40, 41, 91, 93, 45]] = 5


def ngrams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the text and the weight's index of every occurrence, and its value."""
    words = block.words(SOLID)
    if not len(words.start):
        return
    h = words.hashes()
    kind = KIND[block.data]
    # a word's shape: its runs of kinds, in order
    change = np.concatenate([[True], kind[1:] != kind[:-1]])
    change[words.start] = True
    runs = np.flatnonzero(change)
    run_word = np.searchsorted(words.start, runs, "right") - 1
    inside = (run_word >= 0) & (runs < words.end[np.maximum(run_word, 0)])
    runs, run_word = runs[inside], run_word[inside]
    nth = np.arange(len(runs)) - np.searchsorted(run_word, run_word)
    shape = np.zeros(len(h), dtype=np.uint64)
    np.add.at(shape, run_word, mix(kind[runs].astype(np.uint64) * ODD[8] + np.minimum(nth, 6).astype(np.uint64) * ODD[9]))
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])])
    shape = mix(shape + again.astype(np.uint64) * ODD[10])
    for series, n, at in ((h, 1, 11), (h, 2, 12), (shape, 1, 13), (shape, 2, 14), (shape, 3, 15)):
        start = np.arange(len(series) - n + 1)
        start = start[words.text[start] == words.text[start + n - 1]]
        text = words.text[start]
        value = SCALE / np.maximum(words.count - n + 1, 1)
        yield text, (mix(sequence_hash(series, start, n) + ODD[at]) >> U(64 - BITS)).astype(np.int64), value[text]


def rows_of(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sparse feature vector (index, value) of each text; index 0 also carries the bias."""
    found = list(ngrams(block))
    if not found:
        return [(np.zeros(1, dtype=np.int64), np.ones(1))] * block.n
    text, index, value = (np.concatenate(x) for x in zip(*found, strict=True))
    cell, inverse = np.unique(text * (1 << BITS) + index, return_inverse=True)
    total = np.bincount(inverse, weights=value)
    first = np.searchsorted(cell, np.arange(block.n + 1) << BITS)
    return [(np.append(0, cell[a:b] & ((1 << BITS) - 1)), np.append(1.0, total[a:b])) for a, b in zip(first, first[1:], strict=False)]


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int) -> np.ndarray:
    """FTRL-proximal over the rows, in their order, so many times."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            np.add.at(z, i, g - step * w)
            np.add.at(n, i, g * g)
    return weights(slice(None))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """The weights. labels has doc_id and target (0 or 1; null rows are left out).

    Only labels outside the held-out fifth count, about `sample` of them, chosen by a hash of the id and taken in an order by another. With no labels
    all weights are 0, so every score is 1/2. Repeated rows count as often as they stand; null and wordless texts count by the bias.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out()).select("doc_id", F.col(target).cast("int").alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = small(cut(known.filter(draw < F.lit(min(1.0, sample / max(n, 1)))), "labels"))
    rows = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").select(F.xxhash64("doc_id", F.lit(2)).alias("at"), F.xxhash64("text").alias("text_key"), "y", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                found = rows_of(block)
                index, value = pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(block.at, block.n) for k in range(3)), index, value], ["at", "text_key", "y", "index", "value"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "text_key", "y"])
        w = learn([(i.astype(np.int64), x.astype(np.float64)) for i, x in zip(group["index"], group["value"], strict=True)], group["y"].tolist(), epochs)
        used = np.flatnonzero(w)
        return pd.DataFrame({"index": used, "w": w[used]})

    made = rows.mapInArrow(vectors, "at long, text_key long, y int, index array<int>, value array<float>")
    found = made.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(fit, "index int, w double").toPandas()  # at most a row a weight
    out = np.zeros(1 << BITS, dtype=np.float32)
    out[found["index"].to_numpy(dtype=np.int64)] = found["w"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The id, held_out, score (0 to 1) and predicted (1 if the score reaches the threshold) of every document. Null and wordless texts score by the bias alone.

    An empty table gives none. The id keeps its name unless another output has it; then it is called id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType.simpleString()
    name = id_col if id_col not in ("held_out", "score", "predicted") else "id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            total = np.full(batch.num_rows, float(w[0]))
            for block in blocks(batch.column(2)):
                for text, index, value in ngrams(block):
                    total[block.at : block.at + block.n] += np.bincount(text, weights=w[index] * value, minlength=block.n)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [name, "held_out", "score", "predicted"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), held_out(f"`{id_col}`").alias("held_out"), text_of(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{name}` {kind}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model of the labels outside the held-out fifth; a null text scores by the bias."""
    docs = docs.select("doc_id", "text")
    return score(docs, train(docs, labels))
