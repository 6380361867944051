"""Whitening, packing and the Merkle manifest against brute force on small fixtures: nulls, odd vectors, long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from compare import oracle_rows, spark_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportloom.llm import merkle, packing, whitening
from reportloom.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")
rng = random.Random(11)
VECTORS = "vec_id long, embedding array<float>, whitened string, n string"


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "w", "n") for i, v in rows], VECTORS.replace("float", kind))


def check_whitening(spark, rows, n_components):
    """The digest against numpy over the sound rows of the given dimension."""
    got = whitening.whitening_digest(vectors(spark, rows, "double")).collect()
    sound = [(i, v) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v)) and len(v) == 3]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in sound]
    fit = np.array(sorted({tuple(v) for v in x}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    by_row = defaultdict(list)
    for r in got:
        by_row[r["vec_id"], r["component"]].append(r)
    assert len(got) == len(sound) * n_components
    signs = {}
    for (i, _), row in zip(sound, x, strict=True):
        for k in range(n_components):
            r = by_row[i, k + 1][0]
            want = float((np.array(row) - sums / n) @ v[:, k] / math.sqrt(e[k]))
            sign = signs.setdefault(k, 1 if abs(want) < 1e-9 or r["whitened"] * want > 0 else -1)
            assert abs(r["whitened"] * sign - want) < 1e-7 and r["n"] == n and abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-4
            assert r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(row, sums.tolist(), strict=True))


def test_whitening(spark):
    rows = [(k, [rng.gauss(0, 1), rng.gauss(0, 0.3), rng.gauss(2, 0.1)]) for k in range(40)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [1.0, float("-inf"), 2.0]), (94, [1.0, 2.0]), (95, []), (96, [1.0, 2.0, 3.0, 4.0])]
    check_whitening(spark, [*rows, *odd, (7, rows[7][1]), (None, rows[3][1]), (41, rows[3][1])], 3)
    # a dimension that does not vary has no component; two vectors have one
    check_whitening(spark, [(k, [v[0], 1.0, v[2]]) for k, v in rows], 2)
    check_whitening(spark, [(0, [0.0, 0.0, 0.0]), (1, [1.0, -1.0, 0.5])], 1)


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whitening_digest(vectors(spark, rows)).count() == 0


def test_exact_sums(spark):
    huge = [[3.0e38, -3.0e38], [1.0, 2.0], [-1.5, 0.25], [2.0e16, 7.0]]
    model = whitening.fit_whitening(vectors(spark, list(enumerate(huge)), "double"), components=2)
    top = 2**63 - 1 - 1_000_000
    x = [[max(-(2**63), min(math.floor(64 * c), top)) + 1_000_000 for c in v] for v in huge]
    assert [model.n * f + r for f, r in zip(model.floor, model.rest, strict=True)] == [sum(c) for c in zip(*x, strict=True)]
    got = whitening.whiten(vectors(spark, list(enumerate(huge)), "double"), model).collect()
    assert len(got) == 4 and all(r["deviation"] is None for r in got) and got[0]["n"] == "n"  # beyond a long; a column named like one of the digest stays
    z = np.array([[3, -2], [0, 5], [10**6, 7]])
    assert whitening.square_sums(z) == [9 + 10**12, 4 + 25 + 49, 1 + 25 + (10**6 + 7) ** 2] and whitening.plain_sums(z) == [1_000_003, 10]
    big = z * 2**40
    assert whitening.square_sums(big) == [v * 2**80 for v in whitening.square_sums(z)]
    # covariance from variances of sums, against the definition
    fit = np.array([[rng.randint(-9, 9) for _ in range(5)] for _ in range(30)])
    floor = [int(s) // 30 for s in fit.sum(axis=0)]
    made = whitening.covariance(30, [int(s) % 30 for s in fit.sum(axis=0)], whitening.square_sums(fit - np.array(floor)))
    assert np.allclose(made, np.cov(fit.T, bias=True), rtol=1e-13, atol=1e-13)


# ---- packing -------------------------------------------------------------------------------------------------------------------------------------------


def prose(n):
    return " ".join("".join(rng.choice("abcdefgh éßñ'1.,&")[0] for _ in range(rng.randint(1, 9))) for _ in range(n))


TEXTS = [
    None, "", " ", "a", "It's we're I'LL  don''t '' \"'s", "İstanbul ĲSSEL ſ ŉ é é äb\ttab\x1cq", "a<|endoftext|>b <|startoftext|>", "日本語テキスト ΟΔΟΣ １２３ ①²", "x" * 3000, "'s'T'Re\r\n a", prose(9000), prose(5000),
    *[prose(rng.randint(1, 900)) for _ in range(60)], *["same text here"] * 40,
]


def check_pieces(rows, texts, capacity=4096):
    """Every id lies in one piece, sequences have no gap and need no padding, and they are numbered through."""
    made = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*made.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0 and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    short = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at < capacity and at & (at - 1) == 0
        short += at < capacity
    assert set(by_sequence) == set(range(len(by_sequence))) and short <= 12
    return by_doc


def test_packing(spark):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, start string").repartition(3)
    by_doc = check_pieces(packing.packing_digest(docs, WORDS).collect(), texts)
    assert sum(len([r for r in x if r["length"] < 4096]) > 1 for x in by_doc.values()) < len(texts) / 2  # most documents stay whole
    # small sequences, columns that clash with the pieces' own, and the pieces' ids
    tokens = packing.tokenise(docs, WORDS, capacity=64, width=8)
    pieces = packing.pack(tokens, capacity=64, width=8)
    flat = pieces.select("_row.doc_id", "_row.start", F.col("start").alias("at"), "length", "sequence", "offset", "n")
    assert flat.filter("start <> 'x'").count() == 0 and flat.groupBy("sequence").agg(F.sum("length").alias("s")).filter("s <> 64 and s not in (1, 2, 4, 8, 16, 32)").count() == 0
    made = Tokenizer.from_file(WORDS)
    whole = defaultdict(list)
    for r in packing.piece_ids(tokens, pieces).join(tokens.select("part", "at", F.col("_row.doc_id").alias("doc")), ["part", "at"]).collect():
        whole[r["doc"]].append((r["start"], r["ids"]))
    assert all([i for _, ids in sorted(whole[k]) for i in ids] == [*made.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items())


@pytest.mark.parametrize("texts", [[], [None], ["word"] * 5, ["a " * 4095], ["a " * 4095] * 3 + ["b"], ["a " * 2999] * 9, ["a " * 20000]])
def test_packing_of_few(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(packing.packing_digest(docs, WORDS).collect(), dict(enumerate(texts)))


def test_repeated_ids_and_rows(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "other"), (None, None)], "doc_id long, text string")
    got = packing.packing_digest(docs, WORDS).collect()
    assert sum(r["length"] for r in got) == 3 + 3 + 2 + 1 and {r["doc_id"] for r in got} == {1, None}


def test_linear_program():
    # ten of each of three sizes fit four to a sequence only if mixed: 3 + 3 + 4 = 10
    sizes, demand = np.array([3, 4]), [20, 10]
    patterns, often = packing.fewest(sizes, np.array(demand, dtype=float), 10)
    assert np.allclose(patterns @ often, demand) and abs(often.sum() - 10) < 1e-9
    for seed in range(30):
        r = random.Random(seed)
        sizes = np.array(sorted(r.sample(range(1, 129), r.randint(1, 40))))
        demand = [r.randint(1, 400) for _ in sizes]
        found = packing.whole_patterns(sizes, demand, 128)
        assert [sum(c[i] * n for c, n in found) for i in range(len(sizes))] == demand and all(np.dot(c, sizes) <= 128 and n > 0 for c, n in found)
        patterns, often = packing.fewest(sizes, np.array(demand, dtype=float), 128)
        assert np.allclose(patterns @ often, demand) and sum(n for _, n in found) <= often.sum() + len(sizes)
        # no pattern is worth more than a sequence at the program's prices
        prices = np.linalg.inv(patterns).sum(axis=0)
        assert packing.best_pattern(sizes, prices, 128)[0] <= 1 + 1e-6
    a = np.array([[2.0, 1.0], [0.0, 3.0]])
    assert np.allclose(packing.inverted(a) @ a, np.eye(2))


# ---- Merkle manifest -----------------------------------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def brute_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for doc, source, lang, n, text in rows:
        head = "".join(map(said, (doc, source, lang, n)))
        spoiled = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        groups[source].append(((doc is not None, doc or 0), sha(head + said(text)), sha(head + said(spoiled)), doc))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])

    def path(tree, i):
        for level in tree[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            yield i % 3, run[: i % 3] + run[i % 3 + 1 :]
            i //= 3

    for j, s in enumerate(order):
        for i, (_, own, claimed, doc) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            steps = [*path(trees[s], i), *path(top, j)]
            for k, others in steps:
                claimed = sha("".join([*others[:k], claimed, *others[k:]]))
            yield doc, own, trees[s][-1][0], top[-1][0], sha("".join(x for _, others in steps for x in others)), claimed, claimed == top[-1][0]


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(spark, rows):
    docs = spark.createDataFrame(rows, MANIFEST).withColumns({"leaf": F.lit("x"), "g": F.lit(3), "root": F.lit(None).cast("int")}).repartition(3)
    return sorted((tuple(r) for r in merkle.manifest_digest(docs).collect()), key=repr)


def test_manifest(spark, monkeypatch):
    rows = [(k, rng.choice([None, "", "web", "wéb", "a:b"]), rng.choice([None, "en", "é"]), rng.choice([None, k]), rng.choice([None, "", "a\nb", "x\n" * 50, "größe", f"text {k}\n"])) for k in range(120)]
    rows += [(None, "web", None, None, "no id\n"), (None, "web", None, None, "no id\n"), (5, "web", "en", 1, "other\n"), (5, "web", "en", 1, "other\n"), (10**15, "alone", None, None, "y" * 100_000 + "\n")]
    want = sorted(brute_manifest(rows), key=repr)
    assert manifest_rows(spark, rows) == want and any(not r[-1] for r in want) and any(r[-1] for r in want)
    # blocks of three leaves: many rounds up and down
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    assert manifest_rows(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(2, "a", "b", 3, "c\n"), (1, "b", "b", 3, "c\n")], [(k, "s", None, None, "t") for k in range(4)]])
def test_manifest_of_few(spark, rows):
    assert manifest_rows(spark, rows) == sorted(brute_manifest(rows), key=repr)


def test_sweeps():
    for n in (1, 2, 3, 4, 9, 10, 26, 27, 28, 80):
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        found = merkle.sweep_up(leaves, merkle.height(n))
        assert [[d.hex() for d in level] for level in found] == levels_of([d.hex() for d in leaves])
        assert all(merkle.fold(leaf, proof) == found[-1][0] for leaf, proof in zip(leaves, merkle.sweep_down(found, b""), strict=True))


def test_manifest_equals_its_sql(spark):
    assert spark_rows(llm_queries.queries()["op13_merkle_manifest"](spark, SF)) == oracle_rows(llm_queries.oracle_sql()["op13_merkle_manifest"], SF)
