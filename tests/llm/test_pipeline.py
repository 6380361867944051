"""The pipeline's stages against brute force on a small table."""

import re

from compare import oracle_rows

import corpus_pipeline
from reportloom.llm import decontaminate, line_dedup, quality_rules

SF = "/root/testdata/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "byte-level BPE" or docs.columns == columns
    names, rows = oracle_rows(quality_rules.VERDICTS_SQL, SF)
    kept = {r[names.index("doc_id")] for r in rows if r[names.index("kept")]}
    assert set(seen["quality rules"]) == kept
    lines = seen["line dedup"]
    assert set(lines) <= kept and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    # line dedup by brute force over what the rules kept: windows of three lines with a word, every place but the first covered
    given, first, gone = seen["quality rules"], set(), {}
    for i in sorted(given):
        solid = [k for k, x in enumerate(given[i]["text"].split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        bare = [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", given[i]["text"].split("\n")[k]) for k in solid]
        for k in range(len(bare) - min(3, len(bare)) + 1 if bare else 0):
            window = tuple(bare[k : k + 3])
            if window in first:
                gone.setdefault(i, set()).update(solid[k : k + 3])
            first.add(window)
    left = {i: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone.get(i, ())) for i, r in given.items()}
    assert {i: r["text"] for i, r in lines.items()} == {i: t for i, t in left.items() if i not in gone or re.search(r"[^\x20\x09-\x0D]", t)}
    near = {i: sets(r["text"]) for i, r in lines.items()}
    root = {i: i for i in near}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(near)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near[a] and near[b] and 100 * len(near[a] & near[b]) >= 75 * len(near[a] | near[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(seen["n-gram Jaccard join"]) == {i for i in near if find(i) == i or not near[i]}
    assert set(seen["benchmark decontamination"]) <= set(seen["n-gram Jaccard join"]) and set(seen["byte-level BPE"]) == set(seen["benchmark decontamination"])
    names, rows = oracle_rows(decontaminate.DIGEST_SQL, SF)
    dirty = {r[names.index("doc_id")] for r in rows if r[names.index("contaminated")]}
    whole = {i for i in seen["n-gram Jaccard join"] if seen["line dedup"][i]["text"] == seen["quality rules"][i]["text"]}
    assert {i for i in whole if i not in seen["benchmark decontamination"]} == whole & dirty
    assert line_dedup.LINES == 3
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(seen["byte-level BPE"])


def test_stages_on_an_empty_table_and_other_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, _row string, t string, doc_key string, text_key string, node string"
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(2, words, "en", "a", 1, "r", "t", "d", "k", "n"), (1, words + " more", "en", "b", 1, "r", "t", "d", "k", "n"), (3, None, "en", None, None, "r", "t", "d", "k", "n"), (4, "", None, None, 0, None, None, None, None, None), (None, "x " * 40 + words[::-1], "en", "b", 1, "r", "t", "d", "k", "n")]
    full = spark.createDataFrame(rows, kind)
    for docs, kept in ((full, [1]), (full.limit(0), [])):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "byte-level BPE" or docs.columns == columns
        assert sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None) == kept
