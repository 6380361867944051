"""Line dedup by overlapping three-line windows (operator 4).

Lines are split at newlines; a window is three consecutive lines that have a word (all such lines, if a document has
fewer), told by the hash of their texts without surrounding white space. Windows are counted globally; of those that stand more than once, every
place but the first, by document id and position, is a repeat. A document's repeats are merged into covered positions,
and the covered lines are removed.

What is shuffled is one narrow row a line; only documents with repeats get a row of marks. A window that stands in very many documents
is first reduced to its first place within each task, and its places meet that by a join which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, document_key, let, packed, settled, small, text_of

LINES = 3
HAS_WORD = r"[^\x20\x09-\x0D]"
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_windows(df: DataFrame, id_col: str, text_col: str, lines: int = LINES) -> DataFrame:
    """doc_key, text_key, id, at (index among the lines with a word), n (lines in the window) and window (two hashes, w0 and w1)."""
    solid = F.filter(F.split(text_of(text_col), "\n", -1), lambda x: F.rlike(x, F.lit(HAS_WORD)))
    hashes = F.transform(solid, lambda x: F.xxhash64(F.regexp_replace(x, EDGES, "")))

    def windows(h: Column) -> Column:
        n = F.least(F.size(h), F.lit(lines))
        one = lambda i: let(F.slice(h, i + 1, n), lambda part: F.struct(i.alias("at"), n.alias("n"), F.xxhash64(part).alias("w0"), F.hash(part).alias("w1")))
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), one)

    found = let(F.filter(F.array(hashes), lambda h: F.size(h) > 0), lambda one: F.flatten(F.transform(one, windows)))
    return df.select(F.col(f"`{id_col}`").alias("id"), *document_key(id_col, text_col), F.explode(found).alias("w")).select("id", "doc_key", "text_key", "w.*")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """doc_key, text_key and covered: the sorted indices, among a document's lines with a word, of those that repeat an earlier place."""
    windows = line_windows(df, id_col, text_col, lines)
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("doc_key").alias("doc_key"), F.col("text_key").alias("text_key"), F.col("at").alias("at"))
    first = windows.groupBy("w0", "w1").agg(F.min(place).alias("first"), F.max(place).alias("final")).filter("first <> final").select("w0", "w1", "first")
    repeats = windows.withColumn("place", place).join(first, ["w0", "w1"]).filter("place <> first")
    covered = repeats.groupBy("doc_key", "text_key").agg(F.collect_set(F.struct("at", "n")).alias("marks"))
    merged = F.array_sort(F.array_distinct(F.flatten(F.transform("marks", lambda m: F.sequence(m["at"], m["at"] + m["n"] - 1)))))
    return covered.select("doc_key", "text_key", merged.alias("covered"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """df with the text's repeated lines removed, n_lines (lines with a word before) and n_removed.

    Lines without a word stay where they are. Null texts stay null and, like empty ones, have no lines. Rows that repeat an id and a text are one
    document: its first places are theirs, so they keep the same lines. Null ids come after all others. An empty table gives none. Columns named n_lines
    or n_removed are replaced, all others kept, whatever their names.
    """
    marks = small(cut(repeated_lines(df, id_col, text_col, lines), "lines"))
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("n_lines", "n_removed")])
    out = packed(rest, F.col(f"`{text_col}`").alias("t"), *document_key(id_col, text_col)).join(marks, ["doc_key", "text_key"], "left")
    has_word = lambda x: F.rlike(x, F.lit(HAS_WORD))
    solid = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull())  # noqa: E731  places of the lines with a word

    def left(ls: Column, solid: Column) -> Column:
        """The lines whose places are not those of covered ones, joined again."""
        kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.transform("covered", lambda c: F.get(solid, c)))
        return let(kept, lambda ks: F.array_join(F.transform(ks, lambda i: F.get(ls, i)), "\n"))

    text = F.when(F.col("covered").isNull(), F.struct(F.col("t").alias("text"), F.size(solid(F.split(text_of("t"), "\n", -1))).alias("n")))
    text = text.otherwise(let(F.split(text_of("t"), "\n", -1), lambda ls: let(solid(ls), lambda s: F.struct(left(ls, s).alias("text"), F.size(s).alias("n")))))
    made = {"made": text, "n_removed": F.coalesce(F.size("covered"), F.lit(0)).cast("long")}
    out = settled(out, made, ["t", "doc_key", "text_key", "covered"])
    return out.select(F.col("_row").withField(f"`{text_col}`", F.col("made.text")).alias("_row"), F.col("made.n").cast("long").alias("n_lines"), "n_removed").select("_row.*", "n_lines", "n_removed")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines removed, without documents of which no word is left; n_chars, where there is one, follows the text.

    Documents that had no word before, null texts among them, stay.
    """
    work = packed(docs, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    left = dedup_lines(work, "id", "t").filter((F.col("n_removed") == 0) | F.rlike("t", F.lit(HAS_WORD)))
    row = F.col("_row").withField(f"`{text_col}`", F.col("t"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("t").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")))
    return left.select(row.alias("_row")).select("_row.*")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left), n_lines and n_removed of every document; of a null text null, 0 and 0."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.col("text"))


#: The digest for DuckDB.
DIGEST_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
l AS (SELECT doc_id, p, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS solid, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, unnest(range(1, len(all_lines) + 1)) AS p, unnest(all_lines) AS line FROM d)),
s AS (SELECT doc_id, p, bare, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS total FROM l WHERE solid),
g AS (SELECT doc_id, list(bare ORDER BY idx) AS bares, any_value(total) AS total FROM s GROUP BY doc_id),
w AS (SELECT doc_id, total, n, idx, bares[idx + 1:idx + n] AS win FROM (SELECT doc_id, total, bares, least(total, 3) AS n, unnest(range(0, total - least(total, 3) + 1)) AS idx FROM g)),
r AS (SELECT doc_id, n, idx, row_number() OVER (PARTITION BY win ORDER BY doc_id, idx) AS k FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(idx, idx + n)) AS idx FROM r WHERE k > 1),
gone AS (SELECT s.doc_id, s.p FROM s JOIN c ON s.doc_id = c.doc_id AND s.idx = c.idx),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = l.doc_id AND gone.p = l.p) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(g.total, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) x USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
