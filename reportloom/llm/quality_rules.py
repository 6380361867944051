"""Quality rules as a bitmask ledger (operator 7).

Every rule is evaluated once over the whole text. The ledger keeps the measurements and one bit a failed rule; a policy is
a version and a mask, so a new policy or an ablation reads the ledger and never the texts. All are column expressions over
one row; the ablation adds up distinct masks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, settled, text_of

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
SPAN = 8

#: Rules in the order of their bits. Each fails where its condition over the measurements holds.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("no_letters", "2 * n_letters < word_chars"),
    ("capitals", "2 * n_capitals > n_letters"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules whose failure rejects a document. v2 leaves repeated lines to line dedup, which takes out the lines and keeps the document.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
    "v2": sum(BIT.values()) & ~BIT["repeated_lines"],
}


MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals")


def measurements(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters and n_capitals (long).

    A null or empty text measures 0 throughout. Lines without a word count for nothing. Columns of those names are replaced, all others kept. Repeated rows
    are measured each; an empty table gives none.
    """
    t = F.col("_text")
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in MEASURED])
    out = packed(rest, text_of(f"`{text_col}`").alias("_text"))
    out = out.withColumns({"_words": F.filter(F.split(t, SPACE + "+", -1), lambda w: w != ""), "_lines": F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))})
    hashes = F.when(F.size("_words") >= SPAN, F.transform(F.sequence(F.lit(1), F.size("_words") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("_words", i, SPAN)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_hashes", hashes)
    # texts all of whose windows differ in hash have no repeated window; only the others compare the windows themselves
    windows = F.transform("_hashes", lambda h, i: F.struct(F.array_join(F.slice("_words", i + 1, SPAN), " ").alias("window"), i.alias("at")))
    out = out.withColumn("_sorted", F.when(F.size("_hashes") > F.size(F.array_distinct("_hashes")), F.sort_array(windows)).otherwise(F.array().cast("array<struct<window:string,at:int>>")))
    at = lambda k: F.get("_sorted", k)["window"]
    twice = F.filter("_sorted", lambda x, k: (x["window"] == F.coalesce(at(k - 1), F.lit(""))) | (x["window"] == F.coalesce(at(k + 1), F.lit(""))))
    out = out.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["at"])))
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("to")),
        lambda acc, i: F.struct((acc["words"] + i + SPAN - F.greatest(acc["to"], i)).alias("words"), (i + SPAN).alias("to")),
    )["words"]
    letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))
    measured = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered,
        "n_letters": letters,
        "n_capitals": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
    }
    made = settled(out, {k: v.cast("long") for k, v in measured.items()}, ["_text", "_words", "_lines", "_hashes", "_sorted", "_twice"])
    return made.select("_row.*", *MEASURED)


def rule_ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its measurements and fail_bits: bit i is set where rule i of RULES fails. A null or empty text fails the rule of few words alone."""
    bits = sum((F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)) for name, condition in RULES), F.lit(0))
    return measurements(df, text_col).withColumn("fail_bits", bits.cast("long"))


def passes(version: str) -> Column:
    """True where the ledger's row passes the policy of that version."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0


def apply_policies(ledger: DataFrame, versions: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """The ledger with one boolean kept_<version> for each policy."""
    return ledger.withColumns({f"kept_{v}": passes(v) for v in versions})


def ablation(ledger: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents it rejects, and those that only it rejects, so that dropping it would keep them.

    Documents are first counted by mask, of which there are at most 2^rules. Rows count each, repeated or not; an empty ledger gives no rule.
    """
    masks = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name, _ in RULES if BIT[name] & POLICIES[version]]))
    each = masks.select("mask", "n", rules.alias("r")).select("mask", "n", "r.rule", "r.bit")
    failed = F.col("mask").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))


def quality_verdicts(docs: DataFrame, version: str = "v2") -> DataFrame:
    """One row a document: its measurements, bits, base_failed and kept. A null text has no words, so it fails the base rules."""
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return rule_ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(version)).alias("kept"), "n_lines", "n_letters", "n_capitals", "fail_bits"
    )


def keep_good(docs: DataFrame, version: str = "v2", text_col: str = "text") -> DataFrame:
    """docs without those that the policy of that version rejects; null and empty texts fail its rule of few words."""
    ledger = rule_ledger(packed(docs, F.col(f"`{text_col}`").alias("_t")), "_t")
    return ledger.filter(passes(version)).select("_row.*")


#: The same verdicts for DuckDB.
VERDICTS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n >= 2),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT)
  + 16 * CAST(word_chars > 40 * n_words AS BIGINT) + 32 * CAST(2 * n_letters < word_chars AS BIGINT) + 64 * CAST(2 * n_capitals > n_letters AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & ~8 = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_letters AS BIGINT) AS n_letters,
  CAST(n_capitals AS BIGINT) AS n_capitals, fail_bits FROM b
"""
