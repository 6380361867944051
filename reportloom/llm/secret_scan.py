"""Secret scans (operator 1): known forms by pattern, unknown ones by the entropy of a sliding window.

Everything is a column expression over one row: no shuffle, no Python. A pattern's places are read off the pieces
between its matches, so positions are code points.

The window slides over each candidate string (a run of key characters). Its Shannon entropy is kept through
S = sum of c log2 c over the counts c of its characters: a step takes one character off and puts one on, so two counts
and two terms of S change, and the entropy is log2 W - S / W. The counts are five bits each in a fixed number of longs, so
a step costs the same whatever the window holds. A candidate belongs to the narrowest character class that holds it, and
each class has its own threshold.

Spark copies a fold's state at every step, so no state holds anything that grows with the text: positions are added up, and
windows slid, in blocks of bounded length, and a text with very many matches takes time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, settled, text_of

# The base forms, and the least length of what they match.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Class of characters, its pattern for a whole candidate, and the least entropy (bits a character) of a suspicious window.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.1), ("letters", r"^[A-Za-z]+$", 3.8), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))
#: A candidate is no secret if it matches all the first patterns of a rule and none of the second: no letter, a UUID, a placeholder, a run of the alphabet, a path, a name of
#: words that begin with capitals (1 to 4, then 2 or more small letters). Words have 14 letters at most; a path or name of any length may end in two digits.
ALLOW = (
    ((r"^[^A-Za-z]*$",), ()),
    ((r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",), ()),
    ((r"(?i)example|placeholder|changeme|your[_-]?(?:key|token|secret)|xxxx",), ()),
    ((r"(?i)0123456789|abcdefghij",), ()),
    ((r"^[A-Za-z+/_=-]*[0-9]{0,2}$", r"[+/_=-]"), (r"[A-Za-z]{15}",)),
    ((r"^[A-Za-z]*[0-9]{0,2}$", r"[A-Z]"), (r"[a-z]{15}", r"[A-Z]{5}", r"[A-Z][a-z](?:[^a-z]|$)", r"[A-Z](?:[0-9]|$)")),
)
BLOCK = 32  # values that are added up in one fold
STRETCH = 256  # windows that are slid over in one fold
#: Counts of characters: BITS each, PACKED in a long, for ASCII from LOWEST on.
BITS, PACKED, LOWEST = 5, 12, ord("+")
LONGS = (ord("z") - LOWEST) // PACKED + 1

PLACE = "struct<start:int,rank:int,kind:string,end:int>"
RUN = "struct<from:int,to:int>"


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def plus(a: Column, b: Column) -> Column:
    return a + b


def folded(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: op(a, v))


def before(values: Column, op: Callable[[Column, Column], Column] = plus, levels: int = 3) -> Column:
    """For each value (0 or more) those before it folded by op: within blocks, and over the blocks' folds, level by level."""
    within = lambda block, off: F.transform(block, lambda v, i: op(off, folded(F.slice(block, F.lit(1), i), op)))
    if levels == 0:
        return let(values, lambda vs: within(vs, F.lit(0)))
    blocks = lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int")), lambda b: F.slice(vs, b * BLOCK + 1, F.lit(BLOCK)))
    return let(values, lambda vs: let(blocks(vs), lambda bs: F.flatten(F.zip_with(bs, before(F.transform(bs, lambda b: folded(b, op)), op, levels - 1), within))))


def places(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """Array of (start, rank, kind, end, match), code points, of the matches of pattern whose group has so many characters at least."""
    place = PLACE.replace("end:int", "end:int,match:string")
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else F.lit(None).cast("array<string>")

    def one(match: Column, i: Column, gaps: Column, starts: Column, inner: Column) -> Column:
        start = F.get(starts, i) + F.get(gaps, i)
        kept = F.length(F.get(inner, i)) >= least if group is not None else F.lit(True)
        return F.when(kept, F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(match)).alias("end"), match.alias("match")))

    def placed(found: Column) -> Column:
        steps = lambda gaps: F.transform(found, lambda match, i: F.length(match) + F.get(gaps, i))
        return let(gaps, lambda g: let(before(steps(g)), lambda starts: let(inner, lambda inn: F.transform(found, lambda match, i: one(match, i, g, starts, inn)))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(found, lambda p: p.isNotNull())).otherwise(none(place))


def bare(found: Column) -> Column:
    """Places without the matches."""
    return F.transform(found, lambda p: F.struct(*[p[c].alias(c) for c in ("start", "rank", "kind", "end")]))


def term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)


def entropy_runs(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """Array of (from, to) within the candidate, ASCII from LOWEST to z: the merged windows whose entropy reaches the threshold. Linear in its length."""
    least = (F.log2(F.lit(float(window))) - threshold) * window  # the largest S of a suspicious window
    zero = F.lit(0).cast("long")
    shift = lambda c: (c % PACKED * BITS).cast("int")
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, F.floor(c / PACKED).cast("int")), shift(c)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    unit = lambda c, k: F.when(F.floor(c / PACKED) == k, F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))).otherwise(zero)

    def slide(acc: Column, i: Column, codes: Column, first: Column) -> Column:
        """Character i comes on; the one at i - window goes off, unless the stretch, which starts at first, has not come that far."""
        on, off = F.get(codes, i), F.get(codes, F.greatest(i - window, F.lit(0)))
        full, start = i - first >= window, i - window + 1
        less = count(acc["counts"], off)
        more = count(acc["counts"], on) - F.when(full & (on == off), 1).otherwise(0)
        s = acc["s"] + F.when(full, term(less - 1) - term(less)).otherwise(0.0) - term(more) + term(more + 1)
        counts = F.transform(acc["counts"], lambda c, k: c + unit(on, k) - F.when(full, unit(off, k)).otherwise(zero))
        return let(F.when(start >= first, s <= least).otherwise(F.lit(False)), lambda high: F.struct(counts.alias("counts"), s.alias("s"), noted(acc["runs"], high, start).alias("runs")))

    def noted(runs: Column, high: Column, start: Column) -> Column:
        """runs after the window at start: a suspicious window widens the last run, if it meets that, or opens one."""
        last = F.try_element_at(runs, F.lit(-1))
        run = lambda a: F.array(F.struct(a.cast("int").alias("from"), (start + window).cast("int").alias("to")))
        widened = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), run(last["from"]))
        return F.when(~high, runs).when(start <= last["to"], widened).otherwise(F.concat(runs, run(start)))

    def stretch(codes: Column, first: Column) -> Column:
        """Runs of the windows that start at first and the STRETCH - 1 places after it."""
        begin = F.struct(F.array(*[zero] * LONGS).alias("counts"), F.lit(0.0).alias("s"), none(RUN).alias("runs"))
        upto = F.least(first + STRETCH + window - 2, F.size(codes) - 1)
        return F.aggregate(F.sequence(first, upto), begin, lambda acc, i: slide(acc, i, codes, first))["runs"]

    def merged(runs: Column) -> Column:
        """Runs of neighbouring stretches that meet become one."""
        heads = F.filter(F.transform(runs, lambda r, i: F.when((i == 0) | (r["from"] > F.get(runs, i - 1)["to"]), i)), lambda i: i.isNotNull())
        end = lambda hs, k: F.get(runs, F.coalesce(F.get(hs, k + 1), F.size(runs)) - 1)["to"]
        return let(heads, lambda hs: F.transform(hs, lambda h, k: F.struct(F.get(runs, h)["from"].alias("from"), end(hs, k).alias("to"))))

    codes = F.transform(F.split(candidate, "", -1), lambda c: F.ascii(c) - LOWEST)
    stretches = F.sequence(F.lit(0), F.floor(F.greatest(F.length(candidate) - window, F.lit(0)) / STRETCH).cast("int"))
    return let(codes, lambda cs: let(F.flatten(F.transform(stretches, lambda b: stretch(cs, b * STRETCH))), merged))


def entropy_places(text: Column, allow: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ALLOW) -> Column:
    """Places, as of `bare`, of the suspicious windows in candidates that are on no allow-list."""

    def scored(p: Column) -> Column:
        word = p["match"]
        threshold = F.coalesce(*[F.when(F.rlike(word, F.lit(pattern)), F.lit(bits)) for _, pattern, bits in CLASSES])
        spared = F.lit(False)
        for held, broken in allow:
            rule = F.lit(True)
            for pattern in held:
                rule = rule & F.rlike(word, F.lit(pattern))
            for pattern in broken:
                rule = rule & ~F.rlike(word, F.lit(pattern))
            spared = spared | rule
        runs = F.when(~spared, let(threshold, lambda bits: entropy_runs(word, bits))).otherwise(none(RUN))
        return F.transform(runs, lambda r: F.struct((p["start"] + r["from"]).alias("start"), p["rank"].alias("rank"), p["kind"].alias("kind"), (p["start"] + r["to"]).alias("end")))

    return F.flatten(F.transform(places(text, CANDIDATE, "entropy"), scored))


def find_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with base_places and all_places: arrays of (start, rank, kind, end) in order of start and kind.

    A place is the whole match. Null texts count as empty and have no places. Columns of those names are replaced, all others kept.
    """
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("base_places", "all_places")])
    out = packed(rest, text_of(text_col).alias("t"))
    t = F.col("t")
    out = out.select("_row", bare(places(t, ASSIGN, "assign", 1, 12)).alias("a"), bare(places(t, ACCESS, "access")).alias("k"), bare(places(t, HEX, "hex")).alias("h"), entropy_places(t).alias("e"))
    made = {"base_places": F.sort_array(F.concat("a", "k", "h")), "all_places": F.sort_array(F.concat("a", "k", "h", "e"))}
    return settled(out, made, ["a", "k", "h", "e"]).select("_row.*", "base_places", "all_places")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with the text's secrets, overlapping places merged, replaced by a mark. A null text stays null.

    A place lies in a merged one if an earlier place reaches beyond its start; what lies between them is read off the text's characters, each once.
    """
    found = find_secrets(packed(df, F.col(f"`{text_col}`").alias("t")), "t").withColumnsRenamed({"all_places": "ps"})
    part = lambda chars, a, b: F.array_join(F.slice(chars, a + 1, b - a), "")

    def clean(ps: Column, reach: Column, chars: Column) -> Column:
        """The pieces that no place covers: before each place that starts at or beyond the reach of the earlier ones, and after the last."""
        pieces = F.transform(ps, lambda p, i: F.when(p["start"] >= F.get(reach, i), part(chars, F.get(reach, i), p["start"])))
        end = F.array_max(F.transform(ps, lambda p: p["end"]))
        return F.concat(F.array_join(F.filter(pieces, lambda x: x.isNotNull()), mark), F.lit(mark), part(chars, end, F.size(chars)))

    reach = before(F.transform("ps", lambda p: p["end"]), F.greatest)
    cleaned = let(reach, lambda r: let(F.split(F.col("t"), "", -1), lambda chars: clean(F.col("ps"), r, chars)))
    text = F.when(F.size("ps") > 0, cleaned).otherwise(F.col("t"))
    return found.select(F.col("_row").withField(f"`{text_col}`", text).alias("_row")).select("_row.*")


def spans(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts and a digest of the base places, and all places as text. A null text counts as empty: counts of 0, the digest of no place."""
    found = find_secrets(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base_places", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(spans(F.col("base_places")), 256).alias("base_sha256"), spans(F.col("all_places")).alias("spans"))
