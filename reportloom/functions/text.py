"""Text rules over columns: normalisation, extraction, comparison of values. No Python runs on the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Forms that are one and the same sign.
SIGNS_FROM = "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻×－–—−＜＞“”‘’Ω"
SIGNS_TO = "01234567890123456789+-x----<>\"\"''Ω"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

HAN = "一-鿿"
WORD = r"[\p{L}\p{N}_]"

# Units, how they are also written (a blank stands for one that may be there), and where: in any text, as a word, as a
# word or after a number, or after a number only (before anything or before no letter).
UNIT_SPELLINGS = (
    ("μg/mL", "μ+ μ* g / m L", "text"), ("μg/mL", "u g / m L", "word"), ("μL", "u L", "word"), ("mL", "ml", "anywhere"), ("ms", "ms", "anywhere"), ("ns", "ns", "anywhere"),
    ("μs", "[μu] (?:u )?s", "number, no letter"), ("Hz", "hz", "number"), ("V", "v", "number"), ("A", "a", "number"),
)
#: Units that stand next to their number, without a blank.
JOINED_UNITS = "μg/mL|mL|ms|ns|Hz|V|A|Ω"
# What recognition misreads, as patterns, and what it was.
MISREAD_SIGNS = ((r"(?<=[0-9])\s*士\s*(?=[0-9])", "±"), (r"(?<=[0-9])M ?Q(?![\p{L}\p{N}_])", "MΩ"))
MISREAD_VALUES = (
    (r"(?i)(?<![\p{L}\p{N}_])ohm(?![\p{L}\p{N}_])|欧姆", "Ω"), (r"ρ ?(?=\()", "p"), (r"(?<=[<>=≤≥]) ?[lI|](?= ?[μu])", "1"),
    (r"([0-9](?:\.[0-9]+)?) ?(?:''|\"\"|″|“|”|＂)+", "$1\""),
)
MISREAD_OHMS = (
    (r"(?<=[0-9]) ?([MK]?)(?:Q2|(?<=[MK])2)(?![\p{L}\p{N}_])", "$1Ω"), (r"(?<=[0-9]) ?2(?=Ω(?![\p{L}\p{N}_]))", ""),
    (r"(电阻值) ?([-+]?[0-9]+(?:\.[0-9]+)?)2(?=[。；;，, ]|$)", "$1<=$2Ω"),
)
MISREAD_WORDS = ((r"KMnO ?\)", "KMnO4)"), (r"之 ?4 ?差", "之差"))


def gaps(*sides: tuple[str, str]) -> tuple[str, str]:
    """The rule that takes out a blank between a left and a right side; an empty side is anything."""
    return " (?:" + "|".join((f"(?<={left} )" if left else "") + (f"(?={right})" if right else "") for left, right in sides) + ")", ""


def unit_rules() -> list[tuple[str, str]]:
    """Each unit's spellings become the unit, and blanks between numbers and units go."""
    before = {"text": "", "word": f"(?<!{WORD})", "anywhere": r"(?<![\p{L}_])", "number": "(?<=[0-9]) ?", "number, no letter": "(?<=[0-9]) ?"}
    after = {"text": "", "word": f"(?!{WORD})", "anywhere": f"(?!{WORD})", "number": f"(?!{WORD})", "number, no letter": "(?![A-Za-z])"}
    rules = [(f"(?i){before[place]}(?:{spelling.replace(' ', ' ?')}){after[place]}", unit) for unit, spelling, place in UNIT_SPELLINGS]
    return [*rules, gaps(("[0-9]", f"(?:{JOINED_UNITS})(?!{WORD})"))]


#: The normaliser's steps, in order: patterns and replacements. From "spaces" on, white space is single blanks.
STEPS: dict[str, list[tuple[str, str]]] = {
    "join_breaks": [(r"\n(?<=[^\n。！？；：.!?;:]\n)(?=[^\n0-9])", " ")],
    "signs": [("[≤≦⩽]", "<="), ("[≥≧⩾]", ">="), *MISREAD_SIGNS],
    "headings": [(rf"(?m)^([{HAN}A-Za-z0-9/（）()]{{2,20}}?)(?:\s*\1)+(?=应|[<>≤≥=])", "$1")],
    "unit_notes": [(r"(?U)(?:^|\s)单位\s*[：:]\s*[A-Za-z0-9μuΩ/%²³\-.()]+", " ")],
    "spaces": [(r"(?U)\s+", " ")],
    "units": [
        *MISREAD_VALUES, gaps(("[A-Za-z]", "[0-9]"), ("[0-9]", r"[+\-]"), ("[cp]", r"\("), (r"[cp] ?\(", ""), ("", r"\)"), ("", "="), ("[=<>]", "(?:=|[0-9])"), ("=", "")),
        *unit_rules(), *MISREAD_OHMS, gaps((r"[A-Za-z0-9μΩ/\])+\-]", f"[{HAN}]")), *MISREAD_WORDS,
    ],
    "inner_spaces": [gaps((f"[{HAN}]", f"[{HAN}]"))],
    "punctuation": [(r" (?:(?=[，。！？；：])|(?<=[，。！？；：] )(?![\"'»]))", ""), (rf"(?<=[{HAN}A-Za-z0-9)])[:：](?=应符合)", "")],
}


def said(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def computed(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """df with the columns made, each computed once a row: filters and joins read them, and none is pushed into their expressions, as it would be through a projection.

    They are made in a lambda: long chains of patterns as generated code are methods too long to be compiled by the JVM, and run slower than the expressions themselves.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return df.select(*rest, F.explode(F.transform(F.array(F.lit(0)), lambda _: F.struct(*[v.alias(k) for k, v in made.items()]))).alias("_made")).select(*rest, "_made.*")


def once(col: Column, use: Callable[[Column], Column]) -> Column:
    """use(col) with col computed once, however often use names it."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def replaced(col: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, col)


def strip(col: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def compact(col: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(said(col), r"(?U)\s+", "")


#: Texts that no step changes: Chinese and Latin letters, and single blanks between Latin ones, without signs that rules look for and without words that are units.
PLAIN = rf"^(?:[A-Za-z]|[{HAN}&&[^应单欧]]|(?<=[A-Za-z]) (?=[A-Za-z]))*\z"
UNIT_WORDS = rf"(?i)(?<!{WORD})(?:u ?l|m ?[lq]|ms|ns|ohm)(?!{WORD})"


def normalize(col: Column | str) -> Column:
    """The eight steps in order; texts that none of them changes are told by two patterns. Missing counts as empty."""
    return once(said(col), lambda t: F.when(F.rlike(t, F.lit(PLAIN)) & ~F.rlike(t, F.lit(UNIT_WORDS)), t).otherwise(every_step(t)))


def every_step(col: Column | str) -> Column:
    text = F.translate(said(col), FULL_WIDTH, HALF_WIDTH)
    for step, rules in STEPS.items():
        if step == "signs":
            text = F.translate(text, SIGNS_FROM, SIGNS_TO)
        text = replaced(text, rules)
    return strip(text)


def normalize_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """N1 over a column. The steps are separate projections, so that the generated code of each stays small."""
    out = out or col
    df = df.withColumn(out, F.translate(said(col), FULL_WIDTH, HALF_WIDTH))
    for step, rules in STEPS.items():
        text = F.translate(F.col(out), SIGNS_FROM, SIGNS_TO) if step == "signs" else F.col(out)
        df = df.withColumn(out, replaced(text, rules))
    return df.withColumn(out, strip(F.col(out)))


def rule_audit(df: DataFrame, col: str) -> DataFrame:
    """How many rows each step of N1 would change by itself, and how many characters it would take off."""
    steps = [(name, replaced(F.translate(said(col), SIGNS_FROM, SIGNS_TO) if name == "signs" else said(col), rules)) for name, rules in STEPS.items()]
    cells = F.array(*[F.struct(F.lit(name).alias("step"), (changed != said(col)).alias("changed"), (F.length(said(col)) - F.length(changed)).alias("taken")) for name, changed in steps])
    each = df.select(F.explode(cells).alias("c")).select("c.*")
    return each.groupBy("step").agg(F.count_if("changed").alias("n_rows"), F.sum("taken").alias("n_chars"))


def text_equal(a: Column | str, b: Column | str) -> Column:
    """Equal after normalisation, white space aside."""
    return compact(normalize(a)) == compact(normalize(b))


# Signs that recognition confuses, and the right sign.
CORRECTIONS = ((r"[\+-]", "±"), ("≦|⩽", "≤"), ("≧|⩾", "≥"), ("µ", "μ"), ("Ω", "Ω"), ("℉", "℃"))


def correct_symbols(df: DataFrame, col: str) -> DataFrame:
    """The column corrected, and warnings: (symbol, n) of every sign that was changed."""
    warned = F.array_compact(F.array(*[F.when(F.rlike(said(col), F.lit(p)), F.struct(F.lit(r).alias("symbol"), F.regexp_count(said(col), F.lit(p)).alias("n"))) for p, r in CORRECTIONS]))
    return df.withColumn("warnings", warned).withColumn(col, replaced(said(col), list(CORRECTIONS)))


def symbol_summary(df: DataFrame, col: str, id_col: str, contexts: int = 5) -> DataFrame:
    """Per corrected sign its count, rows, and the first few contexts by id (a top-k report)."""
    found = F.array(*[F.struct(F.lit(r).alias("symbol"), F.regexp_count(said(col), F.lit(p)).alias("n"), F.regexp_extract(said(col), f"(.{{0,10}}(?:{p}).{{0,10}})", 1).alias("context")) for p, r in CORRECTIONS])
    each = df.select(F.col(id_col).alias("id"), F.explode(found).alias("f")).select("id", "f.*").filter("n > 0")
    totals = each.groupBy("symbol").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows"))
    first = each.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy("id", "context"))).filter(F.col("k") <= contexts)
    return totals.join(first.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "context"))), lambda x: x["context"]).alias("contexts")), "symbol")


# Words at the end of a caption that are no part of the name.
SUFFIXES = ("中文标签样张", "中文标签", "标签样张", "标签", "主机背面", "主机正面", "主机侧面", "背面", "正面", "侧面", "照片")


def match_name(col: Column | str, kind: str = "component") -> Column:
    """A component's or label's name for matching."""
    text = compact(normalize(col)) if kind == "component" else normalize(col)
    if kind == "label":
        text = F.regexp_replace(text, r"(?i)^(?:№|no\.?|图|photo|plate|fig\.?)\s*\d+\s*", "")
        return compact(F.regexp_replace(text, "(中文标签样张|中文标签|标签样张|标签)$", ""))
    for suffix in SUFFIXES:
        text = F.regexp_replace(text, f"(?<=.){suffix}$", "")
    return F.regexp_replace(text, "(?<=.)主机$", "")


def split_scope(col: Column | str) -> Column:
    """Items between commas and enumeration marks outside brackets, in order, each once. Unbalanced brackets are taken by depth."""
    balanced = F.regexp_extract_all(said(col), F.lit(r"((?:[^,，、（()）]|[（(][^（()）]*[）)])+)"), F.lit(1))
    nested = F.rlike(said(col), F.lit(r"[（(][^）)]*[（(]")) | (F.regexp_count(said(col), F.lit("[（(]")) != F.regexp_count(said(col), F.lit("[）)]")))

    def step(acc: Column, ch: Column) -> Column:
        depth = F.greatest(F.lit(0), acc["depth"] + F.when(ch.isin("(", "（"), 1).when(ch.isin(")", "）"), -1).otherwise(0))
        ends = ch.isin(",", "，", "、") & (acc["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(ends, F.concat(acc["items"], F.array(acc["open"]))).otherwise(acc["items"]).alias("items"), F.when(ends, "").otherwise(F.concat(acc["open"], ch)).alias("open"))

    walked = F.aggregate(F.split(said(col), "", -1), F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("items"), F.lit("").alias("open")), step, lambda a: F.concat(a["items"], F.array(a["open"])))
    return F.array_distinct(F.filter(F.transform(F.when(nested, walked).otherwise(balanced), strip), lambda x: x != ""))


def exclusion_ranges(pages: DataFrame, first_page: int = 4) -> DataFrame:
    """(report_id, lo, hi) of 序号N~序号M on the first page that has any, the given page before all others; single numbers where there is no range."""
    text = said("raw_text")
    pattern = r"序号\s*(\d+)\s*[~～\-—至]\s*(?:序号)?\s*(\d+)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("lo"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("hi"))
    singles = F.regexp_extract_all(text, F.lit(r"序号\s*(\d+)"), F.lit(1))
    found = F.when(F.size(pairs) > 0, pairs).otherwise(F.arrays_zip(singles.alias("lo"), singles.alias("hi")))
    rows = pages.withColumn("_found", found).filter(F.size("_found") > 0)
    best = rows.groupBy("report_id").agg(F.min_by("_found", F.struct(F.col("page_no") != first_page, F.col("page_no"))).alias("_found"))
    return best.select("report_id", F.explode("_found").alias("r")).select("report_id", F.col("r.lo").cast("int").alias("lo"), F.col("r.hi").cast("int").alias("hi")).distinct()


# Months that recognition garbles, and what they were.
MONTHS = {"13": "12", "14": "11", "15": "10", "16": "10", "17": "11", "18": "12", "19": "10"}


def date_format_of(col: Column | str) -> Column:
    """The form of a date."""
    d = F.trim(said(col))
    return F.when(F.rlike(d, F.lit(r"^\d{8}$")), "YYYYMMDD").when(F.contains(d, F.lit(".")), "YYYY.MM.DD").when(F.contains(d, F.lit("/")), "YYYY/MM/DD").when(F.contains(d, F.lit("-")), "YYYY-MM-DD").otherwise("UNKNOWN")


def parse_date(col: Column | str) -> Column:
    """The date, or null."""
    d = F.trim(said(col))
    y, m, day = (F.regexp_extract(d, r"^(\d{4})([./-]?)(\d{1,2})\2(\d{1,2})$", g) for g in (1, 3, 4))
    plain = F.when(F.rlike(d, F.lit(r"^\d{8}$")), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(day, 2, "0")))
    return F.to_date(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")))


def normalize_dates(df: DataFrame, col: str) -> DataFrame:
    """Normalized (yyyy-MM-dd or null) and changed: six and eight digits and separated forms; garbled months and days past the month's end are repaired."""
    d = F.regexp_replace(F.trim(said(col)), r"[年月./]", "-")
    d = F.regexp_replace(d, "日$", "")
    year = lambda yy: F.when(yy.cast("int") < 50, F.concat(F.lit("20"), yy)).otherwise(F.concat(F.lit("19"), yy))
    six, eight, parts = F.rlike(d, F.lit(r"^\d{6}$")), F.rlike(d, F.lit(r"^\d{8}$")), F.rlike(d, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$"))
    y = F.when(six, year(F.substring(d, 1, 2))).when(eight, F.substring(d, 1, 4)).when(parts, F.split_part(d, F.lit("-"), F.lit(1)))
    m = F.when(six, F.substring(d, 3, 2)).when(eight, F.substring(d, 5, 2)).when(parts, F.lpad(F.split_part(d, F.lit("-"), F.lit(2)), 2, "0"))
    day = F.when(six, F.substring(d, 5, 2)).when(eight, F.substring(d, 7, 2)).when(parts, F.lpad(F.split_part(d, F.lit("-"), F.lit(3)), 2, "0"))
    fixed_m = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in MONTHS.items() for x in p]), m), m)
    start = F.to_date(F.try_to_timestamp(F.concat_ws("-", y, fixed_m, F.lit("01")), F.lit("yyyy-MM-dd")))
    last = F.dayofmonth(F.last_day(start))
    fixed = F.when(day.cast("int") >= 1, F.date_add(start, F.least(day.cast("int"), last) - 1))
    out = df.withColumn("normalized", F.date_format(fixed, "yyyy-MM-dd"))
    return out.withColumn("changed", F.coalesce((fixed_m != m) | (day.cast("int") > last), F.lit(False)))


def repair_codes(col: Column | str) -> Column:
    """Letters O beside digits in the last part of a code are zeros."""
    return F.regexp_replace(said(col), r"(?<=\d)[Oo](?=[\dOo]*$)|(?<=[-_])[Oo](?=\d+$)", "0")


NUMBER = r"[-+]?\d+(?:\.\d+)?"
CANDIDATE = rf"((?:[<>]=?|[≤≥])?\s*{NUMBER}(?:\s*(?:~|～|±)\s*\d+(?:\.\d+)?%?)?\s*(?:mA|mL|mm|ms|kHz|MHz|Hz|MΩ|kΩ|Ω|μs|μg/mL|℃|%|V|A|W)?)"


EVIDENCE = rf"((?:[<>]=?)?\s*{NUMBER}(?:\s*[~～至到-]\s*{NUMBER})?(?:\s*±\s*\d+(?:\.\d+)?%?)?(?:\s*(?i:EU/套|mL|mm|cm|kHz|MHz|Hz|kg|ohm|Ω|°|EU|套|N|V|A|m|g))?)"


def numeric_candidates(df: DataFrame, col: str) -> DataFrame:
    """One row a distinct numeric expression of the text, in order of first appearance (pos)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(said(col), F.lit(CANDIDATE), F.lit(1)), F.trim))
    return df.select("*", F.posexplode(found).alias("pos", "candidate"))


def candidates(text: Column) -> Column:
    """The numeric expressions of a text, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(replaced(text, [("[≤≦]", "<="), ("[≥≧]", ">=")]), F.lit(EVIDENCE), F.lit(1)), F.trim))


def numbers_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def interval_of(text: Column) -> Column:
    """struct(lo, hi, lo_open, hi_open) of a constraint such as <=2, 20~350, 100±20% or 2.5±0.1; null if it is none."""
    t = F.regexp_replace(replaced(compact(text), [("[≤≦]", "<="), ("[≥≧]", ">="), ("＜", "<"), ("＞", ">"), ("[～至]", "~")]), r"(?<=\d)[-—](?=\d)", "~")
    n = lambda pattern, g=1: F.regexp_extract(t, pattern, g).try_cast("double")
    pct, abs_, span = rf"({NUMBER})[^\d±]*±(\d+(?:\.\d+)?)%", rf"({NUMBER})[^\d±]*±(\d+(?:\.\d+)?)", rf"({NUMBER})[^\d~]*~\+?({NUMBER})"
    make = lambda lo, hi, a=False, b=False: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), F.lit(a).alias("lo_open"), F.lit(b).alias("hi_open"))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    has = lambda p: F.rlike(t, F.lit(p))
    return (
        F.when(has(pct), make(n(pct) - F.abs(n(pct)) * n(pct, 2) / 100, n(pct) + F.abs(n(pct)) * n(pct, 2) / 100))
        .when(has(abs_), make(n(abs_) - n(abs_, 2), n(abs_) + n(abs_, 2)))
        .when(has(span), make(F.least(n(span), n(span, 2)), F.greatest(n(span), n(span, 2))))
        .when(has(rf"<=\s*{NUMBER}"), make(low, n(rf"<=\s*({NUMBER})")))
        .when(has(rf">=\s*{NUMBER}"), make(n(rf">=\s*({NUMBER})"), high))
        .when(has(rf"<\s*{NUMBER}"), make(low, n(rf"<\s*({NUMBER})"), False, True))
        .when(has(rf">\s*{NUMBER}"), make(n(rf">\s*({NUMBER})"), high, True, False))
    )


def satisfies(expected: Column, actual: Column) -> Column:
    """Whether the actual value or interval meets the expected constraint; null if one of them has no number.

    A deviation written with a sign (+0.03, -0.02~+0.06) is held against the tolerance of an expected a±b, not against its value.
    """
    want, t = interval_of(expected), compact(actual)
    signed, delta = F.rlike(t, F.lit(r"^[+\-]")), F.contains(compact(expected), F.lit("±")) & ~F.contains(compact(expected), F.lit("%"))
    middle = F.when(signed & delta, (want["lo"] + want["hi"]) / 2).otherwise(0.0)
    got = interval_of(actual)
    first = F.get(numbers_of(t), F.lit(0))
    lo = F.coalesce(F.when(F.rlike(t, F.lit("[~～±]|\\d[-—]\\d")), got["lo"]), first) + middle
    hi = F.coalesce(F.when(F.rlike(t, F.lit("[~～±]|\\d[-—]\\d")), got["hi"]), first) + middle
    above = F.when(want["lo_open"], lo > want["lo"]).otherwise(lo >= want["lo"] - 1e-9)
    below = F.when(want["hi_open"], hi < want["hi"]).otherwise(hi <= want["hi"] + 1e-9)
    return F.when(want.isNotNull() & first.isNotNull(), above & below)


def eval_constraint(df: DataFrame, expected: str, actual: str, out: str = "satisfied") -> DataFrame:
    return df.withColumn(out, satisfies(F.col(expected), F.col(actual)))


# Words of a bound, and its sign.
BOUND_WORDS = (("不应超过|应不超过|不超过|应不大于|不大于|小于等于|应≤|≤|<=", "<="), ("应不小于|不小于|大于等于|应≥|≥|>=", ">="), ("应小于|小于|<", "<"), ("应大于|大于|>", ">"))
PLACEHOLDERS = ("", "/", "—", "——", "-", "--")


def values_match(df: DataFrame, a: str, b: str) -> DataFrame:
    """Match and match_rule: placeholder, equal, compact, constraint (either way), numbers, unit_free, or null where nothing fits."""
    na, nb = normalize(a), normalize(b)
    ca, cb = F.lower(compact(na)), F.lower(compact(nb))
    bare = lambda c: F.regexp_replace(c, r"(?i)(mA|mL|mm|ms|kHz|MHz|Hz|MΩ|kΩ|Ω|μs|℃|%|V|A|W)$", "")
    both_blank = F.trim(said(a)).isin(*PLACEHOLDERS) & F.trim(said(b)).isin(*PLACEHOLDERS)
    numbers = lambda c: numbers_of(compact(c))
    rule = (
        F.when(both_blank, "placeholder").when(na == nb, "equal").when(ca == cb, "compact")
        .when(F.coalesce(satisfies(F.col(a), F.col(b)), F.lit(False)) | F.coalesce(satisfies(F.col(b), F.col(a)), F.lit(False)), "constraint")
        .when((F.size(numbers(na)) > 1) & (numbers(na) == numbers(nb)), "numbers").when((bare(ca) == bare(cb)) & (bare(ca) != ""), "unit_free")
    )
    return df.withColumn("match_rule", rule).withColumn("match", F.col("match_rule").isNotNull())


def agree(a: Column, b: Column) -> Column:
    """N19 of two values that are normalised already: both placeholders, equal but for white space, one meets the other's constraint, the same numbers, or equal without units."""
    ca, cb = compact(a), compact(b)
    bare = lambda c: F.regexp_replace(c, "[A-Za-zμΩ/%]+", "")
    meets = lambda x, y: F.coalesce(satisfies(x, y), F.lit(False))
    blank = strip(a).isin(*PLACEHOLDERS) & strip(b).isin(*PLACEHOLDERS)
    numbers = (F.size(numbers_of(ca)) > 0) & (numbers_of(ca) == numbers_of(cb))
    return blank | (ca == cb) | meets(a, b) | meets(b, a) | numbers | ((bare(ca) != "") & (bare(ca) == bare(cb)))


def numeric_expectation(text: Column) -> Column:
    """What a normalised requirement demands of a number: a tolerance, a range or a bound (<=20Ω), without white space; empty if nothing."""
    value = rf"{NUMBER}(?:[A-Za-zμΩ°/套]+)?"
    found = lambda pattern: compact(F.regexp_extract(text, f"({pattern})", 1))
    bound = lambda words: compact(F.regexp_extract(text, rf"(?:{words})\s*({value})", 1))
    bounds = [F.when(bound(words) != "", F.concat(F.lit(sign), bound(words))) for words, sign in BOUND_WORDS]
    tolerance, span = found(rf"{value}\s*±\s*{NUMBER}(?:%|[A-Za-zμΩ°/套]+)?"), found(rf"{value}\s*[~～至到-]\s*{value}")
    return F.coalesce(F.nullif(tolerance, F.lit("")), F.nullif(span, F.lit("")), *bounds, F.lit(""))


# Characters that recognition confuses, and the one that stands for them.
CONFUSED = ("OIL|SB", "011158")


def code_class(col: Column | str) -> Column:
    """A code with one representative for each group of confusable characters."""
    return F.translate(F.upper(compact(col)), *CONFUSED)


def code_parts(col: Column | str) -> list[Column]:
    """What code_equal asks of a code, so that it is made once a row and not once a pair: code, code_class, the digits at its end (three or more) and the length before them."""
    return bare_code_parts(compact(col))


def bare_code_parts(text: Column) -> list[Column]:
    code, suffix = F.upper(text), r"(\d{3,})$"
    return [code.alias("code"), F.translate(code, *CONFUSED).alias("code_class"), F.regexp_extract(code, suffix, 1).alias("suffix"), F.length(F.regexp_replace(code, suffix, "")).alias("before")]


def codes_equal(a: Column, b: Column) -> Column:
    """N20 of two structs of code_parts."""
    # codes of one length with one substitution; in prefixes of n characters the matching blocks are n - 1 characters
    near = (a["suffix"] != "") & (a["suffix"] == b["suffix"]) & (a["before"] >= 5) & (F.length(a["code"]) == F.length(b["code"])) & (F.levenshtein(a["code"], b["code"], 1) == 1)
    return (a["code_class"] == b["code_class"]) | near


def code_equal(a: Column | str, b: Column | str) -> Column:
    """Equal codes under confusion; one other mismatch passes if both end in the same three or more digits and the parts before agree to 4/5."""
    return codes_equal(F.struct(*code_parts(a)), F.struct(*code_parts(b)))


def clause_number(col: Column | str) -> Column:
    """The first dotted number as an array of ints; arrays compare by parts. Null if there is none."""
    dotted = F.regexp_extract(F.replace(said(col), F.lit("续"), F.lit("")), r"(\d+(?:\.\d+)*)", 1)
    return F.when(dotted != "", F.transform(F.split(dotted, r"\."), lambda p: p.try_cast("int")))


def topic_label(col: Column | str) -> Column:
    """A parameter's name without bracketed units, trailing digits and slashes."""
    return F.regexp_replace(F.regexp_replace(compact(normalize(col)), r"[（(][^）)]*[）)]", ""), r"[\d/]+$", "")


def normalize_token(col: Column | str) -> Column:
    """A header token: lower case, no white space, colons or bracketed units."""
    return F.regexp_replace(F.lower(compact(normalize(col))), r"[:：]|[（(][^）)]*[）)]", "")


def is_blank(col: Column | str, mode: str = "plain") -> Column:
    """F16: empty values; plain: nothing at all, dashes: also / and dashes, specimen: also 见实物."""
    known = {"plain": ("",), "dashes": ("", "/", "——", "-"), "specimen": ("", "/", "——", "-", "见实物")}[mode]
    return strip(said(col)).isin(*known)


def is_reference(col: Column | str) -> Column:
    """the value points to the sample description."""
    return F.rlike(compact(normalize(col)), F.lit("见.{0,4}样品描述|见样品描述栏"))


def has_alnum(col: Column | str) -> Column:
    """has both a letter and a digit."""
    return F.rlike(said(col), F.lit("[A-Za-z]")) & F.rlike(said(col), F.lit("[0-9]"))


def extract_fields(pages: DataFrame, fields: dict[str, str], page_no: int = 1) -> DataFrame:
    """One column a field (name -> label) from "label: value" or the line below, on one page of each report."""
    text = F.col("raw_text")
    values = [strip(F.regexp_extract(said(text), rf"(?U){label}\s*(?:[:：]\s*|[ \t]+|\n\s*)([^\n]+)", 1)).alias(name) for name, label in fields.items()]
    return pages.filter(F.col("page_no") == page_no).select("report_id", *values)


def display_title(col: Column | str) -> Column:
    """A clause's title: the first line if short, else its first sentence cut at 24 characters."""
    line = strip(F.split_part(said(col), F.lit("\n"), F.lit(1)))
    return F.when(F.length(line) <= 24, line).otherwise(F.substring(F.regexp_extract(line, "^([^。；;]+)", 1), 1, 24))
