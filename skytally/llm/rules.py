"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule is a share of the text in hundredths (symbols, repeated lines, words in repeated windows, capitals) and rejects
above a cutoff. Cutoffs are chosen for each stratum on labelled holdouts: a cutoff is certified if the good documents of
the stratum that it rejects, k of n, would be so few only with probability P(Bin(n, risk) <= k) <= level, that is, if the
exact binomial upper bound on its false rejections is at most ``risk``. Cutoffs are tested from lenient to strict and the
test stops at the first failure (fixed sequence, no correction needed within a rule); over all rules and strata the level
is divided by their number (Bonferroni), and the total risk by the number of rules. So with probability 1 - ``level`` the
rules together reject at most ``total`` of the good documents of every stratum. Of the certified cutoffs the one that
gains most on the holdout, poor documents rejected less good ones, is used; a stratum with too few labels gets none.

Texts are read once; their measures are a narrow table which calibration and verdict both use.

Defined results: null text has no words (and fails the base rule). A null stratum is one of its own. A document labelled
more than once counts with its lowest label; labels with a null are left out. Repeated rows give repeated results, and
count once for each row in the holdout. Without labels only the base rule rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytally.llm.common import SPACE, split_words, stage

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Rules: name, measure and its whole.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}


def measure(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_capitals."""
    content = F.coalesce(F.col(text), F.lit(""))
    cut = df.select(*keep, content.alias("__text"), split_words(F.col(text), SPACE).alias("__w"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = cut.select(
        *keep,
        F.size("__w").alias("__n"),
        F.length(F.array_join("__w", "")).alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("__text", r"[^A-Z]+", "")).alias("n_capitals"),
        lines.alias("__lines"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__g"),
    )
    # Windows by their place; reading neighbours by index keeps this linear in the number of words.
    hashed = counted.select(
        *keep, "__n", "word_chars", "n_symbols", "n_capitals", "__lines",
        F.when(F.col("__n") >= WINDOW, F.transform("__g", lambda x, i: F.when(i <= F.size("__g") - WINDOW, F.xxhash64(x, *(F.get("__g", i + k) for k in range(1, WINDOW)))))).alias("__all"),
    )
    found = hashed.select("*", F.when(F.col("__n") >= WINDOW, F.slice("__all", 1, F.greatest(F.lit(1), F.col("__n") - (WINDOW - 1)))).alias("__h")).drop("__all")
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    ordered = found.select("*", F.when(repeated, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("__s")).drop("__h")
    twice = F.filter("__s", lambda x, k: (F.get("__s", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("__s", k + 1)["h"].eqNullSafe(x["h"])))
    placed = ordered.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__at")).drop("__s")
    cover = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct((acc["n"] + x + WINDOW - F.greatest(x, acc["to"])).alias("n"), (x + WINDOW).alias("to")),
        lambda acc: acc["n"],
    )
    number = lambda c: c.cast("long")
    return placed.select(
        *keep,
        number(F.col("__n")).alias("n_words"),
        number(F.col("word_chars")).alias("word_chars"),
        number(F.col("n_symbols")).alias("n_symbols"),
        number(F.size("__lines")).alias("n_lines"),
        number(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        number(F.coalesce(cover, F.lit(0))).alias("n_repeat_words"),
        number(F.col("n_capitals")).alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def hundredths(rule: str) -> Column:
    """The measure as a share of its whole, in hundredths rounded down, 100 at most; 0 of nothing."""
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.least(F.lit(100).cast("long"), F.floor(F.col(part) * 100 / F.col(whole)))).otherwise(F.lit(0)).cast("int")


def log_gamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series eight further up, where it is good to 1e-13."""
    y = x + 8.0
    low = sum((F.ln(x + k) for k in range(1, 8)), F.ln(x))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed downwards from k until terms no longer count; 1 from the mean on."""
    import math

    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(60 * F.sqrt(n * p) + 60)).cast("int")
    odds = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (k - i) / (n - k + i + 1) * odds).alias("term")),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", label: str = "quality", total: float = 0.01, level: float = 0.05) -> DataFrame:
    """Rows (stratum, rule, cutoff) of the cutoffs in use: a rule rejects above its cutoff. 101 counts a stratum and rule
    are all that is ordered."""
    known = labels.select(F.col(key).alias("__key"), F.col(label).alias("__good")).dropna().groupBy("__key").agg(F.min("__good").alias("__good"))
    held = measured.where(~base_failed()).join(known, measured[key] == known["__key"])
    shares = F.array(*(F.struct(F.lit(rule).alias("rule"), hundredths(rule).alias("share")) for rule in RULES))
    counts = held.select(F.col(stratum).alias("stratum"), "__good", F.inline(shares)).groupBy("stratum", "rule", "share").agg(
        F.count(F.when(F.col("__good") != 0, 1)).alias("good"), F.count(F.when(F.col("__good") == 0, 1)).alias("poor")
    )
    # A cutoff c rejects shares above c. Only shares that occur (and 100, which rejects nothing) can make a difference.
    families = F.count(F.when(F.col("__first"), 1)).over(W.partitionBy(F.lit(0)))
    by = W.partitionBy("stratum", "rule").orderBy(F.desc("share"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    tested = counts.select(
        "stratum", "rule", F.col("share").alias("cutoff"),
        F.coalesce(F.sum("good").over(before), F.lit(0)).alias("k"),
        F.coalesce(F.sum("poor").over(before), F.lit(0)).alias("caught"),
        F.sum("good").over(W.partitionBy("stratum", "rule")).alias("n"),
        (F.row_number().over(by) == 1).alias("__first"),
    ).select("*", families.alias("__families"))
    passes = binomial_tail(F.col("k"), F.col("n"), total / len(RULES)) <= level / F.col("__families")
    sequence = F.min(passes.cast("int")).over(W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")))
    certified = tested.select("*", sequence.alias("__ok")).where((F.col("__ok") == 1) & (F.col("caught") > F.col("k")))
    best = F.max_by("cutoff", F.struct((F.col("caught") - F.col("k")).alias("gain"), "cutoff"))
    return certified.groupBy("stratum", "rule").agg(best.alias("cutoff"))


def judge(df: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text", total: float = 0.01, level: float = 0.05) -> DataFrame:
    """Per row: key, the measures, base_failed and kept."""
    measured = stage(measure(df.select(F.col(key), F.col(stratum).alias("__stratum"), F.col(text)), (key, "__stratum"), text), "measures")
    cutoffs = calibrate(measured, labels, "__stratum", key, total=total, level=level)
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"__{rule}") for rule in RULES))
    joined = measured.join(wide, measured["__stratum"].eqNullSafe(wide["stratum"]), "left")
    above = [F.coalesce(hundredths(rule) > F.col(f"__{rule}"), F.lit(False)) for rule in RULES]
    rejected = above[0] | above[1] | above[2] | above[3]
    failed = base_failed()
    return joined.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
