"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base measures come from a text's words and lines. On top of fixed base limits,
cutoffs are chosen per stratum from labelled documents: a rule rejects texts
whose measure lies above its cutoff. For each rule and cutoff of a fixed grid
the false rejections among the good labelled documents of the stratum are
counted; the exact binomial tail gives the p-value of "the rate of false
rejections is above the rule's share of ALPHA". Within a rule and stratum,
cutoffs are tested from the highest down until one fails (fixed sequence);
across rules and strata the level is DELTA divided by their number
(Bonferroni). So all cutoffs that pass are safe together with probability
1 - DELTA, and in each stratum ALPHA at most of the good texts are rejected. Of
the safe cutoffs of a rule the one is used that rejects the largest share of
labelled bad documents, less COST times the share of good ones; a rule for which
that is never positive rejects nothing.

Null and empty texts have no words and fail the base limits. A null stratum is
a stratum of its own. Without labels no rule rejects anything; an empty table has
no verdicts. Texts of any length are measured whole. Rows that repeat are
measured and judged each; each of a labelled id counts in the tests. Of cutoffs
of equal gain the highest is used; a measure equal to its cutoff passes. Only the
named columns are read, whatever else the table has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, words_of

#: Greatest rate of false rejections of a stratum, over all rules together.
ALPHA = 0.03
#: Shares of bad documents that a share of good ones must outweigh.
COST = 10
#: Probability that any of the chosen cutoffs exceeds its rate.
DELTA = 0.05
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Terms of a binomial tail that are added one by one; a geometric bound covers the rest.
TERMS = 4000
#: Measures, each a share, and the cutoffs that are tested.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
}
GRID = (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8)


def counted(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def repeated_words(words: str, window: int = WINDOW) -> str:
    """SQL: words of array column `words` that lie in windows found twice or more.

    Hashes of 2, 4 and 8 words are made from those of half the length. Only
    texts with an equal pair of windows go on: windows are sorted with their
    places, places with an equal neighbour are sorted again, and each covers what
    lies before the next, up to the window.
    """
    h, size = f"transform({words}, w -> xxhash64(w))", 1
    while size < window:
        # A one-element array binds the inner hashes, so they are made once.
        h = f"element_at(transform(array({h}), h -> if(size(h) > {size}, zip_with(slice(h, 1, size(h) - {size}), slice(h, {size + 1}, size(h) - {size}), (a, b) -> xxhash64(a, b)), cast(array() as array<bigint>))), 1)"
        size *= 2
    places = "array_sort(transform(h, (x, i) -> struct(x as x, i as i)))"
    twice = "filter(s, (e, k) -> (k > 0 and s[greatest(k - 1, 0)].x = e.x) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].x = e.x))"
    order = f"element_at(transform(array({places}), s -> array_sort(transform({twice}, e -> e.i))), 1)"
    cover = f"element_at(transform(array({order}), p -> aggregate(transform(p, (x, k) -> if(k < size(p) - 1, least({window}, p[least(k + 1, size(p) - 1)] - x), {window})), 0L, (a, x) -> a + x)), 1)"
    return f"element_at(transform(array({h}), h -> if(size(array_distinct(h)) = size(h), 0L, {cover})), 1)"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with the base measures after their own columns; columns named like them are replaced."""
    names = ("_words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bars")
    text = F.col(text_col)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keep = [c for c in docs.columns if c not in names]
    out = docs.select(*keep, words_of(text).alias("_words"), lines.alias("_lines"))
    return out.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        (F.coalesce(F.length(text), F.lit(0)) - counted(text, r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        counted(text, r"[#*$%&|<>]").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated_words("_words")).alias("n_repeat_words"),
        counted(text, r"\p{Lu}").alias("n_capitals"),
        counted(text, r"(?<![^\x20\x09-\x0D])\|(?![^\x20\x09-\x0D])").alias("n_bars"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def log_gamma(x: str) -> str:
    """SQL of ln gamma for x >= 1: Stirling's series ten places further on, less the logarithms of the steps."""
    y = f"({x} + 10D)"
    steps = " + ".join(f"ln({x} + {k}D)" for k in range(10))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)}D + 1 / (12D * {y}) - 1 / (360D * pow({y}, 3)) + 1 / (1260D * pow({y}, 5)) - ({steps}))"


def binomial_tail(k: str, n: str, p: str) -> str:
    """SQL of P(X <= k) for X binomial over n with rate p, 1 if k is not under the mean.

    The term at k comes from its logarithm and each lower one from the one above.
    Their ratios fall, so a geometric series bounds what follows TERMS terms.
    """
    top = f"exp({log_gamma(f'({n} + 1D)')} - {log_gamma(f'({k} + 1D)')} - {log_gamma(f'({n} - {k} + 1D)')} + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"
    step = f"named_struct('t', a.t * ({k} - i) * (1 - {p}) / (({n} - {k} + i + 1) * {p}), 's', a.s + a.t * ({k} - i) * (1 - {p}) / (({n} - {k} + i + 1) * {p}))"
    low = f"greatest(0D, {k} - {TERMS})"
    ratio = f"({low} * (1 - {p}) / (({n} - {low} + 1) * {p}))"
    tail = f"aggregate(if({k} >= 1, sequence(0L, cast(least({k}, {TERMS}D) as bigint) - 1), cast(array() as array<bigint>)), named_struct('t', {top}, 's', {top}), (a, i) -> {step}, a -> least(1D, a.s + a.t * {ratio} / (1 - {ratio})))"
    return f"if({k} >= {n} * {p}, 1D, {tail})"


def cutoffs(holdout: DataFrame, stratum_col: str, label_col: str, alpha: float = ALPHA, delta: float = DELTA, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(stratum, rule, cutoff, n, k, bad, caught, p_value): the chosen cutoff of each rule that has one.

    holdout: labelled documents (1: good) with their measures. They are added up
    by the grid cell of each measure before the shuffle, which holds strata x
    rules x cells rows a task; what follows works on those sums.
    """
    alike = F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(f"double({e})").alias("x")) for r, e in RULES.items()])
    each = holdout.select(F.col(stratum_col).alias("stratum"), (F.col(label_col) == 1).alias("good"), F.explode(alike).alias("m"))
    cell = F.lit(0)
    for c in grid:
        cell = cell + F.when(F.col("m.x") > c, 1).otherwise(0)
    each = each.groupBy("stratum", "m.rule", "good", cell.alias("cell")).count()
    tests = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(c).alias("cutoff")) for i, c in enumerate(grid)]))
    above = F.when(F.col("cell") >= F.col("t.i"), F.col("count")).otherwise(0)
    sums = each.withColumn("t", tests).groupBy("stratum", "rule", "t.cutoff")
    sums = sums.agg(*[F.sum(F.when(g, x).otherwise(0)).cast("double").alias(n) for n, g, x in (("n", F.col("good"), F.col("count")), ("k", F.col("good"), above), ("bad", ~F.col("good"), F.col("count")), ("caught", ~F.col("good"), above))])
    rate = alpha / len(RULES)
    tested = sums.where("n > 0").withColumn("p_value", F.expr(binomial_tail("k", "n", f"{rate!r}D")))
    tested = tested.withColumn("tests", F.size(F.collect_set(F.struct("stratum", "rule")).over(Window.partitionBy())))
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    safe = tested.withColumn("worst", F.max("p_value").over(down)).where(F.col("worst") * F.col("tests") <= delta)
    gain = F.col("caught") / F.greatest("bad", F.lit(1.0)) - COST * F.col("k") / F.col("n")
    best = F.max(F.struct(gain.alias("gain"), "cutoff", "n", "k", "bad", "caught", "p_value")).alias("b")
    return safe.groupBy("stratum", "rule").agg(best).where("b.gain > 0").select("stratum", "rule", *[f"b.{c}" for c in ("cutoff", "n", "k", "bad", "caught", "p_value")])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(id, stratum, measures, base_failed, kept) of each document. Label 1 marks a good document; repeated labels count by their largest."""
    stash = Stash(docs.sparkSession, "quality")
    slim = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    every = stash.keep(measured(slim).drop("text").withColumn("base_failed", base_failed()))
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen = cutoffs(every.where("not base_failed").join(marked, "id"), "stratum", "y", alpha, delta)
    # One row a stratum, a map of rule to cutoff.
    chosen = chosen.groupBy(F.col("stratum").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    chosen = stash.keep(chosen)
    out = every.join(chosen, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    rejected = F.lit(False)
    for rule, e in RULES.items():
        rejected = rejected | F.coalesce(F.expr(f"double({e})") > F.col("_cut")[rule], F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_s", "_cut")
