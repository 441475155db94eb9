"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts decide first (too few words, too many repeated words). Then every rule has a measure from 0 to 1000 and a grid of cutoffs,
from lenient to strict. A document is rejected by a rule if its measure is above the cutoff chosen for its stratum. Cutoffs are chosen on labelled
documents: for each stratum and rule, the grid is tested from lenient to strict, and a cutoff is certified while the exact
binomial probability of so few rejected good documents, were the true rate `risk / rules`, is at most
`error / (strata * rules)`. The first cutoff that fails ends the walk (fixed-sequence testing), so the correction is over
strata and rules only, and with probability 1 - error no stratum loses more than `risk` of its good documents. Strata without
enough labels certify nothing and keep all.

Defined results: null, empty and blank texts have no words and fail the base rule; texts are taken whole; a null stratum is a stratum of its own; of
several labels of one id the smallest counts, a repeated document is judged by the same rules each time; null ids are
judged and teach nothing; empty tables give no rows or no cutoffs. Other columns of the input are not looked at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgate.llm.common import Scratch, match, quoted, unused

#: Share of the good documents of a stratum that may be rejected, and the probability that any stratum exceeds it.
RISK, ERROR = 0.02, 0.1
#: White space between words, and the symbols that are counted, fixed values.
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Rules: measure in thousandths from the counts, and cutoffs from lenient to strict. A measure above the cutoff rejects.
RULES = {
    "symbols": ("n_symbols * 1000 div greatest(word_chars, 1)", [500, 300, 200, 100, 50, 20, 10]),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", [450, 400, 350, 300, 250, 200, 150]),
    "lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", [900, 800, 700, 600, 500, 400, 350]),
    "sameness": ("1000 - n_distinct * 1000 div greatest(n_words, 1)", [950, 900, 800, 700, 600, 550, 500]),
    "capitals": ("n_capitals * 1000 div greatest(word_chars, 1)", [900, 700, 500, 400, 300, 200]),
    "shouts": ("n_shouts * 1000 div greatest(word_chars, 1)", [500, 300, 200, 100, 50, 20, 10]),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_shouts"]


def _less(chars: str) -> Column:
    """Characters of the text that are not among the given ones."""
    return F.char_length(F.translate("t", chars, ""))


def counts(text: Column, rows: DataFrame, *carried: Column) -> DataFrame:
    """The carried columns and the counts of every row. Each step is a projection of its own, so no array is built twice."""
    rows = rows.select(*carried, F.coalesce(text, F.lit("")).alias("t"))
    kept = rows.columns[:-1]
    rows = rows.select(
        *kept,
        F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: F.translate(line, BLANKS, "") != "").alias("lines"),
        _less(BLANKS).alias("word_chars"),
        (F.char_length("t") - _less(SYMBOLS)).alias("n_symbols"),
        (F.char_length("t") - _less("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
        (F.char_length("t") - _less("!?")).alias("n_shouts"),
    )
    kept += ["word_chars", "n_symbols", "n_capitals", "n_shouts"]
    windows = "if(size(w) < 3, cast(array() AS array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))"
    rows = rows.select(
        *kept, F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.expr(windows).alias("h"),
    )
    kept += ["n_words", "n_distinct", "n_lines", "n_dup_lines"]
    # Sorted by hash, equal windows are neighbours. Most texts repeat none and are done with one set of hashes.
    same = "sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    rows = rows.select(*kept, F.expr(f"if(size(array_distinct(h)) = size(h), NULL, {same})").alias("s"))
    repeated = "filter(s, (x, j) -> get(s, j - 1).h = x.h OR get(s, j + 1).h = x.h)"
    rows = rows.select(*kept, F.expr(f"sort_array(transform({repeated}, x -> x.i))").alias("at"))
    # Each repeated window covers the words up to the next one, three at most.
    covered = "aggregate(transform(at, (p, j) -> least(3, coalesce(get(at, j + 1) - p, 3))), 0L, (a, x) -> a + x)"
    rows = rows.select(*kept, F.coalesce(F.expr(covered), F.lit(0)).alias("n_repeat_words"))
    return rows.select(*kept[: len(carried)], *[F.col(c).cast("bigint").alias(c) for c in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def measure(rule: str) -> Column:
    return F.expr(RULES[rule][0])


def _ln_factorial(n: str) -> str:
    """ln n!, exact up to 20 and by Stirling's series beyond, where it is right to 14 digits."""
    x = f"({n} + 1D)"
    series = f"({x} - 0.5) * ln({x}) - {x} + 0.9189385332046727 + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5))"
    return f"if({n} <= 20, ln(factorial(cast(least({n}, 20) AS int))), {series})"


def binomial_tail(k: str, n: str, p: float) -> Column:
    """Probability of at most k of n, each with probability p, summed exactly from the largest term down. 1 from the mean on,
    where the true value is too large to certify anything."""
    largest = f"exp({_ln_factorial(n)} - ({_ln_factorial(k)}) - ({_ln_factorial(f'({n} - {k})')}) + {k} * ln({p}D) + ({n} - {k}) * ln({1 - p}D))"
    step = f"s.term * i / ({n} - i + 1) * {(1 - p) / p}D"
    terms = f"if({k} < 1, cast(array() AS array<bigint>), sequence({k}, 1L, -1L))"
    total = f"aggregate({terms}, struct({largest} AS term, {largest} AS total), (s, i) -> struct({step} AS term, s.total + {step} AS total), s -> s.total)"
    return F.expr(f"if({k} >= {n} * {p}D, 1D, {total})")


def choose_cutoffs(judged: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff) of the certified cutoffs. judged: doc_id, stratum and counts; labels: 1 for good documents, 0 for bad ones.
    Documents that fail the base rule are not in the holdout, as no cutoff decides about them."""
    scratch = Scratch(judged.sparkSession, "quality")
    marks = labels.where(quoted(label_col).isin(0, 1) & quoted(id_col).isNotNull())
    good = marks.groupBy(quoted(id_col).alias("id")).agg(F.min(quoted(label_col)).alias("good")).where("good = 1")
    held = judged.where(~base_failed()).join(good, F.col("doc_id") == F.col("id"))
    cells = [(rule, step, cutoff) for rule, (_, grid) in RULES.items() for step, cutoff in enumerate(grid)]
    lost = [F.sum((measure(rule) > cutoff).cast("bigint")).alias(f"{rule}_{step}") for rule, step, cutoff in cells]
    one = scratch.table(held.groupBy("stratum").agg(F.count("*").alias("n"), *lost))
    tests = max(1, one.count() * len(RULES))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r, i, c in cells]))
    tested = one.select("stratum", "n", rows.alias("c")).select("stratum", "n", "c.*")
    p = binomial_tail("k", "n", risk / len(RULES))
    walk = Window.partitionBy("stratum", "rule").orderBy("step")
    certified = tested.withColumn("fails", (p > error / tests).cast("int")).withColumn("failed", F.sum("fails").over(walk))
    return certified.where("failed = 0").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def _by_stratum(cutoffs: DataFrame) -> DataFrame:
    """One row per stratum, with a column for each rule."""
    return cutoffs.groupBy(F.col("stratum").alias("stratum_")).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in RULES])


def _passes() -> Column:
    """The verdict: the base rule, then every certified cutoff."""
    return reduce(Column.__and__, [F.coalesce(measure(r) <= F.col(f"{r}_cutoff"), F.lit(True)) for r in RULES], ~base_failed())


def _judge(judged: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return judged.join(_by_stratum(cutoffs), F.col("stratum").eqNullSafe(F.col("stratum_")), "left")


def _counted(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """Counts of all rows as a table. It is written because a filter on counts would be pushed below the steps that make them."""
    carried = [quoted(id_col).alias("doc_id"), quoted(stratum_col).cast("string").alias("stratum"), F.xxhash64(quoted(text_col)).alias("text_hash")]
    return scratch.table(counts(quoted(text_col), docs, *carried))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", **how) -> DataFrame:
    """One row per document row: doc_id, stratum, text_hash, the counts, base_failed and kept. Cutoffs come from the labelled ones among the documents."""
    scratch = Scratch(docs.sparkSession, "quality")
    judged = _counted(docs, scratch, id_col, text_col, stratum_col)
    cutoffs = scratch.table(choose_cutoffs(judged, labels, label_col, id_col, **how))
    return _judge(judged, cutoffs).select("doc_id", "stratum", "text_hash", *COUNTS, base_failed().alias("base_failed"), _passes().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **how) -> DataFrame:
    """The documents that are kept, with all their columns."""
    th, *keys = unused(docs, "text_hash_", "key_", "of_", "hash_")
    found = judge(docs, labels, id_col, text_col, stratum_col, **how).where(~F.col("kept"))
    bad = found.select(F.col("doc_id").alias(keys[0]), F.col("stratum").alias(keys[1]), F.col("text_hash").alias(keys[2])).distinct()
    bad = Scratch(docs.sparkSession, "quality").table(bad)
    same = quoted(id_col).eqNullSafe(F.col(keys[0])) & quoted(stratum_col).cast("string").eqNullSafe(F.col(keys[1])) & (F.col(th) == F.col(keys[2]))
    return match(docs.withColumn(th, F.xxhash64(quoted(text_col))), bad, same, "left_anti").drop(th)
