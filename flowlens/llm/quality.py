"""Quality rules with thresholds that adapt to each language and source.

Per document, counts are taken from the whole text. Their ratios go into mergeable
quantile sketches (``percentile_approx``: partial sketches per task, merged by key),
one per (language, source), one per language and one over all. A group with fewer
than ``min_rows`` documents takes the thresholds of its language, and a language
with fewer those of all documents. A document is kept when its base rules hold, its
mean word length lies inside fences around the group's deciles, and no other ratio is
above its quantile in the group. Those ratios are zero in most documents, where
quartiles say nothing, so a rule's quantile follows from the ``SHARES`` it may reject
at most; where the quantile itself is zero, any more than zero is too much.

Null text: no words, so the base rules fail. Null language or source is a group of
its own. Empty table: empty result. Repeated rows count as often as they occur.
Extra columns are ignored. All steps are Spark SQL functions.
"""

from __future__ import annotations

from functools import reduce

from flowlens.llm.common import SPACE, settle, split_words, table
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATIOS = ["word_length", "symbols", "repeats", "duplicate_lines"]
#: Word lengths spread over all documents, so that fences around two deciles hold.
DECILES = [0.1, 0.9]
#: The share of a group's documents that a rule rejects at most, those with the highest ratios.
SHARES = {"symbols": 0.1, "repeats": 0.05, "duplicate_lines": 0.02}
#: The distance of the deciles if most of a group are copies of one text, in letters.
LEAST_SPREAD = 0.1


def repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows that occur twice or more, each word once.

    ``hashes`` are the windows as sorted (hash, place) pairs; equal neighbours repeat.
    """
    twice = F.filter(hashes, lambda x, i: (x["h"] == F.get(hashes, i - 1)["h"]) | (x["h"] == F.get(hashes, i + 1)["h"]))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        "doc_id", "lang", "source", split_words(F.col("text"), SPACE).alias("words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    # a window is the text of its words: a word has no space, so the joined text is unique
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p"))))
    second = first.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,p:int>>"))).alias("hashes"))
    return second.withColumn("n_repeat_words", repeated_words(F.col("hashes")).cast("long")).drop("hashes")


def ratios(counts: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns({
        "word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words, "repeats": F.col("n_repeat_words") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))})


def thresholds(rated: DataFrame, min_rows: int = 200, accuracy: int = 10_000) -> DataFrame:
    """Quantiles per (lang, source), per language and over all documents: two of the word length, one of each other ratio.

    Only documents that pass the base rules shape the thresholds. The three levels
    come from one pass over grouping sets.
    """
    good = rated.filter(~F.col("base_failed"))
    sketches = [F.percentile_approx(c, [1 - SHARES[c]] if c in SHARES else DECILES, accuracy).alias(c) for c in RATIOS]
    levels = good.rollup("lang", "source").agg(F.count("*").alias("rows"), F.grouping_id().alias("level"), *sketches)
    return levels.withColumn("enough", (F.col("rows") >= min_rows) | (F.col("level") == 3))


def limits(q: Column, c: str, width: float) -> tuple[Column, Column]:
    """Lowest and highest good value of a ratio; word lengths may leave their deciles by ``width`` times the deciles' distance."""
    if c in SHARES:
        return F.lit(0.0), q[c][0]
    spread = width * F.greatest(q[c][1] - q[c][0], F.lit(LEAST_SPREAD))
    return q[c][0] - spread, q[c][1] + spread


def judge(docs: DataFrame, min_rows: int = 200, width: float = 2.0) -> DataFrame:
    """doc_id, counts, base_failed, kept and the names of the failed adaptive rules."""
    # the counts are small and used twice, so the texts are read once
    rated = ratios(settle(base_counts(docs)))
    levels = thresholds(rated, min_rows)
    out = rated
    # (lang, source) pairs may be many, so that join is left to the planner
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"]), (3, [])):
        own = levels.filter((F.col("level") == level) & F.col("enough")).select(
            *[F.col(k).alias(f"{k}_{level}") for k in keys], F.struct(*RATIOS).alias(f"q{level}"))
        if keys:
            out = out.join(own, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_{level}")) for k in keys]), "left")
        else:
            out = out.join(F.broadcast(own), F.lit(True), "left")  # one row
    out = out.withColumn("q", F.coalesce("q0", "q1", "q3"))
    failed = []
    for c in RATIOS:
        low, high = limits(F.col("q"), c, width)
        bad = (F.col(c) > high) | (F.col(c) < low)
        failed.append(F.when(F.col("q").isNotNull() & bad, F.lit(c)))
    out = out.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
