"""Line dedup over overlapping windows of three consecutive lines.

Every window is hashed to 128 bits; a window that occurs anywhere before (by doc_id,
then line) is a repeat, and the lines that repeats cover are removed. Documents of
fewer than three lines have no window and stay as they are, and so do windows of
blank lines only. Line ends inside the kept text stay ``\\n``.

Null text: no lines, stays null. Null doc_id sorts first. Rows that repeat both
doc_id and text are one document: all of them get the same result. Empty table:
empty result. Extra columns are kept. All steps are Spark SQL functions. A window
that a third of all documents share is pre-aggregated before its shuffle, and the
join back has one row a window on one side, so large partitions can be split.
"""

from __future__ import annotations

from functools import reduce

from flowlens.llm.common import fresh, table
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 3


def same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def line_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k_id, k_text, line, h1, h2): every window, by its first line from 0."""
    lines = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text"), F.split("text", "\n").alias("lines")).filter(F.size("lines") >= width)
    # each line is hashed once; a window's hashes are those of its lines' hashes
    each = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(r"[^ \t\r]").alias("some")))
    hashed = lines.select("k_id", "k_text", each.alias("each"))
    at = lambda i, part: [F.get("each", i + j)[part] for j in range(width)]
    hashes = F.transform(F.sequence(F.lit(0), F.size("each") - width), lambda i: F.when(
        reduce(lambda x, y: x | y, at(i, "some")), F.struct(F.xxhash64(*at(i, "a")).alias("h1"), F.xxhash64(*at(i, "b")).alias("h2"))))
    rows = hashed.select("k_id", "k_text", F.posexplode(hashes).alias("line", "h"))
    return rows.filter("h is not null").select("k_id", "k_text", "line", "h.h1", "h.h2")


def repeated_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k_id, k_text, covered): the sorted lines of each document that repeats cover."""
    windows = line_windows(docs, width)
    place = F.struct("k_id", "k_text", "line")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.filter(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    later = windows.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("k_id", "k_text").agg(F.collect_set("line").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))
    return starts.select("k_id", "k_text", F.sort_array(covered).alias("covered"))


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with text cut down, and n_lines, n_removed and n_spans (runs of removed lines)."""
    k_id, k_text, gone, all_lines = fresh(docs, "k_id", "k_text", "gone", "all_lines")
    found = repeated_lines(docs, width).toDF(k_id, k_text, gone)
    # the few found lines are hashed, so that the texts need no sort
    joined = docs.join(found.hint("shuffle_hash"), same([F.col("doc_id"), F.xxhash64("text")], [F.col(k_id), F.col(k_text)]), "left")
    others = [F.col(c) for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed", "n_spans")]
    lines, cut = F.split("text", "\n"), F.col(gone)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), cut), lambda i: F.get(F.col(all_lines), i)), "\n")
    runs = F.size(F.filter(cut, lambda x, i: (i == 0) | (F.get(cut, i - 1) != x - 1)))
    staged = joined.select(*others, "text", F.col(gone), lines.alias(all_lines))
    number = lambda x, given: F.when(given.isNotNull(), x).otherwise(0).cast("long")
    return staged.select(*others, F.when(cut.isNull(), F.col("text")).otherwise(kept).alias("text"), number(F.size(all_lines), F.col("text")).alias("n_lines"),
                         number(F.size(cut), cut).alias("n_removed"), number(runs, cut).alias("n_spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_spans", "text")


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {"op2_line_dedup": r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] as win from d, unnest(range(1, len(ls) - 1)) t(p)),
r as (select *, row_number() over (partition by win order by doc_id, p) as k from w where length(regexp_replace(win, '[\n\t\r ]', '', 'g')) > 0),
c as (select distinct doc_id, p + j as line from r, (values (0), (1), (2)) o(j) where k > 1),
g as (select doc_id, list(line order by line) as gone, count(*) filter (line - 1 <> coalesce(before, -1)) as runs
      from (select *, lag(line) over (partition by doc_id order by line) as before from c) group by doc_id)
select d.doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed, coalesce(runs, 0)::bigint as n_spans,
  case when gone is null then text else coalesce(array_to_string([ls[i] for i in range(1, len(ls) + 1) if not list_contains(gone, i)], chr(10)), '') end as text
from d left join g on d.doc_id = g.doc_id"""}
