"""Benchmark decontamination with a hash set of normalised test windows.

Words are runs of digits, letters and non-ASCII characters after A-Z is lower case.
A window is 13 consecutive words of a benchmark item; a shorter item is one window.
Every window of a document is hashed and looked up in the benchmark's windows; hits
are verified word by word. A document is contaminated when some of its words lie in
a verified window and these are at least a twentieth of its words.

The benchmark's windows are broadcast only after their number and bytes have been
counted against ``max_windows`` and ``max_bytes``; beyond that the look-up is a
shuffled join. Documents are joined back on (doc_id, hash of text).

Null text: no words. Null doc_id is a document of its own key. Null item_id is left
out of item lists but its windows hit. Rows that repeat doc_id and text are one
document and all get its result. Items of equal windows all count. Empty tables:
no hits, or an empty result. Extra columns are kept. All steps are Spark SQL.
"""

from __future__ import annotations

from flowlens.llm.common import NOT_WORD, ascii_lower, fresh, settle, split_words, table
from flowlens.llm.lines import same
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 13
#: One word of any case with what separates it from the next, and what stands before the first.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def normalised(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_WORD)


def word_hashes(words: Column) -> Column:
    """Each word hashed once; a window's key is the hash of its words' hashes."""
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(size, key, win, item_id): each item's windows; win is the words joined by spaces."""
    items = benchmark.select("item_id", normalised(F.col("text")).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("start")
    rows = items.select("item_id", "words", size.alias("size"), starts)
    part = F.slice("words", F.col("start"), F.col("size"))
    return rows.select("size", F.xxhash64(word_hashes(part)).alias("key"), F.array_join(part, " ").alias("win"), "item_id").distinct()


def hits(docs: DataFrame, windows: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(k_id, k_text, found): for each document with hits, its (start from 1, size, win) triples."""
    words = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text"), normalised(F.col("text")).alias("words"))
    words = words.select("k_id", "k_text", word_hashes(F.col("words")).alias("words"))

    def hashes(size):
        last = F.size("words") - size + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("words", i, size)))).otherwise(F.array().cast("array<bigint>"))

    lists = words.select("k_id", "k_text", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), hashes(s).alias("keys")) for s in sizes])).alias("w"))
    rows = lists.select("k_id", "k_text", F.col("w.size").alias("size"), F.posexplode("w.keys").alias("at", "key"))
    look_up = windows.select(F.col("size").alias("s"), F.col("key").alias("k"), "win").distinct()
    matched = rows.join(F.broadcast(look_up) if small else look_up, (F.col("key") == F.col("k")) & (F.col("size") == F.col("s")))
    return matched.groupBy("k_id", "k_text").agg(F.collect_set(F.struct((F.col("at") + 1).alias("start"), "size", "win")).alias("found"))


def verdicts(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = 500_000, max_bytes: int = 64 << 20) -> DataFrame:
    """(k_id, k_text, words_, n_hit, hit_words, items, contaminated) of the documents with verified hits; hit_words are places from 0."""
    windows = item_windows(benchmark, width)
    size = windows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("win") + 64), F.lit(0)).alias("bytes"), F.collect_set("size").alias("sizes")).first()
    small = size["rows"] <= max_windows and size["bytes"] <= max_bytes
    found = hits(docs, windows, sorted(size["sizes"]) or [width], small).toDF("f_id", "f_text", "found")
    texts = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text"), "text")
    both = texts.join(found.hint("shuffle_hash"), same([F.col("k_id"), F.col("k_text")], [F.col("f_id"), F.col("f_text")]))
    seen = both.select("k_id", "k_text", "found", normalised(F.col("text")).alias("words"))
    true = F.filter("found", lambda h: F.array_join(F.slice("words", h["start"], h["size"]), " ") == h["win"])
    seen = seen.select("k_id", "k_text", F.size("words").cast("long").alias("words_"), true.alias("found")).filter(F.size("found") > 0)
    places = F.sort_array(F.array_distinct(F.flatten(F.transform("found", lambda h: F.sequence(h["start"] - 1, h["start"] + h["size"] - 2)))))
    seen = settle(seen.select("k_id", "k_text", "words_", places.alias("hit_words"), F.array_distinct(F.transform("found", lambda h: h["win"])).alias("wins")).dropDuplicates(["k_id", "k_text"]))
    # the items of each document, from its distinct windows
    ids = windows.filter("item_id is not null").select(F.col("win").alias("w"), "item_id").distinct()
    pairs = seen.select(F.col("k_id").alias("d"), F.col("k_text").alias("t"), F.explode("wins").alias("win"))
    of = pairs.join(F.broadcast(ids) if small else ids, F.col("win") == F.col("w")).groupBy("d", "t").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = seen.join(of, same([F.col("k_id"), F.col("k_text")], [F.col("d"), F.col("t")]), "left")
    n_hit = F.size("hit_words").cast("long")
    return out.select("k_id", "k_text", "words_", n_hit.alias("n_hit"), "hit_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (20 * n_hit >= F.col("words_")).alias("contaminated"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, hit_words, items, contaminated) of every document."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(normalised(F.col("text"))).cast("long").alias("n_words"))
    hit = verdicts(docs, benchmark, **options)
    out = rows.join(hit, same([F.col("doc_id"), F.col("text_key")], [F.col("k_id"), F.col("k_text")]), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def remove_words(text: Column, places: Column) -> Column:
    """The text without the words at ``places`` (from 0) and the separators after them."""
    kept = F.filter(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda _, i: ~F.array_contains(places, i))
    return F.concat(F.regexp_extract(text, LEAD, 0), F.array_join(kept, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (mode "spans") without the hit words of these."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    k_id, k_text, places = fresh(docs, "k_id", "k_text", "places")
    bad = verdicts(docs, benchmark, **options).filter("contaminated").select("k_id", "k_text", "hit_words").toDF(k_id, k_text, places).hint("shuffle_hash")
    on = same([F.col("doc_id"), F.xxhash64("text")], [F.col(k_id), F.col(k_text)])
    if mode == "documents":
        return docs.join(bad, on, "left_anti")
    cut = F.when(F.col(places).isNotNull(), remove_words(F.col("text"), F.col(places))).otherwise(F.col("text"))
    return docs.join(bad, on, "left").withColumn("text", cut).select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op5_decontamination": op5_decontamination}
SQL = {"op5_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 13) as size, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') as win from b, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) t(i) where len(ws) > 0),
s as (select distinct size from bw),
dw as (select doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') as win from d, s, unnest(range(1, len(ws) - size + 2)) t(i)),
h as (select distinct doc_id, i, dw.size, dw.win from dw join (select distinct size, win from bw) x on x.size = dw.size and x.win = dw.win),
p as (select doc_id, count(distinct i + j) as n from h, unnest(range(0, size)) t(j) group by doc_id),
it as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h join bw on bw.size = h.size and bw.win = h.win) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(p.n, 0)::bigint as n_hit, coalesce(it.n, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(p.n, 0) > 0 and 20 * coalesce(p.n, 0) >= len(ws) as contaminated
from d left join p on p.doc_id = d.doc_id left join it on it.doc_id = d.doc_id"""}
