"""Spelling variants: words one edit apart, found by bidirectional FM-index search schemes.

Words are counted with Spark's own functions. Two words are near if one inserted,
deleted or replaced code point turns one into the other; then one half of either
occurs unchanged at its end of the other. So a word is indexed under the beginnings
and ends that a near word's half may have, and asks only under its own two halves. A
bucket of such keys is one text of delimited words with an index of its suffix ranks
in both directions. Each half is matched exactly up to its delimiter, then extended
across the other half with one error.

A key with more than ``key_rows`` words is dealt by word into parts, and its
questions go to every part: every two words of a key still meet once. A bucket gives
one row for each question, never the pairs themselves.

A word's form is its near word of largest count (ties: smallest in code-point order)
if that count is at least ``times`` its own. Forms are followed to the root by
pointer doubling; counts grow tenfold at each step, so a few rounds are enough.

Null or empty texts have no words. A null doc_id counts as an empty id. Repeated rows
count as often as they occur. Very long runs are words like others. Empty table: empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from flowlens.llm.common import ascii_lower, settle, table
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "A-Za-zÀ-ÿ"
DELIMITER = "\n"
LEFT, RIGHT = 0, 1


class Ranks:
    """How many of the first i symbols are smaller than c, as bits with counts every 64 symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        words = len(symbols) // 64 + 1
        padded = np.full(words * 64, size, symbols.dtype)
        padded[:len(symbols)] = symbols
        self.columns = size + 1
        bits = np.empty((words, self.columns), np.uint64)
        for c in range(self.columns):
            bits[:, c] = np.packbits(padded < c, bitorder="little").view(np.uint64)
        before = np.zeros((words, self.columns), np.int32)
        np.cumsum(np.bitwise_count(bits[:-1]), axis=0, dtype=np.int32, out=before[1:])
        self.bits, self.before = bits.ravel(), before.ravel()

    def smaller(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = (i >> 6) * self.columns + c
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.bits[at] & mask)


def rotation_order(text: np.ndarray, size: int) -> np.ndarray:
    """Starts of the rotations of a cyclic text in sorted order, by prefix doubling from as many symbols as fit 62 bits."""
    bits = max(1, int(size - 1).bit_length())
    depth = min(62 // bits, len(text))
    key = np.zeros(len(text), np.int64)
    for shift in range(depth):
        key = key << bits | np.roll(text, -shift)
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        if depth >= len(text) or rank[order[-1]] == len(text) - 1:
            return order
        key = rank * len(text) + np.roll(rank, -depth)
        depth *= 2


class BidirectionalIndex:
    """Suffix-rank intervals of patterns in a cyclic text of distinct delimited words.

    A pattern's interval is (rank in the text's order, rank in the reversed text's
    order, width). Growing to the left looks at the symbols before the text's
    suffixes, growing to the right at those before the reversed text's; either keeps
    both ranks in step.
    """

    def __init__(self, words: list[str]):
        text = np.frombuffer((DELIMITER + DELIMITER.join(words)).encode("utf-32-le"), "<u4")
        self.alphabet, codes = np.unique(text, return_inverse=True)  # the delimiter is smallest: 0
        codes = codes.astype(np.int64)
        self.size, self.length = len(self.alphabet), len(codes)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=self.size))))
        self.order = rotation_order(codes, self.size)
        self.last = [codes[self.order - 1]]
        self.last.append(codes[::-1][rotation_order(codes[::-1].copy(), self.size) - 1])
        self.ranks = [Ranks(x, self.size) for x in self.last]
        self.starts = np.flatnonzero(codes == 0)

    def codes(self, word: str) -> np.ndarray:
        return np.searchsorted(self.alphabet, np.frombuffer(word.encode("utf-32-le"), "<u4"))

    def grow(self, side: int, c: np.ndarray, ranks: tuple[np.ndarray, np.ndarray], width: np.ndarray):
        """The intervals of the patterns with c added on one side; width 0 where nothing is left."""
        here, there = ranks[side], ranks[1 - side]
        table = self.ranks[side]
        low, low_next = table.smaller(c, here), table.smaller(c + 1, here)
        high, high_next = table.smaller(c, here + width), table.smaller(c + 1, here + width)
        grown, follows = self.first[c] + low_next - low, there + high - low
        return (grown, follows) if side == LEFT else (follows, grown), (high_next - high) - (low_next - low)

    def next_symbols(self, side: int, rank: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) of every letter that occurs beside each state's pattern."""
        narrow = width <= self.size
        at = np.flatnonzero(narrow)
        many, wide = width[at], np.flatnonzero(~narrow)
        state = np.repeat(at, many)
        row = rank[state] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found = np.unique(state * self.size + self.last[side][row])
        full = (wide[:, None] * self.size + np.arange(self.size)).ravel()
        both = np.concatenate((found, full))
        state, symbol = both // self.size, both % self.size
        return state[symbol > 0], symbol[symbol > 0]


def one_error(index: BidirectionalIndex, words: np.ndarray, half: int, side: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(question, word number) of indexed words one edit away, the edit lying beyond ``half``.

    ``words``: symbols, one row for each question, all of one length. Side RIGHT
    matches the first ``half`` symbols to the left up to the delimiter and extends to
    the right; LEFT is the mirror image: the last ``half`` symbols, then to the left.
    ``own``: whether the question itself is indexed.
    """
    if side == LEFT:
        words = words[:, ::-1]
    length = words.shape[1]
    asked, ranks = np.arange(len(words)), (np.zeros(len(words), np.int64), np.zeros(len(words), np.int64))
    width = np.full(len(words), index.length, np.int64)

    def kept(some, asked, ranks, width):
        return asked[some], (ranks[0][some], ranks[1][some]), width[some]

    def joined(*states):
        return (np.concatenate([s[0] for s in states]), tuple(np.concatenate([s[1][i] for s in states]) for i in (0, 1)),
                np.concatenate([s[2] for s in states]))

    for step in range(half, -1, -1):  # the exact half, outwards, then the delimiter
        symbol = words[asked, step - 1] if step else np.zeros(len(asked), np.int64)
        ranks, width = index.grow(1 - side, symbol, ranks, width)
        asked, ranks, width = kept(width > own[asked], asked, ranks, width)  # others match nothing but themselves
    exact = asked, ranks, width
    wrong = kept(np.zeros(len(asked), bool), asked, ranks, width)
    for at in range(half, length + 1):
        asked, ranks, width = exact
        state, symbol = index.next_symbols(side, ranks[side], width)
        grown, left = index.grow(side, symbol, (ranks[0][state], ranks[1][state]), width[state])
        expected = words[asked[state], at] if at < length else np.zeros(len(state), np.int64)
        strange = kept((left > 0) & (symbol != expected), asked[state], grown, left)
        wrong = joined(wrong, strange)  # the strange symbol is inserted
        symbol = words[wrong[0], at] if at < length else np.zeros(len(wrong[0]), np.int64)
        grown, left = index.grow(side, symbol, *wrong[1:])
        wrong = kept(left > 0, wrong[0], grown, left)
        if at == length:
            break
        gone = np.ones(len(asked), bool) if at == half else words[asked, at] != words[asked, at - 1]
        wrong = joined(wrong, strange, kept(gone, *exact))  # it replaces, or one is deleted
        ranks, width = index.grow(side, words[asked, at], ranks, width)
        exact = kept(width > own[asked], asked, ranks, width)
    # a closed pattern is a word between delimiters; its first suffix starts at the left one
    found = np.searchsorted(index.starts, index.order[wrong[1][0]])
    pairs = np.unique(wrong[0] * len(index.starts) + found)
    return pairs // len(index.starts), pairs % len(index.starts)


def near_words(rows: pd.DataFrame) -> pd.DataFrame:
    """The near words of a bucket's questions: how many, and the one of largest count.

    ``rows``: word, n, side, slot (key and part), indexed, asks. A word found by both
    searches counts for that of its first half.
    """
    rows = rows.reset_index(drop=True)
    indexed = rows["indexed"].to_numpy()
    words, number = np.unique(rows["word"].to_numpy()[indexed], return_inverse=True)  # in code-point order
    none = pd.DataFrame({"word": pd.Series(dtype="str"), "n_near": pd.Series(dtype="int64"), "form": pd.Series(dtype="str"), "form_n": pd.Series(dtype="int64")})
    if not len(words):
        return none
    count = np.zeros(len(words), np.int64)
    count[number] = rows["n"].to_numpy()[indexed]
    slots, slot = np.unique(rows["slot"].to_numpy(), return_inverse=True)
    members = np.sort(slot[indexed] * len(words) + number)
    index = BidirectionalIndex(words.tolist())
    letters = set(index.alphabet.tolist())
    asking = rows[rows["asks"]]
    lengths, out = asking["word"].str.len(), []
    for (side, length), some in asking.groupby([asking["side"], lengths]):
        # a letter that no indexed word has gets a number of its own, which matches nothing
        some = some[[set(map(ord, w)) <= letters for w in some["word"]]] if not some["indexed"].all() else some
        if not len(some):
            continue
        symbols = index.codes("".join(some["word"])).reshape(len(some), length)
        half = length // 2 if side == RIGHT else length - length // 2
        asked, found = one_error(index, symbols, half, side, some["indexed"].to_numpy().astype(np.int64))
        at = some.index.to_numpy()[asked]
        key = slot[at] * len(words) + found
        place = np.minimum(np.searchsorted(members, key), len(members) - 1)
        good = members[place] == key  # under this key and part, so that no pair counts twice
        at, found = at[good], found[good]
        if side == LEFT:
            whole, start = rows["word"].to_numpy()[at], length // 2
            good = np.fromiter((not b.startswith(a[:start]) for a, b in zip(whole, words[found], strict=True)), bool, len(at))
            at, found = at[good], found[good]
        out.append((at, found))
    if not out:
        return none
    at, found = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.lexsort((found, -count[found], at))
    at, found = at[by], found[by]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))[:len(at)]
    total = np.diff(np.append(first, len(at)))
    return pd.DataFrame({"word": rows["word"].to_numpy()[at[first]], "n_near": total, "form": words[found[first]], "form_n": count[found[first]]})


def counted_words(docs: DataFrame, shortest: int = 7, least: int = 2, spoil: int | None = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least ``shortest`` code points that occur ``least`` times or more.

    ``spoil``: where it divides the crc32 of id and run, one letter of the run is left out.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{shortest},}}"), 0)).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(ascii_lower(F.col("run"))).alias("word"))
    if spoil:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        runs = runs.withColumn("word", F.when(F.col("h") % spoil == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")))
        runs = runs.filter(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def keys_of(word: Column) -> Column:
    """(side, half, asks): beginnings and ends that a near word's half may have; the word asks under its own two."""
    size, halves = F.length(word), []
    for off in (-1, 0, 1):
        start, end = F.floor((size + off) / 2).cast("int"), F.ceil((size + off) / 2).cast("int")
        own, other = F.floor(size / 2).cast("int"), F.ceil(size / 2).cast("int")
        halves.append((start, F.struct(F.lit(RIGHT).alias("side"), F.substring(word, F.lit(1), start).alias("half"), (start == own).alias("asks"))))
        halves.append((end, F.struct(F.lit(LEFT).alias("side"), F.substring(word, size - end + 1, end).alias("half"), (end == other).alias("asks"))))
    return F.array_distinct(F.array(*[F.when(length > 0, key) for length, key in halves]))


def near_counts(vocabulary: DataFrame, key_rows: int = 10_000, bucket_rows: int = 100_000) -> DataFrame:
    """(word, n_near, form, form_n) of every word with a near word; form is the most frequent one."""
    keyed = vocabulary.select("word", "n", F.explode(keys_of(F.col("word"))).alias("k")).filter("k is not null").select("word", "n", "k.*")
    hot = keyed.groupBy("side", "half").agg(F.count("*").alias("words")).filter(F.col("words") > key_rows)
    hot = hot.select("side", "half", F.ceil(F.col("words") / key_rows).cast("int").alias("parts"))
    keyed = keyed.join(hot, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    keyed = keyed.withColumn("home", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    dealt = keyed.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))))
    dealt = dealt.withColumn("slot", F.xxhash64("side", "half", "part"))
    buckets = max(1, -(-4 * vocabulary.count() // bucket_rows))
    dealt = dealt.select("word", "n", "side", "slot", (F.col("part") == F.col("home")).alias("indexed"), "asks", F.pmod("slot", F.lit(buckets)).alias("bucket"))
    found = dealt.groupBy("bucket").applyInPandas(lambda rows: near_words(rows), "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form")).alias("best")).select(
        "word", "n_near", "best.*")


def followed(forms: DataFrame, largest: int, times: int) -> DataFrame:
    """(word, root): forms followed to the last; a chain's counts grow ``times`` fold a step, so their number is known."""
    steps = max(1, math.ceil(math.log(max(largest, 2), max(times, 2))))
    links = settle(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = settle(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return links


def group_variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, spoil: int | None = None,
                   key_rows: int = 10_000, bucket_rows: int = 100_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; ``times`` is at least 2."""
    vocabulary = settle(counted_words(docs, shortest, least, spoil))
    near = settle(near_counts(vocabulary, key_rows, bucket_rows))
    largest = vocabulary.agg(F.max("n")).first()[0] or 2
    judged = settle(vocabulary.join(near, "word", "left").withColumn("has_form", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))))
    roots = followed(judged.filter("has_form"), largest, times)
    return judged.join(roots, "word", "left").select(
        "word", F.when(F.col("has_form"), F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has_form"), F.col("form_n")).alias("form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"), spoil=31)


QUERIES = {"op13_spelling_variants": op13_spelling_variants}

#: crc32 by bytes; the table follows from the reversed polynomial.
CRC32 = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length({0})::bigint),
    lambda i: ('0x' || substr(hex({0}), (2 * i + 1)::int, 2))::bigint)), lambda acc, b: xor(acc >> 8, crc_row[(xor(acc, b) & 255) + 1]))"""
CRC_ROWS = """select list(c order by b) as crc_row from (select b, list_reduce(list_prepend(b, range(0, 8)::bigint[]),
    lambda acc, i: case when acc & 1 = 1 then xor(3988292384, acc >> 1) else acc >> 1 end) as c from (select unnest(range(0, 256))::bigint as b))"""

SQL = {"op13_spelling_variants": f"""
with recursive crc as ({CRC_ROWS}),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
kinds as (select doc_id, run, count(*) as times, encode(coalesce(doc_id::varchar, '') || ':' || run) as bytes from runs group by doc_id, run),
hashed as (select run, times, xor({CRC32.format('bytes')}, 4294967295) as h from kinds, crc),
spoiled as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed),
words as (select word, sum(times)::bigint as n from spoiled where length(word) >= 7 group by word having sum(times) >= 2),
gaps as (select word, n, unnest(range(1, length(word) + 1)) as i, length(word) as size from words),
shorter as (select word, n, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as rest from gaps),
near as (
  select a.word, b.word as other, b.n from shorter a join shorter b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from shorter a join words b on a.rest = b.word
  union select b.word, a.word, a.n from shorter a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as form, max(n) as form_n from near group by word),
judged as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.form_n >= 10 * w.n then b.form end as form,
  case when b.form_n >= 10 * w.n then b.form_n end as form_n from words w left join best b on w.word = b.word),
walk as (select word, word as reached, form as onward from judged
  union all select w.word, w.onward, j.form from walk w join judged j on j.word = w.onward),
roots as (select word, reached as root from walk where onward is null)
select j.word, j.form, r.root, j.n, j.n_near, j.form_n from judged j join roots r on r.word = j.word"""}
