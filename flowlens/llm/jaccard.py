"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are documents, columns their distinct word n-grams (64-bit
hashes). Documents of equal rows are one class. A pair of classes links when
100 * |A and B| >= percent * |A or B|.

Bounds. Of a set that links, all but ``100 - percent`` in a hundred n-grams occur in some
other set. So a class with more n-grams of its own than that is discarded: first by
those in a fixed share of the hashes, which discards most classes with unique text
and shuffles little, then by all n-grams of the classes left.

Blocks. Linked sets of sizes near s differ in at most ``d`` n-grams, a bound that
follows from the size and the threshold. The columns are cut by hash into more than
``d`` parts, so linked rows agree entirely on some part: a block is all rows that
agree on a part. Sizes are cut into ranges, each with its own number of parts; a row
near a range's lower end also takes the parts of the range below. Rows with so many
empty parts that only empty ones might agree take their empty parts too. A passage
that many documents share spreads over all parts and makes no block.

Products. Each block's first ``FIRST`` rows are multiplied with the rows after them, every
such pair once in all blocks, and links make components. Bitmaps of the rows go first
and discard pairs that differ in more n-grams than their sizes allow. Blocks whose
further rows are all in one component are done. The others, without their first
rows and joined where they share rows, are multiplied
whole, tile by tile of about ``TILE`` rows a side, overlap counts adding up over ranges of columns
while pairs that cannot reach their bound are discarded; a tile returns links that
join different components, never all pairs. So no link between components is lost.

Documents with fewer words than n are their whole word sequence; without words, or
null, they are empty and link with nothing. Null doc_id: part of its class and its
component, but never the smallest id; alone, its component is null. Rows of one
doc_id are compared by their own texts. Repeated rows are one class. Empty table:
empty result. Extra columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from flowlens.llm.common import fresh, settle, table
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 512
COLUMNS = 4096
#: Blocks that share rows are multiplied as one up to so many rows, and for themselves beyond.
JOINED = 4 * TILE
REMEMBERED = 300_000
LOT = 100_000
FIRST = 16
MASK = (1 << 64) - 1
#: Odd 64-bit multipliers (golden ratio and two primes of common mixing functions).
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


_HASHES = WordHashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes. Bytes are lower-cased and split as ASCII: A-Z, and tab to carriage return with space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(n, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc = mix(acc * MIX[0] + h[j:len(h) - width + 1 + j])
    return np.unique(acc)


class Parts:
    """Size ranges and their numbers of parts, for a threshold in percent."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent, self.low = percent, [1]
        self.ratio = max(ratio, 100 / percent)
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.ratio)))

    def differ(self, k: int) -> int:
        """Most n-grams in which a set of range k and a linked set no smaller can differ."""
        return (self.low[k + 1] - 1) * (100 - self.percent) // self.percent

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """One number for each part of the set, in its own size range and, near its lower end, in those below."""
        if not len(s):
            return s
        k, out = int(np.searchsorted(self.low, len(s), side="right")) - 1, []
        spread = mix(s * MIX[0] + MIX[2])
        while k >= 0 and self.percent * len(s) <= 100 * (self.low[k + 1] - 1):
            differ = self.differ(k)
            if differ:
                spare = 2 + differ // 32
                m = differ + 1 + spare
                # 24 bits choose the part by their share of the range
                part = ((spread >> np.uint64(40)) * np.uint64(m)) >> np.uint64(24)
                order = np.argsort(part, kind="stable")
                own, start = np.unique(part[order], return_index=True)
                total = np.zeros(m, np.uint64)
                total[own] = np.add.reduceat(mix(s[order] + MIX[1]), start)
                full = np.zeros(m, bool)
                full[own] = True
                if m - len(own) <= spare:
                    number = own
                else:
                    number = np.arange(m, dtype=np.uint64)
                key = total[number.astype(np.int64)] * MIX[0] + full[number.astype(np.int64)]
                out.append(mix(key + mix(number * MIX[1] + np.uint64((k + 1) * int(MIX[2]) & MASK))))
            k -= 1
        return np.concatenate(out) if out else s[:0]


def links(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


def own_bound(size: Column, percent: int) -> Column:
    """Most n-grams that a linked set of this size can have for itself."""
    return F.floor(size * (100 - percent) / 100)


def sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, key, n_shingles, digest, some) of every row; key is the hash of the text, ``some`` the n-grams in a share of the hashes.

    The share is half as much again as a linked set may have for itself, so that own text shows in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    below = np.uint64(min(MASK, (MASK // 200) * 3 * (100 - percent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, some = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), n)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                some.append(s[:np.searchsorted(s, below)].astype(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in some])])
            joined = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(some) if some else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), joined], names=["doc_id", "key", "n_shingles", "digest", "some"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, f"doc_id {kind}, key long, n_shingles long, digest binary, some array<long>")


def own_ngrams(entries: DataFrame) -> DataFrame:
    """(owner, own): how many n-grams of (ngram, owner) rows an owner has for itself. Frequent n-grams shrink before the shuffle."""
    kinds = entries.groupBy("ngram").agg(F.min("owner").alias("owner"), F.max("owner").alias("last"))
    return kinds.filter("owner = last").groupBy("owner").agg(F.count("*").alias("own"))


def text_numbers(texts: DataFrame, name: str, numbers: Callable[[str], np.ndarray]) -> DataFrame:
    """(name, cls): the numbers that a function gives for each text, in lots of about ``LOT``."""

    def lot(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        values = np.concatenate([v for _, v in held]) if held else np.empty(0, np.uint64)
        owner = np.repeat(np.array([c for c, _ in held], np.int64), [len(v) for _, v in held])
        return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(owner)], names=[name, "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count = [], 0
            for cls, text in zip(batch.column("cls").to_pylist(), batch.column("text"), strict=True):
                held.append((cls, numbers(text.as_py())))
                count += len(held[-1][1])
                if count >= LOT:
                    yield lot(held)
                    held, count = [], 0
            if held:
                yield lot(held)

    return texts.select("cls", "text").mapInArrow(run, f"{name} long, cls long")


def block_rows(parts: DataFrame) -> DataFrame:
    """(part, nth, first, cls): the rows of every block with each of the block's ``FIRST`` first rows that come before them.

    Rows come sorted by part, so a task passes over them once, whatever a block's size.
    """
    rows = parts.repartition("part").sortWithinPartitions("part", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, firsts = None, []
        for batch in batches:
            out = []
            for part, cls in zip(batch.column("part").to_pylist(), batch.column("cls").to_pylist(), strict=True):
                if part != last:
                    last, firsts = part, []
                out += [(part, nth, first, cls) for nth, first in enumerate(firsts) if first != cls]
                if len(firsts) < FIRST and cls not in firsts:
                    firsts.append(cls)
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "nth", "first", "cls"])

    return rows.mapInArrow(run, "part long, nth long, first long, cls long")


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each n-gram, in four to eight times as many bits, by the low bits of the hashes."""
    bits = np.zeros(max(8, 1 << (4 * len(s) - 1).bit_length()), np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, size_a: int, size_b: int, percent: int) -> bool:
    """False if bits of one side alone show that the sets differ too much. The longer map is folded to the shorter."""
    width = 8 * min(len(a), len(b))
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    while x.bit_length() > width or y.bit_length() > width:
        x, y = ((v >> width) | (v & ((1 << width) - 1)) for v in (x, y))
    most = min(size_a - (x & ~y).bit_count(), size_b - (y & ~x).bit_count())
    return (100 + percent) * most >= percent * (size_a + size_b)


def likely_pairs(edges: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The (first, cls) pairs that sizes and bitmaps do not rule out."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [shingles(t.as_py(), n) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(list(map(len, sets_)), pa.int64()), pa.array(list(map(bitmap, sets_)), pa.binary())], names=["c", "size", "bits"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [may_link(*row, percent) for row in zip(*(batch.column(c).to_pylist() for c in ("bits1", "bits2", "size1", "size2")), strict=True)]
            yield batch.select(["first", "cls"]).filter(pa.array(good, pa.bool_()))

    maps = settle(texts.select("cls", "text").mapInArrow(draw, "c long, size long, bits binary"))
    pairs = edges
    for side, of in ((1, "first"), (2, "cls")):
        sizes = maps.select(F.col("c").alias(f"c{side}"), F.col("size").alias(f"size{side}"))
        pairs = pairs.join(sizes, F.col(of) == F.col(f"c{side}"))
    pairs = pairs.filter(100 * F.least("size1", "size2") >= percent * F.greatest("size1", "size2"))
    for side, of in ((1, "first"), (2, "cls")):
        bits = maps.select(F.col("c").alias(f"b{side}"), F.col("bits").alias(f"bits{side}"))
        pairs = pairs.join(bits, F.col(of) == F.col(f"b{side}"))
    return pairs.select("first", "cls", "bits1", "bits2", "size1", "size2").mapInArrow(test, "first long, cls long")


def first_row_products(edges: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of the (first, cls) pairs that link."""
    one = texts.select(F.col("cls").alias("c1"), F.col("text").alias("t1"))
    two = texts.select(F.col("cls").alias("c2"), F.col("text").alias("t2"))
    rows = edges.join(one, F.col("cls") == F.col("c1")).select("first", "cls", "t1").join(two, F.col("first") == F.col("c2")).select("first", "cls", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for first, cls, text, other in zip(batch.column("first").to_pylist(), batch.column("cls").to_pylist(), batch.column("t1"), batch.column("t2"), strict=True):
                if first != held:
                    held, row = first, shingles(other.as_py(), n)
                s = shingles(text.as_py(), n)
                if 100 * min(len(s), len(row)) < percent * max(len(s), len(row)):
                    continue
                at = np.searchsorted(row, s)
                overlap = int((row[np.minimum(at, len(row) - 1)] == s).sum())
                if links(overlap, len(s), len(row), percent):
                    a.append(first)
                    b.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def tile_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Linked (i, j) of two row blocks: overlap counts added up over ranges of columns."""
    a, b = (np.array(list(map(len, x)), np.int64) for x in (left, right))
    need = -(-percent * (a[:, None] + b[None, :]) // (100 + percent))
    alive = np.minimum(a[:, None], b[None, :]) >= need
    overlap = np.zeros(alive.shape, np.int64)
    kinds = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    rest = [[np.searchsorted(kinds, s[np.isin(s, kinds, assume_unique=True)]) for s in x] for x in (left, right)]
    for start in range(0, len(kinds), COLUMNS):
        if not alive.any():
            break
        dense = []
        for x in rest:
            m = np.zeros((len(x), COLUMNS), np.float32)
            for i, columns in enumerate(x):
                m[i, columns[np.searchsorted(columns, start):np.searchsorted(columns, start + COLUMNS)] - start] = 1
            dense.append(m)
        overlap += (dense[0] @ dense[1].T).astype(np.int64)
        left_over = [np.array([len(c) - np.searchsorted(c, start + COLUMNS) for c in x]) for x in rest]
        alive &= overlap + np.minimum(left_over[0][:, None], left_over[1][None, :]) >= need
    return np.argwhere(alive & links(overlap, a[:, None], b[None, :], percent))


def joined_blocks(open_rows: DataFrame, open_edges: DataFrame) -> DataFrame:
    """(joined, part, cls, comp): blocks that share rows become one block, unless that has more than ``JOINED`` rows."""
    family = components(thinned(open_edges.select(F.col("first").alias("a"), F.col("cls").alias("b")))).select(F.col("cls").alias("c"), F.col("comp").alias("family"))
    rows = settle(open_rows.select("cls", "comp").distinct().join(family, F.col("cls") == F.col("c")).select("cls", "comp", "family"))
    small = rows.groupBy(F.col("family").alias("f")).count().filter(F.col("count") <= JOINED).select("f")
    whole = rows.join(small, F.col("family") == F.col("f"), "left_semi").select(F.lit(True).alias("joined"), F.col("family").alias("part"), "cls", "comp")
    large = rows.join(small, F.col("family") == F.col("f"), "left_anti").select(F.col("cls").alias("c"))
    return whole.unionByName(open_rows.join(large, F.col("cls") == F.col("c"), "left_semi").select(F.lit(False).alias("joined"), "part", "cls", "comp"))


def whole_block_products(blocks: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) links between components, from blocks (joined, part, cls, comp)."""
    blocks = settle(blocks)
    shape = blocks.groupBy("joined", "part").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("cls")).alias("x1"), F.sum(F.xxhash64(F.lit(1), "cls").cast("decimal(38,0)")).alias("x2"))
    # blocks of the same rows are one block
    kept = shape.groupBy("joined", "rows", "x1", "x2").agg(F.min("part").alias("p")).select(F.col("joined").alias("j"), "p", F.ceil(F.col("rows") / TILE).cast("int").alias("sides"))
    dealt = blocks.join(kept, (F.col("part") == F.col("p")) & (F.col("joined") == F.col("j"))).withColumn("side", F.pmod(F.xxhash64("cls"), "sides").cast("int"))
    tiles = dealt.select("joined", "part", "cls", "comp", "side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    rows = tiles.join(texts.select(F.col("cls").alias("c"), "text"), F.col("cls") == F.col("c")).select(
        "joined", "part", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "cls", "comp", "text")

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cls").reset_index(drop=True)
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        left, right = (np.flatnonzero(frame["side"] == x) for x in (lo, hi))
        found = []
        if len(left) and len(right):
            all_sets = [shingles(t, n) for t in frame["text"]]
            comp, cls = frame["comp"].to_numpy(), frame["cls"].to_numpy()
            parent: dict[int, int] = {}

            def root(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for i, j in tile_links([all_sets[i] for i in left], [all_sets[j] for j in right], percent).tolist():
                p, q = root(comp[left[i]]), root(comp[right[j]])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((cls[left[i]], cls[right[j]]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return rows.groupBy("joined", "part", "lo", "hi").applyInPandas(multiply, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) of every class in ``edges``: the smallest class reachable.

    Each round hooks every component to its smallest neighbour, so that at most half of those
    with a neighbour stay. Hooks end in two components that hook to each other; the smaller one,
    which is the smallest of all that lead there, is the root. Pointers double until they reach
    it, then links between roots are the next round's. So rounds grow with the logarithm.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = both.select(F.col("a").alias("cls"), F.col("a").alias("comp")).distinct()
    rest = both.filter("a <> b")
    while not rest.isEmpty():
        hooks = settle(rest.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("up")))
        mutual = hooks.select(F.col("v").alias("w"), F.col("up").alias("back"))
        pointers = settle(hooks.join(mutual, F.col("up") == F.col("w")).select("v", F.when(F.col("back") == F.col("v"), F.least("v", "up")).otherwise(F.col("up")).alias("up")))
        moved = True
        while moved:
            jump = pointers.select(F.col("v").alias("w"), F.col("up").alias("further"))
            new = settle(pointers.join(jump, F.col("up") == F.col("w")).select("v", F.col("up").alias("was"), F.col("further").alias("up")))
            pointers, moved = new.select("v", "up"), not new.filter("up <> was").isEmpty()
        state = settle(state.join(pointers, F.col("comp") == F.col("v"), "left").select("cls", F.coalesce("up", "comp").alias("comp")))
        other = pointers.select(F.col("v").alias("w"), F.col("up").alias("b2"))
        joined = rest.join(pointers, F.col("a") == F.col("v")).select(F.col("up").alias("a2"), "b").join(other, F.col("b") == F.col("w"))
        rest = settle(joined.filter("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
    return state


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) of the same components: each b to its smallest a, and that one to the other a of b, once each."""
    held = links.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    return held.select(F.col("least").alias("a"), "b").union(held.filter("a <> least").select("least", "a")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    return grouped(docs, n, percent).drop("key")


def grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, key, n_shingles, component_id) of every row; key is the hash of the text."""
    docs = docs.select("doc_id", "text")
    rows = settle(sets(docs, n, percent))
    # any row of a class stands for it; its text is found again by id and hash of text
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "key")).alias("row"), F.first("n_shingles").alias("size"))
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()))
    own = own_ngrams(rows.select(F.explode("some").alias("ngram"), F.xxhash64("digest").alias("owner")))
    wanted = classes.join(own, F.xxhash64("digest") == F.col("owner"), "left").filter((F.col("size") > 0) & (F.coalesce("own", F.lit(0)) <= own_bound(F.col("size"), percent)))
    wanted = wanted.select("row.*", "cls", "size").toDF("i", "x", "cls", "size").hint("shuffle_hash")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("x")))
    texts = settle(texts.select("cls", "size", "text").dropDuplicates(["cls"]))
    own = own_ngrams(text_numbers(texts, "ngram", lambda t: shingles(t, n)).withColumnRenamed("cls", "owner"))
    texts = texts.join(own, F.col("cls") == F.col("owner"), "left").filter(F.coalesce("own", F.lit(0)) <= own_bound(F.col("size"), percent))
    texts = settle(texts.select("cls", "text"))
    cut = Parts(percent)
    blocks = settle(block_rows(text_numbers(texts, "part", lambda t: cut.signatures(shingles(t, n)))))
    edges = settle(blocks.select("first", "cls").distinct())
    linked = settle(first_row_products(settle(likely_pairs(edges, texts, n, percent)), texts, n, percent))
    linked = settle(thinned(linked))
    comps = components(linked)
    label = comps.select(F.col("cls").alias("c"), "comp")
    # pairs without a first row of their block are still open, where components differ
    marked = blocks.filter(F.col("nth") == FIRST - 1).join(label, F.col("cls") == F.col("c"), "left").select("part", "cls", F.coalesce("comp", "cls").alias("comp"))
    unsettled = marked.groupBy(F.col("part").alias("p")).agg(F.min("cls").alias("least"), F.min("comp").alias("from"), F.max("comp").alias("to"))
    still = settle(marked.join(unsettled.filter("from <> to").select("p", "least"), F.col("part") == F.col("p")).select("part", "cls", "comp", "least"))
    if not still.isEmpty():
        open_rows, open_edges = still.select("part", "cls", "comp"), still.select(F.col("least").alias("first"), "cls").distinct()
        more = settle(whole_block_products(joined_blocks(open_rows, open_edges), texts, n, percent).distinct())
        if not more.isEmpty():
            comps = components(linked.unionByName(more))
    label = comps.select(F.col("cls").alias("c"), "comp")
    of = classes.select("digest", "first_id", "cls").join(label, F.col("cls") == F.col("c"), "left").select("digest", "first_id", F.coalesce("comp", "cls").alias("comp"))
    of = settle(of)
    smallest = of.groupBy(F.col("comp").alias("m")).agg(F.min("first_id").alias("least_id"))
    lookup = of.join(smallest, F.col("comp") == F.col("m")).select(F.col("digest").alias("g"), "least_id")
    out = rows.select("doc_id", "key", "n_shingles", "digest").join(lookup, F.col("digest") == F.col("g"))
    return out.select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id. Rows are told apart by id and
    text, so another text of a dropped row's id stays if its own component begins with that id. Rows
    that repeat the kept doc_id, and rows without one, stay."""
    gone, text = fresh(docs, "gone", "gone_text")
    drop = grouped(docs, n, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias(gone), F.col("key").alias(text)).distinct()
    same = (F.col("doc_id") == F.col(gone)) & (F.xxhash64(docs["text"]) == F.col(text))
    return docs.join(drop.hint("shuffle_hash"), same, "left_anti")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)


QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard}
SQL: dict[str, str] = {}
