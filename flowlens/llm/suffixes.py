"""Exact-substring dedup with a sparse suffix array sorted the deep-shallow way.

A byte goes when it lies in a ``length``-byte string that also starts in a document
of a smaller doc_id. Strings are compared by their bytes.

Which suffixes meet. In every ``length``-byte window the smallest hash of its
``GRAM``-byte strings (the first of equal ones) is its anchor, so equal windows have
equal anchors at equal places. An anchor and the stretch of bytes that its windows
cover are a context. Contexts are dealt by anchor; of equal contexts (equal 64-bit
hashes of anchor and context) the smallest doc_id keeps its windows and the others lose
them. Only anchors with several different contexts need their suffixes sorted, by their
bytes: one context of each kind, found again in its document.

Sorting. The window-long suffixes of those contexts are ordered by multikey quicksort
over eight-byte words to a shallow depth; groups with a longer common prefix are
ordered by blind tries, in which only branching places and one full comparison a
suffix count. Runs of neighbours equal over the whole length are equal windows; all
but those of the smallest doc_id go.

Work per document, task and group is bounded: a context has at most ``length`` bytes
on either side of its anchor; an anchor with more than ``HOT`` kinds of context is
dealt window by window, by the hash of all bytes, and such a deal is judged in parts.
Texts travel compressed and are hashed many at a time.

Null or empty text: no bytes. Null doc_id: neither smaller nor larger than others,
kept whole. Rows of one doc_id never remove from each other; repeated rows get the
same result. Very long texts are read whole. Empty table: empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from flowlens.llm.common import packed, settle, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 50
GRAM = 20
#: Words of eight bytes that quicksort compares before tries take over.
SHALLOW_WORDS = 3
#: Kinds of context above which an anchor's windows are dealt singly.
HOT = 20_000
#: Rows of one deal that a task holds before it drops those that can tell nothing more.
HELD_ROWS = 2 * HOT
#: Bytes of text hashed at once: the arrays of one slice stay in the processor's cache.
SLICE = 200_000
#: The upper half of a hash orders anchors; the place takes the lower half.
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
MIX = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
STEPS = tuple(np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64) | 1) for i in range(1, 9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


#: One number for each byte value.
BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


def rolling(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width, the unmixed hash of so many bytes at every place; blocks of doubled size are shared."""
    block, size, step, have = BYTES[data], 1, 0, {w: (None, 0) for w in widths}
    while True:
        for w, (value, done) in have.items():
            if w & size:
                n = len(data) - done - size + 1
                have[w] = (block if value is None else value[:n] * STEPS[7] + block[done:done + n], done + size)
        if size * 2 > max(widths):
            return [have[w][0] for w in widths]
        block, step = block[:-size] * STEPS[step] + block[size:], step + 1
        size *= 2


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value (by its upper half) among the ``width`` from every place."""
    low, size = (values & HIGH) | np.arange(len(values), dtype=np.uint64), 1
    while size < width:
        shift = min(size, width - size)
        low = np.minimum(low[:-shift], low[shift:])
        size += shift
    return (low & LOW).astype(np.int64)


class Contexts(NamedTuple):
    """The contexts of joined texts, in order of place."""

    anchor: np.ndarray  #: hash of the anchor string
    context: np.ndarray  #: hash of all bytes, and where the anchor lies in them
    first: np.ndarray  #: place of the first window
    last: np.ndarray  #: place of the last window
    window: np.ndarray  #: unmixed hash of the window at every place


def contexts(data: np.ndarray, owner: np.ndarray, length: int) -> Contexts:
    """``owner`` numbers the document of each byte; windows lie inside one document."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return Contexts(none, none, none, none, none.astype(np.uint64))
    grams, whole = rolling(data, GRAM, length)
    anchors = mix(grams)
    at = first_smallest(anchors, length - GRAM + 1)
    inside = owner[:len(data) - length + 1] == owner[length - 1:]
    # neighbouring windows that both lie inside a document lie inside the same one
    goes_on = (at[1:] == at[:-1]) & inside[1:] & inside[:-1]
    first = np.flatnonzero(inside & ~np.concatenate([[False], goes_on]))
    last = np.flatnonzero(inside & ~np.concatenate([goes_on, [False]]))
    anchor = at[first]
    shape = (anchor - first).astype(np.uint64) << np.uint64(16) | (last - first).astype(np.uint64)
    context = mix(mix(whole[first]) * STEPS[1] + mix(mix(whole[last]) * STEPS[2] + shape))
    return Contexts(anchors[anchor].view(np.int64), context.view(np.int64), first, last, whole)


def steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, number within i) for every i repeated ``counts[i]`` times."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def shallow_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, all groups of a depth at once: (rows in order, group number of each).

    At each depth the rows of every group that is still tied are sorted by the next
    eight-byte word, and groups split where the word changes.
    """
    order = np.argsort(keys[:, 0])
    group = starts_to_groups(keys[order, 0][1:] != keys[order, 0][:-1])
    for depth in range(1, keys.shape[1]):
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        rows, of = order[tied], group[tied]
        word = keys[rows, depth]
        by = np.lexsort((word, of))
        order[tied] = rows[by]
        split = np.zeros(len(order), bool)
        split[tied[1:]] = (of[1:] == of[:-1]) & (word[by][1:] != word[by][:-1])
        group = starts_to_groups((group[1:] != group[:-1]) | split[1:])
    return order, group


def starts_to_groups(changes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(changes)])


class BlindTrie:
    """Orders strings of one length: inner nodes hold only a place and branches by byte there."""

    def __init__(self, first: bytes):
        self.root = [first]  # a leaf: [string]; an inner node: (place, {byte: node})

    def add(self, text: bytes) -> None:
        # go down blindly to any leaf, then compare once
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            return
        # the first byte that differs holds the highest bit that differs
        place = len(text) - ((int.from_bytes(other) ^ int.from_bytes(text)).bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < place:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node, tuple) and node[0] == place:
            node[1][text[place]] = [text]
            return
        inner = (place, {other[place]: node, text[place]: [text]})
        if above is None:
            self.root = inner
        else:
            above[1][text[above[0]]] = inner

    def strings(self) -> Iterator[bytes]:
        work = [self.root]
        while work:
            node = work.pop()
            if isinstance(node, tuple):
                work += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[0]


def deep_shallow(suffixes: np.ndarray, words: int = SHALLOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``suffixes`` in sorted order, run number of each): rows of one run are equal.

    ``suffixes`` has the bytes of one suffix a row.
    """
    padded = np.zeros((len(suffixes), -(-suffixes.shape[1] // 8) * 8), np.uint8)
    padded[:, :suffixes.shape[1]] = suffixes
    keys = padded.view(">u8").astype(np.uint64)
    order, group = shallow_sort(keys[:, :words])
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    first = order[np.searchsorted(group, group[tied])]
    differs = np.zeros(len(tied), bool)
    for word in range(words, keys.shape[1]):
        differs |= keys[order[tied], word] != keys[first, word]
    # groups that go on differing below the shallow depth are left to blind tries
    split = np.zeros(len(order), bool)
    deep = np.unique(group[tied[differs]])
    for lo, hi in zip(np.searchsorted(group, deep).tolist(), np.searchsorted(group, deep, "right").tolist(), strict=True):
        size, blob = padded.shape[1], padded[order[lo:hi]].tobytes()
        same: dict[bytes, list[int]] = {}
        for i, row in enumerate(order[lo:hi].tolist()):
            same.setdefault(blob[i * size:i * size + size], []).append(row)
        texts = iter(same)
        trie = BlindTrie(next(texts))
        for text in texts:
            trie.add(text)
        at = lo
        for text in trie.strings():
            split[at] = True
            order[at:at + len(same[text])] = same[text]
            at += len(same[text])
    return order, starts_to_groups((group[1:] != group[:-1]) | split[1:])


def slices(texts: Iterable[bytes], limit: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of about ``limit`` bytes together."""
    start, size, some = 0, 0, []
    for text in texts:
        if some and size + len(text) > (limit or SLICE):
            yield start, some
            start, size, some = start + len(some), 0, []
        some.append(text)
        size += len(text)
    if some:
        yield start, some


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts), dtype=np.int32), list(map(len, texts)))


def context_rows(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, context, doc_id): each kind of context of each document once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            texts = ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text"))
            for start, some in slices(texts):
                data, owner = joined(some)
                found = contexts(data, owner, length)
                who = owner[found.first]
                _, keep = np.unique(row_keys(found.context, who), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.anchor[keep]), pa.array(found.context[keep]), ids.take(pa.array(who[keep] + start))], names=["anchor", "context", "doc_id"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"anchor long, context long, doc_id {kind}")


def row_keys(context: np.ndarray, who: np.ndarray) -> np.ndarray:
    """One hash for a context of a document of the slice."""
    return context.view(np.uint64) + mix(who.astype(np.uint64) + np.uint64(1))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each item, items) of a column of lists without nulls among the items."""
    return pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()


def cut_out(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as a binary column."""
    of, number = steps(size)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[begin[of] + number])])


def met(rows: DataFrame) -> DataFrame:
    """(anchor, context, doc_id, lost): contexts that a smaller doc_id has (lost), and first ones of anchors with several kinds.

    Rows come sorted, so a task passes over them once with two rows in hand.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    ready = rows.repartition("anchor").sortWithinPartitions("anchor", "context", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held: (anchor, context, doc_id) of the last context's first row, and whether it was told already
        held = None
        for batch in batches:
            anchor, context, doc = (batch.column(c).to_numpy() for c in ("anchor", "context", "doc_id"))
            if not len(anchor):
                continue
            before = held or (~anchor[0], 0, 0, True)
            a, c = np.concatenate([[before[0]], anchor]), np.concatenate([[before[1]], context])
            new_anchor, new_context = a[1:] != a[:-1], (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            starts = np.flatnonzero(new_context)
            run_of = np.cumsum(new_context)  # 0: the held context goes on
            low = np.concatenate([[before[2]], doc[starts]])[run_of]
            lost = doc != low
            # first rows whose anchor has another kind before or after
            second = new_context & ~new_anchor
            told = second.copy()
            follows = second[starts]  # run i+1 is a further kind of the anchor of run i
            firsts = starts[:-1][follows[1:]] if len(starts) > 1 else starts[:0]
            told[firsts] = True
            late = len(starts) > 0 and follows[0] and not before[3]
            pick = lost | told
            cols = [anchor[pick], context[pick], doc[pick], lost[pick]]
            if late:
                cols = [np.concatenate([[x], y]) for x, y in zip((before[0], before[1], before[2], False), cols, strict=True)]
            last = starts[-1] if len(starts) else None
            held = (anchor[-1], context[-1], low[-1], bool(told[last]) if last is not None else before[3] or bool(late))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3].astype(bool))], names=["anchor", "context", "doc_id", "lost"])

    return ready.mapInArrow(run, f"anchor long, context long, doc_id {kind}, lost boolean")


def windows_to_sort(bodies: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(deal, doc_id, context, first, body): asked contexts with their bytes; first is the number of body's first window in the context.

    Windows of hot anchors come one by one, dealt by the hash of all their bytes.
    """
    kind = bodies.schema["doc_id"].dataType.simpleString()
    hot = asked.groupBy("anchor").count().filter(F.col("count") > HOT).select(F.col("anchor").alias("h"))
    marked = asked.join(hot, F.col("anchor") == F.col("h"), "left")
    wanted = marked.groupBy(F.col("doc_id").alias("d")).agg(*[F.collect_list(F.when(F.col("h").isNull() == cold, F.col("context"))).alias(name) for cold, name in ((True, "whole"), (False, "single"))])
    both = bodies.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("d")).select("doc_id", "body", "whole", "single")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = batch.column("doc_id")
            for start, some in slices(unpack(b.as_py()) for b in batch.column("body")):
                data, owner = joined(some)
                found = contexts(data, owner, length)
                who = owner[found.first]
                keys, place = np.unique(row_keys(found.context, who), return_index=True)

                def places(name):
                    of, items = flat(batch.column(name).slice(start, len(some)))
                    return place[np.isin(keys, row_keys(items, of))]

                whole, single = places("whole"), places("single")
                of, number = steps((found.last - found.first + 1)[single])
                at = found.first[single][of] + number
                rows = np.concatenate([whole, single[of]])
                begin = np.concatenate([found.first[whole], at])
                size = np.concatenate([(found.last - found.first)[whole] + length, np.full(len(at), length)])
                deal = np.concatenate([found.anchor[whole], found.anchor[single[of]] ^ mix(found.window[at]).view(np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(deal), ids.take(pa.array(who[rows] + start)), pa.array(found.context[rows]), pa.array(np.concatenate([np.zeros(len(whole), np.int32), number.astype(np.int32)])), cut_out(data, begin, size)],
                    names=["deal", "doc_id", "context", "first", "body"])

    return both.mapInArrow(run, f"deal long, doc_id {kind}, context long, first int, body binary")


def judge(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks of lost windows, whether all windows are lost) of rows of whole deals. Equal windows have one anchor, so they are of one deal."""
    body = rows.column("body").combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset:body.offset + len(body) + 1]
    data, count = np.frombuffer(body.buffers()[2], np.uint8), np.diff(ends) - length + 1
    owner, number = steps(count)
    order, run_of = deep_shallow(np.lib.stride_tricks.sliding_window_view(data, length)[ends[owner] + number])
    doc = rows.column("doc_id").to_numpy()[owner[order]]
    low = np.minimum.reduceat(doc, np.searchsorted(run_of, np.arange(run_of[-1] + 1)))
    gone = order[doc > low[run_of]]
    masks, n_gone = np.zeros(len(count), np.int64), np.bincount(owner[gone], minlength=len(count))
    np.bitwise_or.at(masks, owner[gone], np.int64(1) << (number[gone] + rows.column("first").to_numpy()[owner[gone]]))
    return masks, n_gone == count


def sorted_losses(rows: DataFrame, length: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """(doc_id, context, mask): bit i is set if window i of the context also starts in a smaller doc_id.

    A deal that outgrows ``held_rows`` is judged in parts: rows that have lost all
    windows can tell later ones nothing, as equal windows of a smaller doc_id stay.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    ready = rows.repartition("deal").sortWithinPartitions("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = None, held_rows

        def told(some: pa.Table, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
            lost = np.flatnonzero(masks)
            out = some.select(["doc_id", "context"]).take(pa.array(lost)).append_column("mask", pa.array(masks[lost]))
            return iter(out.combine_chunks().to_batches())

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            # whole deals only; the last one may go on in the next batch
            deals = held.column("deal").to_numpy()
            cut = int(np.searchsorted(deals, deals[-1]))
            if cut:
                some = held.slice(0, cut)
                yield from told(some, judge(some, length)[0])
                held, room = held.slice(cut), held_rows
            if held.num_rows > room:
                masks, all_lost = judge(held, length)
                yield from told(held, masks)
                held = held.take(pa.array(np.flatnonzero(~all_lost)))
                room = max(held_rows, 2 * held.num_rows)
        if held is not None:
            yield from told(held, judge(held, length)[0])

    return ready.mapInArrow(run, f"doc_id {kind}, context long, mask long")


def covered(data: np.ndarray, owner: np.ndarray, of: np.ndarray, lost: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of joined texts go, from the masks of the lost windows (-1: all) of contexts of text ``of``."""
    if not len(lost):
        return np.zeros(len(data), bool)
    found = contexts(data, owner, length)
    keys = row_keys(lost, of)
    by = np.argsort(keys)
    keys, start = np.unique(keys[by], return_index=True)
    masks = np.bitwise_or.reduceat(masks[by], start)
    asked = row_keys(found.context, owner[found.first])
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    mask = np.where(keys[at] == asked, masks[at], 0)
    edge, whole, some = np.zeros(len(data) + 1, np.int32), np.flatnonzero(mask == -1), np.flatnonzero((mask != -1) & (mask != 0))
    edge[found.first[whole]] += 1
    edge[found.last[whole] + length] -= 1
    item, number = steps((found.last - found.first + 1)[some])
    place = (found.first[some][item] + number)[(mask[some][item] >> number & 1) == 1]
    edge[place] += 1
    edge[place + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept where asked for) of every row."""
    if not GRAM < length < GRAM + 48:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 47}")
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = settle(met(context_rows(docs, length)))
    bodies = packed(docs)
    asked = found.filter("not lost")
    masks = sorted_losses(windows_to_sort(bodies, asked, length), length)
    lost = found.filter("lost").select("doc_id", "context", F.lit(-1).cast("long").alias("mask")).unionByName(masks)
    per_doc = lost.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("context", "mask")).alias("lost"))
    both = bodies.join(per_doc.hint("shuffle_hash"), F.col("doc_id") == F.col("d"), "left").select("doc_id", "body", F.col("lost.context").alias("context"), F.col("lost.mask").alias("mask"))
    extra = ", kept binary" if keep_bytes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for start, some in slices(unpack(b.as_py()) for b in batch.column("body")):
                data, owner = joined(some)
                (of, lost), (_, masks) = (flat(batch.column(c).slice(start, len(some))) for c in ("context", "mask"))
                drop = covered(data, owner, of, lost, masks, length)
                ends = np.concatenate([[0], np.cumsum(list(map(len, some)))])
                begins = drop.copy()
                begins[1:] &= ~drop[:-1] | (owner[1:] != owner[:-1])
                removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (drop, begins))
                rest, kept_ends = data[~drop].tobytes(), ends - np.concatenate([[0], np.cumsum(drop)])[ends]
                texts = [rest[a:b] for a, b in zip(kept_ends[:-1].tolist(), kept_ends[1:].tolist(), strict=True)]
                cols = [batch.column("doc_id").slice(start, len(some)), pa.array(np.diff(ends)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())], names=[*names, "kept"]) if keep_bytes else pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), keep_bytes=False)


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL: dict[str, str] = {}
