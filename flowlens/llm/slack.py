"""Minimum bin slack packing of token sequences.

Each document is tokenised and closed by an end id. Whole stretches of ``capacity``
are sequences by themselves; the rests are dealt evenly by hash into groups of about
``group_rows``, whatever source or length they have, and each group is packed by one
task. A window takes the longest rest left; a bitset over sums, grown by the lengths
that remain and as often as they remain, finds the multiset that comes closest to
filling it, and the bitsets before each step give the counts back. A multiset that
fills its window is used as often as the counts allow.

Slack that no multiset fills is filled by cutting the shortest rest longer than it. What is
left of a group at last, less than ``capacity``, goes into windows of powers of two,
which are not padded. So nothing is padded, and few documents are cut: the number
of windows with slack. With ``cut=False`` rests stay whole and slack is padding.

Rests travel with their ids (less than ``capacity`` a row), so that a cut can be
made, and its checksum taken, where it is decided.

Null or empty text: the end id alone. Null doc_id: packed like any other. Repeated
rows: packed as often as they occur. Empty table: empty result. Very long texts are
whole sequences and one rest. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from flowlens.llm.common import settle, table
from flowlens.llm.packing import Ids, definition_at, tokenizer_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2

#: The tokenizer of this worker's last task, by the job's key.
_READY: dict[str, Ids] = {}


def coded(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) of whole stretches (ids null) and rests."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared, key = docs.sparkSession.sparkContext.broadcast(definition), uuid.uuid4().hex
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _READY.get(key)
        if ids is None:
            _READY.clear()
            ids = _READY[key] = Ids(tokenizer_of(shared.value))
        for batch in batches:
            rows = []
            for at, found in enumerate(ids.of_all(batch.column("text"))):
                whole = found + end
                for start in range(0, len(whole), 4 * capacity):
                    part = whole[start:start + 4 * capacity]
                    rows.append((at, start // 4, len(part) // 4, zlib.crc32(part), len(whole) // 4, part if len(part) < 4 * capacity else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *[pa.array(c, pa.int64()) for c in columns[1:5]], pa.array(columns[5], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


class Stock:
    """Pieces by length: (row, first token in the row)."""

    def __init__(self, lengths: list[int]):
        self.of: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for row in range(len(lengths) - 1, -1, -1):
            self.of[lengths[row]].append((row, 0))
        self.lengths = sorted(self.of)
        self.total = sum(lengths)

    def take(self, length: int) -> tuple[int, int]:
        pieces = self.of[length]
        piece = pieces.pop()
        self.total -= length
        if not pieces:
            del self.of[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return piece

    def put(self, row: int, first: int, length: int) -> None:
        if length not in self.of:
            insort(self.lengths, length)
        self.of[length].append((row, first))
        self.total += length

    def closest(self, seed: int, gap: int) -> Counter:
        """The multiset of lengths, the seed's piece left out, whose sum comes closest to the gap from below."""
        reach, within, steps = 1, (1 << gap + 1) - 1, []
        for i in range(bisect_right(self.lengths, gap) - 1, -1, -1):
            length = self.lengths[i]
            left, some = min(len(self.of[length]) - (length == seed), gap // length), 1
            while left > 0:
                some = min(some, left)
                grown = reach | reach << length * some & within
                if grown != reach:
                    steps.append((reach, length, some))
                    reach = grown
                left -= some
                some *= 2
            if reach >> gap:
                break
        best, chosen = reach.bit_length() - 1, Counter()
        for before, length, some in reversed(steps):
            if not before >> best & 1:
                best -= length * some
                chosen[length] += some
        return chosen


def minimum_slack(lengths: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (row, first token in the row, length)."""
    stock, windows = Stock(lengths), []
    while stock.total:
        window = capacity if stock.total >= capacity or not cut else 1 << stock.total.bit_length() - 1
        seed = stock.lengths[-1]
        if seed > window:  # only in a group's last windows
            row, first = stock.take(seed)
            stock.put(row, first + window, seed - window)
            windows.append([(row, first, window)])
            continue
        chosen = stock.closest(seed, window - seed)
        slack = window - seed - sum(length * n for length, n in chosen.items())
        chosen[seed] += 1
        times = 1 if slack or window < capacity else min(len(stock.of[length]) // n for length, n in chosen.items())
        parts = sorted(chosen.elements(), reverse=True)
        for _ in range(times):
            windows.append([(*stock.take(length), length) for length in parts])
        if slack and cut:  # every piece left is longer than the slack
            length = stock.lengths[bisect_right(stock.lengths, slack)]
            row, first = stock.take(length)
            windows[-1].append((row, first, slack))
            stock.put(row, first + slack, length - slack)
    return windows


def pack_with_little_slack(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID, cut: bool = True, group_rows: int = 20_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    pieces = settle(coded(docs, definition, capacity, end_id))  # row numbers below stay the same when a task runs again
    row = F.monotonically_increasing_id()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = pieces.filter("ids is null").select(*names, (-1 - row).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = pieces.filter("ids is not null")
    groups = max(1, -(-rests.count() // group_rows))

    def place(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending")]
        rows = rows.sort_by(order)
        lengths, sums, starts = (rows.column(c).to_pylist() for c in ("length", "ids_crc32", "start"))
        group, out = rows.column("group_")[0].as_py() << 32, []
        for number, window in enumerate(minimum_slack(lengths, capacity, cut)):
            offset = 0
            for at, first, length in window:
                crc = sums[at] if length == lengths[at] else zlib.crc32(rows.column("ids")[at].as_py()[4 * first:4 * (first + length)])
                out.append((at, starts[at] + first, length, crc, group + number, offset))
                offset += length
        at, *columns = zip(*out, strict=True)
        at, columns = pa.array(at, pa.int64()), [pa.array(c, pa.int64()) for c in columns]
        return pa.Table.from_arrays([rows.column("doc_id").take(at), *columns[:3], rows.column("doc_tokens").take(at), *columns[3:]],
                                    names=[*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = rests.withColumn("group_", F.pmod(F.xxhash64(row), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("group_").applyInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(packed)


def op11_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_with_little_slack(table(spark, sf_dir, "documents"), definition_at(public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op11_minimum_slack_packing": op11_minimum_slack_packing}
SQL: dict[str, str] = {}
