"""Sum-of-squares packing of token sequences.

Each document is tokenised, closed by an end id, and cut into pieces of ``capacity``
only if longer. A piece goes into the open bin, or a new one, that makes the sum
over residual gaps of (open bins of that gap) squared smallest; filled bins leave
the sum. Larger pieces go first.

Tokenising is one pass in map tasks. The (document, piece) rows, without ids, are
dealt evenly by hash into groups of about ``group_rows`` pieces, whatever source or
length they have, and each group is packed by one task; a group wastes about as much
as a few bins, whatever the number of groups.

Null or empty text: the end id alone. Null doc_id: packed like any other. Repeated
rows: packed as often as they occur. Empty table: empty result. Very long texts are
cut into whole pieces. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from flowlens.llm.common import settle, table
from flowlens.llm.tokens import byte_alphabet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 1
REMEMBERED = 500_000
#: Bytes of text, and one text more, that are split together.
TOGETHER = 1_000_000
#: Not before an apostrophe, which may begin a string of its own ('s).
PLAIN_THEN_SIGN = r"([A-Za-zªµºÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
LATIN = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
LETTERS = {byte: letter for letter, byte in byte_alphabet().items()}


def tokenizer_of(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


class Ids(dict):
    """String without spaces -> its token ids as bytes; forgets all when full.

    The tokenizer drops white space, never merges across it and takes runs of
    letters, single digits and runs of other signs for themselves. So a text's ids
    are those of its strings in order, and a run of plain Latin letters, alone or
    before a run of ASCII signs, can go straight to the tokenizer's model, lower-cased
    and spelled in its byte letters, as the tokenizer itself would do.

    The texts of a batch are split by Arrow, also between a plain letter and the signs
    after it, and only their distinct strings are looked up here.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.spelling = str.maketrans({c: "".join(LETTERS[b] for b in chr(c).encode()) for c in range(0xAA, 0x100)})

    def __missing__(self, text: str) -> bytes:
        plain = LATIN.fullmatch(text)
        if not plain:
            value = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        elif plain[2]:
            value = self[plain[1]] + self[plain[2]]
        else:
            value = array("I", [t.id for t in self.model.tokenize(text.lower().translate(self.spelling))]).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[text] = value
        return value

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def of_all(self, texts: pa.Array) -> Iterator[bytes]:
        """:meth:`of` each text."""
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")) // TOGETHER
        firsts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for first, end in zip(firsts, [*firsts[1:], len(texts)], strict=False):
            some = pc.fill_null(texts.slice(first, end - first), "").cast(pa.large_string())
            some = pc.replace_substring(some, "\n", " ")
            plain = pc.replace_substring_regex(pc.ascii_lower(some), PLAIN_THEN_SIGN, r"\1 \2")
            # that could spell, or split, a special token
            words = pc.split_pattern(pc.if_else(pc.match_substring(some, "<|"), some, plain), " ")
            coded = words.flatten().dictionary_encode()
            ids = pa.array([self[w] for w in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
            ends = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[words.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(words) + 1)
            whole = memoryview(ids.buffers()[2] or b"")
            for i in range(len(words)):
                yield bytes(whole[ends[i]:ends[i + 1]])


#: The tokenizer of this worker's last task, by the job's key.
_READY: dict[str, Ids] = {}


def cut(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared, key = docs.sparkSession.sparkContext.broadcast(definition), uuid.uuid4().hex
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _READY.get(key)
        if ids is None:
            _READY.clear()
            ids = _READY[key] = Ids(tokenizer_of(shared.value))
        for batch in batches:
            rows, owners = [], batch.column("doc_id")
            for at, found in enumerate(ids.of_all(batch.column("text"))):
                coded = found + end
                for piece, start in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[start:start + 4 * capacity]
                    rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([owners.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size in the order given, and the bins' remaining gaps."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, np.int64)  # counts[0] stays 0: full bins leave the sum
    bins, offsets, gaps = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        # taking gap g turns one bin of gap g into one of gap g - size
        gain = counts[:capacity + 1 - size] - counts[size:]
        gain[0] = 2 * gain[0] - 1
        gain[1:] *= 2
        gain[counts[size:] == 0] = 1 << 60
        best = int(gain.argmin())
        fresh_bin = 2 * int(counts[capacity - size]) - 1 if size < capacity else -1
        if gain[best] <= fresh_bin and gain[best] < 1 << 60:
            gap = best + size
            chosen = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, chosen = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = chosen, capacity - gap
        gaps[chosen] = left = gap - size
        if left:
            open_bins[left].append(chosen)
            counts[left] += 1
    return bins, offsets, np.array(gaps, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 50_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset, gapless from 0."""
    pieces = settle(pieces)  # row numbers below stay the same when a task runs again
    groups = max(1, -(-pieces.count() // group_rows))
    columns = pieces.columns

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, _ = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = rows.pop("group_").astype("int64") * (1 << 32) + bins
        rows["offset"] = offsets
        return rows

    dealt = pieces.withColumn("group_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("group_").applyInPandas(place, schema).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = 50_000) -> DataFrame:
    return pack(cut(docs, definition, capacity, end_id), capacity, group_rows)


def definition_at(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), definition_at(public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
SQL: dict[str, str] = {}
