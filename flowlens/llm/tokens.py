"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each trie node has a failure link and the
number of pieces that greedy longest match has surely cut off when the automaton
takes that link, so one pass over a word's bytes counts its pieces without building
any of them, and no byte is read twice. A word that cannot be cut counts as one
token.

Words are runs of letters, digits and underscores, or single other characters; white
space separates. Counts of recurring strings between white space are remembered in
a table of bounded size per task.

Null or empty text: 0 words, 0 tokens. Very long texts are counted whole. Rows are
independent: repeated rows and null ids give rows of their own. Empty table: empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from flowlens.llm.common import table
from pyspark.sql import DataFrame, SparkSession

NONE = -1
WORD = re.compile(r"\w+|[^\w\s]")
REMEMBERED = 500_000
WORDS = 1 << 40


class LongestMatch:
    """Counts greedy longest-match pieces of a word.

    ``first`` are the pieces that may begin a word, ``later`` those that may go on
    (None: the same pieces, one shared trie).
    """

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes] | None = None):
        self.child: dict[int, int] = {}
        self.ends = bytearray()
        self.start = self._node()
        self.resume = self.start if later is None else self._node()
        for root, pieces in ((self.start, first), (self.resume, later or ())):
            for piece in pieces:
                self._add(root, piece)
        self._link()

    def _node(self) -> int:
        self.ends.append(0)
        return len(self.ends) - 1

    def _add(self, node: int, piece: bytes) -> None:
        if not piece:
            return
        for byte in piece:
            key = node << 8 | byte
            nxt = self.child.get(key)
            if nxt is None:
                nxt = self.child[key] = self._node()
            node = nxt
        self.ends[node] = 1

    def _link(self) -> None:
        """Breadth first: a node's link follows from the links of shallower nodes."""
        child, count = self.child, len(self.ends)
        self.fail, self.popped = array("i", [NONE]) * count, array("i", [0]) * count
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        level = [self.start] if self.resume == self.start else [self.start, self.resume]
        while level:
            deeper = []
            for parent in level:
                for byte, node in below.get(parent, ()):
                    if self.ends[node]:
                        self.fail[node], self.popped[node] = self.resume, 1
                    else:
                        target, pieces = self.fail[parent], self.popped[parent]
                        while target != NONE and target << 8 | byte not in child:
                            pieces += self.popped[target]
                            target = self.fail[target]
                        if target != NONE:
                            self.fail[node], self.popped[node] = child[target << 8 | byte], pieces
                    deeper.append(node)
            level = deeper

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 for a word that cannot be cut, 0 for an empty one."""
        child, fail, popped = self.child, self.fail, self.popped
        node, pieces = self.start, 0
        for byte in word:
            while (nxt := child.get(node << 8 | byte)) is None:
                pieces += popped[node]
                node = fail[node]
                if node == NONE:
                    return 1
            node = nxt
        while node != self.resume and word:
            pieces += popped[node]
            node = fail[node]
            if node == NONE:
                return 1
        return pieces


class Counts(dict):
    """String between white space -> words * WORDS + tokens; forgets all when full."""

    def __init__(self, matcher: LongestMatch):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, text: str) -> int:
        words = WORD.findall(text.lower())
        value = len(words) * WORDS + sum(self.matcher.count(w.encode("utf-8", "replace")) for w in words)
        if len(self) >= REMEMBERED:
            self.clear()
        self[text] = value
        return value


#: The automaton of this worker's last task, by the job's key.
_BUILT: dict[str, Counts] = {}


def count_tokens(docs: DataFrame, first: list[bytes], later: list[bytes] | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) with the given pieces; the vocabulary is broadcast, its size does not depend on the data."""
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast((first, later)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _BUILT.get(key)
        if counts is None:
            _BUILT.clear()
            counts = _BUILT[key] = Counts(LongestMatch(*shared.value))
        get = counts.__getitem__
        for batch in batches:
            totals = [sum(map(get, t.as_py().split())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t // WORDS for t in totals], pa.int64()), pa.array([t % WORDS for t in totals], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: visible Latin-1 characters for themselves, the rest from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces_of(path: str, word_end: str = "</w>") -> list[bytes]:
    """Pieces of a byte-level vocabulary file, without special tokens and word-end marks."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    special, letters = {t["content"] for t in given.get("added_tokens", [])}, byte_alphabet()
    names = {p.removesuffix(word_end) for p in given["model"]["vocab"] if p not in special}
    return sorted(bytes(letters[c] for c in p) for p in names if p and all(c in letters for c in p))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), pieces_of(public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
