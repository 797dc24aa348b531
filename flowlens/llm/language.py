"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector, drawn from a seed and its code point. An
n-gram's vector binds (multiplies) the vectors of its letters, each permuted
(rotated) by its distance from the n-gram's end. A document bundles (adds) the
vectors of its n-grams, a language bundles the unit vectors of its learning
documents. A text gets the language of the nearest prototype by cosine; the score is
that cosine, no less than 0. Ties go to the language that sorts first.

Letters are lower-cased; what lies between words counts as one space. Learning adds
integers, so its result does not depend on the order of rows or tasks. It reads all
rows that may be learnt from; per task and language one vector leaves the task.

Null text or a text without letters: ``und``, score 0. No learning row: ``und`` for
all. Null lang: not learnt from. Null doc_id: not held out, not learnt from. Very
long texts are read whole, in slices. Repeated rows count as often as they occur.
Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from flowlens.llm.common import fresh, remainder, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 512
GRAM = 3
SEED = 17
UNKNOWN = "und"
#: Unit vectors are added as integers of this scale.
SCALE = 1 << 20
#: Characters handled at once, documents bundled at once, and n-grams bound at once.
SLICE, TOGETHER, BOUND = 1_000_000, 32, 2048


class Letters:
    """Turns texts into letter numbers and holds the letters' vectors."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        self.dim, self.gram, self.seed = dim, gram, seed
        self.is_letter = np.zeros(sys.maxunicode + 1, bool)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                self.is_letter[c] = True
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, point: int) -> np.ndarray:
        if point not in self.vectors:
            bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dim, dtype=np.int8)
            self.vectors[point] = bits * 2 - 1
        return self.vectors[point]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, gram) for each n-gram in order, and the code points of each gram number."""
        lowered = [f" {t.lower()} " for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), list(map(len, lowered)))
        letter = self.is_letter[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[np.cumsum([0, *map(len, lowered[:-1])])] = True  # the space before each text
        points, owner = np.where(letter, points, 32)[keep], owner[keep]
        own, number = present(points)
        n, base = self.gram, len(own)
        if len(points) < n or base ** n > 1 << 60:
            if len(points) >= n:  # so many letters that numbers would not fit: name the grams by sorting
                rows = np.stack([points[i:len(points) - n + 1 + i] for i in range(n)], axis=1)
                own_grams, gram = np.unique(rows, axis=0, return_inverse=True)
                inside = owner[:len(rows)] == owner[n - 1:]
                return owner[:len(rows)][inside], gram[inside], own_grams
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, n), np.int64)
        code = np.zeros(len(points) - n + 1, np.int64)
        for i in range(n):
            code = code * base + number[i:len(number) - n + 1 + i]
        inside = owner[:len(code)] == owner[n - 1:]
        kinds, gram = present(code[inside])
        letters = np.stack([own[kinds // base ** (n - 1 - i) % base] for i in range(n)], axis=1)
        return owner[:len(code)][inside], gram, letters

    def bind(self, letters: np.ndarray) -> np.ndarray:
        """The vectors of n-grams given by their code points, one n-gram a row."""
        own, number = np.unique(letters, return_inverse=True)
        base = np.stack([self.vector(int(p)) for p in own]) if len(own) else np.empty((0, self.dim), np.int8)
        out = np.ones((len(letters), self.dim), np.int8)
        for i in range(self.gram):
            out *= np.roll(base, self.gram - 1 - i, axis=1)[number.reshape(letters.shape)[:, i]]
        return out

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One vector a text; zero for a text without letters."""
        owner, gram, letters = self.grams(texts)
        # an n-gram without letters is a lone space between texts, never part of a profile
        out = np.zeros((len(texts), self.dim), np.float32)
        edges = np.searchsorted(owner, np.arange(0, len(texts) + TOGETHER, TOGETHER))
        for k in range(len(edges) - 1):
            some, who = gram[edges[k]:edges[k + 1]], owner[edges[k]:edges[k + 1]] - k * TOGETHER
            if len(some):
                kinds, at = present(some)
                rows = min(TOGETHER, len(texts) - k * TOGETHER)
                counts = np.bincount(who * np.int64(len(kinds)) + at, minlength=rows * len(kinds)).reshape(rows, -1)
                for i in range(0, len(kinds), BOUND):
                    out[k * TOGETHER:k * TOGETHER + rows] += counts[:, i:i + BOUND].astype(np.float32) @ self.bind(letters[kinds[i:i + BOUND]]).astype(np.float32)
        return out


def present(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each value among them, without a sort where the values are small."""
    top = int(values.max()) + 1 if len(values) else 0
    if top > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


def slices(texts: list[str], limit: int = SLICE) -> Iterator[list[str]]:
    """The texts in order, in lists of bounded total length (one longer text may stand alone) and number."""
    some, size = [], 0
    for text in texts:
        if some and (size + len(text) > limit or len(some) >= 32 * TOGETHER):
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


_READY: dict[str, Letters] = {}


def letters_of(key: str, dim: int, gram: int, seed: int) -> Letters:
    if key not in _READY:
        _READY.clear()
        _READY[key] = Letters(dim, gram, seed)
    return _READY[key]


def learn(docs: DataFrame, dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Language -> unit prototype, from the text and lang of all of ``docs``; a few kilobytes a language come to the driver."""
    key = f"{dim}-{gram}-{seed}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = letters_of(key, dim, gram, seed), {}
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for some in slices(batch.column("text").to_pylist()):
                units = letters.bundle(some)
                lengths = np.linalg.norm(units, axis=1, keepdims=True)
                units = np.rint(units / np.where(lengths > 0, lengths, 1) * SCALE).astype(np.int64)
                for lang in set(langs[at:at + len(some)]):
                    sums[lang] = sums.get(lang, 0) + units[[x == lang for x in langs[at:at + len(some)]]].sum(axis=0)
                at += len(some)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(total)], names=["lang", "i", "x"])

    known = docs.filter("lang is not null and text is not null").select("text", "lang")
    sums = known.mapInArrow(run, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    out = {r["lang"]: np.array([v["x"] for v in r["v"]], np.float64) for r in rows}
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], columns: list[str], dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """``columns`` of ``docs`` with lang_pred and score; only the text is looked at."""
    names, key = list(prototypes), f"{dim}-{gram}-{seed}"
    # whole numbers, as the texts' vectors are, add up to the same sum in any order
    matrix = np.rint(np.stack([prototypes[n] for n in names], axis=1) * SCALE) if names else None
    (source,) = ["text"] if "text" in columns else fresh(docs, "text")
    kept = docs.select(*columns, *([] if "text" in columns else [F.col("text").alias(source)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letters_of(key, dim, gram, seed)
        for batch in batches:
            langs, scores = [], []
            for some in slices([t or "" for t in batch.column(source).to_pylist()]):
                vectors = letters.bundle(some).astype(np.float64)
                lengths = np.sqrt((vectors * vectors).sum(axis=1))
                if matrix is None:
                    near, best = np.zeros(len(some), int), np.zeros(len(some))
                else:
                    cosines = (vectors @ matrix) / (np.where(lengths > 0, lengths, 1) * SCALE)[:, None]
                    near, best = cosines.argmax(axis=1), cosines.max(axis=1)
                langs += [names[i] if n > 0 and names else UNKNOWN for i, n in zip(near, lengths, strict=True)]
                scores += np.where(lengths > 0, np.clip(best, 0, 1), 0).tolist()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(docs: DataFrame):
    return F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = learn(docs.filter(remainder(F.col("doc_id"), 3) != 1))
    return predict(docs, prototypes, ["doc_id"]).withColumn("held_out", held_out(docs)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
