"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learnt from labelled documents: terms that
occur in more toxic documents than chance explains. Each text then has densities of
lexicon hits, hits in obfuscated spelling, the nearness of hits to second-person
words, capitals, punctuation, symbols and length. Boosted trees (``pyspark.ml``)
learn from these, and an isotonic fit on rows that the trees have not seen turns
their output into a score; a hundredth of the score is the trees' own output, which
orders texts on one step of the fit.

Learning takes at most ``sample_rows`` labelled rows, by hash order; lexicon, trees
and calibration learn from separate parts. Everything else reads all rows.

Null or empty text: scored like a text without words. Several labels of one document:
toxic if any says so; null labels are left out. Labels of one class only: the score
is the share of that class. Null doc_id: not held out, never learnt from. Repeated
rows get equal scores. Very long texts are read whole. Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from flowlens.llm.common import remainder, table
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_ROWS = 30_000
MAX_TERMS = 2_000
REMEMBERED = 200_000
#: Terms that a task counts before it hands the counts on.
COUNTED = 100_000
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Signs that stand for letters, and signs that only break words up.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", ".": None, "-": None, "_": None, "*": None, "'": None})
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os".split())
FEATURES = ["density", "weight_density", "hits", "distinct", "strongest", "obfuscated", "nearness", "second_person", "capitals", "exclamations", "punctuation", "symbols", "words"]


def terms(word: str) -> list[str]:
    """A word and its beginnings, marked by a star."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


class Looked(dict):
    """String between white space -> None, or (term weight, term, obfuscated, second person)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def weight(self, word: str) -> tuple[float, str]:
        return max(((self.lexicon[t], t) for t in terms(word) if t in self.lexicon), default=(0.0, ""))

    def __missing__(self, text: str):
        low, value = text.lower(), None
        words = WORD.findall(low)
        weight, term = max(map(self.weight, words), default=(0.0, ""))
        hidden = False
        if not weight and len(low) < 60 and not low.isalpha():
            weight, term = max(map(self.weight, WORD.findall(low.rstrip(".!,;:?").translate(STAND_INS))), default=(0.0, ""))
            hidden = weight > 0
        you = any(w in SECOND_PERSON for w in words)
        if weight or you:
            value = (weight, term, hidden, you)
        if len(self) >= REMEMBERED:
            self.clear()
        self[text] = value
        return value


def features_of(text: str | None, looked: Looked) -> list[float]:
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    marked = [(i, v) for i, v in enumerate(map(looked.__getitem__, words)) if v]
    hits = [(i, v) for i, v in marked if v[0]]
    yous = np.array([i for i, v in marked if v[3]])
    weights = [v[0] for _, v in hits]
    nearness = max((1 / (1 + int(np.abs(yous - i).min())) for i, _ in hits), default=0.0) if len(yous) else 0.0
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    marks, signs = int(raw[[33, 63]].sum()), int(raw[[35, 36, 37, 38, 42, 60, 62, 64, 124]].sum())
    return [1000 * len(hits) / n, sum(weights) / n, float(np.log1p(len(hits))), float(len({v[1] for _, v in hits})), max(weights, default=0.0),
            sum(v[2] for _, v in hits) / n, nearness, len(yous) / n, upper / max(upper + lower, 1), marks / n,
            int(raw[[44, 46, 58, 59]].sum()) / n, signs / n, float(np.log1p(len(words)))]


def learn_lexicon(docs: DataFrame, max_terms: int = MAX_TERMS, least: float = 1.5, surprise: float = 15.0) -> dict[str, float]:
    """Term -> log odds, from (text, toxic) rows: terms with log odds and G-test at or over the limits, at most ``max_terms`` by the test."""

    def counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = [t for t in counts[0] | counts[1] if len(t) < 60]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][t] for t in names], pa.int64()), pa.array([counts[1][t] for t in names], pa.int64())], names=["term", "c", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update({t for w in set(WORD.findall((text.as_py() or "").lower())) for t in terms(w)})
                if len(counts[0]) + len(counts[1]) >= COUNTED:  # partial counts go on to Spark's sums
                    yield counted(counts)
                    counts = (Counter(), Counter())
        yield counted(counts)

    docs = docs.select("text", "toxic")
    size = docs.agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("c"), F.count(F.when(F.col("toxic") == 1, 1)).alias("t")).first()
    if not size["c"] or not size["t"]:
        return {}
    sums = docs.mapInArrow(run, "term string, c long, t long").groupBy("term").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).filter("t >= 3")
    odds = F.log((F.col("t") + 0.5) / (size["t"] + 1.0)) - F.log((F.col("c") + 0.5) / (size["c"] + 1.0))
    share = size["t"] / (size["t"] + size["c"])
    seen = F.col("t") + F.col("c")
    g = 2 * (F.col("t") * F.log(F.col("t") / (seen * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (seen * (1 - share)))).otherwise(0.0))
    best = sums.select("term", odds.alias("odds"), g.alias("g")).filter((F.col("odds") >= least) & (F.col("g") >= surprise)).orderBy(F.desc("g"), "term").limit(max_terms)
    return {r["term"]: r["odds"] for r in best.collect()}


#: The lexicon table of this worker's last task, by the job's key.
_READY: dict[str, Looked] = {}


def featurize(docs: DataFrame, lexicon: dict[str, float], columns: list[str]) -> DataFrame:
    """``columns`` and x, the array of FEATURES of each text; the lexicon has at most MAX_TERMS terms."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Looked(shared.value)
        for batch in batches:
            rows = [features_of(t.as_py(), _READY[key]) for t in batch.column("text_")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(rows, pa.list_(pa.float64()))], names=[*columns, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, F.col("text").alias("text_")).mapInArrow(run, f"{schema}, x array<double>")


class ToxicityModel:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon, trees, steps, constant):
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, steps, constant

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 20, depth: int = 3) -> ToxicityModel:
        """``labels`` (doc_id, toxic) are the rows that may be learnt from."""
        known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id_")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        known = known.withColumn("order_", F.xxhash64(F.lit(9), "id_")).orderBy("order_", "id_").limit(sample_rows)
        # at most sample_rows rows of three numbers
        rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id_")).select("text", "toxic", F.pmod("order_", F.lit(10)).alias("part"))
        lexicon = learn_lexicon(rows.filter("part < 4"))
        # a few numbers a row, kept while the trees are fitted; a lost part is computed again
        kept = featurize(rows.filter("part >= 4"), lexicon, ["toxic", "part"]).persist()
        try:
            return cls(lexicon, *cls.learn(kept, known, rounds, depth))
        finally:
            kept.unpersist()

    @staticmethod
    def learn(kept: DataFrame, known: DataFrame, rounds: int, depth: int) -> tuple:
        """(trees, steps, constant) from (toxic, part, x)."""
        data = kept.withColumns({"features": array_to_vector("x"), "label": F.col("toxic").cast("double")})
        share = known.agg(F.avg("toxic")).first()[0]
        size = {(r["late"], r["toxic"]): r["count"] for r in data.groupBy((F.col("part") >= 8).alias("late"), "toxic").count().collect()}
        if not all(size.get((late, y)) for late in (False, True) for y in (0, 1)):
            return None, None, float(share or 0.0)
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=5).fit(data.filter("part < 8").select("features", "label"))
        late = trees.transform(data.filter("part >= 8").select("features", "label")).select("label", vector_to_array("probability")[1].alias("p"))
        return trees, IsotonicRegression(featuresCol="p").fit(late), None

    def score(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """``columns``, score and predicted for every row."""
        if self.trees is None:
            out = docs.select(*columns, F.lit(self.constant).alias("score"))
        else:
            seen = featurize(docs, self.lexicon, columns).select(*columns, array_to_vector("x").alias("features"))
            judged = self.trees.transform(seen).select(*columns, vector_to_array("probability")[1].alias("p"))
            fitted = self.steps.transform(judged)
            out = fitted.select(*columns, F.least(F.greatest(0.99 * F.col("prediction") + 0.01 * F.col("p"), F.lit(0.0)), F.lit(1.0)).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(remainder(F.col("doc_id"), 5) != 0)
    scored = ToxicityModel.fit(docs, labels).score(docs, ["doc_id"])
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
