"""Plain-Python twins of the language profiles and of the quality rules' verdict."""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict

import pytest
from flowlens.llm import language, quality
from flowlens.llm.common import table


def profile(text, letters):
    """Bound and bundled letter vectors of one text, one n-gram at a time."""
    shown = []
    for c in f" {(text or '').lower()} ":
        is_letter = unicodedata.category(c)[0] == "L"
        if is_letter or not shown or shown[-1] != " ":
            shown.append(c if is_letter else " ")
    total = [0] * letters.dim
    for at in range(len(shown) - letters.gram + 1):
        for d in range(letters.dim):
            product = 1
            for i in range(letters.gram):
                product *= int(letters.vector(ord(shown[at + i]))[(d - (letters.gram - 1 - i)) % letters.dim])
            total[d] += product
    return total if any(c != " " for c in shown) else [0] * letters.dim


def length(v):
    return math.sqrt(sum(x * x for x in v))


def test_language_profiles_equal_plain_bind_and_bundle(spark):
    rows = [(1, "The cat, the hat.", "en"), (2, "le chat et la souris", "fr"), (3, "a", "en"), (4, "Über 3 Brücken", "de"), (5, "", "de"), (6, None, "fr"),
            (7, "the the the", None), (8, "42", "en"), (9, "le chat et la souris", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters = language.Letters(dim=64)
    vectors = {i: profile(text, letters) for i, text, _ in rows}
    sums = defaultdict(lambda: [0.0] * 64)
    for i, text, lang in rows:
        if lang and text is not None and length(vectors[i]):
            sums[lang] = [a + b / length(vectors[i]) for a, b in zip(sums[lang], vectors[i], strict=True)]
    got = {r["doc_id"]: r for r in language.predict(docs, language.learn(docs, dim=64), ["doc_id"], dim=64).collect()}
    for i, _, _ in rows:
        size = length(vectors[i])
        cosines = {k: sum(a * b for a, b in zip(v, vectors[i], strict=True)) / (length(v) * size) if size else 0.0 for k, v in sums.items()}
        best = max(cosines, key=cosines.get)
        assert got[i]["lang_pred"] == (best if size else "und")
        assert got[i]["score"] == pytest.approx(min(max(cosines[best], 0), 1) if size else 0.0, abs=1e-4)


def test_quality_verdict_equals_sorted_lists(spark):
    """Thresholds from whole sorted lists: a sketch of fewer rows than its accuracy is exact."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    width = 2.0
    rated = quality.ratios(quality.base_counts(docs)).collect()
    good = [r for r in rated if not r["base_failed"]]
    groups = defaultdict(list)
    for r in good:
        for key in ((r["lang"], r["source"]), (r["lang"],), ()):
            groups[key].append(r)

    # about half of the pairs of language and source have enough rows of their own
    sizes = sorted(len(g) for k, g in groups.items() if len(k) == 2)
    min_rows = sizes[len(sizes) // 2]

    def quantile(group, c, share):
        values = sorted(r[c] for r in group)
        return values[max(math.ceil(share * len(values)), 1) - 1]

    limits = {}
    for key, group in groups.items():
        if len(group) >= min_rows or key == ():
            low, high = (quantile(group, "word_length", p) for p in quality.DECILES)
            spread = width * max(high - low, quality.LEAST_SPREAD)
            limits[key] = {"word_length": (low - spread, high + spread), **{c: (0.0, quantile(group, c, 1 - s)) for c, s in quality.SHARES.items()}}
    assert {len(k) for k in limits} == {0, 1, 2} and sizes[0] < min_rows
    got = {r["doc_id"]: r for r in quality.judge(docs, min_rows, width).collect()}
    assert len(got) == len(rated)
    for r in rated:
        own = next(limits[k] for k in ((r["lang"], r["source"]), (r["lang"],), ()) if k in limits)
        failed = [c for c in quality.RATIOS if not own[c][0] <= r[c] <= own[c][1]]
        assert got[r["doc_id"]]["failed_rules"] == failed
        assert got[r["doc_id"]]["kept"] == (not r["base_failed"] and not failed)
