"""Minimum slack packing, Merkle manifest and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from flowlens.llm import manifest, packing, slack, variants
from flowlens.llm.common import table
from flowlens.llm.packing import definition_at, tokenizer_of
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "no id here at all, nothing whatever", "en", "s", 1), (1, None, "en", None, 2), (2, "", None, "s", None), (3, " \n\t ", "", "s", 3), (4, "a b c\nd\ne", "en", "s", 4),
       (4, "a b c\nd\ne", "en", "s", 4), (4, "same id, other text", "de", "s", 5), (5, "x " * 9_000, "en", "s", 6), (6, "Ünïcode <|im_end|> 😀 words", "de", None, 7),
       (7, "abcdefgh" * 3_000 + " whatever Whatever whateverr", "zz", "s", 2 ** 63 - 1), (8, "whatever " * 40, None, "s", 8), (30, "whateverr " * 3, None, "s", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"key": F.lit(1), "rank": F.lit("x"), "n": F.lit(0), "word": F.lit(2), "ids": F.lit(3), "path": F.lit(4)})


@pytest.fixture(scope="module")
def definition():
    return definition_at(public_tokenizers.path("word_bpe_49k.json"))


# --- minimum bin slack

def test_closest_multiset_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(2, 9))]
        stock, seed, gap = slack.Stock(lengths), max(lengths), rng.randint(1, 60)
        others = list(lengths)
        others.remove(seed)
        best = max(s for n in range(len(others) + 1) for c in itertools.combinations(others, n) if (s := sum(c)) <= gap)
        chosen = stock.closest(seed, gap)
        assert sum(k * v for k, v in chosen.items()) == best
        assert not chosen - Counter(others)


@pytest.mark.parametrize("cut", [True, False])
def test_windows_hold_every_token_once(cut):
    rng = random.Random(4)
    for capacity in (64, 100, 4096):
        for lengths in ([], [1], [capacity - 1], [3 * capacity // 4] * 50, [1] * 1000, [rng.randint(1, capacity - 1) for _ in range(300)]):
            windows = slack.minimum_slack(lengths, capacity, cut)
            seen = defaultdict(list)
            for window in windows:
                total = sum(length for _, _, length in window)
                assert total <= capacity
                assert not cut or total == capacity or total & (total - 1) == 0
                for row, first, length in window:
                    seen[row].append((first, length))
            assert len(seen) == len(lengths)
            for row, parts in seen.items():
                reached = 0
                for first, length in sorted(parts):
                    assert first == reached
                    reached += length
                assert reached == lengths[row]
                assert cut or len(parts) == 1
            if cut and lengths and sum(lengths) >= capacity:
                assert sum(map(len, windows)) - len(lengths) <= len(windows) + capacity.bit_length()
            if not cut and lengths:
                assert len(windows) <= 2 * sum(lengths) / capacity + 1


def pieces_are_right(docs, rows, tokenizer):
    """Every document's ids lie in its pieces once, sequences have no gaps and no padding."""
    texts = Counter((d, t or "") for d, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, pieces in by_doc.items():
        want = Counter()
        for (d, text), times in texts.items():
            if d == doc_id:
                ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
                for p in pieces:
                    assert p.length > 0
                    if p.doc_tokens == len(ids) and zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32:
                        want[p.start, p.length] += 0
                want["tokens"] += times * len(ids)
        assert sum(p.length for p in pieces) == want.pop("tokens")
        assert {(p.start, p.length) for p in pieces} == set(want)
    for pieces in by_sequence.values():
        reached = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == reached
            reached += p.length
        assert reached == 4096 or reached < 4096 and reached & (reached - 1) == 0


def test_packed_pieces_are_the_tokenizers(spark, sf_dir, definition, odd):
    tokenizer = tokenizer_of(definition)
    docs = table(spark, sf_dir, "documents")
    pieces_are_right([(r.doc_id, r.text) for r in docs.collect()], slack.op11_minimum_slack_packing(spark, sf_dir).collect(), tokenizer)
    for group_rows in (3, 1000):
        rows = slack.pack_with_little_slack(odd, definition, group_rows=group_rows).collect()
        pieces_are_right([(r[0], r[1]) for r in ODD], rows, tokenizer)
    assert [r for r in rows if r.doc_id == 2][0].doc_tokens == 1
    assert max(r.doc_tokens for r in rows if r.doc_id == 5) == 9001
    assert slack.pack_with_little_slack(odd.filter("false"), definition).count() == 0
    assert {r.length for r in slack.pack_with_little_slack(odd.filter("doc_id = 5"), definition, cut=False).collect()} == {4096, 9001 - 2 * 4096}


def test_strings_of_a_batch_are_taken_apart_once(definition, monkeypatch):
    tokenizer = tokenizer_of(definition)
    calls = []

    class Counted:
        model = tokenizer.model

        def encode(self, text, **more):
            calls.append(text)
            return tokenizer.encode(text, **more)

    monkeypatch.setattr(packing, "TOGETHER", 40)
    ids = packing.Ids(Counted())
    texts = ["", None, "  Word###\n\nword... WORD,!! wörd", "don't a.'s É'S 'tis", "A<|endoftext|>b <|ENDOFTEXT|>", "Σ.ΟΔΟΣ! A\u030a. ǅ!", "x\t.y-z 12,5", "word" * 50 + "!"]
    whole = pa.array([*texts, *texts])
    for some in (whole, whole.slice(3, 6), whole.slice(0, 0)):
        for text, found in zip(some, ids.of_all(some), strict=True):
            want = tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids
            assert np.frombuffer(found, "<u4").tolist() == want and ids.of(text.as_py()) == found
    calls.clear()
    fresh = packing.Ids(Counted())
    list(fresh.of_all(pa.array(["Word### word### WORD### wORD", "wörd!!! Wörd"])))
    assert sorted(calls) == ["!!!", "###"] and not any(w != w.lower() for w in fresh if w.isascii())


# --- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    """All levels of the plain tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i, digest):
    found = []
    for nodes in levels[:-1]:
        sibling = nodes[i ^ 1:(i ^ 1) + 1]
        found += sibling
        digest = sha(*(sibling + [digest] if i % 2 else [digest] + sibling))
        i //= 2
    return found, digest


def plain_manifest(docs):
    by_lang, out = defaultdict(list), []
    for doc_id, text, lang, source, n_chars in docs:
        plus = n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        by_lang[lang].append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n_chars, text), leaf_of(doc_id, source, lang, n_chars + plus if n_chars is not None else None, text)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort()
        trees[lang] = tree_of([r[2] for r in by_lang[lang]])
    top = tree_of([trees[x][-1][0] for x in langs])
    for k, lang in enumerate(langs):
        for i, (given, doc_id, leaf, folded) in enumerate(by_lang[lang]):
            low, digest = climb(trees[lang], i, folded)
            high, digest = climb(top, k, digest)
            out.append((doc_id if given else None, leaf, trees[lang][-1][0], top[-1][0], sha(*low, *high), digest, digest == top[-1][0]))
    return out


def test_layout_is_a_permutation_with_whole_subtrees():
    for height in range(1, 14):
        at = [manifest.addresses(height, d, np.arange(1 << d)) for d in range(height)]
        assert sorted(np.concatenate(at)) == list(range((1 << height) - 1))
        upper = height // 2
        if upper:  # the upper half lies first, then one subtree after the other
            assert max(np.concatenate(at[:upper])) < (1 << upper) - 1
            size = (1 << height - upper) - 1
            for d in range(upper, height):
                assert ((at[d] - ((1 << upper) - 1)) // size == np.arange(1 << d) >> d - upper).all()


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest_equals_the_plain_tree(spark, odd, levels):
    assert ordered(manifest.manifest(odd, levels).collect()) == ordered(plain_manifest(ODD))
    rng = random.Random(levels)
    docs = [(rng.randint(0, 400), "t" * rng.randint(0, 5), rng.choice(["en", "en", "en", "de", None, "é", "z"]), "s", rng.randint(0, 9)) for _ in range(150)] + [(5000, "one", "only", None, 1)]
    assert ordered(manifest.manifest(spark.createDataFrame(docs, DOCS).repartition(3), levels).collect()) == ordered(plain_manifest(docs))


def test_manifest_of_few_rows(spark, odd):
    assert manifest.manifest(odd.filter("false")).count() == 0
    one = manifest.manifest(odd.filter("doc_id = 5")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_blocks_can_be_read_back():
    leaves = [sha(str(i)) for i in range(11)]
    block = manifest.Block.build(4, leaves, True)
    again = manifest.Block.unpack(4, block.size, block.height, block.pack())
    assert all(manifest.fold(leaf, again.path(i)) == block.root == tree_of(leaves)[-1][0] for i, leaf in enumerate(leaves))


# --- spelling variants

def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(docs, shortest, least, times, spoil):
    n = Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= shortest
    n = {w: c for w, c in n.items() if c >= least}
    near = {w: [x for x in n if are_near(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("key_rows,bucket_rows", [(10_000, 100_000), (3, 40)])
def test_variants_equal_brute_force(spark, key_rows, bucket_rows):
    rng = random.Random(key_rows)
    base = ["".join(rng.choices("abéÿ", k=rng.randint(3, 7))) for _ in range(25)]
    docs = []
    for i in range(60):
        words = [rng.choice(base[:3]) if rng.random() < 0.6 else rng.choice(base) for _ in range(40)]
        docs.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    docs += [(100, "aba " * 2000 + "abab " * 130 + "ababb " * 9 + "ababbe "), (101, "ababbe")]  # forms of forms
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for spoil, times in ((5, 10), (None, 2)):
        got = variants.group_variants(frame, shortest=3, least=1, times=times, spoil=spoil, key_rows=key_rows, bucket_rows=bucket_rows)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        want = plain_variants(docs, 3, 1, times, spoil)
        assert any(f is not None and f != r for _, f, r, *_ in want)
        assert ordered(got.collect()) == ordered(want)


def test_variants_of_odd_rows(spark, odd):
    got = ordered(variants.group_variants(odd, spoil=31).collect())
    assert got == ordered(plain_variants([(r[0], r[1]) for r in ODD], 7, 2, 10, 31))
    assert variants.group_variants(odd.filter("false")).count() == 0
    assert variants.group_variants(odd.filter("text is null or text = ''")).count() == 0


def test_long_words_meet(spark):
    long = "".join(random.Random(5).choices("abcdefgh", k=3000))
    docs = spark.createDataFrame([(i, long) for i in range(20)] + [(50, f"{long[:2000]}x{long[2000:]} {long[:-1]}")], "doc_id long, text string")
    got = {len(r.word): (r.n_near, r.n, r.form == long) for r in variants.group_variants(docs, least=1).collect()}
    assert got == {3000: (2, 20, False), 3001: (1, 1, True), 2999: (1, 1, True)}
