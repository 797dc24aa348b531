"""Brute-force versions, round trips and edge cases of the training-data operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from flowlens.llm import chat, decontaminate, jaccard, language, lines, packing, quality, suffixes, tokens, toxicity
from flowlens.llm.common import remainder, table
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "no id here at all", "en", "s", 1), (1, None, "en", None, 2), (2, "", None, "s", None), (3, " \n\t ", "en", "s", 3), (4, "a b c\nd\ne", "en", "s", 4),
       (4, "a b c\nd\ne", "en", "s", 4), (4, "same id, other text", "de", "s", 5), (5, "x " * 20_000, "en", "s", 6), (6, "Ünïcode <|im_end|> 😀 words", "de", "s", 7), (7, "\\<\\|<|", "en", "s", 8)]
VOCABULARY = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"gone": F.lit(1), "k_id": F.lit("x"), "text_": F.lit(0), "score": F.lit(2)})


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def definition():
    return packing.definition_at(public_tokenizers.path(VOCABULARY))


def operators(spark, definition):
    bench = spark.createDataFrame([(1, "a b c"), (None, "same id"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, toxic int")
    return {
        "tokens": lambda d: tokens.count_tokens(d, [b"a", b"ab"]), "lines": lines.dedup_lines,
        "language": lambda d: language.predict(d, language.learn(d), ["doc_id"]), "packing": lambda d: packing.pack_documents(d, definition),
        "decontaminate": lambda d: decontaminate.find_contamination(d, bench), "documents": lambda d: decontaminate.decontaminate(d, bench),
        "spans": lambda d: decontaminate.decontaminate(d, bench, mode="spans"), "suffixes": suffixes.dedup_substrings,
        "jaccard": jaccard.near_duplicates, "one": jaccard.one_of_each, "quality": quality.judge, "toxicity": lambda d: toxicity.ToxicityModel.fit(d, labels).score(d, ["doc_id"])}


@pytest.mark.parametrize("name", ["tokens", "lines", "language", "packing", "decontaminate", "documents", "spans", "suffixes", "jaccard", "one", "quality", "toxicity"])
def test_odd_rows_and_empty_tables(spark, odd, nothing, definition, name):
    run = operators(spark, definition)[name]
    rows = run(odd).collect()
    whole = name not in ("packing", "documents", "one")
    assert len(rows) == len(ODD) if whole else len(rows) > 0
    assert run(nothing).count() == 0


def test_stages_take_odd_and_empty_documents(spark, sf_dir, odd, nothing):
    for given in (odd.select("doc_id", "text", "lang", "source", "n_chars"), nothing.select("doc_id", "text", "lang", "source", "n_chars")):
        kept = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf_dir)
            assert kept.columns == given.columns, name
            kept = spark.createDataFrame(kept.collect(), given.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).count() >= kept.count()


def test_longest_match_equals_greedy():
    rng = random.Random(2)
    for _ in range(300):
        first = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        later = None if rng.random() < 0.5 else {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        match = tokens.LongestMatch(first, later)
        for _ in range(20):
            word, at, n = bytes(rng.choices(b"abc", k=rng.randint(0, 12))), 0, 0
            while at < len(word):
                usable = first if later is None or at == 0 else later
                size = max((len(p) for p in usable if word.startswith(p, at)), default=0)
                if not size:
                    n = 1
                    break
                at, n = at + size, n + 1
            assert match.count(word) == n


def test_packing_places_every_piece_once(docs, definition):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    rows = packing.pack_documents(docs, definition, capacity=256, group_rows=500).collect()
    want = {}
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start:start + 256]
            want[r["doc_id"], piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 256 and len(bins) <= 1.05 * sum(r["length"] for r in rows) / 256 + 3


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for at, i in enumerate(ids):
        for j in ids[at + 1:]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, n, percent):
    rng, base = random.Random(1), [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(600):  # near copies, most of them unlinked, that share many parts
        words = list(base)
        for j in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            words[j] = f"X{rng.randrange(400)}"
        texts.append(" ".join(words))
    texts += ["one two", "ONE  two", "one two three", "", None, texts[0]]
    rows = list(enumerate(texts))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in rows}
    sets = {i: {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    want = components(sets, percent)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    rng = random.Random(3)
    copied, alone, second = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(3))
    rows = [(2, copied), (4, copied), (4, alone), (4, second), (9, second), (9, None), (None, copied), (2, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit(1), "gone_text": F.lit(2), "key": F.lit(3)})
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()]
    want = [(2, copied), (4, alone), (4, second), (9, None), (None, copied), (2, copied)]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_components_of_long_chains(spark):
    rng = random.Random(6)
    chain, ordered = rng.sample(range(5000), 1000), list(range(6000, 6300))
    edges = list(zip(chain, chain[1:], strict=False)) + list(zip(ordered, ordered[1:], strict=False)) + [(7000, x) for x in range(6500, 6600)] + [(8000, 8000), (8002, 8001)]
    got = dict(jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: min(chain) for x in chain} | {x: 6000 for x in ordered} | {x: 6500 for x in [*range(6500, 6600), 7000]} | {8000: 8000, 8001: 8001, 8002: 8001}


@pytest.mark.parametrize("hot", [0, suffixes.HOT])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng, pieces = random.Random(3), ["ab", "abc", "the ", "xxxxxxx", "é", "zz "]
    texts = ["".join(rng.choices(pieces, k=rng.choice([0, 5, 30, 60, 120]))) for _ in range(150)]
    texts += [t[3:] + texts[i * 7 % 150] for i, t in enumerate(texts)] + ["a" * 500, "a" * 60, "b" + "a" * 49, "c" + "a" * 50, "abab" * 50, "baba" * 50]
    first, want = {}, {}
    for i, t in enumerate(texts):
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first.setdefault(data[p:p + 50], i) < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        want[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r[1:]) for r in suffixes.dedup_substrings(frame, keep_bytes=False).collect()} == want


def test_passage_with_many_endings_is_judged_in_parts(spark):
    """Every document holds one passage and goes on in its own way; the deal of the passage is far larger than what a task holds."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdef ", k=70))
    texts = ["".join(rng.choices("ghij", k=rng.randrange(40))) + passage + "".join(rng.choices("kl", k=rng.randrange(3, 30))) for _ in range(400)]
    rows, want = [], set()
    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        for w in range(len(t) - 49):
            window = t[w:w + 50]
            rows.append((7 if window in passage else 9, i, 1000 * i + w, 0, window.encode()))
            if first.setdefault(window, i) < i:
                want.add((i, 1000 * i + w, 1))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "deal long, doc_id long, context long, first int, body binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        got = [tuple(r) for r in suffixes.sorted_losses(frame, 50, held_rows=100).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # a row that stays is told again with a later part
    assert set(got) == want


def test_paths_of_trees_with_cycles(spark):
    """Cycles of one to three with leaves, chains of many lengths, a null tree, repeated nodes; against walking up in Python."""
    rng = random.Random(12)
    parent = {("c", 1): 2, ("c", 2): 1, ("c", 3): 1, ("d", 1): 2, ("d", 2): 3, ("d", 3): 1, ("d", 4): 3, ("d", 5): 4, ("d", 6): None, ("d", 7): 6,
              ("e", 1): 1, ("e", 2): 1, ("f", 1): None, ("g", 1): 99, ("g", 2): 1, (None, 1): None, (None, 2): 1, (None, 3): 1}
    for depth in (2, 3, 17):
        parent |= {(f"chain{depth}", n): n - 1 if n else None for n in range(depth)}
    parent |= {("wide", n): rng.randrange(n) if n else None for n in range(60)}
    want = set()
    for tree, leaf in parent:
        if any(t == tree and p == leaf and n != leaf for (t, n), p in parent.items()):
            continue
        walk = [leaf]
        while True:
            up = parent[tree, walk[-1]]
            if up is None or up == walk[-1] or (tree, up) not in parent:
                want |= {(tree, leaf, n, i) for i, n in enumerate(walk)}
                break
            if up in walk:
                break
            walk.append(up)
    rows = [(t, n, p, "user", f"{t}{n}", 0.0) for (t, n), p in parent.items()]
    frame = spark.createDataFrame(rows + rows[:5], "tree string, node long, parent long, role string, text string, score double").repartition(3)
    clean = chat.clean_messages(frame)
    assert sorted(map(str, map(tuple, chat.paths(clean).collect()))) == sorted(map(str, want))
    shown = {r["tree"]: r["formatted"] for r in chat.format_paths(frame).collect()}
    assert set(shown) == {t for t, *_ in want} and "c" not in shown
    assert shown["d"] == "<|im_start|>user\nd6<|im_end|>\n<|im_start|>user\nd7<|im_end|>\n"


def test_deep_shallow_sort_orders_suffixes():
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (400, 50), dtype=np.uint8)
    rows[50:200, :40] = rows[7, :40]
    rows[200:250] = rows[9]
    order, run = suffixes.deep_shallow(rows)
    texts = [bytes(rows[i]) for i in order]
    assert texts == sorted(map(bytes, rows)) and [a == b for a, b in zip(texts, texts[1:], strict=False)] == (run[1:] == run[:-1]).tolist()


def test_quality_counts_equal_plain_counts(docs):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        kept_lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(kept_lines) - len(set(kept_lines)), len(repeated), failed)
        assert not (failed and g["kept"])


def test_quality_thresholds_follow_the_group(spark):
    rng = random.Random(5)

    def text(letters, symbols=0, repeated=0, lines=0):
        words = ["".join(rng.choices("abcdefghij", k=letters + rng.choice([-1, 0, 1]))) for _ in range(100)]
        words = words[:100 - symbols] + [w + "#" for w in words[100 - symbols:]]
        words += words[:3] * repeated
        return " ".join(words) + "".join(f"\nline {k // 2} {letters}" for k in range(lines))

    rows = [("prose", text(6), None) for _ in range(380)] + [("code", text(9, symbols=rng.randrange(20, 30), lines=6), None) for _ in range(380)]
    bad = {"symbols": text(6, symbols=15), "repeats": text(6, repeated=5), "duplicate_lines": text(6, lines=4), "word_length": text(14)}
    rows += [("prose", t, c) for c, t in bad.items()] + [("code", text(9, symbols=90, lines=6), "symbols"), ("code", text(9, symbols=15, lines=20), "duplicate_lines")]
    docs = spark.createDataFrame([(i, t, "en", s) for i, (s, t, _) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    levels = {r["source"]: r for r in quality.thresholds(quality.ratios(quality.base_counts(docs))).filter("level = 0").collect()}
    assert all(levels["prose"][c] != levels["code"][c] for c in ("word_length", "symbols", "duplicate_lines"))
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, (_, _, rule) in enumerate(rows):
        assert not got[i]["base_failed"] and (rule is None or rule in got[i]["failed_rules"] and not got[i]["kept"])
    assert sum(r["kept"] for r in got.values()) >= 0.8 * len(rows)
    rate = lambda r: r["n_symbols"] / r["n_words"]
    kept = [rate(got[i]) for i, (s, _, _) in enumerate(rows) if s == "code" and got[i]["kept"]]
    assert max(kept) > rate(got[760])  # more symbols than what prose may have


def test_language_and_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    known = table(spark, sf, "documents").select("doc_id", "lang")
    rows = language.op3_language_id(spark, sf).filter("held_out").join(known, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.op9_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["toxic"] == r["predicted"] for r in rows) >= 0.9 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert docs.filter(remainder(F.col("doc_id"), 5) == 0).count() > 0


def test_language_without_letters(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr"), (3, "123 !?", None), (4, None, None)], "doc_id long, text string, lang string")
    got = {r[0]: (r[1], r[2]) for r in language.predict(docs, language.learn(docs), ["doc_id"]).collect()}
    assert got[1][0] == "en" and got[2][0] == "fr" and got[3] == got[4] == ("und", 0.0)


def test_language_does_not_depend_on_the_place_in_a_batch(spark):
    letters = language.Letters()
    one, two = "The cat sat on the mat.", "\u00e9 1 x"
    vectors = letters.bundle([one, "A.", one, "!? b", two, "", one, "123", two, "A."])
    assert all((vectors[i] == vectors[0]).all() for i in (2, 6)) and (vectors[4] == vectors[8]).all() and (vectors[1] == vectors[9]).all()
    assert vectors[[1, 3]].any(axis=1).all() and not vectors[[5, 7]].any()
    assert (vectors == np.concatenate([letters.bundle([t]) for t in (one, "A.", one, "!? b", two, "", one, "123", two, "A.")])).all()
    docs = spark.createDataFrame([(1, "a cat", "en"), (2, "A.", "en"), (3, "a cat", "en")], "doc_id long, text string, lang string").coalesce(1)
    got = {r[0]: (r[1], r[2]) for r in language.predict(docs, language.learn(docs), ["doc_id"]).collect()}
    assert got[2][0] == "en" and got[2][1] > 0 and got[1] == got[3]


def test_pipeline_rejects_unseen_scripts_and_keeps_short_texts(spark):
    rng = random.Random(7)
    learnt = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source", "n_chars")
    unseen = [" ".join("".join(chr(rng.randint(*script)) for _ in range(rng.randint(2, 9))) for _ in range(200))
              for script in ((0x430, 0x44F), (0x4E00, 0x9000), (0x627, 0x64A), (0x3B1, 0x3C9)) for _ in range(100)]
    unseen.append("Это обычное русское предложение, которое мы написали для проверки.")
    short = ["The cat sat on the mat.", "It was a good day for them.", "Le chat est sur la table.", "Der Hund ist in dem Haus.", "El perro come en la casa."]
    rows = [(f"u{i}", t) for i, t in enumerate(unseen)] + [(f"s{i}", t) for i, t in enumerate(short)]
    asked = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in rows], "doc_id string, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, learnt.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(asked), "")
    got = Counter(r["doc_id"][0] if r["doc_id"][0] in "us" else "known" for r in kept.select("doc_id").collect())
    assert got["u"] <= len(unseen) // 100 and got["s"] == len(short)
    assert got["known"] == learnt.filter(F.col("text").rlike("[A-Za-z]")).count()


def test_chat_tree_picks_the_best_branch_and_reads_back(spark):
    rows = [("t", 1, None, "user", "q <|im_end|>", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "go<\\|od\n", 0.9), ("t", 4, 3, "user\\|x\n", None, None), ("t", 9, 9, "user", "alone", -1.0)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    done = chat.format_paths(messages, per_tree=2).select("branch", chat.read_back(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("said")).orderBy("branch").collect()
    turns = [[(t["role"], t["text"]) for t in r["turns"]] for r in done]
    assert turns == [[("user", "q <|im_end|>"), ("assistant", "go<\\|od\n"), ("user\\|x\n", "")], [("user", "q <|im_end|>"), ("assistant", "bad")]]
    assert [r["said"] for r in done] == ["go<\\|od\n", "bad"]
    assert chat.format_paths(messages.filter("false")).count() == 0


def test_decontamination_removes_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this. One TWO three, four! And this.")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench, mode="spans").first()["text"] == "Keep this. And this."
    assert decontaminate.decontaminate(docs, bench).count() == 0
    shuffled = decontaminate.find_contamination(docs, bench, max_windows=0).first()
    assert (shuffled["n_words"], shuffled["n_hit"], shuffled["items"], shuffled["contaminated"]) == (8, 4, ["1"], True)


def test_vocabulary_pieces_are_bytes():
    pieces = set(tokens.pieces_of(public_tokenizers.path(VOCABULARY)))
    assert {bytes([b]) for b in range(256)} <= pieces
