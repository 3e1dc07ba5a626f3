import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import langid, lm, queries

PIECES = ["", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
BYTES = [len(PIECES) + b for b in range(256)]


def small():
    rng = np.random.default_rng(3)
    weight = rng.random(len(PIECES) + 256) + 0.05
    weight[0] = 0
    return lm.Lattice([*PIECES, *[""] * 256], BYTES), np.log(np.maximum(weight / weight.sum(), 1e-300))


def segmentations(text, logp):
    """(probability, pieces) of every segmentation."""
    if not text:
        yield 1.0, []
        return
    steps = [(p, [k]) for k, p in enumerate(PIECES) if p and text.startswith(p)]
    if text[0] not in PIECES:
        steps.append((text[0], [BYTES[b] for b in text[0].encode()]))
    for piece, ids in steps:
        for p, rest in segmentations(text[len(piece) :], logp):
            yield p * math.exp(sum(logp[i] for i in ids)), ids + rest


def test_lattice_equals_enumeration():
    lattice, logp = small()
    words = ["a", "abc", "abcabc", "cab", "é", "aéb", "x" * 3, "abcaabbcc", "ca" * 5, "b"]
    got = lattice.log_probability(words, logp)
    for w, x in zip(words, got, strict=True):
        assert x == pytest.approx(math.log(sum(p for p, _ in segmentations(lm.MARK + w, logp))))
    counts = np.arange(1, len(words) + 1, dtype=float)
    want = np.zeros(len(logp))
    for w, c in zip(words, counts, strict=True):
        found = list(segmentations(lm.MARK + w, logp))
        total = sum(p for p, _ in found)
        for p, ids in found:
            for i in ids:
                want[i] += c * p / total
    assert np.allclose(lattice.expected(words, counts, logp), want)


def test_long_words_do_not_underflow():
    lattice, logp = small()
    (x,) = lattice.log_probability(["abc" * 2000], logp)
    assert -1e6 < x < -1000


LM = "doc_id long, text string, held_out boolean, word string, score string"


def test_lm_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["the", "The", "of", "und", "ción", "größe", "x1", "a" * 40]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), k % 5 == 0) for k in range(60)]
    rows += [(100, None, False), (101, "", True), (102, "never seen before words", True), (None, "the of", False), (5, "repeated row", False), (5, "repeated row", False), (103, "the " * 20_000, True)]
    path = public_tokenizers.path(lm.VOCABULARY)
    frame = spark.createDataFrame([(*r, "w", "s") for r in rows], LM)
    for heavy in (lm.HEAVY, 1):
        got = lm.score(frame, path, heavy=heavy).collect()
        c, n_docs = Counter(), 0
        for _, text, held in rows:
            if not held:
                c.update(lm.tokens_of((text or "").encode()))
                n_docs += 1
        n, v = sum(c.values()) + n_docs, len(c) + 1
        want = []
        for key, text, held in rows:
            words = lm.tokens_of((text or "").encode())
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((n_docs + 1) / (n + v + 1))
            want.append((key, held, len(words) + 1, sum(c[w] > 0 for w in words) + 1, n, round(base, 6)))
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
        assert all(r.score < 0 for r in got)
        scores = {(r.doc_id, r.n_tokens): r.score for r in got}
        if heavy == 1:
            assert scores.keys() == kept.keys() and all(scores[k] == pytest.approx(kept[k]) for k in kept)
        kept = scores
    empty = lm.score(spark.createDataFrame([], LM), path)
    assert empty.count() == 0


def test_lm_score_by_formula(spark):
    """The lattice alone, and whole-word edges against it, each with its share."""
    rows = [(k, "alpha beta beta", False) for k in range(4)] + [(9, "gamma", False), (10, "gamma delta", True)]
    path = public_tokenizers.path(lm.VOCABULARY)
    frame = spark.createDataFrame([(*r, "w", "s") for r in rows], LM)
    got = {r.doc_id: r for r in lm.score(frame, path).collect()}
    words = lm.count_words(frame)
    logp, p_end = lm.train(words.persist(), 5, path)
    n, share = 13 + 5, 1 / 18
    inner = np.exp(lm.lattice(path).log_probability(["gamma", "delta"], logp))
    want = math.log10(share * inner[0] + (1 - share) * 1 / n) + math.log10(share * inner[1]) + math.log10(share * p_end + (1 - share) * 5 / n)
    assert got[10].mixed_score == pytest.approx(want)
    assert got[10].score == pytest.approx(math.log10(inner[0]) + math.log10(inner[1]) + math.log10(p_end))


def test_lm_learns_from_counts(spark):
    """Pieces of words that occur often gain; a text in the training words' pieces scores higher than one in others."""
    rows = [(k, "alpha " * 50 + "beta", False) for k in range(20)] + [(50, "alphabeta alpha", True), (51, "zwischenzug quixotry", True), (52, None, True)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame([(*r, "w", "s") for r in rows], LM)).collect()}
    assert got[50].score > got[51].score and got[52].score > got[50].score
    none = lm.score(spark.createDataFrame([(1, None, False, "w", "s"), (2, "a word", True, "w", "s")], LM)).collect()
    assert all(math.isfinite(r.score) and math.isfinite(r.mixed_score) for r in none)


TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then this that with", "de": "der schnelle braune fuchs springt über den faulen hund und dann nicht mit", "fr": "le renard brun rapide saute par dessus le chien paresseux et puis avec"}
LANG = "doc_id long, text string, lang string, slots string, lang_pred string"


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(TEXTS[lang].split(), k=12)), lang, "s", "clash") for k in range(300) for lang in [list(TEXTS)[k % 3]]]
    rows += [(900, None, "en", "", ""), (901, "", "en", "", ""), (902, "123 !!", "de", "", ""), (903, "der hund und der fuchs", None, "", ""), (904, "漢", "fr", "", ""), (905, "the dog " * 20_000, "en", "", ""), (None, "le chien avec le renard", "fr", "", ""), (906, "I", "en", "", "")]
    got = langid.identify(spark.createDataFrame(rows, LANG)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert by[903].lang_pred == "de" and by[905].lang_pred == "en" and by[None].lang_pred == "fr"
    assert by[904].lang_pred in TEXTS and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) > 0


def test_language_id_without_labels_and_empty(spark):
    got = langid.identify(spark.createDataFrame([(1, "text", None, "", "")], LANG)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], LANG)).count() == 0


def test_language_query_on_held_out_rows(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in queries.op7_language_id(spark, sf_dir).collect() if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got) > 0


def test_lm_query_beats_nothing_but_is_a_probability(spark, sf_dir):
    got = queries.op8_lm_score(spark, sf_dir).collect()
    assert all(r.score < 0 and r.base_score < 0 and 1 <= r.n_tokens and r.n_known <= r.n_tokens for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)


def grams(text):
    """Distinct n-grams of a text by their characters."""
    plain = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return {plain[k : k + n] for n in langid.ORDERS for k in range(len(plain) - n + 1)}


def test_language_model_equals_full_kernel_ridge(spark):
    """With every training text a landmark, the classifier is kernel ridge regression over the whole kernel matrix."""
    draw = random.Random(4)
    sounds = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["ção", "que", "lha", "ra"]}
    text = lambda lang: " ".join("".join(draw.choices(sounds[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(3, 25)))
    train = [(k, text(lang), lang) for k, lang in enumerate(draw.choices(list(sounds), k=200))]
    test = [(1000 + k, text(lang), lang) for k, lang in enumerate(draw.choices(list(sounds), k=40))]
    names = sorted(sounds)
    sets, asked = [grams(t) for _, t, _ in train], [grams(t) for _, t, _ in test]
    like = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    kernel = np.array([[like(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for _, _, lang in train])
    alpha = np.linalg.solve(kernel + langid.RIDGE * len(train) * np.eye(len(train)), y)
    values = np.array([[like(a, b) for b in sets] for a in asked]) @ alpha
    share = np.exp(langid.SHARPNESS * values)
    share /= share.sum(axis=1, keepdims=True)
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), landmarks=3 * len(train), train=3 * len(train))
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()}
    for (key, _, _), row in zip(test, share, strict=True):
        assert got[key].lang_pred == names[int(row.argmax())]
        # N-grams are hashed; the few that share a slot move scores a little.
        assert got[key].score == pytest.approx(row.max(), abs=0.02)


def test_a_tie_of_languages_goes_to_the_first_name(spark):
    """Texts that two languages share alike have equal scores; the language of the smaller name is told."""
    rows = [(2 * k + j, "the same words in both", lang) for k in range(20) for j, lang in enumerate(("yy", "xx"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (r,) = langid.predict(spark.createDataFrame([(1, "the same words in both")], "doc_id long, text string"), model).collect()
    assert r.lang_pred == "xx" and r.score == pytest.approx(0.5)
