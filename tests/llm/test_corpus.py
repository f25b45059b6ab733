"""Operators that learn from the whole corpus: resampling, collocations, language model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapelight.llm import collocations, maxent, resample

from .helpers import awkward, none, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_resample(documents, target, percent=5, least=20):
    def buckets(text):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    found = [(i, *buckets(t)) for i, t in documents]
    s, t = Counter(b for *_, bs in found for b in bs), Counter(b for x in target for b in buckets(x)[1])
    of_s, of_t = sum(s.values()) + 10000.0, sum(t.values()) + 10000.0
    rows = []
    for i, n, bs in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t))) for b in bs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    drawn = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, row in enumerate(drawn[: len(drawn) * percent // 100], 1):
        row[4] = rank
    return sorted((r[:5] for r in rows), key=repr)


def test_resampling_against_brute_force(spark):
    rng = random.Random(3)
    documents = awkward(spark, extra=["Aa Bb, cc-ddé 42 \U0001f600 x", *(words(rng, rng.randint(10, 60)) for _ in range(40))]).repartition(5)
    target = spark.createDataFrame([(None,), ("the aa bb cc",), (words(rng, 50),), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for percent in (5, 50, 100):
        found = sorted((list(r) for r in resample.resample(documents, target, percent).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
        assert found == brute_resample(rows, [r.text for r in target.collect()], percent)


def test_resampling_of_nothing(spark):
    assert resample.resample(none(spark), none(spark)).count() == 0
    found = resample.resample(awkward(spark), none(spark)).collect()
    assert len(found) == awkward(spark).count() and all(r.weight == 0 for r in found if not r.n_features)


def brute_collocations(rows, least, most, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {key: a for key, a in f.items() if a >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), a in frequent.items() for k in range(1, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * f[lang, p[i : i + k]]}
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, of in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(of)[:most], 1)}


def test_collocations_against_brute_force(spark):
    rng = random.Random(4)
    few = ["a", "B", "\u00e9", "x\x00", "\U0001f600", "the"]
    texts = ["".join(rng.choice(few) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \r\n"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += ["a a a a a a a a a", "the b the b the b the b.the b"] * 3
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, rank int").repartition(7).union(awkward(spark).selectExpr("lang", "text", "id AS rank"))
    every = [(r.lang, r.text) for r in frame.collect()]
    for least, most in ((5, 2000), (30, 7), (1_000_000, 5)):
        found = {tuple(r) for r in collocations.collocations(frame, least=least, most=most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
        assert found == brute_collocations(every, least, most)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(none(spark)).count() == 0


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """With a bitmap far too small everything passes it, and the exact threshold decides."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    rng = random.Random(6)
    rows = [("en", words(rng, 3) + " of the one of the two " + words(rng, 2)) for _ in range(50)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = {tuple(r) for r in collocations.collocations(frame, least=20).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert found == brute_collocations(rows, 20, 2000)


def brute_unigram(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by plain loops."""
    split = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None]) for i, t in rows]
    c = Counter(w for _, held, ws in split if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, held, ws in split), key=repr)


def unigram(found):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr)


def test_known_words_are_found_without_a_table_of_all(monkeypatch):
    known = [b"the", b"of", "\u00e9t\u00e9".encode(), b"and,", *(b"w%d" % i for i in range(2000))]
    asked = pa.array([b"of", b"w1999", b"w2000", b"", "\u00e9t\u00e9".encode(), b"The", b"w0"], pa.binary())
    expected = [1, 2003, -1, -1, 2, -1, 4]

    def vocabulary(words):
        return maxent.Vocabulary(pa.array(words, pa.binary()), np.arange(len(words), 0, -1), 5, 100, len(words) + 1, np.zeros(maxent.RARE), np.zeros(maxent.RARE))

    def places(v):
        return v.places(asked, maxent.hashed(maxent.spellings(asked))).tolist()

    assert places(vocabulary([])) == [-1] * len(asked)
    table, found = maxent.pc.index_in, vocabulary(known)
    monkeypatch.setattr(maxent.pc, "index_in", lambda *a, **k: pytest.fail("a table of all known words"))
    assert places(found) == expected and maxent.tokens(pa.array(["The w7 new"]), found).known.tolist() == [0, 11, -1, -2]
    # where words have the hash of others, their spelling decides
    monkeypatch.setattr(maxent.xxhash, "xxh64_intdigest", lambda w: 3 if w in (b"w2000", b"w1999") else len(w) * 1000 + sum(w) * 100000 + int.from_bytes(w[-4:]) * 10**9)
    assert places(vocabulary(known)) == expected
    monkeypatch.setattr(maxent.pc, "index_in", table)
    monkeypatch.setattr(maxent.xxhash, "xxh64_intdigest", len)
    assert places(vocabulary(known)) == expected


@pytest.mark.parametrize("known", [maxent.KNOWN, 40, 0])
def test_language_model_counts(spark, monkeypatch, known):
    """The same however many words go to the tasks: all, some or none."""
    monkeypatch.setattr(maxent, "KNOWN", known)
    documents = awkward(spark, extra=["\U0001f600 The the. THE", *(words(random.Random(i), 30) + " of the a of" for i in range(30))]).repartition(3)
    found = maxent.score_texts(documents).collect()
    assert unigram(found) == brute_unigram([(r.doc_id, r.text) for r in documents.collect()])
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found)


def test_language_model_of_nothing(spark):
    assert maxent.score_texts(none(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    found = maxent.score_texts(spark.createDataFrame([(held, "no text to learn from")], "doc_id long, text string")).collect()
    assert unigram(found) == brute_unigram([(held, "no text to learn from")]) and math.isfinite(found[0].score)


def test_probabilities_add_up_to_one(spark):
    """Over every known word, the end and one unseen word of each rare class, after any words."""
    rng = random.Random(8)
    texts = spark.createDataFrame([(words(rng, 400), i) for i in range(12)], "text string, share long")
    vocabulary, _ = maxent.vocabulary_of(maxent.count_words(texts))
    model = maxent.Model(vocabulary, maxent.train(texts, vocabulary))
    assert np.abs(model.weights).max() > 0
    every = [w.decode() for w in vocabulary.words.to_pylist()]
    assert len(every) > maxent.TOP
    unseen = {}
    for i in range(5000):
        word = f"zq{i}{'x' * (i % 3)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'.' * (i % 2)}"
        unseen.setdefault(int(maxent.rare_classes(pa.array([word.encode()]))[0]), word)
    assert len(unseen) == maxent.RARE
    for before in ("", every[0], f"{every[3]} {every[-1]} {every[1]}"):
        k = len(before.split())
        found = maxent.tokens(pa.array([f"{before} {w}" for w in [*every, *unseen.values()]] + [before]), vocabulary)
        logs = model.score(found)
        at = np.flatnonzero(np.append(found.text[1:] != found.text[:-1], True))
        chosen = np.append(at[:-1] - 1, at[-1])
        assert len(chosen) == len(every) + maxent.RARE + 1 and found.code[chosen[-1]] == len(found.distinct)
        assert abs((10.0 ** logs[chosen]).sum() - 1) < 1e-4, k


def test_language_model_learns_what_follows(spark):
    """Held-out texts of pairs of words are far likelier than single words say."""
    rng = random.Random(9)
    firsts, follow = [f"w{i}" for i in range(50)], {f"w{i}": f"v{(i * 7) % 50}" for i in range(50)}

    def text():
        return " ".join(f"{w} {follow[w]}" for w in rng.choices(firsts, k=150))

    documents = spark.createDataFrame([(i, text()) for i in range(120)], "doc_id long, text string")
    held = [r for r in maxent.score_texts(documents).collect() if r.held_out]
    assert len(held) > 5 and all(r.score > 0.75 * r.base_score for r in held)
