import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tapelight.llm import exact_dedup, line_dedup, near_dedup
from tapelight.llm.components import components

from .helpers import awkward, none, words


def test_exact_groups(spark):
    documents = awkward(spark, extra=["same"] * 40)
    for counters in (4, 1024):  # with and without frequent digests
        rows = exact_dedup.exact_groups(documents, counters=counters).collect()
        texts = [(r.doc_id, r.text or "") for r in documents.collect()]
        by_digest = {}
        for i, t in texts:
            by_digest.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
        assert len(rows) == len(texts)
        for r in rows:
            own = by_digest[r.text_sha256]
            best = max((i for i in own if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (best, len(own), r.doc_id == best)
    assert exact_dedup.exact_groups(none(spark)).count() == 0
    assert {r.doc_id for r in exact_dedup.drop_exact(documents, keep="smallest").collect() if r.text == "same"} == {12}


def test_misra_gries_bound():
    import pyarrow as pa

    rng = random.Random(2)
    values = [b"hot"] * 600 + [b"warm"] * 300 + [str(rng.random()).encode() for _ in range(2000)]
    rng.shuffle(values)
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 100], pa.binary())], ["digest"]) for i in range(0, len(values), 100)]
    found = dict(zip(*[c.to_pylist() for c in next(exact_dedup.misra_gries(16)(iter(batches))).columns], strict=True))
    assert len(found) <= 16
    for value in (b"hot", b"warm"):
        assert values.count(value) - len(values) / 16 <= found[value] <= values.count(value)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts, k, percent):
    """Sets by plain Python, every pair, union of links."""
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def varied(rng, n):
    base = words(rng, 90).split()
    texts = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = words(rng, 1)
        texts.append(" ".join(own))
    return texts


def test_near_groups(spark):
    rng = random.Random(9)
    documents = awkward(spark, with_null_id=False, extra=varied(rng, 60) + ["One two", "one TWO", "one two three"] + [words(rng, 40) for _ in range(20)])
    expected = brute([(r.doc_id, r.text) for r in documents.collect()], 4, 80)
    rows = near_dedup.near_groups(documents, 4, 80).collect()
    assert len(rows) == documents.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert near_dedup.near_groups(none(spark)).count() == 0
    assert all(r.kept and r.component_id is None for r in near_dedup.near_groups(awkward(spark)).collect() if r.doc_id is None)


def test_near_groups_dense(spark, monkeypatch):
    """A group of many texts of which few are linked, through the block-wise path with small blocks."""
    monkeypatch.setattr(near_dedup, "SETS", 16)
    monkeypatch.setattr(near_dedup, "SIGNATURES", 16)
    monkeypatch.setattr("tapelight.llm.linking.FEW", 2)
    rng = random.Random(4)
    texts = list(enumerate(varied(rng, 150)))
    rows = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, 4, 80)


def test_intersections_take_little_memory():
    import tracemalloc

    import numpy as np

    draw = np.random.default_rng(3)
    many = draw.integers(-(2**62), 2**62, 70_000)
    sets = [np.unique(draw.choice(many, 400)) for _ in range(2 * near_dedup.SETS)] + [np.zeros(0, np.int64)]
    left, right = sets[: near_dedup.SETS], sets[near_dedup.SETS :]
    tracemalloc.start()
    shared = near_dedup.intersections(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20  # one product of 65,536 columns took 260 MB
    for i, j in [(0, 0), (7, 300), (511, 512)]:
        assert shared[i, j] == len(np.intersect1d(left[i], right[j]))
    assert near_dedup.intersections(sets[-1:], right).sum() == 0


def test_index_guarantee():
    """Any two signatures up to the guaranteed distance share a key."""
    import numpy as np

    rng = np.random.default_rng(3)
    far = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(200):
        x = rng.integers(0, 1 << 16, near_dedup.CHUNKS * near_dedup.WIDTH).astype(np.uint16)
        y = x.copy()
        y[rng.choice(len(x), far, replace=False)] ^= 1
        assert set(near_dedup.index_keys(x[None])[0]) & set(near_dedup.index_keys(y[None])[0])


def test_line_groups(spark):
    rng = random.Random(3)
    long = words(rng, 150)
    changed = long.replace(long.split()[70], "other", 1)
    documents = spark.createDataFrame([(1, f"Hello World 12\n{long}\n\n---"), (2, f"hello, WORLD 77!\n{changed}\nunlike"), (3, None), (4, ""), (None, long), (2, f"hello, WORLD 77!\n{changed}\nunlike")], "doc_id long, text string")
    rows = {(r.doc_id, r.line_no): (r.group_doc_id, r.group_line_no, r.kept) for r in line_dedup.line_groups(documents, indexed=line_dedup.simhash_index).collect()}
    assert rows[1, 0] == (1, 0, True) and rows[2, 0] == (1, 0, False)
    hashes = [r.simhash for r in line_dedup.simhashes(line_dedup.raw_lines(documents)).where("line_no = 1").orderBy("doc_id").collect() if r.simhash is not None]
    apart = bin((hashes[0] ^ hashes[1]) & (1 << 64) - 1).count("1")
    assert rows[2, 1] == ((1, 1, False) if apart <= line_dedup.DISTANCE else (2, 1, True))
    assert rows[1, 2] == (1, 2, True) and rows[1, 3] == (1, 3, True) and rows[4, 0] == (4, 0, True) and rows[None, 0] == (None, 0, True)
    assert len(rows) == 4 + 3 + 1 + 1
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_lines(documents).collect()}
    assert cleaned[1] == f"Hello World 12\n{long}\n\n---" and "unlike" in cleaned[2] and "WORLD" not in cleaned[2] and cleaned[3] is None
    assert line_dedup.line_groups(none(spark)).count() == 0
    awkward_lines = [(r.doc_id, i, line) for r in awkward(spark).collect() if r.text is not None for i, line in enumerate(r.text.split("\n"))]
    found = line_dedup.line_groups(awkward(spark)).collect()
    assert sorted((repr(r.doc_id), r.line_no) for r in found) == sorted((repr(d), i) for d, i, _ in awkward_lines)
    first = {}
    for d, i, line in awkward_lines:
        if d is not None and any(c.isalnum() for c in line):
            first[line] = min(first.get(line, (d, i)), (d, i))
    for r in found:
        line = next(x for d, i, x in awkward_lines if (d, i) == (r.doc_id, r.line_no))
        if line in first and r.doc_id is not None:
            assert (r.group_doc_id, r.group_line_no) <= first[line] and r.kept == ((r.group_doc_id, r.group_line_no) == (r.doc_id, r.line_no))
        else:
            assert r.kept


def test_line_groups_against_all_pairs(spark):
    """Every two distinct lines within the SimHash distance and the edit distance end in one group."""
    rng = random.Random(8)
    base = [words(rng, 120) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = "x" + words(rng, 1)
            texts.append(" ".join(w))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = {r.doc_id: r.simhash for r in line_dedup.simhashes(line_dedup.raw_lines(documents)).collect()}
    group = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(documents, indexed=line_dedup.simhash_index).collect()}
    label = {i: i for i in range(len(texts))}
    for _ in range(len(texts)):
        for a in label:
            for b in label:
                if bin((hashes[a] ^ hashes[b]) & (1 << 64) - 1).count("1") <= 3 and a // 6 == b // 6:
                    label[a] = label[b] = min(label[a], label[b])
    assert group == label


@pytest.mark.parametrize("n", [1, 127, 128, 400])
def test_simhash_is_that_of_a_loop(spark, n):
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
    each = [r.h for r in documents.selectExpr("explode(split(text, ' ')) AS w").selectExpr("xxhash64(w) AS h").collect()]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each))
    assert line_dedup.simhashes(line_dedup.raw_lines(documents)).first().simhash & (1 << 64) - 1 == expected


@pytest.mark.parametrize("least, most", [(5, 12), (13, 60), (61, 200)])
def test_similar_lines_meet(spark, least, most):
    """Nearly all pairs of an edit similarity of 90% by brute force share a key, pass the test of a pair and are linked."""
    rng = random.Random(least)
    texts = []
    for _ in range(40):
        line = words(rng, rng.randint(least, most))
        texts.append(line)
        for edits in (1, len(line) // 25, len(line) // 11):  # scattered over the words
            own = list(line)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice("abcdefghi")
            texts.append("".join(own))
    documents = spark.createDataFrame(list(enumerate(texts)), "id long, normal string")
    near = "x.id < y.id AND levenshtein(x.normal, y.normal) <= floor(greatest(length(x.normal), length(y.normal)) / 10)"
    wanted = {(r[0], r[1]) for r in documents.alias("x").crossJoin(documents.alias("y")).where(near).selectExpr("x.id", "y.id").collect()}
    index, fits = line_dedup.gram_index(documents, 90)
    x, y = index.alias("x"), index.alias("y")
    met = x.join(y, "key").where("x.id < y.id").where(fits(F.col("x.n"), F.col("y.n"))).selectExpr("x.id", "y.id").distinct().collect()
    missed = wanted - {(r[0], r[1]) for r in met}
    assert len(wanted) > 100 and len(missed) <= 0.02 * len(wanted)
    group = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(documents.toDF("doc_id", "text"), indexed=line_dedup.gram_index).collect()}
    assert sum(group[a] != group[b] for a, b in wanted) <= len(missed)


def test_substrings_of_all_places_can_be_keys(spark, monkeypatch):
    """At every place of a line, also around line separators of Unicode and where a stretch ends; equal substrings alone have one hash."""
    monkeypatch.setattr(line_dedup, "GRAMS", 1 << 20)  # all are chosen
    rng = random.Random(6)
    long = words(rng, 60)
    texts = [long[:n] + "x" for n in range(70, 70 + line_dedup.STRETCH + 1)] + [long[:90] + "\u2028" + long[90:200], long[:50] + " \U00020000\u4e00 " + long[50:150]]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, normal string").selectExpr("id", "normal", "length(normal) AS size", "size(split(normal, ' ')) AS words", "array(0L) AS lanes")
    rows = line_dedup._substring_keys(units).collect()
    found = {(r.id, r.place): r.gram for r in rows}
    wanted = {(i, k + 1): text[k : k + line_dedup.LETTERS] for i, text in enumerate(texts) for k in range(len(text) - line_dedup.LETTERS + 1)}
    assert len(rows) == len(found) and found.keys() == wanted.keys() and all(r.size == len(texts[r.id]) for r in rows)
    assert len(set(found.values())) == len(set(wanted.values())) == len({(found[k], wanted[k]) for k in wanted})


def test_letters_rule_out_no_line_within_the_distance(spark):
    """Against the counts of characters in plain Python: what one line has more than the other, up to 127 of each."""
    rng = random.Random(8)
    texts = [words(rng, rng.randint(1, 90)) for _ in range(25)] + ["e" * 300 + " a", "e" * 120 + "t" * 128, "\u4e00\u00e9 u\U00020000", "x", "u" * 127]
    texts += ["".join(c for c in t if rng.random() > 0.1) for t in texts]
    lines = line_dedup.letter_counts(spark.createDataFrame(list(enumerate(texts)), "id long, normal string"))
    x, y = lines.toDF("a", "x"), lines.toDF("b", "y")
    for percent in (90, 70):
        found = {(r.a, r.b): r.near for r in x.crossJoin(y).select("a", "b", line_dedup.near_by_letters(percent)(F.col("x"), F.col("y")).alias("near")).collect()}

        def counts(text):
            own = [text.count(c) for c in line_dedup.COUNTED]
            return [min(n, 127) for n in (*own, len(text) - sum(own))]

        for (a, b), near in found.items():
            apart = [n - m for n, m in zip(counts(texts[a]), counts(texts[b]), strict=True)]
            most = max(sum(d for d in apart if d > 0), -sum(d for d in apart if d < 0))
            assert near == (most <= max(len(texts[a]), len(texts[b])) * (100 - percent) // 100), (texts[a], texts[b])


def test_recall_of_edited_lines(spark):
    """Edits of 5% and 9% of the characters, spread evenly (one in every second word, or in every one) or at random, in short and long words."""
    rng = random.Random(31)
    texts, classes = [], {}
    for n, letters in ((5, 9), (7, 4), (10, 9), (12, 8), (20, 12), (30, 6), (60, 4), (60, 9)):
        for share in (0.05, 0.09):
            for evenly in (True, False):
                for _ in range(20):
                    line = list(" ".join("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(letters)) for _ in range(n)))
                    inside, edits = [i for i, c in enumerate(line) if c != " "], max(1, int(len(line) * share))
                    places = {min(inside, key=lambda i, at=(j + 0.5) * len(line) / edits: abs(i - at)) for j in range(edits)} if evenly else rng.sample(inside, edits)
                    texts.append("".join(line))
                    for i in places:
                        line[i] = "z"
                    classes.setdefault((n, letters, share, evenly), []).append((len(texts) - 1, len(texts)))
                    texts.append("".join(line))
    group = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    recall = {k: sum(group[a] == group[b] for a, b in pairs) / len(pairs) for k, pairs in classes.items()}
    assert min(recall.values()) >= 0.9 and sum(recall.values()) / len(recall) >= 0.98, recall
    whole = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(spark.createDataFrame(list(enumerate(texts[:80])), "doc_id long, text string"), shared=0).collect()}
    assert all(whole[i] == group[i] for i in whole if group[i] < 80)


def test_line_groups_are_those_of_edit_similarity(spark):
    """Against every pair by edit distance, in plain Python: one-letter, many-letter and word edits, chains, copies, ties."""
    rng = random.Random(21)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    texts = []
    for n in (5, 7, 10, 20, 40, 90):
        for _ in range(4):
            line = words(rng, n)
            texts.append(line)
            for _ in range(3):  # a chain of edits
                own = list(line)
                for _ in range(rng.randint(1, max(1, len(own) // 25))):
                    at = rng.randrange(len(own))
                    own[at : at + rng.randint(0, 1)] = rng.choice(["x", "y ", "", "u"])
                line = " ".join("".join(own).split())
                texts.append(line)
            texts += [texts[-1].upper() + "!", line + " " + words(rng, n)]
    groups = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    plain = [" ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) for t in texts]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if abs(len(plain[a]) - len(plain[b])) <= 0.1 * max(len(plain[a]), len(plain[b])) and distance(plain[a], plain[b]) <= max(len(plain[a]), len(plain[b])) // 10]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert len(near) > 60 and sum(groups[a] == groups[b] for a, b in near) >= 0.98 * len(near)
    assert all(label[i] == label[groups[i]] for i in range(len(texts)))  # nothing is linked that isn't


def test_lines_with_clashing_columns_and_nulls(spark):
    rows = [(1, "one line of words here\nsomething else", "g", 1, 2), (2, "one line of words hers", None, None, None), (None, "one line of words here", "x", 3, 4), (1, "one line of words here\nsomething else", "g", 1, 2), (3, None, "n", 5, 6)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, gone string, first int, component int")
    left = line_dedup.drop_lines(documents)
    assert left.columns == documents.columns
    found = sorted(((r.doc_id or 0, r.text, r.gone) for r in left.collect()), key=str)
    assert found == sorted([(1, rows[0][1], "g"), (1, rows[0][1], "g"), (2, "", None), (0, rows[2][1], "x"), (3, None, "n")], key=str)


def test_drop_exact_leaves_one_row_of_each_text(spark):
    """Null ids with a text of their own, repeated rows, and an id with two texts of which one is another's copy."""
    rows = [(None, "alone"), (None, "both"), (None, "both"), (1, "shared"), (None, "shared"), (2, "twice"), (2, "twice"), (3, "copy"), (4, "copy"), (3, "own"), (None, None), (5, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_exact(documents).collect()), key=str)
    assert left == sorted([(None, "alone"), (None, "both"), (1, "shared"), (2, "twice"), (4, "copy"), (3, "own"), (5, "")], key=str)
