import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tapelight.llm import boosting, html_text, pii, quality, url_filter
from tapelight.llm.arrowtext import slices, utf8

from .helpers import awkward, none, words


def test_boosting_learns_and_stays_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(int)
    forest = boosting.train(x[:600], y[:600], trees=60)
    assert ((forest.score(x[600:]) > 0) == y[600:]).mean() > 0.93
    noisy = (x[:, 0] + 0.4 * rng.random(800) > 0.7).astype(int)
    held = boosting.train(x, noisy, np.array([1, 0, 0]))
    grid = np.repeat(x[:50], 40, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(held.score(grid).reshape(50, 40), axis=1) >= -1e-12).all()
    assert np.isfinite(held.score(np.full((1, 3), np.nan))).all() and len(held.score(np.zeros((0, 3)))) == 0


def brute_counts(text):
    found = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    repeat = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return [len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)]


@given(st.lists(st.text(st.sampled_from(list("ab \n#é\t|")), max_size=30), max_size=8))
@settings(deadline=None, max_examples=150)
def test_statistics(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for part in slices([batch]):
        counts, rows = quality.statistics(*utf8(part.column("text")))
        assert [[int(v[i]) for v in counts.values()] for i in range(part.num_rows)] == [brute_counts(t) for t in part.column("text").to_pylist()]
        assert rows.shape == (part.num_rows, len(quality.FEATURES)) and np.isfinite(rows).all()


def test_quality_held_out(spark):
    rng = random.Random(1)

    def good():
        return ". ".join(words(rng, rng.randint(5, 14)).capitalize() for _ in range(rng.randint(8, 20)))

    def bad():
        return rng.choice([lambda: " ".join(w + rng.choice(["***", "###", "%%%"]) for w in good().split()), lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: " | ".join(good().split()), lambda: " ".join(w for w in good().split() for _ in range(12))])()

    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(400)]
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 200], "doc_id long, quality int")
    forest = quality.train_quality(documents, labels)
    kept = {r.doc_id: r.kept for r in quality.score_quality(documents, forest).collect()}
    assert np.mean([kept[i] == bool(q) for i, _, q in rows if i >= 200]) > 0.97
    for r in quality.score_quality(awkward(spark), forest).collect():
        assert not (r.base_failed and r.kept) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.score_quality(none(spark), forest).count() == 0
    alone = quality.train_quality(documents, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_quality(documents, alone).where("NOT kept AND NOT base_failed").count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in (EMAIL.finditer(text) if "@" in text else ())]  # else quadratic in long words
    out += [("ip", m.start(), m.end()) for m in ADDRESS.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in pii.CARD.finditer(text) if 13 <= len(d := pii.digits_of(m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in pii.PHONE.finditer(text) if 9 <= len(pii.digits_of(m[0])) <= 15]


@given(st.lists(st.sampled_from(list("a@.1235- ()+%") + ["25", ".com", "4111 1111 1111 1111", "+1 (555) 123-4567"]), max_size=40).map("".join))
@settings(deadline=None, max_examples=400)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_added_spans():
    model = pii.train()
    text = "call +1 (314) 555-6532 4663622617512349 now, or 4451718024887799 27.65.93.188; mail joe.doe (at) mail (dot) com, tel (212) 555-0147"
    found = {(k, text[a:b]) for k, a, b in pii.added_spans(model, text, pii.base_spans(text))}
    assert {("phone", "+1 (314) 555-6532"), ("card", "4663622617512349"), ("card", "4451718024887799"), ("email", "joe.doe (at) mail (dot) com"), ("phone", "(212) 555-0147")} <= found
    for clean in ("Apache License, Version 2.0.", "on 2024-11-05 and 05.11.2024 at 10:30", "version 10.2.33.4000", "order 123456789012", "nothing here", "1.2.3"):
        assert not pii.base_spans(clean) and not pii.added_spans(model, clean, [])


def test_span_model_held_out():
    rng, model = random.Random(123), pii.train()
    hit = wrong = missed = 0
    for _ in range(400):
        text, truth = pii.example(rng)
        found = set(pii.decode(model, text, pii.candidates(text, [])))
        hit, wrong, missed = hit + len(found & truth), wrong + len(found - truth), missed + len(truth - found)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_no_added_card_fails_its_check():
    """Numbers of 13 to 19 digits that fail Luhn, in every shape, among ordinary words; cards that run into each other are found."""
    rng, model = random.Random(11), pii.train()
    shapes = [lambda d: d, lambda d: " ".join(d[i : i + 4] for i in range(0, len(d), 4)), lambda d: "-".join(d[i : i + 4] for i in range(0, len(d), 4)), lambda d: f"{d[:4]} {d[4:10]} {d[10:]}"]
    for _ in range(600):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19)))
        text = f"{words(rng, 3)} {rng.choice(['', 'card ', 'tel ', 'no. '])}{rng.choice(shapes)(digits)}{rng.choice(['.', ',', ''])} {words(rng, 2)}"
        base = pii.base_spans(text)
        assert all(kind != "card" or pii.luhn(pii.digits_of(text[a:b])) for kind, a, b in pii.added_spans(model, text, base)), text


def test_added_spans_in_written_sentences():
    """Precision and recall on sentences written by hand, of other words and shapes than the training's."""
    model = pii.train()
    positive = [
        ("Please ring (020) 555-0199 before noon", "(020) 555-0199"), ("fax: 415-555-2671, thanks", "415-555-2671"), ("write to anna.berg (at) posteo (dot) com today", "anna.berg (at) posteo (dot) com"),
        ("contact max[at]firma.com for it", "max[at]firma.com"), ("paid with 4111111111111111 5500005555555559 yesterday", "4111111111111111"), ("paid with 4111111111111111 5500005555555559 yesterday", "5500005555555559"),
        ("use +1 (212) 555-0147 10.0.0.7 as fallback", "+1 (212) 555-0147"), ("mobile 212-555-0163.", "212-555-0163"),
    ]
    negative = [
        "invoice 4111111111111112 was paid", "the ISBN 978-3-16-148410-0 is old", "from 1914-1918 and 1939-1945", "pi is 3.14159265358979", "id 1234-5678-9012-3456 expired", "population 83 166 711 in 2020",
        "released 2024.01.15 at 10:30:55", "row 0000000000000001 of 20", "grid 48.8566 2.3522 here", "section 4.2.1.7000", "he was at home dot matrix", "5 000 000 000 stars", "tracking 9400110200881234567890",
    ]
    hits = sum(any(text[a:b] == span for _, a, b in pii.base_spans(text) + pii.added_spans(model, text, pii.base_spans(text))) for text, span in positive)
    wrong = [text for text in negative if pii.added_spans(model, text, pii.base_spans(text))]
    assert hits >= 0.85 * len(positive) and len(wrong) <= 1, (hits, wrong)


def test_decode_is_the_best_of_all_sets():
    """Dynamic programming against every set of segments that don't overlap."""
    from itertools import combinations

    rng, model = random.Random(6), pii.train()
    for _ in range(60):
        text, _ = pii.example(rng)
        nodes = pii.lattice(text, pii.candidates(text, []))
        if len(nodes) > 14:
            continue

        def worth(chosen):
            last, total = None, 0.0
            for _, _, kind, names in chosen:
                total += sum(model.get(n, 0.0) for n in names) + model.get(pii.pair(last, kind), 0.0)
                last = kind
            return total

        best = max((worth(c) for size in range(5) for c in combinations(nodes, size) if all(x[1] <= y[0] for x, y in zip(c, c[1:], strict=False))), default=0.0)
        found = [n for s in pii.decode(model, text, pii.candidates(text, [])) for n in nodes if (n[2], n[0], n[1]) == s]
        assert abs(worth(found) - best) < 1e-9


def test_pii_documents(spark):
    documents = awkward(spark, extra=["mail a.b@c.de or b@c.de, 10.0.0.1", "+1 (314) 555-6532 4663622617512349", "@" * 3000, "1." * 5000, "+1" * 3000])
    rows = pii.find_spans(documents).collect()
    assert len(rows) == documents.count()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        if r.doc_id is not None:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in brute_spans(texts[r.doc_id] or "")) for k in pii.KINDS]
            assert (r.redacted is None) == (texts[r.doc_id] is None)
    assert {r.redacted for r in rows if r.doc_id == 12} == {"mail [EMAIL] or [EMAIL], [IP]"}
    redacted = pii.redact_documents(documents)
    assert redacted.schema == documents.schema and redacted.count() == documents.count()
    assert all(r.n_chars == len(r.text) for r in redacted.collect() if r.text is not None)
    assert pii.find_spans(none(spark)).count() == 0 and pii.redact_documents(none(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li><li><a href="/y">More</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, really.</p></div>
<article><h1>A &amp; B</h1><p>First <b>bold</b>
 line.<br>Next&nbsp;one.<p>Second<!-- no --> line, with more words in it.</p><ul><li>point one</li><li>point two</li></ul></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked it, a lot.</p></div></section><footer>&copy; somebody</footer></body></html>"""


def test_extraction():
    assert html_text.main_texts([PAGE], html_text.forest()) == ["A & B\nFirst bold line. Next one.\nSecond line, with more words in it.\npoint one\npoint two"]
    for odd in ("", "plain", "<", "<p", "</p></p>", "<div " * 500, "<a href='x", "<!--", "<script>", "<b>" * 2000 + "x", "&#x110000; &am &amp", "<td><li><p></td>"):
        assert isinstance(html_text.main_texts([odd], html_text.forest())[0], str)


def test_missing_ends_lose_no_text():
    """An open head, unclosed raw elements, formulas in the text."""
    body = "<article><h1>A title here</h1><p>Some words of the article, and more of them here.</p><p>A second part of it, as long as the first one.</p></article>"
    wanted = "A title here\nSome words of the article, and more of them here.\nA second part of it, as long as the first one."
    for page in (f"<html><head><title>no</title>{body}", f"<html><head><script>if (a < b) x = '<div>no</div>';</script><title>no</title></head><body>{body}", f"<body><video src=x>{body}", f"<body><iframe src=x><object>{body}"):
        assert html_text.main_texts([page], html_text.forest()) == [wanted]
    assert "x squared" in html_text.main_texts([body.replace("Some words", "Some <math>x squared</math> words")], html_text.forest())[0]


def test_deep_pages_take_linear_time():
    import time

    html_text.forest()
    took = []
    for depth in (20_000, 80_000):
        began = time.time()
        html_text.main_texts(["<div>" * depth + "x"], html_text.forest())
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1


def test_decoding_is_the_best_of_all_choices():
    """Against every set of nodes in which a kept node's parent is kept."""
    from itertools import product

    rng = np.random.default_rng(7)
    for _ in range(40):
        n = 9
        parent = np.array([-1, *(rng.integers(0, k) for k in range(1, n))])
        odds = rng.normal(size=n) * 2
        worth = np.clip(odds, -html_text.CLIP, html_text.CLIP)
        allowed = [c for c in product([False, True], repeat=n) if c[0] and all(c[parent[k]] for k in range(1, n) if c[k])]
        best = max(worth[np.array(c)].sum() for c in allowed)
        assert abs(worth[html_text.keep_nodes(odds, parent, 0)].sum() - best) < 1e-9


def test_extraction_held_out():
    rng, exact = random.Random(42), 0
    for _ in range(150):
        page, _ = html_text.sample_page(rng)
        found = html_text.main_texts([page], html_text.forest())[0].split()
        wanted = re.findall(r"\bq[a-z]+", re.sub(r"<[^>]*>", " ", page))
        exact += [w.strip(",.") for w in found] == wanted
    assert exact >= 128


def test_kept_nodes_have_kept_parents():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = 30
        parent = np.array([-1, *(rng.integers(0, k) for k in range(1, n))])
        kept = html_text.keep_nodes(rng.normal(size=n) * 3, parent, 0)
        assert all(kept[parent[k]] for k in range(1, n) if kept[k])


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", None)], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows)[:2] == [(0, 0), (1, rows[0].n_chars)] and len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://A.example.NET/en/1", "https://example.net/de", "x.net", None, "http://x.net", "http://example.com/de/", "http://example.com/de", "https://b.org/fr/?q", "http://borg/fr/", "http://b.org?x=/fr/", "a://b.org/fr/://c", "http://É.net/#a"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert rows == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("example.net", "/de", "net/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("x.net", "", None, "block" if rows[4][3] == "block" else "allow"),
        5: ("example.com", "/de/", "example.com/de/", "block"), 6: ("example.com", "/de", None, rows[6][3]), 7: ("b.org", "/fr/", "org/fr/", "allow"), 8: ("borg", "/fr/", None, "allow"), 9: ("b.org", "", None, "allow"), 10: ("b.org", "/fr/://c", "org/fr/", "allow"), 11: ("É.net", "/", "net/", "block"),
    }
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_scores_are_those_of_a_plain_loop(spark):
    """Trust and distrust of all hosts of a random graph, and the verdicts that follow from them."""
    rng = random.Random(13)
    hosts = [f"h{k}.{rng.choice(['com', 'org', 'net', 'info'])}" for k in range(25)]
    pages = []
    for k in range(120):
        host = hosts[0] if k % 3 == 0 else rng.choice(hosts)  # a third of all pages is one host's
        targets = [rng.choice(hosts) for _ in range(rng.randint(0, 4))]
        pages.append((k, f"http://{host}/{rng.choice(['fr', 'en', 'de'])}/{k}", "".join(f'<a href="http://{t}/">x</a>' for t in targets), host, targets))
    rows = url_filter.judge_urls(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()
    verdict = {r.page_id: (r.rule, r.verdict) for r in rows}
    seeds = {kind: {h: 0.0 for h in hosts} for kind in ("allow", "block")}
    for h in hosts:
        own = [p for p in pages if p[3] == h]
        for kind in seeds:
            seeds[kind][h] = sum(verdict[p[0]][0] is not None and verdict[p[0]][1] == kind for p in own) / len(own) if own else 0.0
    links = {}
    for *_, host, targets in pages:
        for t in targets:
            if t != host:
                links[host, t] = links.get((host, t), 0) + 1

    def scores(seed, edges):
        out = {a: sum(n for (x, _), n in edges.items() if x == a) for a, _ in edges}
        now = dict(seed)
        for _ in range(300):
            now = {h: 0.15 * seed[h] + 0.85 * sum(now[a] * n / out[a] for (a, b), n in edges.items() if b == h) for h in hosts}
        return now

    trust, distrust = scores(seeds["allow"], links), scores(seeds["block"], {(b, a): n for (a, b), n in links.items()})
    for r in rows:
        assert abs(r.trust - trust[r.host]) < 1e-3 and abs(r.distrust - distrust[r.host]) < 1e-3
        if r.rule is None and abs(distrust[r.host] - 0.1) > 1e-3 and abs(distrust[r.host] - trust[r.host]) > 2e-3:
            assert r.verdict == ("block" if distrust[r.host] >= 0.1 and distrust[r.host] > trust[r.host] else "allow")


def test_link_graph(spark):
    """Hosts that link to blocked ones only are blocked; those that trusted ones link to are not."""
    def link(*hosts):
        return "".join(f'<a href="http://{h}/">x</a>' for h in hosts)

    pages = spark.createDataFrame(
        [(1, "http://bad.net/x", ""), (2, "http://farm.com/a", link(*["bad.net"] * 9)), (3, "http://good.org/fr/1", link("friend.com")), (4, "http://friend.com/", link("bad.net", "calm.com", "fine.com", "more.com")), (5, "http://calm.com/", ""), (5, "http://calm.com/", "")],
        "page_id long, url string, html string",
    )
    rows = {r.host: r for r in url_filter.judge_urls(pages).collect()}
    assert rows["farm.com"].verdict == "block" and rows["friend.com"].verdict == "allow" and rows["calm.com"].verdict == "allow"
    assert abs(rows["bad.net"].distrust - 0.15) < 0.01 and rows["farm.com"].distrust > 0.1 and rows["friend.com"].trust > rows["friend.com"].distrust
