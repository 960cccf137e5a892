from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import decontaminate, html, langid, lm, quality
from cohortry.llm.common import WORD, CharGrams, fold

ENGLISH = "the cat sat on the mat and the dog ran to the house with a ball of thread in the morning".split()
GERMAN = "der hund und die katze sitzen auf dem dach wenn es nicht regnet über straßen und häuser".split()


def words(rng, source, n):
    return " ".join(rng.choice(source) for _ in range(n))


def test_char_grams_stay_inside_their_text():
    rng = random.Random(1)
    texts = ["", "a", "Ab", "ÄÖ 😀x", *("".join(rng.choice("abc é") for _ in range(rng.randint(0, 30))) for _ in range(30))]
    grams = CharGrams((1, 2, 3, 4), 12)
    alone = [[b.tolist() for b, _ in grams([t])] for t in texts]
    for k, (buckets, starts) in enumerate(grams(texts)):
        assert [buckets[starts[i] : starts[i + 1]].tolist() for i in range(len(texts))] == [a[k] for a in alone]
        assert [starts[i + 1] - starts[i] for i in range(len(texts))] == [max(0, len(t) + 2 - k) for t in (x.lower() for x in texts)]


def test_language_id(spark, documents):
    rng = random.Random(2)
    rows = [(i, words(rng, ENGLISH if i % 2 else GERMAN, rng.randint(3, 40)), "en" if i % 2 else "de") for i in range(200)]
    docs = documents([*rows, (500, None, "en"), (501, "no language", None), (502, "", "de"), (None, "1234 !?", "en")], extra=True)
    held = fold("doc_id", 3) == 1
    model = langid.learn(docs.where(~held), bits=10)
    got = langid.predict(docs, model, more={"held_out": held}).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 204 and model.languages == ["de", "en"]
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(200))
    assert np.mean([by_id[i].lang_pred == lang for i, _, lang in rows if by_id[i].held_out]) > 0.95
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (500, 502, None))
    assert all(0 <= r.score <= 1 for r in got)


def test_language_model_equals_its_definition(spark, documents):
    rows = [(1, "aab", "x"), (2, "abb", "y"), (3, "b" * 5000, "y"), (3, "b" * 5000, "y")]
    model = langid.learn(documents(rows), bits=8)
    grams, expected = CharGrams((1, 2, 3), 8), {}
    for _, text, lang in rows:
        own = expected.setdefault(lang, np.full((3, 256), 0.1))
        for k, (buckets, _) in enumerate(grams([text])):
            np.add.at(own[k], buckets, 1)
    for i, lang in enumerate(model.languages):
        want = np.log(expected[lang] / expected[lang].sum(axis=1, keepdims=True)).reshape(-1)
        np.testing.assert_allclose(model.log_likelihood[i], want, rtol=1e-5)
    np.testing.assert_allclose(np.exp(model.log_prior), [1 / 4, 3 / 4])


def test_language_id_of_an_empty_table(spark, documents):
    model = langid.learn(documents([]))
    assert langid.predict(documents([]), model).collect() == []
    assert [r.lang_pred for r in langid.predict(documents([(1, "text")]), model).collect()] == ["und"]


def base_by_hand(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(covered)


def test_quality(spark, documents):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 > 0
        text = words(rng, ENGLISH, rng.randint(60, 120)) if good else " ".join(w + "***" for w in words(rng, ENGLISH, 70).split())
        rows.append((i, text))
        if i < 200:
            marks.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "a b a b a b a b a b\nx\nx\n\n"), (903, "same three words " * 40), (None, words(rng, ENGLISH, 60)), (904, words(rng, ENGLISH, 30_000))]
    labels = spark.createDataFrame([*marks, (0, None), (None, 1), (1, 1)], "doc_id long, quality int")
    docs = documents(rows, extra=True).repartition(4)
    model = quality.learn(docs, labels)
    got = quality.judge(docs, model).collect()
    texts = {i: t for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id != 904:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_by_hand(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    held = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert all(r.kept == (r.doc_id % 3 > 0) for r in held if not r.base_failed)
    # without a model the base rules decide alone
    assert quality.learn(docs, labels.where("quality = 1")) is None
    assert all(r.kept != r.base_failed and r.probability is None for r in quality.judge(docs, None).collect())
    assert quality.judge(documents([]), None).collect() == []


def test_calibration_recovers_a_logistic_curve():
    rng = np.random.default_rng(3)
    margin = rng.normal(size=20_000) * 3
    label = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * margin - 1)))).astype(float)
    slope, offset = quality.platt(margin, label)
    assert abs(slope - 2) < 0.15 and abs(offset + 1) < 0.15


def lm_by_hand(rows, mix, train):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*WORD.findall((t or "").translate(low)), None] for _, t in rows]
    uni, bi = {}, {}
    for one, ok in zip(tokens, train):
        if ok:
            for a, b in zip([None, *one], one):
                uni[b] = uni.get(b, 0) + 1
                bi[a, b] = bi.get((a, b), 0) + 1
    n, v = sum(uni.values()), len(uni)
    out = []
    for one in tokens:
        base = sum(np.log10((uni.get(x, 0) + 1) / (n + v + 1)) for x in one)
        score = 0.0
        for a, b in zip([None, *one], one):
            c = uni.get(a, 0)
            w = mix[min(int(np.frexp(float(c))[1]), lm.BUCKETS - 1)]
            score += np.log10(w[0] * bi.get((a, b), 0) / max(c, 1) + w[1] * uni.get(b, 0) / max(n, 1) + w[2] / (v + 1))
        out.append((len(one), sum(uni.get(x, 0) > 0 for x in one), n, base, score))
    return out


def test_language_model_scores(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 300)
    learned = []
    original = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: learned.append(original(*a)) or learned[0])
    rng = random.Random(8)
    rows = [(i, words(rng, ENGLISH + ["The", "ÉTÉ"], rng.randint(0, 60))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "the cat"), (5, rows[5][1]), (203, words(rng, ENGLISH, 5000)), (204, "unseen words only"), *((i, " ".join(ENGLISH)) for i in range(300, 330))]
    docs = documents(rows, extra=True).repartition(3)
    got = lm.score(docs, fold("doc_id", 7) != 2, fold("doc_id", 7) == 5).collect()
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    want = sorted((str(i), not ok, *x) for (i, _), ok, x in zip(rows, train, lm_by_hand(rows, learned[0].mix, train)))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    np.testing.assert_allclose([h[5:] for h in have], [w[5:] for w in want], rtol=1e-9)
    held = [h for h in have if h[1] and h[0] >= "300" and len(h[0]) == 3]
    assert held
    assert sum(h[6] for h in held) > sum(h[5] for h in held)
    np.testing.assert_allclose(learned[0].mix.sum(axis=1), 1)


def test_language_model_edges(spark, documents):
    yes, no = F.lit(True), F.lit(False)
    assert lm.score(documents([]), yes, no).collect() == []
    r = lm.score(documents([(1, "a b")]), no, no).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score <= 0


def test_expectation_maximisation_never_loses_likelihood():
    rng = np.random.default_rng(5)
    bucket, est, n = rng.integers(0, 4, 200), rng.random((200, 3)), rng.integers(1, 9, 200).astype(float)
    last = -np.inf
    for rounds in (1, 2, 5, 20, 60):
        mix = lm.mixture(bucket, est, n, rounds)
        value = (n * np.log((mix[bucket] * est).sum(axis=1))).sum() + np.log(mix[:4]).sum()  # with the pseudo-tokens
        assert value >= last - 1e-9
        last = value


def test_greedy_tiles_cover_reordered_passages(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    swapped = " ".join(w[10:] + ["noise"] + w[:10])
    half = " ".join(w[:9])
    bench = spark.createDataFrame([(7, item), (3, item.upper() + "!"), (8, None), (9, ""), (10, "too short"), (None, "one more item of seven words here")], "item_id long, text string")
    rows = [(1, "before " + item + " after"), (2, swapped), (3, half), (4, None), (5, ""), (6, "nothing of it " * 2000), (None, item), (1, "before " + item + " after"), (11, "One more item, of seven words here.")]
    docs = documents(rows, extra=True)
    got = sorted(((r.doc_id, r.item_id, r.n_covered, r.n_tiles) for r in decontaminate.find(docs, bench).collect()), key=str)
    assert got == sorted([(1, 3, 20, 1), (1, 3, 20, 1), (2, 3, 20, 2), (None, 3, 20, 1), (11, -1, 7, 1)], key=str)
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    empty = bench.where("false")
    assert decontaminate.find(docs, empty).collect() == [] and decontaminate.remove(docs, empty).count() == len(rows)
    assert decontaminate.find(documents([]), bench).collect() == []


def tiles_by_hand(item, doc, least):
    """Greedy string tiling as defined: all matches are looked for again after each mark."""
    used_q, used_p, total = set(), set(), 0
    while True:
        best = None
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n] and q + n not in used_q and p + n not in used_p:
                    n += 1
                if n >= least and (best is None or (-n, q, p) < best):
                    best = (-n, q, p)
        if best is None:
            return total
        n, q, p = -best[0], best[1], best[2]
        used_q |= set(range(q, q + n))
        used_p |= set(range(p, p + n))
        total += n


def test_tiling_against_the_definition():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.choice("abcd") for _ in range(rng.randint(3, 30))]
        doc = [rng.choice("abcde") for _ in range(rng.randint(0, 20))]
        for _ in range(3):
            at = rng.randrange(len(item))
            doc[len(doc) // 2 : len(doc) // 2] = item[at : at + rng.randint(3, 12)]
        index = decontaminate.build_index([(1, " ".join(item))], 3)
        found = decontaminate.compare(" ".join(doc), index)
        assert (sum(t[0] for t in found[0][1]) if found else 0) == tiles_by_hand(item, doc, 3)


def test_benchmark_in_blocks(spark, documents, monkeypatch):
    rng = random.Random(10)
    items = [(i, " ".join(f"x{rng.randrange(500)}" for _ in range(12))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(i, f"intro {t} end") for i, t in items[::2]] + [(100, "clean words only here and there")])
    want = sorted((i, i) for i, _ in items[::2])
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (400,))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()) == want
    assert [r.doc_id for r in decontaminate.remove(docs, bench).collect()] == [100]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies on this site and many more words about it than you ever want to read here today.</div>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp; paragraph,
 with <b>bold</b> and <a href="/x">a link</a>.<p>Of.</p><div class="ad">Buy now</div><aside>Related stuff that is long enough to look like text in any case</aside>
<p>Last &lt;tag&gt; &#233;&#x1F600;</p><form><label>Name</label><input></form><section id="comments"><p>Nice article, I liked it very much and read it twice in a row.</p></section></article>
<div class="sidebar"><p>Side text that is long enough to look like text in any case, is it not</p></div><footer>&copy; 2020</footer></body></html>"""


def test_html_main_text(spark):
    tree = html.fit_tree()
    table = np.array(html.LABELLED, float)
    assert (tree.classify(table[:, :-1]) == table[:, -1]).all()
    plain = "<div>" + " ".join(ENGLISH * 2) + "</div><br><div>" + " ".join(ENGLISH * 3) + "</div>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>text <"), (1, "u", PAGE), (None, "u", plain), (5, "u", "<article>" + "<p>long text</p>" * 5000 + "</article>"), (6, "u", "<nav>x</nav><!-- open")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = {r.page_id: r for r in html.extract(pages, tree).collect()}
    want = "Title & more\n\nFirst paragraph, with bold and a link.\n\nOf.\n\nLast <tag> é😀"
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == got[6].text == "" and got[2].url is None
    assert got[None].text.count("\n\n") == 1 and got[5].text.count("long text") == 5000
    assert html.extract(pages.where("false"), tree).collect() == []


def test_html_places_decide():
    tree, rng = html.fit_tree(), np.random.default_rng(0)

    def share(outside, place, most_links):
        n = 3000
        size = lambda: np.floor(np.exp(rng.uniform(0, 6.5, n)))
        links = lambda: rng.choice([0, 0, 1.0], n)
        return tree.classify(np.stack([size(), rng.uniform(0, most_links, n), size(), links(), size(), links(), np.full(n, outside), np.full(n, place)], axis=1)).mean()

    assert share(1, 1, 1) == share(1, 0, 1) == share(1, -1, 1) == share(0, -1, 1) == 0
    assert share(0, 1, 0.5) == 1


def test_pages_keep_text_around_graphics_in_formulas_and_in_hinted_wrappers():
    one = lambda page: [(b.text, b.outside, b.inside) for b in html.blocks(page)]
    assert one('<p>one <svg class="i"/> two</p><p>three</p>') == [("one two", False, False), ("three", False, False)]
    assert one("<p>a <svg><text>no</text></svg> b</p>") == [("a b", False, False)]
    assert one("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>") == [("so x=2 holds", False, True)]
    assert one("<math><annotation-xml><p>no</p></annotation-xml></math><svg-icon>a</svg-icon><p>b</p>") == [("a", False, False), ("b", False, False)]
    prose = "word " * 60
    page = f"<body><div class='content-sidebar-wrap'><p>Menu</p><article><p>{prose}</p></article><p>Other</p></div><p>last</p></body>"
    assert [(b.outside, b.inside) for b in html.blocks(page)] == [(True, False), (False, True), (True, False), (False, False)]
    assert html.main_text(page, html.fit_tree())[0] == prose.strip()
    for wrapper in ("<aside>", "<div class='related'>", "<div hidden>"):
        assert all(b.outside for b in html.blocks(f"{wrapper}<article><p>{prose}</p></article>"))
