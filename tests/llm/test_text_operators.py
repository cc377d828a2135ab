"""Quality, language, decontamination and extraction: brute force, held-out accuracy, odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lattix.llm import decontaminate, html_text, langid, quality
from lattix.llm.common import NOT_ALNUM, SPACE, Words, hash_words, text_slices

ODD = [None, "", " \n\t ", "a", "ÀÉ ß", "x" * 50_000, "w " * 30_000, "two words", "two words", "\u0000 　 zero", "🙂 🙂"]


def rows_of(texts, lang="en"):
    return [(i, t, lang, "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("separators", "pattern"), [(SPACE, rb"[^\x20\x09-\x0D]+"), (NOT_ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(separators, pattern):
    import pyarrow as pa

    texts = [*ODD, "Mixed CASE, 12 words; été", "tail"]
    got = []
    for lo, hi, part in text_slices(pa.array(texts), 1000):
        w = Words(part, separators)
        for i in range(hi - lo):
            got.append([bytes(w.data[s:e]) for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)])
        assert (w.hashes == hash_words([bytes(w.data[s:e]) for s, e in zip(w.starts, w.ends, strict=True)])).all()
    want = [re.findall(pattern, re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    assert got == want


def junk(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) + rng.choice(["***", "$$$", "###"]) for _ in range(n))


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def test_quality_learns_and_takes_any_text(spark, made):
    rng = random.Random(1)
    texts = [junk(rng, 40) if i % 2 else prose(rng, 40) for i in range(400)] + ODD
    docs = made(rows_of(texts))
    labels = spark.createDataFrame([(i, int(i % 2 == 0) if i != 7 else None, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["quality_score"] for r in quality.quality(docs.withColumnRenamed("extra", "quality_score"), labels).collect()}
    assert len(out) == len(texts)
    assert all(0 <= s <= 1 for s in out.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= quality.THRESHOLD) == (i % 2 == 0) for i in held]) > 0.97
    assert out[400] == out[401]  # null, empty
    empty = quality.quality(docs.limit(0), labels)
    assert empty.count() == 0
    assert {"extra", "n_chars"} <= set(quality.quality(docs, labels.limit(0)).columns)


def test_language(spark, made):
    rng = random.Random(2)
    sound = {"aa": "klmn", "bb": "prst", "cc": "vwxz"}
    make = lambda lang, n: " ".join("".join(rng.choice(sound[lang]) + rng.choice("aeio") for _ in range(rng.randint(1, 4))) for _ in range(n))
    langs = [rng.choice(sorted(sound)) for _ in range(300)]
    rows = [(i, make(x, rng.randint(5, 40)), x if i % 11 else None, "s") for i, x in enumerate(langs)]
    rows += [(1000 + i, t, None, "s") for i, t in enumerate(["", None, "12 34 --", "kala " + "k" * 5000])]
    out = {r["doc_id"]: r for r in langid.language_id(made(rows)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i]["lang_pred"] == langs[i] for i in held]) > 0.97
    assert [out[1000 + i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert out[1003]["lang_pred"] in sound
    assert all(0 <= r["score"] <= 1 for r in out.values())
    none = langid.language_id(made([(1, "abc", None, "s")])).collect()
    assert [r["lang_pred"] for r in none] == ["und"]
    assert langid.language_id(made(rows).limit(0)).count() == 0


def test_recurrent_gradients_are_right():
    net = langid.Network(["a", "b"], seed=1)
    codes, goal = np.random.default_rng(0).integers(97, 105, (5, 6)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        p, _ = net.label(codes)
        return -np.log(p[:, np.arange(6), goal]).mean()

    kept = ([], [])
    p, states = net.label(codes, kept)
    error = p.copy()
    error[:, np.arange(6), goal] -= 1
    error /= 30
    d = error @ net.out.T
    h = langid.HIDDEN
    grads = [*net.ahead.backward(kept[0], d[:, :, :h]), *net.back.backward(kept[1], d[::-1, :, h:])]
    for x, g in zip([net.ahead.inputs, net.ahead.recurrent, net.back.inputs, net.back.recurrent], grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = x[at]
        x[at] = old + 1e-2
        up = loss()
        x[at] = old - 1e-2
        down = loss()
        x[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05)


def test_pieces_cover_texts_and_cut_no_character():
    texts = ["", None, "a" * 200, "é" * 100, "語" * 90, "🙂" * 77, "x" * 64, "x" * 65, "a" + "語" * 50]
    for lo, hi, part in text_slices(pa.array(texts, pa.large_string()), 1 << 20):
        starts, ends, of = langid.pieces(part)
        got = [""] * (hi - lo)
        for s, e, k in zip(starts.tolist(), ends.tolist(), of.tolist(), strict=True):
            assert 0 < e - s <= langid.PIECE + 3
            got[k] += part.data[s:e].tobytes().decode()
        assert got == [t or "" for t in texts[lo:hi]]


def test_language_of_long_and_repeated_texts(made):
    words = {"aa": ["ola", "mundo", "casa", "verde"], "bb": ["hallo", "welt", "haus", "grün"]}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x, "s") for i in range(200) for x in (("aa", "bb")[i % 2],)]
    rows += [(200, "haus grün " * 30_000, None, "s"), (201, "ola casa", None, "s"), (201, "ola casa", None, "s"), (None, "welt haus", "aa", "s")]
    out = langid.language_id(made(rows)).collect()
    assert len(out) == len(rows)
    of = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert of[200][0] == "bb" and of[201][0] == "aa" and of[None][0] == "bb"
    assert len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == 201}) == 1


def brute_contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for k, item in items:
            v = words(item)
            for s in range(max(1, len(v) - 9)) if v else ():
                win = v[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(k))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 15])
def test_contamination_is_brute_force(spark, made, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (decontaminate.WINDOW, block_words))
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 10, 14])))) for k in range(12)]
    items += [(20, items[3][1].upper()), (21, ""), (22, None), (23, "!!"), (24, "a a a a a a a a a a a a")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"x, {items[i][1]}; y {items[i][1]}" for i in range(12)] + ["a " * 40, *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(made(rows_of(texts)), bench).collect()}
    want = brute_contamination(texts, items)
    assert got == want
    kept = {r["doc_id"] for r in decontaminate.decontaminate(made(rows_of(texts)), bench).collect()}
    assert kept == {i for i, v in want.items() if not v[4]}
    matches = decontaminate.find_matches(made(rows_of(texts)), bench).where("kind = 'phrase'").select("doc_id").distinct().collect()
    assert {r[0] for r in matches} == set(want) - kept
    assert decontaminate.contamination(made(rows_of(texts)), bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.contamination(made(rows_of(texts)).limit(0), bench).isEmpty()


def test_proximity(spark, made):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = made(rows_of(["a " + item, "one two very three four five six seven eight nine ten b", "ten nine eight"]))
    got = {(r["doc_id"], r["kind"]) for r in decontaminate.find_matches(docs, bench, slop=1).collect()}
    assert (0, "phrase") in got
    assert (1, "proximity") in got
    assert 2 not in {d for d, _ in got}


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_is_brute_force(spark, made, monkeypatch, slop):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 200)
    rng = random.Random(slop)
    items = {k: [rng.choice("abcde") for _ in range(rng.choice([2, 4, 5]))] for k in range(6)} | {9: "one two three four".split()}
    texts = [[rng.choice("abcdefg") for _ in range(rng.randint(0, 30))] for _ in range(40)] + ["two one four three".split(), "x two one three four".split()]
    want = set()
    for i, t in enumerate(texts):
        for k, item in items.items():
            windows = [item[j : j + 4] for j in range(max(1, len(item) - 3))]
            for w in windows:
                for p in range(len(t) - len(w) + 1):
                    if all(x in t[max(0, p + j - slop) : p + j + slop + 1] for j, x in enumerate(w)):
                        want.add((i, k, p, len(w), "phrase" if t[p : p + len(w)] == w else "proximity"))
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = decontaminate.find_matches(made(rows_of([" ".join(t) for t in texts])), bench, window=4, slop=slop).collect()
    assert {tuple(r) for r in got} == want


def test_contamination_of_rows_without_or_with_the_same_id(spark):
    docs = spark.createDataFrame([(None, "a b c", 1, 1), (None, "d", 2, 2), (1, "a b c", 3, 3), (1, "d", 4, 4), (1, "a b c", 5, 5)], "doc_id long, text string, _id int, words int")
    bench = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    got = sorted((tuple(r)[:4] for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(None, 3, 3, 1), (None, 1, 0, 0), (1, 3, 3, 1), (1, 1, 0, 0), (1, 3, 3, 1)], key=str)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["_id"] for r in kept.collect()) == [2, 4]



@pytest.mark.parametrize("tag, shown", [("div style='overflow:hidden'", True), ("a href='/the-hidden-valley'", True), ("div title=\"Hidden gems\"", True), ("div data-hidden='false'", True), ("a href=/a/hidden/b", True), ("div hidden", False), ("div class=x HIDDEN=''", False), ("div aria-hidden='true'", False), ("div aria-hidden=false", True)])
def test_html_hidden_is_an_attribute_name(tag, shown):
    _, runs = html_text.parse(f"<article><{tag}><p>Words.</p></{tag.split()[0]}></article>")
    assert ("Words." in "".join(text for _, text in runs)) == shown


def test_html_held_out_pages():
    model = html_text.TreeModel().fit(html_text.labelled_pages(html_text.TRAIN_PAGES))
    wrong = total = 0
    for page in html_text.labelled_pages(150, seed=50):
        blocks, _ = html_text.parse(page)
        p = model.marginals(blocks, [html_text._features(b) for b in blocks])
        for b, q in zip(blocks, p, strict=True):
            if b.chars:
                total += 1
                wrong += (q >= 0.5) != b.label
    assert wrong < 0.01 * total
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class=ad>Buy this now.</div><article><h1>A &amp; B</h1><p>One <b>tw</b>o\n three.<br>Four&nbsp;five.<p>Short.</article><footer>&copy; 2024 Site.</footer><script>var t='</p>';</script></body></html>"
    assert model.extract(page) == "A & B One two three. Four five. Short."
    assert model.extract(page[: page.index("Short")] + "Sho") == "A & B One two three. Four five. Sho"
    for odd in (None, "", "<", "<p", "text only", "<!-- x", "&amp", "<div>" * 3000 + "deep", "</p></p>", "<p>" + "word " * 50_000):
        assert isinstance(model.extract(odd), str)


#: (page, main text) of layouts that were written down by hand, apart from the generator of the training pages.
PAGES = [
    ("<div id=wrapper><div class=nav-bar><a href=/>Home</a> | <a href=/news>News</a></div><div class=story><h2>Storm hits coast</h2><p>The storm arrived at noon, and trees fell on the road.</p><p>Nobody was hurt, the mayor said.</p></div><div class=footer>Copyright 2020 The Paper. All rights reserved.</div></div>",
     "Storm hits coast The storm arrived at noon, and trees fell on the road. Nobody was hurt, the mayor said."),
    ("<header><h1>My Blog</h1></header><main><article><h1>How I bake bread</h1><p>Take flour, water, salt and time.</p><ul><li>Mix it well.</li><li>Let it rest for a night.</li></ul><div class=share-buttons><a href=#>Tweet</a><a href=#>Mail</a></div></article><section class=comments><h3>2 comments</h3><p>Great recipe, thanks a lot!</p></section></main><footer><p>Made with care.</p></footer>",
     "How I bake bread Take flour, water, salt and time. Mix it well. Let it rest for a night."),
    ("<body><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><article><p>First paragraph of the text, without an end tag.<p>Second paragraph, with <a href=x>a link</a> inside it.</article><aside><h3>Read also</h3><ul><li><a href=c>Another story of ours</a></li></ul></aside></body>",
     "First paragraph of the text, without an end tag. Second paragraph, with a link inside it."),
    ("<div class=cookie-notice>We use cookies. <button>Accept</button></div><article class=post><h1>Results</h1><table><tr><td>Team</td><td>Points</td></tr><tr><td>Reds</td><td>12</td></tr></table><p>The season ends in May.</p></article><form class=newsletter><label>Your address</label><input><button>Subscribe</button></form>",
     "Results Team Points Reds 12 The season ends in May."),
    ("<article><h1>Title &amp; more</h1><div style='display: none'>Not shown.</div><p>Shown&nbsp;text.</p><pre>a  b\n c</pre></article><div class=advertisement>Buy two, get one free, today only.</div>",
     "Title & more Shown text. a b c"),
    ("Only a line of text, in no element at all.", "Only a line of text, in no element at all."),
    ("<p>A page of one paragraph.", "A page of one paragraph."),
]


def test_html_pages_labelled_by_hand():
    model = html_text.TreeModel().fit(html_text.labelled_pages(html_text.TRAIN_PAGES))
    for page, text in PAGES:
        assert model.extract(page) == text
    for start in ('<article style="overflow: hidden">', '<article title="a hidden gem">', '<article data-hidden="false">'):
        assert model.extract(start + "<p>Words of it.</p></article>") == "Words of it."


@pytest.mark.parametrize(("start", "first", "then"), [("", "<div>", "</b>"), ("<ul><li>", "<b>", "<div></div>"), ("<li><ul>", "<div>", "<li>x</li>"), ("<p><button>", "<b>", "<div></div>"), ("", "<p>a", "b<i>")])
def test_html_takes_time_in_proportion(start, first, then):
    import time

    took = []
    for n in (2_000, 16_000):
        began = time.process_time()
        html_text.parse(start + first * n + then * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.01)  # 8 times in proportion, 64 times if quadratic


def test_sum_product_is_exact():
    """Marginals against the sum over all labellings of a small tree."""
    import itertools
    import math

    model = html_text.TreeModel()
    blocks, _ = html_text.parse("<div><p>one</p><ul><li>two</li><li>three</li></ul></div>")
    rng = random.Random(4)
    features = [html_text._features(b) for b in blocks]
    for f in {f for fs in features for f in fs}:
        model.weights[f] = rng.uniform(-1, 1)
    for kind in ("text", "frame"):
        model.pairs[kind] = [rng.uniform(-1, 1) for _ in range(4)]
    sums, total = [0.0] * len(blocks), 0.0
    for y in itertools.product((0, 1), repeat=len(blocks)):
        s = sum(y[i] * sum(model.weights[f] for f in features[i]) for i in range(len(blocks)))
        s += sum(model.pairs[model.kind(b)][2 * y[b.parent] + y[i]] for i, b in enumerate(blocks) if i)
        total += math.exp(s)
        for i, v in enumerate(y):
            sums[i] += v * math.exp(s)
    assert model.marginals(blocks, features) == pytest.approx([s / total for s in sums])


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "<article><p>Hello there.</p></article>", 4), (2, None, "<article><p>Hello there.</p></article>", 4)], "page_id long, url string, html string, text int")
    got = sorted(tuple(r) for r in html_text.extract_pages(pages).collect() if r["url"]) + [tuple(r) for r in html_text.extract_pages(pages).where("url is null").collect()]
    assert got == [(1, "u", "", 0), (2, None, "Hello there.", 12), (2, None, "Hello there.", 12)]
    assert html_text.extract_pages(pages.limit(0)).isEmpty()
