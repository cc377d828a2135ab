"""Joins, deduplication, neighbours, mixing, sharding and archives against brute force."""

import gzip
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lattix.llm import ann, line_dedup, mix, ngram_join, shard, warc
from lattix.llm.common import hash_words
from lattix.llm.components import connected_components


class Roots(dict):
    def find(self, i):
        while self.get(i, i) != i:
            i = self[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def families(seed=4):
    rng = random.Random(seed)
    vocabulary, texts = [f"w{i}" for i in range(3000)], []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 12, 20, 40, 90, 200]))]
        for _ in range(rng.choice([1, 3, 10, 50])):
            x = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
                k = rng.randrange(len(x))
                x[k] = rng.choice(vocabulary)
                if rng.random() < 0.3:
                    x.insert(k, rng.choice(vocabulary))
            texts.append(" ".join(x))
    return [*texts, None, "", "  \n ", "one", "ONE", "one two", "z " * 40_000]


def brute_links(texts, width, p, q):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    roots = Roots()
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if q * common >= p * (len(sets[a]) + len(sets[b]) - common):
                    roots.join(a, b)
    return {i: (len(s), roots.find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "p", "q", "block"), [(3, 9, 10, 16), (5, 4, 5, 1024)])
def test_ngram_join_is_brute_force(made, monkeypatch, width, p, q, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks: the upper trees and pairs of blocks run too
    texts = families()
    docs = made([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r[0]: (r[1], r[2]) for r in ngram_join.link_components(docs, width, p, q).collect()}
    want = brute_links(texts, width, p, q)
    assert got == want
    if block > 16:
        kept = ngram_join.drop_near_copies(docs, width, p, q)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}
        assert ngram_join.link_components(docs.limit(0)).isEmpty()
        twice = made([(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s")])
        assert sorted(tuple(r) for r in ngram_join.link_components(twice).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_signature_trees_drop_no_pair():
    rng = np.random.default_rng(1)
    base = mixed = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = []
    for _ in range(150):
        mixed = base.copy()
        change = rng.integers(0, 300, rng.integers(0, 40))
        mixed[change] = rng.integers(0, 1 << 63, len(change)).astype(np.uint64)
        sets.append(np.unique(mixed))
    measure = ngram_join.Measure(9, 10)
    members = ngram_join.Members(sets, np.arange(len(sets)))
    roots, want = Roots(), Roots()
    for a, b in ngram_join.join_blocks(members, members, measure):
        roots.join(a, b)
    for a in range(len(sets)):
        for b in range(a):
            if len(np.intersect1d(sets[a], sets[b])) >= measure.needed(len(sets[a]) + len(sets[b])):
                want.join(a, b)
    assert [roots.find(i) for i in range(150)] == [want.find(i) for i in range(150)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    roots = Roots()
    for a, b in edges:
        if a is not None and a != b:
            roots.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: roots.find(i) for a, b in edges if a is not None and a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_line_dedup_is_brute_force(made):
    rng = random.Random(7)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 25)))
    base = [line() for _ in range(25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            x = rng.choice(base) if rng.random() < 0.5 else line()
            if rng.random() < 0.3 and len(x) > 60:
                k = rng.randrange(len(x))
                x = x[:k] + "z" + x[k + 1 :]
            lines.append(x.upper() if rng.random() < 0.1 else x)
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "x", "x\r\nx", "é" * 30 + "\n" + "q" * 20_000]
    occurrences = [(i, k, n) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if (n := x.replace("\r", " ").strip(" ").lower())]
    names = sorted({n for _, _, n in occurrences})
    sets = [{b[j : j + 9] for j in range(max(1, len(b) - 8))} for b in (n.encode() for n in names)]
    roots = Roots()
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                roots.join(a, b)
    seen, want, at = set(), {}, {n: k for k, n in enumerate(names)}
    for i, k, n in occurrences:
        root = roots.find(at[n])
        if root in seen:
            want.setdefault(i, []).append(k)
        seen.add(root)
    docs = made([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_lines"], r["dropped_lines"]) for r in line_dedup.line_report(docs).collect()}
    assert {i: d for i, (_, d) in got.items() if d} == want
    assert got[60] == (0, []) and got[62][0] == 3
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert clean[60] is None and clean[61] == ""
    assert all(clean[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, [])) for i, t in enumerate(texts) if t is not None)
    assert line_dedup.line_report(docs.limit(0)).isEmpty()
    clash = docs.selectExpr("doc_id AS _id", "doc_id AS _drops", "*")
    assert line_dedup.dedup_lines(clash).columns == clash.columns and line_dedup.dedup_lines(clash).count() == docs.count()
    loose = made([(None, "same line here\nother", "en", "s"), (3, "same line here", "en", "s"), (3, "same line here", "en", "s")])
    assert sorted((str(r["doc_id"]), r["dropped_lines"]) for r in line_dedup.line_report(loose).collect()) == [("3", [0]), ("3", [0]), ("None", [])]


@pytest.mark.parametrize("few, block", [(20, 1000), (0, 7)])
def test_line_dedup_of_interleaved_families(spark, made, monkeypatch, few, block):
    """Families at a similarity of about 1/2 under one key: all pairs of a key are verified or connected."""
    monkeypatch.setattr(line_dedup, "BANDS", 1)
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", few)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    lines = []
    for _ in range(12):
        shared = word(400)
        for tail in (word(200), word(200)):
            for _ in range(12):
                k = rng.randrange(len(tail))
                lines.append(shared + tail[:k] + "z" + tail[k + 1 :])
    rng.shuffle(lines)
    docs = made([(i, x, "en", "s") for i, x in enumerate(lines)])
    of = line_dedup.lines_of(docs)
    ids = {r["line"]: r["id"] for r in of.selectExpr("line", "xxhash64(line) AS id").collect()}
    keyed = line_dedup._keyed(line_dedup._signatures(of)).collect()
    key, sketch = {r["line_id"]: r["key"] for r in keyed}, {r["line_id"]: r["sketch"] for r in keyed}
    sets = [{x[j : j + 9] for j in range(len(x) - 8)} for x in lines]
    same = lambda a, b: sum((sketch[a] ^ sketch[b]) >> 6 * k & 63 == 0 for k in range(10))
    roots, alike, apart = Roots(), 0, 0
    for a in range(len(lines)):
        for b in range(a):
            x, y = ids[lines[a]], ids[lines[b]]
            if key[x] == key[y] and same(x, y) >= line_dedup.AGREE:
                common = len(sets[a] & sets[b])
                if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                    roots.join(a, b)
                    alike += 1
                else:
                    apart += 1
    assert alike and apart
    seen, want = set(), set()
    for i in range(len(lines)):
        if roots.find(i) in seen:
            want.add(i)
        seen.add(roots.find(i))
    assert {r["doc_id"] for r in line_dedup.dropped_lines(docs).collect()} == want


def test_line_dedup_compares_shingles_of_near_pairs_only(spark, made, monkeypatch):
    """Marks drop no similar pair, also of lines that repeat themselves, and most pairs at a similarity of 1/2."""
    rng = random.Random(23)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    lines = ["ab" * 40, "ab" * 40 + "c", "short", "shorter", "z" * 300, "z" * 200]
    for _ in range(6):
        shared = word(300)
        for _ in range(6):
            x = shared + word(rng.choice([10, 30, 60, 150]))
            k = rng.randrange(len(x))
            lines += [x, x[:k] + "z" + x[k + 1 :]]
    sets = [{x[j : j + 9] for j in range(max(1, len(x) - 8))} for x in lines]
    texts = spark.createDataFrame([(i, bytearray(x.encode())) for i, x in enumerate(lines)], "line_id long, data binary")
    marks = line_dedup._marks(texts).cache()
    assert {r["line_id"]: r["size"] for r in marks.collect()} == {i: len(s) for i, s in enumerate(sets)}
    every = spark.createDataFrame([(a, b) for a in range(len(lines)) for b in range(a)], "a long, b long")
    near = line_dedup._near_pairs(marks, every).cache()
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    similar = {(a, b) for a in range(len(lines)) for b in range(a) if jaccard(a, b) >= 0.8}
    assert similar <= {(r["a"], r["b"]) for r in near.collect()}
    assert all(jaccard(r["a"], r["b"]) > 0.65 for r in near.collect())
    assert {(r["a"], r["b"]) for r in line_dedup._similar(texts, near).collect()} == similar
    compared, exact = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "BANDS", 1)
    monkeypatch.setattr(line_dedup, "_similar", lambda texts, pairs: compared.append(pairs.count()) or exact(texts, pairs))
    shared = word(400)
    line_dedup.dropped_lines(made([(i, shared + word(130), "en", "s") for i in range(60)]))
    assert sum(compared) < 60


def test_line_dedup_of_long_lines(made):
    """A line is read once for all its shingles, not copied for each: that took a time that grows with the square of its length."""
    rng = random.Random(29)
    x = "".join(rng.choices("abcdefghij ", k=1_000_000))
    began = time.monotonic()
    assert [(r["doc_id"], r["line_no"]) for r in line_dedup.dropped_lines(made([(1, x, "en", "s"), (2, "other\n" + x[:400_000] + "z" + x[400_001:], "en", "s")])).collect()] == [(2, 1)]
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("block", [1000, 5])
def test_line_dedup_makes_a_pair_of_several_keys_once(spark, monkeypatch, block):
    """Lines that share several keys are one row of the join of all pairs, whatever blocks their keys are dealt into."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    line = "".join(random.Random(31).choices("abcdefghij", k=300))
    texts = spark.createDataFrame([(i, bytearray((line[:i] + "z" + line[i + 1 :]).encode())) for i in range(12)], "line_id long, data binary")
    rows = [(key, i, 0, -1, i, 12 - key, 0, 1) for key in range(3) for i in range(key, 12)]
    now = spark.createDataFrame(rows, "key long, line_id long, sketch long, before long, component long, many long, pivot long, own long")
    made = sorted((r["a"], r["b"]) for r in line_dedup._all_pairs(now, line_dedup._marks(texts)).collect())
    assert made == [(a, b) for a in range(12) for b in range(a)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:140] = x[7]  # copies
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [1.0, None] + [0.0] * 14, 0), (2060, [float("nan")] * 16, 0), (2080, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    got = ann.nearest(df, "vec_id % 20 = 0", 20).toPandas()
    assert set(got["query_id"]) == set(range(0, 1500, 20))
    wide, found = x.astype(float), []
    for q, part in got.groupby("query_id"):
        score = wide @ wide[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -score))[:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21))
        np.testing.assert_allclose(part["score"], score[part["vec_id"]], atol=1e-12)
        found.append(len(set(order) & set(part["vec_id"])) / 20)
        if 100 <= q < 140:
            assert part["vec_id"].tolist() == order.tolist()
    assert np.mean(found) >= 0.95
    few = ann.nearest(df.where("vec_id < 5"), "vec_id % 20 = 0", 20).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few)] == [(0, k) for k in range(1, 5)]
    assert ann.nearest(df.limit(0), "vec_id % 20 = 0").isEmpty()


def _cells():
    rng = np.random.default_rng(9)
    return pd.DataFrame([(s, c, t, int(rng.integers(10, 1000))) for s in ("a", "b", None) for c in ("x", "y") for t in range(3)], columns=["source", "lang", "topic", "tokens"])


def test_rake_meets_its_targets(spark, monkeypatch):
    cells = _cells()
    have = cells.groupby("source", dropna=False)["tokens"].sum()
    # The bound matters: nearly all tokens of b are wanted.
    b = 0.99 * have["b"] / (0.6 * have.sum())
    targets = {"source": {None: 0.8 - b, "b": b, "a": 0.2}, "lang": {"y": 0.4, "x": 0.6}, "topic": {2: 0.4, 0: 0.3, 1: 0.3}}
    p = mix.rake(cells, 0.6, targets)
    assert (p <= 1).all() and (p == 1).any()
    mass = cells["tokens"] * p / (0.6 * cells["tokens"].sum())
    for m in mix.MARGINS:
        for level, share in targets[m].items():
            assert mass[[mix._plain(x) == level for x in cells[m]]].sum() == pytest.approx(share, abs=1e-6)
    with pytest.raises(ValueError, match="can't be met"):
        mix.rake(cells, 0.9, targets)
    for wrong in ({"source": {"a": 0.5}}, {"site": {"a": 1.0}}, {"source": {"a": 0.5, "nowhere": 0.5}}):
        with pytest.raises(ValueError):
            mix.rake(cells, 0.6, wrong)
    monkeypatch.setattr(mix, "ROUNDS", 25)
    rows = spark.createDataFrame([tuple(r) for r in cells.astype(object).where(cells.notna(), None).itertuples(index=False)], "source string, lang string, topic int, n_tokens long")
    easy = {"source": {None: 0.3, "a": 0.3, "b": 0.4}, "topic": {0: 0.3, 1: 0.4, 2: 0.3}}
    here = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mix.cell_probabilities(rows, 0.5, easy)[0].collect()}
    monkeypatch.setattr(mix, "MAX_CELLS", 1)  # the way for many cells
    there, bounded = mix.cell_probabilities(rows, 0.5, easy)
    assert not bounded
    assert {(r["source"], r["lang"], r["topic"]): r["probability"] for r in there.collect()} == pytest.approx(here, abs=1e-9)
    with pytest.raises(ValueError):
        mix.cell_probabilities(rows, 0.5, {"source": {"nowhere": 1.0}})


def test_default_targets_go_as_far_as_the_tokens_reach():
    cells = _cells()
    for budget in (0.3, 0.75, 0.97, 1.0):
        p = mix.rake(cells, budget)
        assert (p <= 1).all()
        assert (p * cells["tokens"]).sum() == pytest.approx(budget * cells["tokens"].sum())
        met = [k for k in range(11) if all((cells["tokens"] * p).groupby(cells[m].fillna("?")).sum().to_numpy() == pytest.approx(mix._local_goals(cells.fillna("?"), budget, {}, k / 10)[m].to_numpy(), rel=1e-5) for m in mix.MARGINS)]
        assert met


def test_mixing(made):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), "big" if i % 3 else f"s{i % 7}") for i in range(600)] + [(600, None, None, None), (600, None, None, None)]
    out = mix.mix_table(made(rows)).toPandas()
    assert len(out) == 602
    assert (out["n_tokens"] * out["probability"]).sum() == pytest.approx(mix.BUDGET * out["n_tokens"].sum())
    assert out[out["doc_id"] == 600]["kept"].nunique() == 1
    kept = mix.mix_documents(made(rows))
    assert kept.columns == made(rows).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(out[out["kept"]]["doc_id"].tolist())
    assert mix.mix_table(made(rows).limit(0)).isEmpty()
    clash = made(rows).selectExpr("*", "1 AS topic", "text AS n_tokens", "3 AS weight", "'k' AS probability")
    assert mix.mix_documents(clash).columns == clash.columns


def test_topics_come_from_all_documents(made):
    """Copies of one text fill a third, and a group lies outside any small sample: seeds are distinct, centres means of all."""
    rng = random.Random(12)
    groups = [[f"{g}{k}" for k in range(6)] for g in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(groups[i % 8]) for _ in range(40)), "en", "s") for i in range(400)] + [(400 + i, "copy of all", "en", "s") for i in range(200)]
    docs = made(rows)
    centres = mix.fit_topics(docs, sample=20)
    assert len(np.unique(centres, axis=0)) == mix.TOPICS
    vectors = np.concatenate([mix._word_shares(t)[0] for _, _, t in mix.text_slices(pa.array([r[1] for r in rows]))])
    near = (vectors @ centres.T).argmax(1)
    assert len(np.unique(near)) == mix.TOPICS
    for k in range(mix.TOPICS):
        mean = vectors[near == k].sum(0)
        assert centres[k] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-5)
    assert (mix.fit_topics(docs.repartition(7), sample=20) == centres).all()


def test_sharding(made):
    rng = random.Random(11)
    texts = ["word " * rng.randint(0, 300) + str(i) for i in range(900)] + ["copy of all"] * 450 + [None, "", "", "é"]
    docs = made([(i, t, "en", "s") for i, t in enumerate(texts)])
    out = shard.shard_table(docs).toPandas().set_index("doc_id").sort_index()
    data = [(t or "").encode() for t in texts]
    assert out["size"].tolist() == [len(b) + 1 for b in data]
    assert out["text_crc32"].tolist() == [zlib.crc32(b) for b in data]
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 16
    assert load.max() - load.min() <= 0.001 * load.mean() + 2
    rows, tokens = out.groupby("shard").size(), pd.Series([len((t or "").split()) for t in texts]).groupby(out["shard"].to_numpy()).sum()
    assert rows.max() / rows.mean() < 1.5
    assert tokens.max() / tokens.mean() < 1.05
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert out["shard"].loc[1351] == out["shard"].loc[1352]  # the two empty texts
    assert out["shard"].loc[1350] == out["shard"].loc[1351]  # null counts as empty
    named = shard.assign_shards(docs).toPandas().set_index("doc_id").sort_index()
    assert (named["shard"] == out["shard"]).all()
    assert shard.shard_table(docs.limit(0)).isEmpty()


def test_sharding_in_tasks(made, monkeypatch):
    """Groups packed in tasks, a group that is cut, groups that stay whole up to a shard, rows joined by a shuffle."""
    for name, value in (("LARGE", 64), ("RESERVE", 100), ("GROUPS", 400), ("BROADCAST_GROUPS", 10)):
        monkeypatch.setattr(shard, name, value)
    rng = random.Random(13)
    texts = ["w " * rng.randint(0, 60) + str(i % 1800) for i in range(2000)]
    whole = len(texts)
    texts += ["kept together " + "k" * 60] * 120 + ["cut, as it fills several shards"] * 1500
    docs = made([(i, t, "en", "s") for i, t in enumerate(texts)] + [(5, texts[5], "en", "s")] * 3)
    clash = docs.selectExpr("*", "1 AS shard", "2 AS cell", "3 AS cells", "4 AS group_key")
    out = shard.shard_table(docs).toPandas()
    load, rows = out.groupby("shard")["size"].sum(), out.groupby("shard").size()
    assert len(load) == 16 and load.max() - load.min() <= 0.001 * load.mean() + 2
    assert rows.max() / rows.mean() < 1.5
    of = dict(zip(out["doc_id"], out["shard"], strict=True))
    assert len({of[i] for i in range(whole, whole + 120)}) == 1
    assert len({of[i] for i in range(whole + 120, whole + 1620)}) > 2
    groups = {}
    for i, t in enumerate(texts[:whole]):
        groups.setdefault(t, set()).add(of[i])
    assert all(len(g) == 1 for g in groups.values())
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    named = shard.assign_shards(clash)
    assert named.columns == [c for c in clash.columns if c != "shard"] + ["shard"]
    assert {(r["doc_id"], r["shard"]) for r in named.collect()} == set(zip(out["doc_id"], out["shard"], strict=True))


def test_archives_round_trip(spark, tmp_path):
    mark = "\r\n\r\nWARC/1.1\r\nX-Archive: "
    html = ["<p>" + "x" * 200, "<p>" + "x" * 200, "short", "short", None, "", "ü" * 60, "a\r\n\r\n" * 40, mark * 20, "tail\r\n\r\n", "z" * 300_000]
    rows = [(i * 3, f"http://www.h{i % 2}.org/p?{i}\n", h, "e") for i, h in enumerate(html)]
    rows += [(100 + i, "https://hot.net/", "same page " * 20, "e") for i in range(60)] + [(None, None, "q" * 150, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(5)
    first = {}
    for i, _, h, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    index = warc.archive_and_index(pages, f"{tmp_path}/w")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"]) for r in index.collect()}
    for i, u, h, _ in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= 100 and first[h or ""] != i
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None, u or "")
    ordered = [(r["url_key"], r["captured_at"], r["page_id"]) for r in index.collect()]
    key = lambda x: (x[0], x[1], x[2] is not None, x[2] or 0)
    assert ordered == sorted(ordered, key=key)
    payload = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert all(bytes(payload[i]) == (h or "").encode() for i, _, h, _ in rows if got[i][2] == "response")
    # An entry of the index is enough to read its record: offset and length name whole gzip members.
    for r in index.collect():
        with open(r["archive"].removeprefix("file:").replace("///", "/"), "rb") as f:
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(f"X-Page-ID: {r['page_id']}".encode()) == (r["page_id"] is not None)
    assert warc.archive_and_index(pages.limit(0), f"{tmp_path}/n").isEmpty()


def test_archives_by_salt_and_stream(spark, tmp_path, monkeypatch):
    """Digests beyond the broadcast, long records in several members, files that are streamed, a table with another captured_at."""
    for name, value in (("BROADCAST_DIGESTS", 0), ("WHOLE_FILE", 100), ("MEMBER_BYTES", 1000), ("SALTS", 3), ("MERGE_ROWS", 20)):
        monkeypatch.setattr(warc, name, value)
    rows = [(i, f"http://a.org/{i}%20x", "equal " * 40 if i % 2 else "own " * 300 + str(i) if i % 3 else None, "x") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, captured_at string").repartition(4)
    got = {r["page_id"]: r for r in warc.archive_and_index(pages, f"{tmp_path}/s").collect()}
    for i, u, h, _ in rows:
        again = i % 2 and i > 1
        assert (got[i]["url"], got[i]["record_type"], got[i]["refers_to"], got[i]["payload_digest"]) == (u, "revisit" if again else "response", 1 if again else None, hashlib.sha256((h or "").encode()).hexdigest())


def test_archives_of_other_makers(spark, tmp_path):
    """A warcinfo record, plain HTTP responses, resources, another digest; compressed by record, as a whole, and not at all."""
    def record(kind, uri, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Date: 2020-01-02T03:04:05Z", *([f"WARC-Target-URI: {uri}"] if uri else []), *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    records = [record("warcinfo", "", b"software: x\r\n"), record("response", "http://b.org/", b"HTTP/1.0 200 OK\r\nServer: s\r\n\r\nhello\r\n\r\nWARC/1.0\r\n", http, "WARC-Payload-Digest: sha1:AAAA"), record("resource", "http://a.org/", b"plain"), record("response", "http://c.org/", b"x" * 3_000_000, http)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    for name in ("a.warc.gz", "b.warc.gz", "c.warc"):
        found = sorted(warc.read_archives(spark, f"{tmp_path}/{name}").collect(), key=lambda r: r["url"])
        assert [(r["record_type"], r["url"], bytes(r["payload"])) for r in found[1:]] == [("resource", "http://a.org/", b"plain"), ("response", "http://b.org/", b"hello\r\n\r\nWARC/1.0\r\n"), ("response", "http://c.org/", b"")]
        if name != "b.warc.gz":
            data = (tmp_path / name).read_bytes()
            for r in found:
                part = data[r["offset"] : r["offset"] + r["length"]]
                assert (gzip.decompress(part) if name.endswith("gz") else part) in records
    assert [r["url"] for r in warc.capture_index(warc.read_archives(spark, f"{tmp_path}/c.warc")).collect()] == ["http://c.org/", "http://a.org/", "http://b.org/"][1:] + ["http://c.org/"]
    (tmp_path / "d.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records)[:-20])
    with pytest.raises(Exception, match="damaged WARC file"):
        warc.read_archives(spark, f"{tmp_path}/d.warc.gz").collect()


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(12))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_key(spark):
    from pyspark.sql import functions as F

    urls = ["http://www.Example.com/a?b=1#c", "https://user@shop.example.com:80/x", "", "ftp://h"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example)/a?b=1", "com,example,shop:80)/x", ")", "h)"]


@pytest.mark.parametrize(("p", "q"), [(4, 5), (9, 10)])
def test_linked_sets_share_the_roots_they_need(p, q):
    """Barely linked sets of many sizes, with and without common n-grams: both need no more roots than they share."""
    rng = np.random.default_rng(5)
    measure = ngram_join.Measure(p, q)
    for trial in range(400):
        n = int(rng.integers(1, 400))
        total = rng.integers(1, 1 << 62, 2 * n + 1, dtype=np.uint64)
        m = n - int(rng.integers(0, n - measure.needed(2 * n) + 1))
        least = measure.needed(n + m)
        if least > m:
            continue
        x, y = np.unique(total[:n]), np.unique(np.concatenate([total[:least], total[n : n + m - least]]))
        common = np.unique(total[: int(rng.integers(0, n))]) if trial % 2 else np.zeros(0, np.uint64)
        found = [set(ngram_join.pick_roots(s, np.array([0, len(s)]), measure, (common, np.ones(len(common), np.int64)))[1].tolist()) for s in (x, y)]
        need = max(int(measure.need(np.array([len(s)]))[0]) for s in (x, y))
        assert len(found[0] & found[1]) >= need >= 1, (n, m)


def test_one_row_of_each_component_stays(spark):
    """Repeated and null doc_ids, rows without words, columns with names like the operator's own."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(2, b), (5, a), (5, b), (1, "x y"), (1, "x y"), (None, a), (None, a), (None, "only one"), (None, "only one"), (7, None), (7, None), (8, " ")]
    docs = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "doc_id long, text string, _id int, component string")
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(2, b), (5, a), (1, "x y"), (None, "only one"), (7, None), (7, None), (8, " ")], key=str)
    found = sorted((tuple(r) for r in ngram_join.link_components(docs).collect()), key=str)
    assert found == sorted([(2, 26, 2), (5, 26, 5), (5, 26, 2), (1, 1, 1), (1, 1, 1), (None, 26, 5), (None, 26, 5), (None, 1, None), (None, 1, None), (7, 0, 7), (7, 0, 7), (8, 0, 8)], key=str)


def test_words_that_differ_by_a_pattern_have_different_hashes():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes = hash_words([word.encode(), other.encode(), b"", b"a", b"a" * 8, b"a" * 9, b"b"])
    assert len(set(hashes.tolist())) == 7


def test_linked_groups_over_many_blocks_and_hot_roots(made, monkeypatch):
    """A large group of near copies, and unrelated sets with a passage that all share, against brute force."""
    for name, value in (("BLOCK", 8), ("HOT_DOCUMENTS", 5), ("COMMON_RATE", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(8)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base, passage, texts = fresh(60), fresh(50), []
    for _ in range(60):
        x = base[:]
        x[rng.randrange(60)] = fresh(1)[0]
        texts.append(" ".join(x))
    texts += [" ".join(passage + fresh(rng.randrange(4, 14))) for _ in range(40)]
    rng.shuffle(texts)
    docs = made([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r[0]: (r[1], r[2]) for r in ngram_join.link_components(docs, 5, 4, 5).collect()}
    assert got == brute_links(texts, 5, 4, 5)
