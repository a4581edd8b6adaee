"""Embedding dedup, neighbour search, language ID, toxicity: against brute force, held-out rows and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortkit.llm import ann, components, embdedup, langid, toxicity
from sortkit.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [1.0, None] + [0.0] * 6), (9005, [float("nan")] + [1.0] * 7), (9006, [float("inf")] + [1.0] * 7), (9007, [1.0, 2.0])]


def vectors(seed: int = 2, n: int = 260) -> list[tuple[int, list]]:
    r = np.random.default_rng(seed)
    hot = r.normal(size=8)
    rows = []
    for i in range(n):
        v = r.normal(size=8) if i % 3 else hot + 0.2 * r.normal(size=8)
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    return [*rows, (500, rows[4][1]), (501, [2 * x for x in rows[7][1]]), *ODD]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, t string, node int")


@pytest.mark.parametrize("split", [2048, 40])
def test_links_equal_brute_force(spark, split, monkeypatch):
    monkeypatch.setattr(embdedup, "SPLIT", split)
    monkeypatch.setattr(embdedup, "RECALL", 0.99999)
    rows = vectors()
    links, parts = brute.embedding_links(rows)
    got = {r.vec_id: r for r in embdedup.near_duplicates(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    found, want = sum(r.n_links for r in got.values()), sum(links)
    assert want > 3000 and 0.99 * want <= found <= want
    for (i, _), n in zip(rows, links):
        assert got[i].n_links <= n and got[i].component_id == parts[i] and got[i].kept == (parts[i] == i)


@pytest.mark.parametrize("hot", [1_000_000, 40])
def test_links_with_the_parameters_of_the_query(spark, hot, monkeypatch):
    monkeypatch.setattr(embdedup, "HOT", hot)
    rows = vectors()
    links, parts = brute.embedding_links(rows)
    got = {r.vec_id: r for r in embdedup.near_duplicates(frame(spark, rows)).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links) and all(got[i].n_links <= n for (i, _), n in zip(rows, links))
    # a missed link may part a component, none joins two of them
    assert all(parts[g.component_id] == parts[i] and g.component_id <= i for i, g in got.items())
    assert sum(g.component_id == parts[i] for i, g in got.items()) >= 0.97 * len(rows)


def test_codes_do_not_depend_on_batches():
    v = np.random.default_rng(2).normal(size=(500, 48)) * np.logspace(-200, 200, 500)[:, None]
    h = embdedup.Hasher(48, 9, 11)
    assert (h.keys(v) == np.concatenate([h.keys(v[i : i + m]) for i, m in ((0, 1), (1, 7), (8, 300), (308, 192))])).all()
    near = v / np.abs(v).max(1, keepdims=True) + np.random.default_rng(3).normal(size=v.shape) * 0.1
    cosine = (near * v).sum(1) / np.sqrt((near**2).sum(1)) / np.sqrt(((v / np.abs(v).max(1, keepdims=True)) ** 2).sum(1)) / np.abs(v).max(1)
    apart = np.bitwise_count(h.signs(v) ^ h.signs(near)).sum(1)
    assert (cosine > 0.9).sum() > 300 and (apart[cosine >= 0.9] <= embdedup.differing(0.9)).all()


def test_links_of_empty_and_repeated(spark):
    assert embdedup.near_duplicates(frame(spark, [])).count() == 0
    rows = embdedup.near_duplicates(frame(spark, [(3, [1.0] * 8), (3, [1.0] * 8), (None, [1.0] * 8), (5, [2.0] * 8), *ODD])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in rows)[:4] == [(0, 0, 0), (3, 2, 3), (3, 2, 3), (5, 2, 3)]
    assert all(r.n_links == 0 and r.kept for r in rows if (r.vec_id or 0) > 9000)


def test_plan_grows_with_the_table():
    assert embdedup.plan(10)[0] <= embdedup.plan(10_000)[0] < embdedup.plan(10_000_000)[0]
    near = embdedup.collision(0.2**0.5)
    k, tables = embdedup.plan(50_000)
    assert 1 - (1 - near**k) ** tables >= embdedup.RECALL


@pytest.mark.parametrize("block,batch", [(16_384, 2_048), (60, 7)])
def test_neighbours(spark, block, batch):
    rows = vectors()
    got: dict = {}
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 10 == 0, block=block, batch=batch).collect():
        got.setdefault(r.query_id, []).append(r)
    good = [(i, np.array(v, float)) for i, v in rows if brute.usable(v) and len(v) == 8]
    hits = total = 0
    for i, q in good:
        if i % 10:
            continue
        best = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i)[:10]
        mine = sorted(got.pop(i), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        exact = {j: float(np.sqrt(((v - q) ** 2).sum())) for j, v in good}
        assert all(r.score == exact[r.vec_id] for r in mine)
        hits += len({j for _, j in best} & {r.vec_id for r in mine})
        total += 10
    assert not got and hits / total >= 0.95


def test_search_verifies_few_in_clusters(spark):
    """Blocks of clustered vectors: near-exact results, and few vectors verified."""
    r = np.random.default_rng(3)
    centre = r.normal(size=(40, 32))
    vec = centre[r.integers(0, 40, 20_000)] + 0.1 * r.normal(size=(20_000, 32))
    ids = np.arange(len(vec))
    tree = ann.Tree(vec[::4], 2)
    leaf = tree.leaves(vec)
    assert np.bincount(leaf).max() < 9_000
    hits = verified = 0
    for q in range(0, 20_000, 1_000):
        b = ann.Block(ids[leaf == leaf[q]], vec[leaf == leaf[q]])
        [(_, found, d)] = b.home(np.array([q]), vec[q : q + 1], 10)
        verified += b.verified
        for other in set(range(4)) - {leaf[q]}:
            b = ann.Block(ids[leaf == other], vec[leaf == other])
            [(more, e)] = b.within(np.array([q]), vec[q : q + 1], np.array([d[-1]]), 10)
            verified += b.verified
            found, d = np.concatenate((found, more)), np.concatenate((d, e))
        exact = np.sqrt(((vec - vec[q]) ** 2).sum(1))
        exact[q] = 9e9
        hits += len(set(np.argsort(exact)[:10]) & set(found[np.argsort(d)[:10]]))
    assert hits >= 0.95 * 200 and verified < 0.1 * 20 * 20_000


def test_copies_of_a_vector_are_dealt_out(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0, 0.0, 2.0]) for i in range(1, 200)] + [(3, [9.0, 9.0, 9.0, 9.0]), (3, [1.0, 2.0, 3.0, 4.0])]
    got: dict = {}
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 50 == 0, block=64, batch=3).collect():
        got.setdefault(r.query_id, []).append(r)
    for q in range(0, 400, 50):
        assert [r.vec_id for r in sorted(got[q], key=lambda r: r.rank)] == [i for i in [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10] if i != q][:10]
        assert all(r.score == 0 for r in got[q])


def test_neighbours_of_few(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 0.0]), (6, [1.0, 0.0]), (8, [0.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 6, 0.0), (0, 2, 7, 0.0), (0, 3, 100, 2**0.5), (100, 1, 0, 2**0.5), (100, 2, 6, 2**0.5), (100, 3, 7, 2**0.5)]
    assert ann.search(frame(spark, []), F.lit(True)).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    parts = brute.Parts()
    for x, y in links:
        parts.join(x, y)
    got = {row.node: row.component for row in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {n: parts.find(n) for n in parts.up if any(n in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


# ---- 4


def test_languages_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_langid"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the cat " * 60, "en"), (2, "le chat noir " * 60, "fr"), (3, None, "en"), (4, "12 !? ²", "fr"), (5, "", None), (None, "the cat", None), (6, "the " * 40_000, None)], "doc_id long, text string, lang string")
    net = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, net).collect()}
    assert [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert (got[1][0], got[2][0], got[6][0], got[None][0]) == ("en", "fr", "en", "en")
    assert langid.fit(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), net).count() == 0


def test_every_language_is_a_class(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_IN_ALL", 40)
    monkeypatch.setattr(langid, "STEPS", 5)
    docs = [(k * 1000 + i, f"{'abcdefghijklmnopqrst'[k]}{i} " * 600, f"l{k:02d}") for k in range(20) for i in range(4)]
    docs += [(50_000 + i, "copy " * 400, "l00") for i in range(300)]
    net = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert net.classes == [f"l{k:02d}" for k in range(20)]


# ---- 9


def toxic_corpus(n: int = 400) -> tuple[list, list]:
    r = random.Random(8)
    clean = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(300)]
    bad = ["zzvile", "zzfoul", "xxgrim"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "er", "est", "!"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_rows(spark):
    rows, marks = toxic_corpus()
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "zzvile", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([m for m in marks if m[0] % 5] + [(0, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 3
    held = [(i, y) for i, y in marks if i % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    assert got[900].score == got[901].score < 0.5 and got[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxic_kind_beside_many_copies_of_a_long_one(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    clean = [word() for _ in range(200)]
    long = [word() for _ in range(2500)]
    prose = lambda: [r.choice(clean) for _ in range(30)]
    docs = [(i, " ".join([*long, f"copy{i}"]), 1) for i in range(60)]
    docs += [(100 + i, " ".join([*prose(), "zzvile"]), 1) for i in range(30)] + [(200 + i, " ".join(prose()), 0) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id % 3 != 0").select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, _, y in docs if i % 3 == 0 and i >= 100]
    assert sum(got[i] == y for i, y in held) / len(held) > 0.95 and all(got[i] for i, y in held if y)


def test_near_copies_of_toxic_examples_without_marks(spark):
    r = random.Random(5)
    clean = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 12))) for _ in range(300)]
    base = [[r.choice(clean) for _ in range(40)] for _ in range(240)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)] + [(1000 + i, " ".join([*w[:7], "other", *w[8:30], "words", *w[31:]])) for i, w in enumerate(base)]
    model = toxicity.fit(df := spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(got[i] == (i % 4 == 0) for i, _ in docs) / len(docs) > 0.98


@pytest.mark.parametrize("words,bad,space", [(["предмет", "преграда", "прелесть", "президент", "премия", "препарат", "прение", "превратность"], "предатель", " "), (["日本", "東京", "山川", "花鳥", "風月", "春夏", "秋冬", "天地"], "悪党", "")])
def test_toxic_words_of_other_scripts(spark, words, bad, space):
    r = random.Random(6)
    docs = []
    for i in range(240):
        w = [r.choice(words) for _ in range(r.randint(10, 20))]
        if i % 3 == 0:
            w[r.randrange(3, 9)] = bad
        docs.append((i, space.join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id % 4 != 0").select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, _, y in docs if i % 4 == 0]
    assert sum(got[i] == y for i, y in held) / len(held) > 0.95


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    sparse = lambda: (t := np.sort(r.choice(40, r.integers(1, 9), replace=False)), (w := r.random(len(t)) + 0.1) / np.sqrt((w * w).sum()))
    vecs = [sparse() for _ in range(700)]
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vecs):
        dense[i, t] = w
    index = toxicity.Index(vecs, r.integers(0, 2, 700), 40)
    for _ in range(60):
        t, w = sparse()
        q = np.zeros(40)
        q[t] = w
        cosine = dense @ q
        docs, best = index.nearest(t, w, 16)
        want = np.lexsort((np.arange(700), -np.round(cosine, 12)))[:16]
        assert np.allclose(np.sort(best), np.sort(cosine[want])) and len(docs) == 16


def test_query_equals_brute_force_tfidf(spark):
    """Every score and evidence of the query from plain dictionaries: counts, IDF, cosines, votes."""
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    given = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in text}
    known = set(model.vocabulary.tolist())
    count = {i: Counter(t for t in toxicity.terms([x])[1].tolist() if t in known) for i, x in text.items()}
    df = Counter(t for c in count.values() for t in c)
    idf = {t: math.log((len(text) + 1) / (df[t] + 0.5)) + 1 for t in known}
    marks = set(model.vocabulary[model.mark].tolist())

    def vector(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        for part, size in ((w.keys() - marks, 1.0), (w.keys() & marks, toxicity.MARKS)):
            norm = math.sqrt(sum(w[t] ** 2 for t in part))
            w |= {t: w[t] * size / norm for t in part}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    first: dict = {}
    for i in sorted(given):
        first.setdefault(text[i], i)
    examples = {i: vector(count[i]) for i in first.values()}
    label = {i: max(given[j] for j in given if text[j] == text[i]) for i in examples}
    near = 0
    for i, r in got.items():
        v = vector(count[i])
        cosine = {j: sum(x * e.get(t, 0.0) for t, x in v.items()) for j, e in examples.items()}
        best = sorted((j for j in cosine if cosine[j] > 0), key=lambda j: -cosine[j])[:16]
        if not best:
            assert not r.evidence and r.score == model.without
            continue
        near += 1
        assert sorted(round(cosine[j], 9) for j in r.evidence) == sorted(round(cosine[j], 9) for j in best)
        w = {j: (cosine[j] / cosine[best[0]]) ** toxicity.SHARPNESS for j in r.evidence}
        x = (sum(w[j] * label[j] for j in w) + toxicity.DOUBT / 2) / (sum(w.values()) + toxicity.DOUBT)
        assert abs(r.score - 1 / (1 + math.exp(-(model.curve[0] * x + model.curve[1])))) < 1e-9
    assert near >= 0.9 * sum(1 for x in text.values() if x.split()) and len({r.score for r in got.values()}) > 50
