"""BPE, sharding, mixing, substring dedup, language model, Jaccard join: against brute force and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortkit.llm import arrays, bpe, jaccard, lm, mixing, sharding, substrings
from sortkit.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute
from tests.oracle import both

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, chunk string, grp int, ratio double"


def frame(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], SCHEMA)


def corpus(seed: int = 5, n: int = 120) -> list[tuple[int, str | None]]:
    """Few words, shared passages, copies, near copies, odd texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "é", "日本", "a" * 50]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    passage = prose(40)
    docs: list[tuple[int, str | None]] = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ONE"), (905, "a b c d"), (906, "A b\tc d")]
    base = prose(80)
    for i in range(n):
        kind = r.random()
        if kind < 0.2:
            text = [*prose(r.randint(0, 30)), *passage, *prose(r.randint(0, 30))]
        elif kind < 0.5:
            text = list(base)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = r.choice(vocab)
        else:
            text = prose(r.randint(1, 90))
        docs.append((i * 7 % 883, r.choice([" ", "  ", "\n"]).join(text)))
    docs.append((2000, " ".join(prose(6000))))
    docs.append((2001, docs[-1][1] + " more"))
    return docs


@pytest.mark.parametrize("name", ["op1_mixing", "op2_sharding", "op3_substrings"])
def test_query_equals_sql(spark, name):
    cols, sql_cols, mine, theirs = both(spark, QUERIES[name], ORACLE_SQL[name], SF)
    assert cols == sql_cols and mine == theirs


# ---- helpers


def test_word_hashes_tell_sequences_apart():
    texts = [b"a b c", b"", b"ab c", b"a  b\tc", b"A b c"]
    h, at = arrays.hash_texts(texts)
    assert at.tolist() == [0, 3, 3, 5, 8, 11]
    assert (h[:3] == h[5:8]).all() and h[0] != h[8] and len(set(h[:5].tolist())) == 4
    low, _ = arrays.hash_texts(texts, lower=True)
    assert (low[:3] == low[8:11]).all()
    assert arrays.inside(at, 3).tolist() == [0, 5, 8]
    assert arrays.rolling(h, 3)[0] == arrays.rolling(h, 3)[5]


def test_packing_round_trip():
    for a in ([], [0], [0, 0, 7], [1, 2**63, 2**64 - 1]):
        x = np.array(a, np.uint64)
        assert (arrays.unpack(arrays.pack(x)) == x).all() and (arrays.unpack_sorted(arrays.pack_sorted(np.sort(x))) == np.sort(x)).all()


# ---- 5


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    r = random.Random(3)
    alphabet = ["a", "the ", " ", "  ", "\n", "é", "日本", "😀", "'s", "'S", "<|endoftext|>", "1", "٣", "　", "ab", "-", "\r\n", "\x1c", "\x85", "İ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(300)]
    texts += ["".join(r.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(100)] + ["a" * k for k in range(60)] + [None, "", " ", " x ", "x" * 30_000]
    texts += [row.text for row in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: row for row in bpe.digests(df, vocabulary, with_ids=True).collect()}
    back = {row.doc_id: row.text for row in bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and back[i] == decoded


# ---- 2


def test_shards_fit_and_split_only_what_is_over(spark):
    df = frame(spark, [(i, "x" * (i % 97)) for i in range(2000)] + [(None, None), (5000, "y" * 3000)])
    rows = sharding.assign_shards(df, 1500).collect()
    assert len(rows) == 2002
    size, count = {}, {}
    for r in rows:
        key = (r.shard_depth, r.shard_prefix, r.page)
        size[key] = size.get(key, 0) + r.bytes
        count[key] = count.get(key, 0) + 1
    assert all(s <= 1500 or count[k] == 1 for k, s in size.items())
    for d, p, _ in size:  # the parent of every shard is over the limit
        parent = sum(s for (e, q, _), s in size.items() if e >= d and q >> (e - d + 1) == p >> 1) if d else 1501
        assert parent > 1500
    assert len({r.shard_depth for r in rows}) > 1
    assert sharding.assign_shards(df.limit(0), 10).count() == 0


def test_equal_keys_overflow_to_pages(spark):
    rows = sharding.assign_shards(frame(spark, [(7, "z" * 100)] * 50 + [(i, "q") for i in range(100, 140)]), 500).collect()
    hot = [r for r in rows if r.doc_id == 7]
    assert len(hot) == 50 and {r.shard_bytes for r in hot} == {5000} and len({r.page for r in hot}) > 9


@pytest.mark.parametrize("limits,part_rows", [(16, 500_000), (2, 9)])
def test_pages_of_uneven_rows_hold_the_limit(spark, limits, part_rows, monkeypatch):
    monkeypatch.setattr(sharding, "PART_LIMITS", limits)
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    sizes = [1, 0, 990, 250, 30, 700, 500, 501, 2500, 3] * 30
    rows = sharding.assign_shards(frame(spark, [(7, "z" * n) for n in sizes] + [(8, None)] * 5 + [(None, "k" * 400)] * 20), 1000).collect()
    pages: dict = {}
    for r in rows:
        pages.setdefault((r.shard_depth, r.shard_prefix, r.page), []).append(r.bytes)
    assert sorted(r.bytes for r in rows if r.doc_id == 7) == sorted(sizes) and len(rows) == 325
    assert all(sum(p) <= 1000 or len(p) == 1 for p in pages.values()) and len(pages) < 3 * sum(sizes) / 1000


@pytest.mark.parametrize("limit", [2_000, 30_000])
def test_shards_of_documents_equal_sql_where_they_split(spark, limit):
    import duckdb

    sql = sharding.ORACLE_SQL.replace(str(sharding.SHARD_BYTES), str(limit)).replace("FROM documents", f"FROM '{SF}/documents.parquet'")
    want = duckdb.sql(sql).fetchall()
    got = sharding.assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.shard_depth for r in got}) > 1


def test_written_shards(spark, tmp_path):
    df = frame(spark, [(i, "x" * 50) for i in range(200)])
    sharding.write_shards(df, str(tmp_path / "s"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).agg(F.max("b")).first()[0] <= 1000


def test_written_shards_of_null_and_repeated_keys(spark, tmp_path):
    rows = [(7, f"{i:03d}" + "z" * 97) for i in range(50)] + [(None, f"n{i}") for i in range(5)] + [(i, "q") for i in range(100, 140)]
    sharding.write_shards(frame(spark, rows), str(tmp_path / "s"), 500)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r.doc_id or -1, r.text, r.chunk, r.grp) for r in back) == sorted((i or -1, t, "x", 1) for i, t in rows)
    size: dict = {}
    for r in back:
        size[r.shard] = size.get(r.shard, 0) + len(r.text)
    assert max(size.values()) <= 500


# ---- 1


def test_raking_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), ["a", "b", None][i % 3], ["x", "y"][i % 5 % 2]) for i in range(300)] + [(900, None, "a", "x"), (901, "", "c", "y")], "doc_id long, text string, s string, l string")
    targets = {"s": {"a": 0.5, "b": 0.3, "(none)": 0.2}, "l": {"x": 0.5, "y": 0.5}}
    rows = mixing.mix(docs, {"s": F.col("s"), "l": F.col("l")}, targets).collect()
    assert len(rows) == 302
    total = sum(r.tokens for r in rows)
    for m, t in targets.items():
        for k, share in t.items():
            assert abs(sum(r.tokens * r.weight for r in rows if r[m] == k) / total - share) < 1e-4
    cells: dict = {}
    for r in rows:
        cells[(r.s, r.l)] = cells.get((r.s, r.l), 0) + r.tokens
    want = brute.rake(cells, [{**targets["s"], "c": 0.0}, targets["l"]])
    for r in rows:
        if cells[(r.s, r.l)]:
            assert abs(r.weight - want[(r.s, r.l)] / cells[(r.s, r.l)]) < 1e-5
    p = brute.kept(cells, want, mixing.KEEP)
    assert all(abs(r.probability - p[(r.s, r.l)]) < 1e-6 for r in rows)
    assert abs(sum(r.tokens * r.probability for r in rows) / total - mixing.KEEP) < 1e-6
    chosen = {r.doc_id for r in rows if r.selected}
    assert chosen == {r.doc_id for r in mixing.sample(docs, {"s": F.col("s"), "l": F.col("l")}, targets).collect()}
    assert mixing.mix(docs.limit(0), {"s": F.col("s")}).count() == 0


@pytest.mark.parametrize("most", [50_000, 2])
def test_rare_cells_stay_whole_and_names_may_clash(spark, most, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_CELLS", most)  # 2: the cells are raked as a distributed table
    rows = [(i, "w " * 50, "big", "n") for i in range(2000)] + [(5000, "w", "tiny", "n"), (5001, "w w", "small", "m")]
    docs = spark.createDataFrame([(*r, 0.5, 0.1, "z") for r in rows], "doc_id long, text string, s string, l string, ratio double, p double, m_s string")
    got = {r.doc_id: r for r in mixing.mix(docs, {"s": F.col("s"), "l": F.col("l")}).collect()}
    assert got[5000].probability == got[5001].probability == 1.0 and 0.59 < got[0].probability < 0.61
    back = mixing.sample(docs, {"s": F.col("s"), "l": F.col("l")}).collect()
    assert {r.doc_id for r in back} == {i for i, r in got.items() if r.selected} and back[0].asDict().keys() == set(docs.columns)
    assert 0.55 < len(back) / 2002 < 0.65 and {5000, 5001} <= {r.doc_id for r in back}


def test_targets_that_no_weights_meet_give_a_warning(spark):
    docs = spark.createDataFrame([(1, "w w", "a", "x"), (2, "w", "b", "y")], "doc_id long, text string, s string, l string")
    with pytest.warns(UserWarning, match="margins are met within"):
        mixing.mix(docs, {"s": F.col("s"), "l": F.col("l")}, {"s": {"a": 0.9, "b": 0.1}, "l": {"x": 0.1, "y": 0.9}})


# ---- 3


@pytest.mark.parametrize("group,chunk", [(1_000_000, 6_000_000), (300, 4000)])
def test_substrings_equal_brute_force(spark, group, chunk):
    docs = corpus()
    want = brute.cover(docs)
    got = substrings.cover(frame(spark, docs), with_text=True, carry=("chunk", "grp"), group=group, chunk_bytes=chunk).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        n, gone, sha, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, sha)
        assert r.kept == (kept if gone else (texts[r.doc_id] or "")) and (r.chunk, r.grp) == ("x", 1)
        assert sum(s.end - s.begin for s in r.spans) == gone


def test_substrings_odd_ids(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = substrings.cover(frame(spark, [(None, long), (3, long), (3, long), (1, "a " + long + " b")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in rows) == [(False, 1, 0), (False, 3, 20), (False, 3, 20), (True, 0, 20)]
    assert substrings.cover(frame(spark, [])).count() == 0


# ---- 6


@pytest.mark.parametrize("shard,chunk", [(1_500_000, 6_000_000), (400, 3000)])
def test_lm_equals_brute_force(spark, shard, chunk, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", shard)
    docs = corpus(9)
    train = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2}
    want = brute.lm(docs, train, lm.M2, lm.M3)
    df = frame(spark, docs)
    got = lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, shard=shard, chunk_bytes=chunk).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * n and abs(r.score - score) < 1e-6 * n
    assert lm.score(frame(spark, []), F.lit(True)).count() == 0
    assert [r.score for r in lm.score(frame(spark, [(1, "a b")]), F.lit(False)).collect()] == [0.0]


def test_elias_fano_and_quantiser(tmp_path):
    r = np.random.default_rng(1)
    for values in ([], [5], [0, 0, 3, 3, 9], sorted(r.integers(0, 2**62, 5000).tolist()), [0, 2**64 - 1], list(range(1000))):
        v = np.array(values, np.uint64)
        e = lm.EliasFano(lm.split_parts(lm.EliasFano.build(v)))
        at = e.find(v)
        assert (at >= 0).all() and (len(v) == 0 or (v[at] == v).all())
        missing = np.array([x for x in (1, 4, 2**63, 12345678901) if x not in set(values)], np.uint64)
        assert (e.find(missing) == -1).all()
    counts = r.integers(1, 100_000, 5000)
    code, book = lm.quantise(counts)
    assert code.min() >= 1 and np.abs(np.log(book[code] / counts)).max() < 0.06
    path = tmp_path / "shard"
    path.write_bytes(lm.Trie.build(*(np.array(x, np.uint64) for x in ([3], [2], [7], [2], [9], [1]))))
    t = lm.Trie.open(str(path))
    assert [x.tolist() for x in t.lookup(np.array([3, 4], np.uint64), np.array([1, 0]), np.array([7], np.uint64), np.array([1]), np.array([9], np.uint64))] == [[2, 0], [1], [1]]


# ---- 7


@pytest.mark.parametrize("group,chunk", [(1_500_000, 6_000_000), (200, 3000)])
def test_jaccard_equals_brute_force(spark, group, chunk):
    docs = corpus(11, 160)
    want = brute.jaccard(docs)
    got = jaccard.near_duplicates(frame(spark, docs), group=group, chunk_bytes=chunk).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert max(list(w[1] for w in want.values()).count(c) for c in {w[1] for w in want.values()}) > 20


def test_jaccard_odd_ids(spark):
    t = "one two three four five six seven"
    rows = jaccard.near_duplicates(frame(spark, [(None, t), (4, t), (4, "other text"), (9, t), (8, "Other  TEXT"), (1, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 3, 0), (1, 0, 1), (4, 1, 4), (4, 3, 4), (8, 1, 4), (9, 3, 4)]
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block,with_base", [(jaccard.BLOCK, True), (20, True), (20, False)])
def test_jaccard_pairs_of_a_large_group_stay_in_their_tasks(spark, monkeypatch, block, with_base):
    """Copies of one text that link with it but hardly with one another: outside the tasks that hold their sets, what is
    compared grows with their number, not with its square, and no link between components is lost."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    docs = [(1000, " ".join(base))] if with_base else []
    for k in range(200):
        text = base[:]
        for at in r.sample(range(400), 6):
            text[at] = f"x{k}"
        docs.append((k, " ".join(text)))
    seen, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "verify", lambda pairs, nodes: (seen.append(pairs.distinct().count()), verify(pairs, nodes))[1])
    got = jaccard.near_duplicates(frame(spark, docs)).collect()
    want = brute.jaccard(docs)
    assert len(got) == len(docs) and all((x.n_shingles, x.component_id) == want[x.doc_id] for x in got)
    assert (len({w[1] for w in want.values()}) == 1) == with_base
    assert sum(seen) <= 20 * len(docs), seen


def test_forest_connects_what_links_and_compares_a_pair_once():
    sets = [np.array(s, np.uint64) << np.uint64(40) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6], [50, 51], [1, 2, 3, 4, 5, 6, 7])]
    nodes = np.array([10, 20, 30, 40, 40])  # one id with two sets
    forest = jaccard.Forest(nodes, [arrays.pack_sorted(s) for s in sets])
    forest.label[:] = forest.ids
    x, y = np.triu_indices(4, 1)
    forest.add(y, x)
    forest.add(x, y)
    forest.compare()
    links, done = len(forest.links), len(forest.compared)
    forest.add(x, y)
    forest.compare()
    assert len(set(forest.label.tolist())) == 1 and len(forest.links) == links == 3 and len(forest.compared) == done == 6


# ---- suffix subtrees


def test_clashing_fingerprints_are_told_apart_by_words(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SPARE_BITS", -6)
    docs = corpus(9)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cover(frame(spark, docs), group=400, chunk_bytes=3_000).collect()}
    assert got == {i: w[:3] for i, w in brute.cover(docs).items()} and any(n for _, n, _ in got.values())


def test_subtree_has_the_internal_nodes_of_its_suffixes():
    r = np.random.default_rng(2)
    rows = r.integers(0, 3, (300, 6)).astype(np.int32)
    tree = substrings.Subtree(rows)
    ordered = rows[tree.order].tolist()
    assert ordered == sorted(rows.tolist())
    for depth in (1, 3, 6):
        begin, end = tree.nodes(depth)
        groups = [{tuple(x[:depth]) for x in ordered[a:b]} for a, b in zip(begin, end)]
        assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == len(groups) == len({tuple(x[:depth]) for x in ordered})
    key, none = r.integers(0, 9, 300), r.random(300) < 0.1
    order = lambda i: (none[i], key[i] if not none[i] else 0)
    want = [any(rows[i].tolist() == rows[j].tolist() and order(j) < order(i) for j in range(300)) for i in range(300)]
    assert tree.earlier(key, none, 6).tolist() == want
