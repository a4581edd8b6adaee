"""The pipeline's stages against plain Python, stage by stage."""

import hashlib

import pytest

from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C
    import public_tokenizers
    from sortkit.llm import mixing, toxicity
    from tokenizers import Tokenizer

    assert [k for k, _ in C.STAGES] == ["toxicity", "near copies", "repeats", "mixing", "tokens"] and C.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    read = lambda df: {r.doc_id: r for r in df.collect()}

    clean = C.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert set(read(clean)) == {i for i, p in scores.items() if not p}

    single = C.drop_near_copies(spark, clean, SF).cache()
    parts = brute.jaccard([(r.doc_id, r.text) for r in clean.collect()])
    assert set(read(single)) == {i for i, (_, c) in parts.items() if c == i} and single.columns == docs.columns

    fresh = C.cut_repeats(spark, single, SF).cache()
    want = brute.cover([(r.doc_id, r.text) for r in single.collect()])
    texts = {i: r.text for i, r in read(single).items()}
    got = read(fresh)
    assert fresh.columns == docs.columns
    assert set(got) == {i for i, (n, gone, _, _) in want.items() if gone < n or not n}
    assert all(r.text == (want[i][3] if want[i][1] else texts[i]) and r.n_chars == len(r.text) for i, r in got.items())

    mixed = C.mix_sources(spark, fresh, SF).cache()
    cells: dict = {}
    cell = {r.doc_id: ((r.source, r.lang, r.topic), r.tokens, r.selected) for r in mixing.mix(fresh, mixing.document_margins()).collect()}
    for k, tokens, _ in cell.values():
        cells[k] = cells.get(k, 0) + tokens
    total, targets = sum(cells.values()), []
    for m in range(3):
        share: dict = {}
        for k, x in cells.items():
            share[k[m]] = share.get(k[m], 0) + x / total
        powered = {k: v**mixing.TEMPER for k, v in share.items()}
        targets.append({k: v / sum(powered.values()) for k, v in powered.items()})
    fitted = brute.rake(cells, targets, mixing.ROUNDS)
    probability = brute.kept(cells, fitted, mixing.KEEP)
    chosen = set()
    for i, (k, _, _) in cell.items():
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2**32
        if u < probability[k]:
            chosen.add(i)
    assert set(read(mixed)) == chosen and 0 < len(chosen) < len(got) and mixed.columns == docs.columns

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    done = read(C.tokenize(spark, mixed, SF))
    assert set(done) == chosen
    assert all(list(r.ids) == library.encode(got[i].text, add_special_tokens=False).ids for i, r in done.items())
    assert read(C.run(spark, SF)).keys() == chosen


def test_near_copies_of_a_large_group_stay_in_their_tasks(spark, monkeypatch):
    import random

    import corpus_pipeline as C
    from sortkit.llm import jaccard

    r, base, rows = random.Random(6), [f"w{i}" for i in range(400)], []
    for k in range(1, 160):
        text = base[:]
        for at in r.sample(range(400), 6):
            text[at] = f"x{k}"
        rows.append((k, " ".join(text), "en", "web", 0))
    rows += [(1000, " ".join(base), "en", "web", 0), (2000, "quite another text of seven words", "en", "web", 0)]
    seen, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, nodes: (seen.append(pairs.distinct().count()), verify(pairs, nodes))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in C.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, (_, c) in brute.jaccard([x[:2] for x in rows]).items() if c == i} == {1, 2000}
    assert sum(seen) <= 20 * len(rows), seen
