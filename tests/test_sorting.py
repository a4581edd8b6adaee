"""Bounds, ranges, order and conservation, with edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sortkit.functions import keys as K
from sortkit.operators import bounds as B
from sortkit.operators import exchange as X
from sortkit.operators import validate as V

SCHEMA = "header binary, body binary"
EDGES = [0, 2**63 - 1, 2**63, 2**64 - 1]


def frame(spark, keys, tail=b"\0\0"):
    return spark.createDataFrame([(bytearray(k.to_bytes(8, "big") + tail), bytearray(90)) for k in keys], SCHEMA)


@pytest.mark.parametrize(
    "samples,n,edges",
    [((0x00, 0x40, 0xC4, 0xFF), 2, [0, 130, 255]), ((0x00, 0x40, 0xC4, 0xFF), 4, [0, 16, 130, 240, 255]), ((1, 2), 2, [0, 1, 255]), ((1, 2), 4, [0, 0, 1, 65, 255])],
)
def test_interpolated_edges(spark, samples, n, edges):
    assert B.interpolated_edges(samples, n) == edges
    assert B.interpolated_edges(spark.createDataFrame([(s,) for s in samples], "value int"), n) == edges


def test_uniform_edges():
    step = (2**64 - 1) // 3
    assert B.uniform_edges(3) == [0, step, 2 * step]
    assert [e for row in B.two_level_edges(4, 18) for e in row] == B.uniform_edges(20)
    with pytest.raises(ValueError):
        B.uniform_edges(0)


def test_nearest_is_half_even():
    assert B.nearest_edges([10, 20, 30, 40, 50, 60], 2) == [10, 30]
    assert B.nearest_edges([1], 3) == [1, 1, 1]


@settings(max_examples=8, deadline=None)
@given(keys=st.lists(st.one_of(st.integers(0, 2**64 - 1), st.sampled_from(EDGES)), max_size=30), n=st.integers(1, 40))
def test_ids_match_arithmetic(spark, keys, n):
    step = (2**64 - 1) // n
    df = frame(spark, keys).select(K.key_number("header").alias("k"), B.uniform_id("header", n).alias("a"), B.edge_id("header", B.uniform_edges(n)).alias("b"))
    for r in df.collect():
        assert r.a == r.b == min(int(r.k) // step, n - 1)


@pytest.mark.parametrize("fills,counts", [([], [0, 0, 0, 0]), ([0], [100, 0, 0, 0]), ([0, 255], [100, 0, 0, 100]), ([0, 0x44, 0x88, 0xCC], [100] * 4)])
def test_blocks_of_one_byte(spark, fills, counts):
    df = spark.createDataFrame([(bytearray([f] * 10), bytearray([f] * 90)) for f in fills for _ in range(100)], SCHEMA)
    done = X.range_partition(df, "header", 4)
    sizes = done.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sizes == counts or (not fills and not sum(sizes))  # Spark plans nothing for an empty table


@pytest.mark.parametrize("keys", [[], [5], [7] * 50, EDGES, list(range(0, 2**64, 2**58)), [*range(100)] * 2])
def test_sort_is_ordered_and_whole(spark, keys):
    df = frame(spark, keys)
    done = X.range_partition(df, "header", 8)
    row = V.validate_sort(df, done, "header", "part_id", F.octet_length("body"), "header").first()
    assert row.n_parts == len({min(k // ((2**64 - 1) // 8), 7) for k in keys})
    assert (row.ok if keys else row.n_inversions is None)
    assert sorted(keys) == [int.from_bytes(r.header[:8], "big") for r in done.orderBy("header").collect()]


def test_last_two_bytes_count(spark):
    df = frame(spark, [9], b"\x02\x00").unionByName(frame(spark, [9], b"\x01\xff"))
    rows = X.range_partition(df, "header", 2).collect()
    assert [bytes(r.header[8:]) for r in rows] == [b"\x01\xff", b"\x02\x00"]


def test_validation_rejects_disorder_loss_and_doubles(spark):
    df = frame(spark, range(0, 2**64, 2**57))
    done = X.range_partition(df, "header", 4).cache()
    shuffled = done.orderBy(F.xxhash64("header"))
    size = F.octet_length("body")
    assert V.validate_sort(df, shuffled, "header", "part_id", size, "header").first().n_inversions > 0
    assert not V.validate_sort(df, done.limit(100), "header", "part_id", size, "header").first().ok
    assert not V.validate_sort(df, done.unionByName(done.limit(1)), "header", "part_id", size, "header").first().ok


def test_global_rank_with_ties(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "a int, b int")
    got = {r.b: r["rank"] for r in X.global_rank(df, ["a", "b"], 5).collect()}
    want = {b: i + 1 for i, (a, b) in enumerate(sorted((i % 3, i) for i in range(100)))}
    assert got == want
    assert X.global_rank(df.limit(0), ["a"], 3).count() == 0


def test_strategies_agree(spark):
    df = frame(spark, [(i * 2654435761) % 2**64 for i in range(500)])
    uniform = [r.header for r in X.range_partition(df, "header", 8).collect()]
    edges = B.edges_for(df, "header", 8, "sampled", 0.5)
    sampled = [r.header for r in X.range_partition(df, "header", 8, edges).collect()]
    assert uniform == sampled == [r.header for r in X.global_sort(df, "header").collect()]
    low, high = X.split_at(df, "header", (2**63).to_bytes(8, "big"))
    assert low.count() + high.count() == 500


def test_keys(spark):
    df = spark.createDataFrame([("",), ("a",), ("é",), ("中",), ("😀x",)], "s string")
    got = [r[0] for r in df.select(K.first_char_bucket("s", 7)).collect()]
    assert got == [0, *(ord(c) % 7 for c in "aé中😀")]
    b = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\x05\x06\x07\x08\x09\x0a"),)], "h binary")
    r = b.select(K.key_number("h").alias("a"), K.key_number_little_endian("h", 2).alias("b"), K.decode_hex("h", True).alias("c")).first()
    assert (int(r.a), int(r.b), r.c) == (0x0102030405060708, 0x0201, "0102030405060708090a")
    one = spark.range(1).select(
        K.part_id(F.lit(3), F.lit(2), F.lit(1)).alias("p"), K.clock_seconds(F.lit("2:05")).alias("s"), K.spilled_mib(F.lit("x Spilled 12 MiB")).alias("m"),
        K.spilled_mib(F.lit("none")).alias("n"), K.prefix(F.lit("en.m")).alias("x"), K.remap(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("z"))).alias("r"),
        K.words(F.lit("  The cat \n THE ")).alias("w"),
    ).first()
    assert one.p == (3 << 32) + (2 << 16) + 1
    assert (one.s, one.m, one.n, one.x, one.r, one.w) == (125, 12, None, "en", ["z", "b"], ["the", "cat", "the"])
