"""Files, manifests, logs, streams, shuffles and the map-reduce API."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sortkit.operators import aggregate as A
from sortkit.operators import permute as P
from sortkit.operators import traces as T
from sortkit.operators import validate as V
from sortkit.operators.exchange import range_partition
from sortkit.plans import mapreduce as M
from sortkit.plans.config import GB, SortJob
from sortkit.sources import logs, manifest, records
from sortkit.streaming import progressive as S


def test_fixed_records_round_trip(spark, tmp_path):
    data = b"".join(bytes([i]) * 100 for i in (3, 1, 2))
    (tmp_path / "a.bin").write_bytes(data)
    rows = records.read_records(spark, str(tmp_path / "a.bin")).collect()
    assert sorted(bytes(r.header) + bytes(r.body) for r in rows) == sorted(data[i : i + 100] for i in (0, 100, 200))
    (tmp_path / "b.bin").write_bytes(data[:150])
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "b.bin")).collect()


def test_generator_follows_from_offset(spark):
    a = {r.id: bytes(r.header) for r in records.generated(spark, 0, 100, 3).collect()}
    b = {r.id: bytes(r.header) for r in records.generated(spark, 50, 100, 7).collect()}
    assert all(a[i] == b[i] for i in range(50, 100)) and len(a) == len(b) == 100
    one = records.generated(spark, 0, 640, 3, skewed=True)
    assert {(len(r.header), len(r.body)) for r in one.collect()} == {(10, 90)}
    assert one.groupBy(F.substring("header", 1, 6)).count().agg(F.max("count")).first()[0] >= 300


def test_generate_sort_write_validate(spark, tmp_path):
    df = records.generated(spark, 0, 2000, 4)
    done = range_partition(df, "header", 5)
    m = records.write_ranges(done, str(tmp_path / "out"))
    rows = m.collect()
    assert sum(r.n_rows for r in rows) == 2000 and sum(r["size"] for r in rows) == 200_000
    manifest.write_manifest(m, str(tmp_path / "manifest"))
    back = {r.part_id: r for r in manifest.read_manifest(spark, str(tmp_path / "manifest")).collect()}
    assert set(back) == {0, 1, 2, 3, 4} and back[0].node == "" and back[0]["size"] == next(r["size"] for r in rows if r.part_id == 0)
    want: dict = {}
    for r in done.collect():
        text = f"{bytes(r.header).hex().upper()}|{bytes(r.body).hex().upper()}"
        want[r.part_id] = want.get(r.part_id, 0) + int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    assert {i: int(r.checksum, 16) for i, r in back.items()} == want and max(want.values()) >= 1 << 63
    assert V.validate_sort(df, done, "header", "part_id", F.octet_length("body"), "id").first().ok
    parts = records.generate_parts(spark, 1050, 100, 3).orderBy("offset").collect()
    assert [p.n for p in parts] == [100] * 10 + [50] and {p.w for p in parts} == {0, 1, 2}
    assert manifest.synthetic_manifest(spark, 3, 7).agg(F.sum("size")).first()[0] == 21


def test_file_sizes(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.bin"))
    good = spark.createDataFrame([(str(tmp_path / "x.bin"), 3), (str(tmp_path / "y.bin"), 1)], "path string, size long")
    assert {r["size"]: r.ok for r in V.check_file_sizes(files, good).collect()} == {3: True, 1: False}


def test_logs(spark, tmp_path):
    (tmp_path / "views.txt").write_text('en.m Main_"Page 5 100\nde x 2 7\n')
    rows = logs.page_views(spark, str(tmp_path / "views.txt")).collect()
    assert [(r.language, r.title, r.requests) for r in rows] == [("en.m", 'Main_"Page', 5), ("de", "x", 2)]
    assert len(logs.hourly_files("p-{year}{month:02}{day:02}-{hour:02}")) == 2232
    (tmp_path / "io-10.0.0.1-77.log").write_text('{"object_refs": ["a"], "size": 1048576, "duration": 2.0, "time": 5}\nnot json\n')
    got = logs.io_log(spark, str(tmp_path / "io-10.0.0.1-77.log")).collect()
    assert [(r.object_refs, r.worker) for r in got] == [(["a"], "10.0.0.1:77")]
    (tmp_path / "trace.json").write_text(json.dumps([{"cat": "span", "name": "map", "pid": "1", "tid": "2", "ts": 1, "dur": 2, "ph": "X"}]))
    assert logs.trace_events(spark, str(tmp_path / "trace.json")).first().name == "map"
    (tmp_path / "c.csv").write_text("run,epoch,time,accuracy\na,1,2.5,0.5\n")
    assert logs.training_curve(spark, str(tmp_path / "c.csv")).first().accuracy == 0.5
    logs.write_table(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_progressive_rounds(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 3).alias("key"))
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = S.rounds(spark, str(tmp_path / "in"), "key string", 2).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shots = S.run_rounds(stream, str(tmp_path / "run"), S.json_proportions(str(tmp_path / "run"), "key", "n"))
    totals = [r.t for r in shots.groupBy("round").agg(F.sum("n").alias("t")).orderBy("round").collect()]
    assert len(totals) == 3 and totals == sorted(totals) and totals[-1] == 1000
    err = {r["round"]: r.divergence for r in S.accuracy(shots, "key").collect()}
    assert abs(err[2]) < 1e-6 and all(e > -1e-6 for e in err.values())
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "run/proportions")).collect()]
    assert all(abs(sum(x.values()) - 1) < 1e-9 for x in lines) and len(lines) == 3


def test_shuffles_are_permutations(spark):
    df = spark.range(1000)
    got = [r.id for r in P.full_shuffle(df, 4, 1, "id").collect()]
    assert sorted(got) == list(range(1000)) and got != list(range(1000)) and got == [r.id for r in P.full_shuffle(df, 4, 1, "id").collect()]
    rows = P.windowed_shuffle(df, F.floor(F.col("id") / 10), 20, 3, 5, "id").collect()
    assert [r.batch for r in rows] == sorted(r.batch for r in rows)
    assert sorted(r.id for r in rows if r.batch == 1) == list(range(200, 400))
    assert sum(1 for _ in P.deliver(df)) == 1000


@pytest.mark.parametrize("mode", list(M.Mode))
def test_mapreduce_equals_aggregate(spark, mode):
    df = spark.createDataFrame([("a b a",), ("B c",), (None,), ("",), ("  ",)], "text string")
    want = {(r.word, r.n) for r in A.word_count(df).collect()}
    seen = []
    got = M.word_count(4, mode=mode).run(df, df.limit(0), publish=lambda d, s: seen.append(d.count()))
    assert {(r.word, r.n) for r in got.collect()} == want == {("a", 2), ("b", 2), ("c", 1)}
    assert (len(seen) == 2) == (mode is M.Mode.PROGRESSIVE)


def test_edge_cases_of_traces(spark):
    none = spark.createDataFrame([], "t double")
    assert T.hopping_counts(none, "t", 1.0, 0.5).count() == 0
    one = spark.createDataFrame([(5.0,)], "t double")
    assert [(r.k, r.n) for r in T.hopping_counts(one, "t", 1.0, 0.5).orderBy("k").collect()] == [(0, 1), (1, 1), (2, 1)]
    spans = spark.createDataFrame([(0.0, 10.0, 1.0), (5.0, 5.0, 9.0)], "b double, e double, w double")
    points = spark.createDataFrame([(0.0,), (10.0,), (4.0,)], "t double")
    assert {r.t: r.n for r in T.concurrency(points, spans, "t", "b", "e", "w", 3.0).collect()} == {0.0: 1, 10.0: 0, 4.0: 1}
    assert A.span_summary(spans, "b", "w").count() == 2 and A.describe(spans.limit(0), "w").first().n == 0


def test_job_sizes():
    j = SortJob(int(0.512 * GB), 2_000_000, 4_000_000, workers=3, cpus=8, merge_factor=2)
    assert (j.num_mappers, j.num_reducers, j.reducers_per_worker, j.map_parallelism, j.num_rounds, j.mergers_per_worker) == (256, 128, 43, 8, 11, 44)


def test_trace_files_hold_one_array_each(spark, tmp_path):
    """However rows are dealt to files, each file is one array and no event is lost."""
    from sortkit.file_queries import trace_file
    from sortkit.queries import ORACLE_SQL
    from tests.oracle import both

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _, _, mine, theirs = both(spark, trace_file, ORACLE_SQL["trace_file"], "/root/testdata/sf0.01")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert mine == theirs
    spans = spark.range(100).selectExpr("id / 8 as time", "0.5D as duration", "concat('a\"\\n,', id % 3) as event", "'é' as address", "string(null) as pid")
    logs.write_trace_events(T.chrome_events(spans), str(tmp_path / "many"), 7)
    files = [json.loads(f.read_text()) for f in (tmp_path / "many").glob("part-*")]
    assert len(files) == 15 and sum(map(len, files)) == 100
    back = logs.trace_events(spark, str(tmp_path / "many"))
    assert sorted(r.ts for r in back.collect()) == [i * 125_000 for i in range(100)]
    assert back.where("name = 'a\"\\n,1' and tid is null and dur = 500000").count() == 33
    logs.write_trace_events(T.chrome_events(spans.limit(0)), str(tmp_path / "none"))
    assert logs.trace_events(spark, str(tmp_path / "none")).count() == 0
