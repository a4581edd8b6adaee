"""Registered queries of the core operators, and equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortkit.functions import divergence as D
from sortkit.functions import keys as K
from sortkit.operators import aggregate as A
from sortkit.operators import bounds as B
from sortkit.operators import exchange as X
from sortkit.operators import permute as P
from sortkit.operators import traces as T
from sortkit.operators import validate as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(spark: SparkSession) -> int:
    """Ranges that a query uses: as many as the session has shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", K.md5_header("o_orderkey").alias("header"))


def seconds(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


#: SQL pieces: the header of orders in hex, and its partition key.
_HEX = "substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 20)"
_KEY = "('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT"
_MAX = K.MAX_KEY
_SECONDS = "epoch_us(ts) / 1000000.0::DOUBLE"
_WORDS = "(SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents)"


# ---- sort and ranges


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_HEX}, o_orderkey) AS rank FROM orders")
def sort_global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: every order's place in the global order of headers."""
    return X.global_rank(order_headers(spark, sf_dir), ["header", "o_orderkey"], parts_of(spark)).select("o_orderkey", "rank")


@query(f"""
WITH k AS (SELECT {_HEX} AS h, least({_KEY} // {_MAX // 16}, 15)::INT AS part_id, o_orderkey, o_totalprice FROM orders),
s AS (SELECT part_id, count(*) AS n_rows, min(h) AS first_key, max(h) AS last_key, 0::BIGINT AS n_inversions FROM k GROUP BY part_id)
SELECT s.*, coalesce(first_key >= lag(last_key) OVER (ORDER BY part_id), true) AS follows FROM s
""")
def sort_ranges_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in 16 uniform ranges, sorted, and what a validator sees of them."""
    done = X.range_partition(order_headers(spark, sf_dir), "header", 16)
    return hexed(V.cross_check(V.partition_summaries(done, "header", "part_id")))


def hexed(summaries: DataFrame) -> DataFrame:
    return summaries.withColumns({c: F.lower(F.hex(c)) for c in ("first_key", "last_key")})


@query(f"SELECT o_orderkey, least({_KEY} // {_MAX // 16}, 15)::INT AS part_id FROM orders")
def range_partition_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, X1, X6."""
    return X.range_partition(order_headers(spark, sf_dir), "header", 16, sort=False).select("o_orderkey", "part_id")


@query(f"""
SELECT coarse, fine, count(*) AS n_rows, min(k)::VARCHAR AS min_key, max(k)::VARCHAR AS max_key
FROM (SELECT {_KEY} AS k, least({_KEY} // {_MAX // 20}, 19)::INT AS fine, fine // 5 AS coarse FROM orders) GROUP BY coarse, fine
""")
def range_partition_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 coarse ranges of ceil(18 / 4) fine ones."""
    edges = [e for row in B.two_level_edges(4, 18) for e in row]
    df = order_headers(spark, sf_dir).withColumn("fine", B.edge_id("header", edges)).withColumn("k", K.key_number("header"))
    out = df.groupBy(F.floor(F.col("fine") / 5).cast("int").alias("coarse"), "fine").agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("a"), F.max("k").alias("b"))
    return out.select("coarse", "fine", "n_rows", F.col("a").cast("string").alias("min_key"), F.col("b").cast("string").alias("max_key"))


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) AS e FROM lineitem)
SELECT unnest(range(0, 9)) AS i, round(unnest(e), 4) AS edge FROM q
""")
def range_bounds_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quantile edges of prices."""
    e = X.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [i / 8 for i in range(9)], n=parts_of(spark))
    return e.select((F.col("q") * 8).cast("long").alias("i"), F.round("value", 4).alias("edge"))


@query(f"""
WITH r AS (SELECT {_KEY} AS k, row_number() OVER (ORDER BY {_KEY}) AS rank, count(*) OVER () AS m FROM orders),
q AS (SELECT unnest(range(0, 7)) AS i)
SELECT q.i, r.k::VARCHAR AS edge FROM q, r WHERE r.rank = round_even((r.m - 1) * q.i / 7.0, 0)::BIGINT + 1
""")
def range_bounds_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 over all keys: the order statistic nearest to each quantile; a count gives the ranks wanted."""
    df = order_headers(spark, sf_dir)
    m = df.count()
    index = {i: round((m - 1) * i / 7) + 1 for i in range(7)} if m else {}
    found = X.order_statistics(df, ["header"], sorted(set(index.values())), parts_of(spark))
    wanted = spark.createDataFrame([(i, r) for i, r in index.items()], "i long, rank long")
    return wanted.join(F.broadcast(found), "rank").select("i", K.key_number("header").cast("string").alias("edge"))


@query(f"""
SELECT side, count(*) AS n_rows, min(h) AS min_key, max(h) AS max_key FROM (
  SELECT {_HEX} AS h, CASE WHEN {_HEX} < '80000000000000000000' THEN 'below' ELSE 'rest' END AS side FROM orders) GROUP BY side
""")
def split_at_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12."""
    low, high = X.split_at(order_headers(spark, sf_dir), "header", bytes([0x80] + [0] * 9))
    both = low.withColumn("side", F.lit("below")).unionByName(high.withColumn("side", F.lit("rest")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.lower(F.hex(F.min("header"))).alias("min_key"), F.lower(F.hex(F.max("header"))).alias("max_key"))


@query("""
WITH m AS (SELECT median(o_totalprice) AS p FROM orders)
SELECT CASE WHEN o_totalprice < p THEN 'below' ELSE 'rest' END AS side, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders, m GROUP BY 1
""")
def split_at_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12 with the median as pivot."""
    df = table(spark, sf_dir, "orders")
    pivot = X.quantiles(df, "o_totalprice", [0.5], n=parts_of(spark)).select(F.col("value").alias("p"))
    side = F.when(F.col("o_totalprice") < F.col("p"), "below").otherwise("rest").alias("side")
    return df.crossJoin(F.broadcast(pivot)).groupBy(side).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---- validation


@query("""
WITH p AS (SELECT substr(md5(concat_ws('|', l_returnflag, l_suppkey)), 1, 20) AS h FROM lineitem),
k AS (SELECT h, CASE WHEN h < '40' THEN 0 WHEN h < '80' THEN 1 WHEN h < 'c0' THEN 2 ELSE 3 END AS part_id FROM p),
s AS (SELECT part_id, count(*) AS n_rows, min(h) AS first_key, max(h) AS last_key, 0::BIGINT AS n_inversions FROM k GROUP BY part_id)
SELECT s.*, coalesce(first_key >= lag(last_key) OVER (ORDER BY part_id), true) AS follows FROM s
""")
def partition_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2 on few and skewed keys, with edges given by hand."""
    df = table(spark, sf_dir, "lineitem").select(K.md5_header(F.concat_ws("|", "l_returnflag", "l_suppkey")).alias("header"))
    done = X.range_partition(df, "header", 4, [i << 62 for i in range(4)])
    return hexed(V.cross_check(V.partition_summaries(done, "header", "part_id")))


_FINGER = "('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)), 1, 15))::BIGINT"


@query(f"""
SELECT count(*) AS n_rows_in, count(*) AS n_rows_out, (sum(length(o_orderpriority)))::BIGINT AS n_bytes_in, n_bytes_in AS n_bytes_out,
       sum({_FINGER})::VARCHAR AS checksum_in, checksum_in AS checksum_out, true AS ok FROM orders
""")
def conservation_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes and checksum before and after a sort by ranges."""
    df = table(spark, sf_dir, "orders").withColumn("header", K.md5_header("o_orderkey"))
    done = X.range_partition(df, "header", 8)
    one = lambda x: V.conservation(x, F.octet_length("o_orderpriority"), "o_orderkey", "o_custkey", "o_orderstatus")
    return V.compare(one(df), one(done)).withColumns({f"checksum_{s}": F.col(f"checksum_{s}").cast("string") for s in ("in", "out")})


@query("""
SELECT part_id, lower(lpad(hex(part_id), 10, '0')) AS part_hex, count(*) AS n_rows, sum(length(l_returnflag) + length(l_linestatus))::BIGINT AS size
FROM (SELECT *, ((l_suppkey % 4) << 32) + ((l_partkey % 3) << 16) + l_linenumber AS part_id FROM lineitem) GROUP BY part_id
""")
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a manifest by packed part id."""
    df = table(spark, sf_dir, "lineitem").withColumn("part_id", K.part_id(F.col("l_suppkey") % 4, F.col("l_partkey") % 3, "l_linenumber"))
    size = F.octet_length("l_returnflag") + F.octet_length("l_linestatus")
    out = df.groupBy("part_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("size"))
    return out.select("part_id", K.part_hex("part_id").alias("part_hex"), "n_rows", "size")


@query("SELECT id, substr(md5(CAST(id AS VARCHAR)), 1, 20) AS header FROM (SELECT unnest(range(100, 1100)) AS id)")
def generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records 100 to 1,099 of the endless sequence."""
    from sortkit.sources.records import generated

    return generated(spark, 100, 1000, 8).select("id", K.decode_hex("header").alias("header"))


# ---- keyed aggregation and top-k


@query(f"SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, A1, A4."""
    return A.word_count(table(spark, sf_dir, "documents"))


@query(f"SELECT row_number() OVER (ORDER BY n DESC, word) AS rank, word, n FROM (SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 20)")
def word_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, O3."""
    return A.ranked(A.top_k(A.word_count(table(spark, sf_dir, "documents")), "n", "word", 20), "n", "word").select("rank", "word", "n")


@query(f"""
WITH c AS (SELECT word, count(*) AS n, ascii(word) % 8 AS bucket FROM {_WORDS} WHERE word <> '' GROUP BY word)
SELECT bucket::INT AS bucket, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 20
""")
def topk_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent words of each of 8 reducers."""
    return A.top_k_by_bucket(A.word_count(table(spark, sf_dir, "documents")), K.first_char_bucket("word", 8), "n", "word", 20)


@query(f"""
SELECT (ascii(word) % 8)::INT AS bucket, sum(n)::BIGINT AS n_words, count(*) AS n_distinct
FROM (SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word) GROUP BY 1
""")
def bucket_by_first_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, X14."""
    return A.words_by_bucket(table(spark, sf_dir, "documents"), 8)


@query("SELECT split_part(event_type, '_', 1) AS key, sum(event_id % 7)::BIGINT AS total FROM events GROUP BY 1 HAVING sum(event_id % 7) > 0")
def prefix_group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the prefix of a name."""
    return A.sum_by(table(spark, sf_dir, "events"), K.prefix("event_type", "_"), F.col("event_id") % 7)


@query("""
SELECT split_part(regexp_extract(url, '^\\w+://([^/]+)', 1), '.', 1) AS key, sum(length(html))::BIGINT AS total FROM pages GROUP BY 1 HAVING sum(length(html)) > 0
""")
def page_views_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, A2-A4, P10 on web pages."""
    host = F.regexp_extract("url", r"^\w+://([^/]+)", 1)
    return A.sum_by(table(spark, sf_dir, "pages"), K.prefix(host), F.length("html"))


@query("SELECT event_type AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    return A.shares(A.count_by(table(spark, sf_dir, "events"), "event_type")).withColumn("share", F.round("share", 9))


@query(f"""
WITH t AS (SELECT row_number() OVER (ORDER BY n DESC, word) AS rank, word FROM (SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word)),
truth AS (SELECT * FROM (VALUES (1, 'the'), (2, 'of'), (3, 'and'), (4, 'to'), (5, 'in')) v(rank, word))
SELECT coalesce(min(CASE WHEN t.word <> truth.word THEN rank END) - 1, count(*))::BIGINT AS n_correct FROM t JOIN truth USING (rank)
""")
def top_words_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading ranks that agree with a list."""
    top = A.ranked(A.top_k(A.word_count(table(spark, sf_dir, "documents")), "n", "word", 20), "n", "word")
    truth = spark.createDataFrame(list(enumerate(["the", "of", "and", "to", "in"], 1)), "rank long, word string")
    return D.truth_prefix(top, truth, "rank", "word")


@query("""
WITH s AS (SELECT r.round, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 4)) AS round) r WHERE event_id % 4 <= r.round GROUP BY ALL),
p AS (SELECT round, event_type, n / sum(n) OVER (PARTITION BY round) AS x FROM s)
SELECT p.round, round(sum(p.x * ln(p.x / (coalesce(f.x, 0) + 1e-9) + 1e-9)), 9) AS divergence
FROM p LEFT JOIN (SELECT * FROM p WHERE round = 3) f ON p.event_type = f.event_type GROUP BY p.round
""")
def snapshot_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the counts after 1 to 4 of 4 rounds are from the last."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.sequence((F.col("event_id") % 4).cast("int"), F.lit(3))).alias("round"))
    counted = e.groupBy("round", "event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("round").agg(F.sum("n").alias("t"))
    share = counted.join(total, "round").select("round", "event_type", (F.col("n") / F.col("t")).alias("share"))
    return D.snapshot_divergence(share, "round", "event_type", "share", 3).select(F.col("round").cast("long").alias("round"), F.round("divergence", 9).alias("divergence"))


# ---- traces


@query("""
SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, max(value) AS max, min(value) AS min, count(value) AS n
FROM events GROUP BY event_type
""")
def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    out = A.span_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("median", "mean", "std")})


@query("""
SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events
""")
def describe_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return A.describe(table(spark, sf_dir, "events"), "value").withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query(f"SELECT min({_SECONDS}) AS first_start, round(max({_SECONDS} + value), 6) AS last_end, max(value) AS peak FROM events")
def trace_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    df = table(spark, sf_dir, "events").select(seconds("ts").alias("start"), (seconds("ts") + F.col("value")).alias("end"), "value")
    return A.extremes(df, "start", "end", "value").withColumn("last_end", F.round("last_end", 6))


@query("SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 21 ELSE floor(value / 10.0)::BIGINT + 1 END::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return A.histogram(table(spark, sf_dir, "events"), "value", 0, 200, 20)


@query("SELECT event_type, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END)::BIGINT AS value, count(*) AS n_changes FROM events GROUP BY 1")
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return A.counters(table(spark, sf_dir, "events"), "event_type", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))


@query("SELECT (l_suppkey % 16)::INT AS part, count(*) AS n FROM lineitem GROUP BY 1")
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return A.balance(table(spark, sf_dir, "lineitem"), (F.col("l_suppkey") % 16).cast("int"))


@query(f"SELECT event_id, round(row_number() OVER (ORDER BY {_SECONDS} + value, event_id) * 100.0 / count(*) OVER (), 9) AS pct FROM events")
def completion_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    df = table(spark, sf_dir, "events").select((seconds("ts") + F.col("value")).alias("end"), "event_id")
    return T.completion_curve(df, "end", ["event_id"], parts_of(spark)).select("event_id", F.round("pct", 9).alias("pct"))


@query(f"""
WITH t AS (SELECT {_SECONDS} AS t FROM events), e AS (SELECT min(t) AS lo, max(t) AS hi FROM t),
k AS (SELECT unnest(range(0, (floor((hi - lo + 86400) / 3600) + 1)::BIGINT)) AS k, lo FROM e)
SELECT k.k, count(t.t) AS n FROM k LEFT JOIN t ON t.t >= k.lo - 86400 + k.k * 3600 AND t.t <= k.lo + k.k * 3600 GROUP BY k.k
""")
def hopping_rps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in closed windows of a day, every hour."""
    return T.hopping_counts(table(spark, sf_dir, "events").select(seconds("ts").alias("t")), "t", 86400.0, 3600.0)


@query(f"""
WITH i AS (SELECT {_SECONDS} AS b, {_SECONDS} + value * 60 AS e, value AS w FROM events),
p AS (SELECT DISTINCT floor({_SECONDS} / 600) * 600 AS t FROM events)
SELECT p.t, count(i.b) AS n, round(coalesce(sum(i.w), 0), 6) AS total FROM p LEFT JOIN i ON i.b <= p.t AND p.t < i.e GROUP BY p.t
""")
def interval_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running intervals at sampled times."""
    e = table(spark, sf_dir, "events").select(seconds("ts").alias("b"), (seconds("ts") + F.col("value") * 60).alias("e"), F.col("value").alias("w"))
    points = e.select((F.floor(F.col("b") / 600) * 600).cast("double").alias("t")).distinct()
    return T.concurrency(points, e, "t", "b", "e", "w", 3600.0).withColumn("total", F.round("total", 6))


@query(f"SELECT event_id, round({_SECONDS} - lag({_SECONDS}) OVER (ORDER BY ts, event_id), 6) AS gap FROM events")
def event_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    r = X.global_rank(table(spark, sf_dir, "events").select("event_id", "ts", seconds("ts").alias("t")), ["ts", "event_id"], parts_of(spark))
    return X.with_previous(r, "t").select("event_id", F.round(F.col("t") - F.col("previous"), 6).alias("gap"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) WHERE (r - 1) % 10 = 0")
def every_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return T.every_nth(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 10, parts_of(spark)).select("event_id")


@query(f"SELECT event_id, round({_SECONDS} - min({_SECONDS}) OVER (), 6) AS t FROM events WHERE event_type IN ('click', 'view')")
def relative_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P13."""
    e = T.events_of(table(spark, sf_dir, "events"), "event_type", "click", "view").select("event_id", seconds("ts").alias("s"))
    return T.relative_time(e, "s").select("event_id", F.round("t", 6).alias("t"))


@query("""
SELECT event_id, coalesce(CASE WHEN user_id % 5 < 3 THEN 'group' || (user_id % 5) END, CAST(user_id AS VARCHAR)) || ',' ||
       coalesce(CASE WHEN event_id % 5 < 3 AND event_id < 1000000 AND event_id IN (SELECT user_id FROM events) THEN 'group' || (event_id % 5) END, CAST(event_id AS VARCHAR)) AS refs FROM events
""")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array elements through a dimension, or themselves."""
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct().where("user_id % 5 < 3").select(F.col("user_id").cast("string").alias("k"), F.concat(F.lit("group"), F.col("user_id") % 5).alias("v"))
    refs = e.select("event_id", F.array(F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("refs"))
    return T.lookup_elements(refs, "refs", "event_id", users, "k", "v").select("event_id", F.array_join("refs", ",").alias("refs"))


@query(f"""
WITH e AS (SELECT event_type, {_SECONDS} AS b, {_SECONDS} + value AS e FROM events), x AS (SELECT min(b) AS lo, max(e) AS hi FROM e)
SELECT event_type, round(e - lo, 6) AS t, round(row_number() OVER (PARTITION BY event_type ORDER BY e) * 100.0 / count(*) OVER (PARTITION BY event_type), 9) AS pct FROM e, x
UNION ALL SELECT DISTINCT event_type, 0.000001::DOUBLE, 0.0 FROM e UNION ALL SELECT DISTINCT event_type, round(hi - lo, 6), 100.0 FROM e, x
""")
def completion_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, U1 with the first and last points."""
    e = table(spark, sf_dir, "events").select("event_type", seconds("ts").alias("b"), (seconds("ts") + F.col("value")).alias("e"))
    return T.series_curves(e, "event_type", "b", "e", parts_of(spark)).select("event_type", F.round("t", 6).alias("t"), F.round("pct", 9).alias("pct"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return T.key_union(a, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("""
SELECT event_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS key, epoch_us(make_timestamp(event_id * 1000000)) AS at_us,
       round(value / 2.0 / 1048576, 12) AS speed, (value * 1000000)::BIGINT AS micros
FROM (SELECT event_id, value, md5(CAST(event_id AS VARCHAR)) AS h FROM events)
""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P7, P8, P11."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", K.key_number_little_endian(K.md5_header("event_id"), 4).cast("long").alias("key"), F.unix_micros(K.epoch_time("event_id")).alias("at_us"),
        F.round(K.mib_per_second("value", F.lit(2.0)), 12).alias("speed"), F.round(F.col("value") * 1_000_000).cast("long").alias("micros"),
    )


@query("""
SELECT split_part(event_type || '.' || (event_id % 3), '.', 1) AS key, sum(event_id)::BIGINT AS total FROM events GROUP BY 1
""")
def page_views_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page-view file is written, read and summed by prefix."""
    from sortkit.sources.logs import page_views
    from sortkit.streaming.progressive import shared_folder

    folder = shared_folder(spark)
    e = table(spark, sf_dir, "events")
    e.select(F.concat_ws(" ", F.concat_ws(".", "event_type", F.col("event_id") % 3), F.lit('Main_"Page'), "event_id", F.lit(1))).write.text(folder)
    return A.sum_by(page_views(spark, folder), K.prefix("language"), "requests")


@query("""
SELECT l_suppkey AS part_id, '' AS node, 'part-' || l_suppkey AS path, count(*) AS size FROM lineitem GROUP BY ALL
""")
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest is written and read; absent fields are empty."""
    from sortkit.sources.manifest import read_manifest, write_manifest
    from sortkit.streaming.progressive import shared_folder

    folder = shared_folder(spark)
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("part_id")).agg(F.count(F.lit(1)).alias("size"))
    write_manifest(parts.withColumn("path", F.concat(F.lit("part-"), "part_id")), folder)
    return read_manifest(spark, folder).select("part_id", "node", "path", "size")


@query(f"SELECT id, substr(md5(CAST(id AS VARCHAR)), 1, 20) AS header, least(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 16))::UBIGINT // {_MAX // 8}, 7)::INT AS part_id FROM (SELECT unnest(range(0, 5000)) AS id)")
def sorted_records_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are generated, sorted by ranges, written and read back."""
    from sortkit.sources.records import generated, write_ranges
    from sortkit.streaming.progressive import shared_folder

    folder = shared_folder(spark)
    write_ranges(X.range_partition(generated(spark, 0, 5000, 8), "header", 8), folder)
    return spark.read.parquet(folder).select("id", K.decode_hex("header").alias("header"), "part_id")


# ---- random shuffles, streaming, opaque functions


def _shuffled(df: DataFrame) -> DataFrame:
    ids = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return V.conservation(df, F.octet_length("l_returnflag"), *ids).withColumn("checksum", F.col("checksum").cast("string"))


_LINES = "('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 15))::BIGINT"


@query(f"SELECT count(*) AS n_rows, sum(length(l_returnflag))::BIGINT AS n_bytes, sum({_LINES})::VARCHAR AS checksum FROM lineitem")
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is lost or doubled by a full shuffle."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return _shuffled(P.full_shuffle(df, parts_of(spark), 42, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))


@query(f"""
SELECT (l_orderkey // 100 // 10)::BIGINT AS batch, count(*) AS n_rows, sum({_LINES})::VARCHAR AS checksum FROM lineitem GROUP BY 1
""")
def windowed_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 blocks of 100 orders keep their rows."""
    ids = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    done = P.windowed_shuffle(table(spark, sf_dir, "lineitem").select(*ids), F.floor(F.col("l_orderkey") / 100), 10, parts_of(spark), 42, *ids)
    return done.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(K.fingerprint(*ids).cast("decimal(38,0)")).cast("string").alias("checksum"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def progressive_topk_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer after the last of 5 rounds."""
    from sortkit.streaming import progressive as S

    folder = S.shared_folder(spark)
    table(spark, sf_dir, "events").select("event_id", "event_type").repartition(10).write.parquet(f"{folder}/input")
    snapshots = S.progressive_counts(spark, f"{folder}/input", "event_id long, event_type string", "event_type", 2, folder)
    last = snapshots.agg(F.max("round").alias("round"))
    return A.top_k(snapshots.join(F.broadcast(last), "round").select("event_type", "n"), "n", "event_type", 3)


@query(f"SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 20")
def mapreduce_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count and top-k by opaque functions."""
    from sortkit.plans.mapreduce import word_count as job

    return job(8, k=20).run(table(spark, sf_dir, "documents").select("text"))


from sortkit import file_queries  # noqa: E402, F401  registers its queries
