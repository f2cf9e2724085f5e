"""Every operator as a query over the test tables, with DuckDB SQL for the same rows.

The log is `events`: one key per user, event_id as the order, `error` events as deletes, props as values. Columns are
text or numbers, never raw bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.functions.keys import key_text, long_key, long_of_key, text_key
from tidemark.operators import measures, reads
from tidemark.operators.resolve import live, merge, resolve, valid_prefix, versions
from tidemark.plans import manifest as manifests
from tidemark.schema import OPS
from tidemark.sources import oplog
from tidemark.sources.files import filesystem, names
from tidemark.sources.runs import is_folder
from tidemark.sources.scratch import scratch_dir
from tidemark.store import Options, Store
from tidemark.streaming.ingest import ingest, live_view

QUERIES = {}
ORACLES: dict[str, str] = {}

_OPS = "ops AS (SELECT lpad(CAST(user_id AS VARCHAR), 16, '0') AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_type = 'error' AS is_delete, event_id AS seq FROM events)"
_WON = f"WITH {_OPS}, won AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
_LIVE = f"{_WON}, live AS (SELECT key, value FROM won WHERE NOT is_delete)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_ops(events: DataFrame) -> DataFrame:
    gone = F.col("event_type") == "error"
    return events.select(text_key(F.col("user_id"), 16).alias("key"), F.when(~gone, F.encode("props", "UTF-8")).alias("value"), gone.alias("is_delete"), F.col("event_id").alias("seq"))


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_ops(_read(spark, sf_dir, "events"))


def _text(df: DataFrame) -> DataFrame:
    """Keys and values as text."""
    return df.select(*[key_text(F.col(c)).alias(c) if c in ("key", "value") else F.col(c) for c in df.columns])


def _quarters(ops: DataFrame, last: int | None = None) -> list[DataFrame]:
    """Four runs by age, newest first, each with one row per key; of operations up to last, if it is given."""
    bounds = ops.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    low, width = bounds["a"] or 0, max(1, -(-((bounds["b"] or 0) - (bounds["a"] or 0) + 1) // 4))
    ops = ops if last is None else ops.where(F.col("seq") <= last)
    return [resolve(ops.where((F.col("seq") >= low + i * width) & (F.col("seq") < low + (i + 1) * width)), keep_tombstones=True) for i in (3, 2, 1, 0)]


@query(f"{_LIVE} SELECT key, value FROM live")
def latest_wins_live(spark, sf_dir):
    return _text(resolve(event_ops(spark, sf_dir)))


@query(f"{_WON} SELECT key, value, is_delete, seq FROM won")
def latest_with_tombstones(spark, sf_dir):
    return _text(resolve(event_ops(spark, sf_dir), keep_tombstones=True))


@query(f"{_WON} SELECT key, seq FROM won WHERE is_delete")
def tombstone_keys(spark, sf_dir):
    return _text(resolve(event_ops(spark, sf_dir), keep_tombstones=True).where("is_delete").select("key", "seq"))


def _lookup(ops: DataFrame, key: bytes | None) -> DataFrame:
    """The key asked for, whether it is live, and its value."""
    spark = ops.sparkSession
    asked = spark.range(1).select(F.lit(bytes(key) if key is not None else None).cast("binary").alias("asked"))
    found = reads.get(ops, bytes(key or b""))
    return asked.join(found, asked["asked"] == found["key"], "left").select(key_text(F.col("asked")).alias("key"), F.col("key").isNotNull().alias("found"), key_text(F.col("value")).alias("value"))


@query(f"{_LIVE} SELECT key, true AS found, value FROM live WHERE key = (SELECT min(key) FROM live)")
def get_hit(spark, sf_dir):
    ops = event_ops(spark, sf_dir)
    return _lookup(ops, resolve(ops).agg(F.min("key")).first()[0])


@query("SELECT 'no such key' AS key, false AS found, CAST(NULL AS VARCHAR) AS value")
def get_miss(spark, sf_dir):
    return _lookup(event_ops(spark, sf_dir), b"no such key")


@query(f"{_WON} SELECT min(key) AS key, false AS found, CAST(NULL AS VARCHAR) AS value FROM won WHERE is_delete")
def get_deleted(spark, sf_dir):
    ops = event_ops(spark, sf_dir)
    return _lookup(ops, resolve(ops, keep_tombstones=True).where("is_delete").agg(F.min("key")).first()[0])


def _customers(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(text_key(F.col("c_custkey"), 16).alias("key"))


@query(f"{_LIVE} SELECT key, value FROM live WHERE key IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') FROM customer)")
def multi_get(spark, sf_dir):
    return _text(reads.multi_get(event_ops(spark, sf_dir), _customers(spark, sf_dir)))


@query(f"{_LIVE} SELECT key FROM (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS key FROM customer) WHERE key NOT IN (SELECT key FROM live)")
def multi_get_missing(spark, sf_dir):
    return _text(reads.multi_get_missing(event_ops(spark, sf_dir), _customers(spark, sf_dir)))


_A, _B = b"0000000000000040", b"0000000000000085"


@query(f"{_LIVE} SELECT key, value FROM live WHERE key >= '{_A.decode()}' AND key < '{_B.decode()}' ORDER BY key")
def scan_bounded(spark, sf_dir):
    return _text(reads.scan(event_ops(spark, sf_dir), _A, _B))


@query(f"{_LIVE} SELECT key, value FROM live WHERE key >= '{_A.decode()}' ORDER BY key")
def scan_from(spark, sf_dir):
    return _text(reads.scan(event_ops(spark, sf_dir), _A, None))


@query(f"{_LIVE} SELECT key, value FROM live WHERE key < '{_B.decode()}' ORDER BY key")
def scan_to(spark, sf_dir):
    return _text(reads.scan(event_ops(spark, sf_dir), None, _B))


@query(f"{_LIVE} SELECT key, value FROM live ORDER BY key")
def scan_all(spark, sf_dir):
    return _text(reads.scan(event_ops(spark, sf_dir)))


@query(f"{_LIVE} SELECT key, value FROM live WHERE false")
def scan_empty(spark, sf_dir):
    return _text(reads.scan(event_ops(spark, sf_dir), _A, _A))


@query(f"{_LIVE} SELECT key, value FROM live ORDER BY key LIMIT 100")
def scan_limit(spark, sf_dir):
    return _text(reads.scan(event_ops(spark, sf_dir), limit=100))


@query(f"{_LIVE} SELECT key, value FROM live WHERE starts_with(key, '00000000000001') ORDER BY key")
def prefix_scan(spark, sf_dir):
    return _text(reads.prefix_scan(event_ops(spark, sf_dir), b"00000000000001"))


@query(f"{_WON} SELECT key, value, is_delete, seq FROM won")
def merge_runs(spark, sf_dir):
    return _text(merge(_quarters(event_ops(spark, sf_dir)), keep_tombstones=True))


_SPAN = "span AS (SELECT min(seq) AS low, greatest(1, CAST(ceil((max(seq) - min(seq) + 1) / 4.0) AS BIGINT)) AS width FROM ops)"


@query(f"WITH {_OPS}, {_SPAN} SELECT key, value, is_delete, seq FROM ops, span WHERE seq >= low + 2 * width QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def compact_partial_keep(spark, sf_dir):
    """The two newest runs become one; their deletes stay, for older runs are not merged."""
    return _text(merge(_quarters(event_ops(spark, sf_dir))[:2], keep_tombstones=True))


@query(f"{_WON} SELECT key, value, is_delete, seq FROM won WHERE NOT is_delete")
def compact_full_drop(spark, sf_dir):
    return _text(merge(_quarters(event_ops(spark, sf_dir)), keep_tombstones=False))


@query(f"{_LIVE} SELECT key, value FROM live")
def read_after_compaction(spark, sf_dir):
    """Runs 0 and 1 merged, then read together with the rest."""
    quarters = _quarters(event_ops(spark, sf_dir))
    return _text(resolve(merge(quarters[:2], keep_tombstones=True).unionByName(quarters[2]).unionByName(quarters[3])))


@query(f"WITH {_OPS}, half AS (SELECT max(seq) // 2 AS n FROM ops), won AS (SELECT key, value, is_delete FROM ops, half WHERE seq <= n QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value FROM won WHERE NOT is_delete")
def snapshot_prefix(spark, sf_dir):
    ops = event_ops(spark, sf_dir)
    return _text(reads.snapshot(ops, (ops.agg(F.max("seq")).first()[0] or 0) // 2))


_BROKEN = 977


@query(f"""
WITH {_OPS}, log AS (SELECT *, seq // 1000 AS segment, seq % {_BROKEN} <> {_BROKEN - 1} AS valid FROM ops),
bad AS (SELECT segment, min(seq) AS bad FROM log WHERE NOT valid GROUP BY segment),
good AS (SELECT key, value, is_delete, seq FROM log LEFT JOIN bad USING (segment) WHERE bad IS NULL OR seq < bad),
won AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT key, value FROM won WHERE NOT is_delete""")
def torn_log_replay(spark, sf_dir):
    """Segments of a thousand records, some of which have a record that fails its check."""
    log = event_ops(spark, sf_dir).withColumn("segment", F.expr("seq div 1000")).withColumn("valid", F.col("seq") % _BROKEN != _BROKEN - 1)
    return _text(resolve(valid_prefix(log, position="seq").select("key", "value", "is_delete", "seq")))


@query(f"{_WON} SELECT CAST(coalesce(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) + 64), 0) AS BIGINT) AS memtable_bytes FROM won")
def memtable_bytes(spark, sf_dir):
    return measures.memtable_bytes(resolve(event_ops(spark, sf_dir), keep_tombstones=True))


@query(f"WITH {_OPS} SELECT count(*) AS writes, count(*) FILTER (is_delete) AS deletes, count(*) FILTER (NOT is_delete) AS puts, count(DISTINCT key) AS keys FROM ops")
def write_stats(spark, sf_dir):
    return measures.write_stats(event_ops(spark, sf_dir))


@query(f"""{_LIVE}, a AS (SELECT CAST(coalesce(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)), 0) AS BIGINT) AS stored_bytes FROM ops),
b AS (SELECT CAST(coalesce(sum(octet_length(encode(key)) + octet_length(encode(value))), 0) AS BIGINT) AS live_bytes FROM live)
SELECT stored_bytes, live_bytes, CASE WHEN live_bytes > 0 THEN round(stored_bytes / live_bytes, 6) END AS space_amp FROM a, b""")
def space_amp(spark, sf_dir):
    ops = event_ops(spark, sf_dir)
    return measures.space_amplification(ops, resolve(ops))


@query("SELECT hex(substring(CAST(user_id AS VARCHAR), 1, 1)) AS first_byte, min(CAST(user_id AS VARCHAR)) AS low, max(CAST(user_id AS VARCHAR)) AS high, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def bytewise_key_order(spark, sf_dir):
    """Least and greatest keys of mixed widths, per first byte: '10' before '9'."""
    keys = _read(spark, sf_dir, "events").select(text_key(F.col("user_id")).alias("key"))
    return keys.groupBy(F.hex(F.substring("key", 1, 1)).alias("first_byte")).agg(key_text(F.min("key")).alias("low"), key_text(F.max("key")).alias("high"), F.count_distinct("key").alias("keys"))


@query("SELECT event_type, CAST(min(CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END) AS BIGINT) AS low, CAST(max(CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END) AS BIGINT) AS high FROM events GROUP BY 1")
def long_key_order(spark, sf_dir):
    """Extremes of signed numbers found on their encoded keys and decoded again."""
    n = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id"))
    keys = _read(spark, sf_dir, "events").select("event_type", long_key(n).alias("key"))
    return keys.groupBy("event_type").agg(long_of_key(F.min("key")).alias("low"), long_of_key(F.max("key")).alias("high"))


_PASSES = 5


@query(f"SELECT lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS key, o_orderpriority || '{_PASSES}' AS value FROM orders")
def overwrite_passes(spark, sf_dir):
    """Every order written five times; the last pass stays."""
    orders = _read(spark, sf_dir, "orders").select("*", F.explode(F.sequence(F.lit(1), F.lit(_PASSES))).alias("pass"))
    ops = orders.select(text_key(F.col("o_orderkey"), 16).alias("key"), F.encode(F.concat("o_orderpriority", F.col("pass").cast("string")), "UTF-8").alias("value"), F.lit(False).alias("is_delete"), (F.col("pass").cast("long") * 10**9 + F.col("o_orderkey")).alias("seq"))
    return _text(resolve(ops))


@query(f"{_WON} SELECT key, seq, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS version FROM ops QUALIFY version <= 3")
def newest_versions(spark, sf_dir):
    return _text(versions(event_ops(spark, sf_dir), 3).select("key", "seq", "version"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def nearest_rank(spark, sf_dir):
    return measures.nearest_rank(_read(spark, sf_dir, "events").groupBy("event_type"), "value", {"p50": 0.5, "p99": 0.99})


@query(f"""{_WON}, old AS (SELECT key, value, is_delete FROM ops, (SELECT max(seq) // 2 AS n FROM ops) WHERE seq <= n QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
a AS (SELECT key, value FROM old WHERE NOT is_delete), b AS (SELECT key, value FROM won WHERE NOT is_delete)
(SELECT key, value, 'expected' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT key, value, 'actual' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def compare_snapshots(spark, sf_dir):
    """What changed between the middle of the log and its end."""
    ops = event_ops(spark, sf_dir)
    return _text(reads.compare(reads.snapshot(ops, (ops.agg(F.max("seq")).first()[0] or 0) // 2), resolve(ops)))


@query("SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS absent_keys, true AS in_bound FROM orders")
def bloom_fpr(spark, sf_dir):
    """A filter over even keys, probed with the odd ones between them: at ten bits a key it passes fewer than two in a hundred."""
    orders = _read(spark, sf_dir, "orders")
    shape = bloom.shape(orders.count(), 10)
    filter_ = bloom.build(orders.select(text_key(F.col("o_orderkey") * 2, 16).alias("key")), shape)
    absent = orders.select(text_key(F.col("o_orderkey") * 2 + 1, 16).alias("key"))
    maybe = bloom.maybe_present(absent, filter_, shape).agg(F.count("*").alias("false_positives"))
    return absent.agg(F.count_distinct("key").alias("absent_keys")).join(maybe).select("absent_keys", (F.col("false_positives") < 0.02 * F.col("absent_keys")).alias("in_bound"))


@query("SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS present_keys, CAST(0 AS BIGINT) AS ruled_out FROM orders")
def bloom_no_false_negative(spark, sf_dir):
    keys = _read(spark, sf_dir, "orders").select(text_key(F.col("o_orderkey"), 16).alias("key"))
    shape = bloom.shape(keys.count(), 10)
    kept = bloom.maybe_present(keys, bloom.build(keys, shape), shape)
    return keys.agg(F.count_distinct("key").alias("present_keys")).join(keys.distinct().join(kept, "key", "left_anti").agg(F.count("*").alias("ruled_out")))


@query(f"{_LIVE} SELECT key, value FROM live")
def store_lifecycle(spark, sf_dir):
    """Four commits into a store, oldest first, a merge of all of them, a new opening, and a read of its runs."""
    path = scratch_dir(spark, "store")
    with Store.open(spark, path, Options(auto_compaction=False)) as store:
        for quarter in reversed(_quarters(event_ops(spark, sf_dir))):
            store.write(quarter, order_by="seq")
        store.compact_all()
    with Store.open(spark, path) as store:
        return _text(store.read())


_NEWEST = 40
_QUARTERS = f"{_SPAN}, runs AS (SELECT (seq - low) // width AS run, key, seq FROM ops, span WHERE seq <= (SELECT max(seq) FROM ops) - {_NEWEST})"


def _filled(spark, sf_dir, options: Options = Options(auto_compaction=False)) -> Store:
    """An open store of the events: four runs by age, and the newest operations one by one in memory."""
    ops = event_ops(spark, sf_dir)
    last = (ops.agg(F.max("seq")).first()[0] or 0) - _NEWEST
    store = Store.open(spark, scratch_dir(spark, "store"), options)
    for quarter in reversed(_quarters(ops, last)):
        store.write(quarter, order_by="seq")
    for r in ops.where(F.col("seq") > last).orderBy("seq").collect():
        if r["is_delete"]:
            store.delete(bytes(r["key"]))
        else:
            store.put(bytes(r["key"]), bytes(r["value"]))
    return store


_ASKED = "asked AS ((SELECT DISTINCT key FROM ops ORDER BY key LIMIT 6) UNION (SELECT DISTINCT key FROM ops ORDER BY key DESC LIMIT 6) UNION (SELECT key FROM ops ORDER BY seq DESC LIMIT 6) UNION SELECT 'no such key')"


@query(f"{_LIVE}, {_ASKED} SELECT asked.key, live.key IS NOT NULL AS found, value FROM asked LEFT JOIN live ON asked.key = live.key")
def store_get(spark, sf_dir):
    """Single reads over four runs with deletes and a table in memory on top."""
    keys = event_ops(spark, sf_dir).groupBy("key").agg(F.max("seq").alias("seq"))
    asked = {bytes(r["key"]) for f in (keys.orderBy("key"), keys.orderBy(F.desc("key")), keys.orderBy(F.desc("seq"))) for r in f.limit(6).collect()}
    with _filled(spark, sf_dir) as store:
        got = [(k, store.get(k)) for k in (*asked, b"no such key")]
    return spark.createDataFrame([(k.decode(), v is not None, None if v is None else v.decode()) for k, v in got], "key string, found boolean, value string")


@query(f"{_LIVE} SELECT key, value FROM live WHERE key IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') FROM customer)")
def store_multi_get(spark, sf_dir):
    with _filled(spark, sf_dir) as store:
        return _text(store.multi_get(_customers(spark, sf_dir)))


@query(f"{_LIVE} SELECT key, value FROM live WHERE key >= '{_A.decode()}' AND key < '{_B.decode()}'")
def store_scan(spark, sf_dir):
    """Through the iterator, row by row; rows out of order fail."""
    with _filled(spark, sf_dir) as store, store.scan(_A, _B) as rows:
        got = list(rows)
    if got != sorted(got):
        raise RuntimeError("rows out of order")
    return spark.createDataFrame([(k.decode(), v.decode()) for k, v in got], "key string, value string")


@query(f"{_LIVE} SELECT key, value FROM live WHERE starts_with(key, '00000000000001')")
def store_prefix_scan(spark, sf_dir):
    with _filled(spark, sf_dir) as store:
        return _text(reads.prefix_scan(store.ops(), b"00000000000001"))


@query(f"{_LIVE} SELECT key, value FROM live ORDER BY key LIMIT 50")
def store_scan_limit(spark, sf_dir):
    with _filled(spark, sf_dir) as store:
        return _text(store.scan_frame(limit=50))


@query(f"{_LIVE} SELECT key, value FROM live")
def store_flush(spark, sf_dir):
    """What was in memory is read from a fifth run."""
    with _filled(spark, sf_dir) as store:
        store.flush()
        if len(store.runs) != 5:
            raise RuntimeError("not five runs")
        return _text(store.read())


@query(f"{_LIVE} SELECT key, value FROM live")
def store_reopened(spark, sf_dir):
    """Closed without a flush: the next opening takes what was in memory from the log."""
    store = _filled(spark, sf_dir)
    store.close()
    with Store.open(spark, store.path, Options(auto_compaction=False)) as again:
        return _text(again.read())


@query(f"{_LIVE} SELECT key, value FROM live")
def store_auto_merge(spark, sf_dir):
    """Runs merge by themselves as they come; the result is read once no merge is due."""
    with _filled(spark, sf_dir, Options(compaction_min_runs=2)) as store:
        store.flush()
        store.await_compactions()
        if not store.stats()["compactions"]:
            raise RuntimeError("nothing was merged")
        return _text(store.read())


@query(f"{_LIVE} SELECT key, value FROM live")
def store_small_memory(spark, sf_dir):
    """A table in memory of a few entries: the newest operations go through several flushes behind the writer."""
    with _filled(spark, sf_dir, Options(memtable_bytes=1024, auto_compaction=False)) as store:
        store.flush()
        if store.stats()["flushes"] < 2:
            raise RuntimeError("not flushed several times")
        return _text(store.read())


@query(f"{_LIVE} SELECT key, value FROM live WHERE key NOT IN (SELECT key FROM live ORDER BY key LIMIT 20)")
def store_delete(spark, sf_dir):
    with _filled(spark, sf_dir) as store:
        for key in [k for k, _ in store.scan(limit=20)]:
            store.delete(key)
        store.delete(b"never there")
        return _text(store.read())


@query(f"{_LIVE} SELECT key, value FROM live")
def store_snapshot(spark, sf_dir):
    """A snapshot reads what it was made of after later writes and a merge of all runs."""
    store = _filled(spark, sf_dir)
    with store, store.snapshot() as then:
        store.write(event_ops(spark, sf_dir).select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("is_delete")).distinct())
        store.compact_all()
        if store.read().limit(1).count():
            raise RuntimeError("deletes did not take effect")
        return spark.createDataFrame([(r["key"], r["value"]) for r in _text(then.read()).collect()], "key string, value string")


@query(f"WITH {_OPS}, {_QUARTERS}, each AS (SELECT run, count(DISTINCT key) AS n FROM runs GROUP BY run) SELECT CAST(sum(n) + {_NEWEST} AS BIGINT) AS writes, CAST(count(*) AS BIGINT) AS runs, CAST(sum(n) AS BIGINT) AS run_rows, CAST(2 AS BIGINT) AS gets, CAST(0 AS BIGINT) AS flushes, CAST(0 AS BIGINT) AS compactions FROM each")
def store_stats(spark, sf_dir):
    with _filled(spark, sf_dir) as store:
        store.get(b"no such key")
        store.get(_A)
        names = ("writes", "runs", "run_rows", "gets", "flushes", "compactions")
        stats = store.stats()
    return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"WITH {_OPS}, {_QUARTERS} SELECT CAST(3 - run AS INTEGER) AS place, min(key) AS low, max(key) AS high, CAST(count(DISTINCT key) AS BIGINT) AS row_count FROM runs GROUP BY run")
def store_manifest(spark, sf_dir):
    """The manifest as it lies on disk: runs newest first, with their bounds."""
    store = _filled(spark, sf_dir)
    store.close()
    runs = manifests.load(store.control).runs
    return spark.createDataFrame([(i, bytes.fromhex(r.low).decode(), bytes.fromhex(r.high).decode(), r.rows) for i, r in enumerate(runs)], "place int, low string, high string, row_count long")


@query(f"{_LIVE}, ranges AS (SELECT c_custkey AS range_id, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS low, lpad(CAST(c_custkey + 1 + c_custkey % 30 AS VARCHAR), 16, '0') AS high FROM customer) SELECT range_id, key, value FROM ranges JOIN live ON key >= low AND key < high")
def scan_ranges(spark, sf_dir):
    """Many ranges at once, of all customers, over the runs and the memory of a store."""
    key = F.col("c_custkey")
    ranges = _read(spark, sf_dir, "customer").select(key.alias("range_id"), text_key(key, 16).alias("low"), text_key(key + 1 + key % 30, 16).alias("high"))
    with _filled(spark, sf_dir) as store:
        return _text(reads.scan_ranges(store.ops(), ranges))


@query(f"WITH {_OPS}, won AS (SELECT key, value, is_delete FROM ops WHERE seq < (SELECT max(seq) FROM ops) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value FROM won WHERE NOT is_delete")
def torn_log_file(spark, sf_dir):
    """The log as one framed file whose last byte is lost: all records but the last come back."""
    path = scratch_dir(spark, "torn")
    oplog.register(spark)
    event_ops(spark, sf_dir).coalesce(1).sortWithinPartitions("seq").select("key", "value", "is_delete").write.format(oplog.FORMAT).mode("append").save(path)
    files, _ = filesystem(path)
    for file in names(path, oplog.SUFFIX)[-1:]:
        with files.open_input_stream(file) as f:
            data = f.read()
        with files.open_output_stream(file) as f:
            f.write(data[:-1])
    return _text(resolve(_log_ops(spark, path)))


def _log_ops(spark, path: str) -> DataFrame:
    """A log folder as operations; segments order by name, as jobs, tasks and their files do."""
    log = spark.read.format(oplog.FORMAT).load(path)
    n = F.split(F.regexp_replace("segment", "[.]log$", ""), "-")
    return log.select("key", "value", "is_delete", ((n[0].cast("long") * 1000 + n[1].cast("long")) * 1000 + n[2].cast("long")).alias("segment_no"), "position").select("key", "value", "is_delete", (F.col("segment_no") * (1 << 28) + F.col("position")).alias("seq"))


@query(f"{_LIVE} SELECT key, value FROM live")
def oplog_appends(spark, sf_dir):
    """The log appended in four jobs, oldest first; later jobs' segments come after earlier ones."""
    path = scratch_dir(spark, "oplog")
    oplog.register(spark)
    for quarter in reversed(_quarters(event_ops(spark, sf_dir))):
        quarter.coalesce(1).sortWithinPartitions("seq").select("key", "value", "is_delete").write.format(oplog.FORMAT).mode("append").save(path)
    return _text(resolve(_log_ops(spark, path)))


@query(f"{_LIVE} SELECT key, value FROM live")
def live_view_stream(spark, sf_dir):
    """The latest-wins table kept by a streaming aggregate over several micro-batches, as its sink holds it at the end."""
    path = scratch_dir(spark, "view")
    event_ops(spark, sf_dir).repartition(4, "seq").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    name = f"live_view_{path[-8:]}"
    live_view(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _text(spark.table(name).where("not is_delete").select("key", "value"))


@query(f"{_LIVE} SELECT key, value FROM live")
def stream_batches(spark, sf_dir):
    """Four files, a micro-batch and a run each; runs merge as they come, and a batch that comes again is passed over."""
    path = scratch_dir(spark, "batches")
    for quarter in reversed(_quarters(event_ops(spark, sf_dir))):
        quarter.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with Store.open(spark, f"{path}/store", Options(compaction_min_runs=2)) as store:
        ingest(stream, store, f"{path}/checkpoint", order_by="seq", name="batches", available_now=True).awaitTermination()
        if store.write(event_ops(spark, sf_dir).limit(1), order_by="seq", stream=("batches", 3)) is not None:
            raise RuntimeError("a batch was taken twice")
        store.await_compactions()
        return _text(store.read())


@query(f"{_LIVE} SELECT key, value FROM live")
def oplog_source(spark, sf_dir):
    """The log written as framed files by one task in order, and read again through the data source."""
    path = scratch_dir(spark, "oplog")
    oplog.register(spark)
    event_ops(spark, sf_dir).repartitionByRange("seq").sortWithinPartitions("seq").select("key", "value", "is_delete").write.format(oplog.FORMAT).mode("append").save(path)
    return _text(resolve(_log_ops(spark, path)))


@query(f"{_LIVE} SELECT key, value FROM live")
def stream_live(spark, sf_dir):
    """The events streamed into a store, a run for each micro-batch."""
    schema = _read(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if is_folder(spark, f"{sf_dir}/events.parquet"):
        stream = _as_ops(files.parquet(f"{sf_dir}/events.parquet"))
    else:  # a streaming source takes folders only
        stream = _as_ops(files.option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    path = scratch_dir(spark, "stream")
    with Store.open(spark, f"{path}/store") as store:
        started = ingest(stream, store, f"{path}/checkpoint", order_by="seq", name=f"events_{path[-8:]}", available_now=True)
        started.awaitTermination()
        return _text(live(resolve(store.ops(), keep_tombstones=True)))
