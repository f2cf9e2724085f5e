"""Resolve, reads, runs, store and streaming, against a dictionary."""

import os
import random
import signal
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.functions.keys import long_key, long_of_key, text_key
from tidemark.operators import measures, reads
from tidemark.operators.resolve import live, merge, resolve, valid_prefix, versions
from tidemark.plans import manifest as M
from tidemark.plans.lock import Locked
from tidemark.schema import OPS
from tidemark.sources import oplog
from tidemark.store import Options, Store, StoreFailed
from tidemark.streaming.ingest import ingest, live_view


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), v is None, s) for k, v, s in rows], OPS)


def pairs(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


def model(rows):
    out = {}
    for k, v, _ in sorted(rows, key=lambda r: r[2]):
        out[k] = v
    return {k: v for k, v in out.items() if v is not None}


def random_ops(n, seed=0):
    r = random.Random(seed)
    return [(b"k%03d" % r.randrange(80), None if r.random() < 0.3 else r.randbytes(r.randrange(5)), i) for i in range(n)]


def test_resolve_matches_model_and_keeps_tombstones(spark):
    ops = random_ops(600)
    df = frame(spark, ops)
    assert pairs(resolve(df)) == model(ops)
    kept = resolve(df, keep_tombstones=True)
    assert kept.count() == len({k for k, _, _ in ops})
    assert pairs(live(kept)) == model(ops)
    assert resolve(frame(spark, [])).count() == 0


def test_empty_key_empty_value_and_byte_order(spark):
    keys = [b"", b"\x00", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    df = frame(spark, [(k, b"", i) for i, k in enumerate(reversed(keys))])
    assert [bytes(r["key"]) for r in reads.scan(df).collect()] == keys
    assert [bytes(r["value"]) for r in reads.get(df, b"").collect()] == [b""]


@pytest.mark.parametrize("low, high", [(None, None), (b"k010", None), (None, b"k050"), (b"k010", b"k050"), (b"k020", b"k020")])
def test_scan_bounds(spark, low, high):
    ops = random_ops(400, 3)
    got = [bytes(r["key"]) for r in reads.scan(frame(spark, ops), low, high).collect()]
    assert got == sorted(k for k in model(ops) if (low is None or k >= low) and (high is None or k < high))


def test_bad_bounds_and_keys(spark):
    df = frame(spark, [(b"a", b"1", 1)])
    with pytest.raises(ValueError):
        reads.scan(df, b"b", b"a")
    with pytest.raises(TypeError):
        reads.get(df, None)
    with pytest.raises(TypeError):
        reads.get(df, "a")


def test_range_reaches_parquet_and_single_shuffle_merge(spark, tmp_path):
    frame(spark, random_ops(100)).write.parquet(str(tmp_path / "r"))
    df = spark.read.schema(OPS).parquet(str(tmp_path / "r"))
    plan = reads.scan(df, b"k010", b"k020")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    merged = merge([df, df], keep_tombstones=True)._jdf.queryExecution().executedPlan().toString()
    assert merged.count("Exchange") == 1


def test_multi_get(spark):
    ops = random_ops(300, 5)
    asked = [b"k%03d" % i for i in range(0, 120, 3)]
    keys = spark.createDataFrame([(bytearray(k),) for k in [*asked, *asked]] + [(None,)], "key binary")
    want = {k: v for k, v in model(ops).items() if k in asked}
    assert pairs(reads.multi_get(frame(spark, ops), keys)) == want
    assert {bytes(r["key"]) for r in reads.multi_get_missing(frame(spark, ops), keys).collect()} == set(asked) - set(want)


def test_partial_merge_must_keep_tombstones(spark):
    ops = random_ops(400, 7)
    runs = [resolve(frame(spark, [o for o in ops if i * 100 <= o[2] < (i + 1) * 100]), keep_tombstones=True) for i in range(4)]
    kept = merge(runs[2:], keep_tombstones=True)
    assert pairs(resolve(kept.unionByName(runs[0]).unionByName(runs[1]))) == model(ops)
    lost = merge(runs[2:], keep_tombstones=False)
    assert pairs(resolve(lost.unionByName(runs[0]).unionByName(runs[1]))) != model(ops)
    assert pairs(live(merge(runs, keep_tombstones=False))) == model(ops)


def test_versions_snapshot_compare_measures(spark):
    ops = random_ops(200, 9)
    df = frame(spark, ops)
    assert versions(df, 2).groupBy("key").count().agg(F.max("count")).first()[0] == 2
    assert pairs(reads.snapshot(df, 99)) == model(ops[:100])
    assert reads.compare(resolve(df), resolve(df)).count() == 0
    assert reads.compare(reads.snapshot(df, 99), resolve(df)).count() > 0
    assert measures.write_stats(df).first()["writes"] == 200
    assert measures.space_amplification(frame(spark, []), resolve(frame(spark, []))).first()["space_amp"] is None


def test_valid_prefix(spark):
    log = spark.createDataFrame([("a", i, i != 5) for i in range(9)] + [("b", i, True) for i in range(3)], "segment string, position int, valid boolean")
    got = valid_prefix(log).groupBy("segment").count().collect()
    assert {r["segment"]: r["count"] for r in got} == {"a": 5, "b": 3}


def test_long_keys_order_as_numbers(spark):
    numbers = [-(1 << 63), -5, -1, 0, 1, 77, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", long_key(F.col("n")).alias("key"))
    assert [r["n"] for r in df.orderBy("key").collect()] == numbers
    assert all(r["n"] == r["back"] for r in df.select("n", long_of_key(F.col("key")).alias("back")).collect())


def test_bloom_never_rules_out_what_it_holds(spark):
    keys = spark.range(3000).select(text_key(F.col("id") * 2, 16).alias("key"))
    s = bloom.shape(3000, 10)
    filter_ = bloom.build(keys, s)
    assert bloom.maybe_present(keys, filter_, s).count() == 3000
    absent = spark.range(3000).select(text_key(F.col("id") * 2 + 1, 16).alias("key"))
    assert bloom.maybe_present(absent, filter_, s).count() < 90


SMALL = Options(memtable_bytes=4096, compaction_min_runs=3)


def test_store_against_a_dictionary(spark, tmp_path):
    r, want, path = random.Random(11), {}, str(tmp_path / "store")
    store = Store.open(spark, path, SMALL)
    for step in range(260):
        x, key = r.random(), b"k%03d" % r.randrange(120)
        if x < 0.68:
            want[key] = r.randbytes(r.randrange(40))
            store.put(key, want[key])
        elif x < 0.9:
            want.pop(key, None)
            store.delete(key)
        elif x < 0.93:
            assert store.get(key) == want.get(key)
        elif x < 0.95:
            low, high = sorted((key, b"k%03d" % r.randrange(120)))
            with store.scan(low, high) as rows:
                assert list(rows) == sorted((k, v) for k, v in want.items() if low <= k < high)
        elif x < 0.965:
            store.flush()
        elif x < 0.98:
            store.close()
            store = Store.open(spark, path, SMALL)
        elif x < 0.99:
            store.compact_all()
        else:
            assert store.get(b"absent") is None
    assert dict(store.scan()) == want
    store.close()
    with Store.open(spark, path, SMALL) as again:
        assert dict(again.scan()) == want
        again.compact_all()
        assert len(again.runs) <= 1 and dict(again.scan()) == want


def test_bulk_writes_runs_and_stats(spark, tmp_path):
    ops = random_ops(500, 13)
    with Store.open(spark, str(tmp_path / "s"), Options(auto_compaction=False)) as store:
        for i in range(5):
            store.write(frame(spark, ops[i * 100 : (i + 1) * 100]), order_by="seq")
        assert pairs(store.read()) == model(ops) and len(store.runs) == 5
        store.compact_all()
        stats = store.stats()
        assert stats["runs"] == 1 and stats["compactions"] == 1 and stats["run_rows"] == len(model(ops))
        assert sorted(os.listdir(tmp_path / "s" / "runs")) == [os.path.basename(store.runs[0].path)]
        with pytest.raises(Exception, match="comes twice"):
            store.write(frame(spark, [(b"a", b"1", 1), (b"a", b"2", 2)]))
        with pytest.raises(Exception, match="null"):
            store.write(spark.createDataFrame([(None, bytearray(b"1"))], "key binary, value binary"))
        assert pairs(store.read()) == model(ops)
        store.write(frame(spark, [(k, None, 1) for k in model(ops)]), order_by="seq")
        store.compact_all()
        assert store.runs == ()  # only deletes were left


def test_auto_compaction_merges_alike_neighbours(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), Options(compaction_min_runs=3)) as store:
        for i in range(3):
            store.write(frame(spark, [(b"%d-%d" % (i, j), b"v" * 20, j) for j in range(50)]), order_by="seq")
        store.await_compactions()
        assert len(store.runs) == 1 and store.read().count() == 150 and store.stats()["compactions"] == 1


def test_scan_keeps_its_runs_and_close(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), Options(auto_compaction=False))
    for i in range(3):
        store.write(frame(spark, [(b"%d" % i, b"v", 1)]))
    rows = store.scan()
    store.compact_all()
    assert [k for k, _ in rows] == [b"0", b"1", b"2"]
    assert store._leases == {}  # a scan that has ended holds nothing
    rows.close()
    rows.close()
    assert list(rows) == []
    assert len(os.listdir(tmp_path / "s" / "runs")) == 1
    store.close()
    store.close()
    with pytest.raises(RuntimeError):
        store.put(b"a", b"b")


def test_one_owner_and_options(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    with pytest.raises(Locked):
        Store.open(spark, str(tmp_path / "s"))
    store.close()
    with pytest.raises(ValueError):
        Options(compaction_min_runs=1)


def test_recovery_drops_what_was_not_committed(spark, tmp_path):
    path = tmp_path / "s"
    store = Store.open(spark, str(path))
    store.put(b"a", b"1")
    store.flush()
    store.put(b"b", b"2")
    store.close()
    (path / "runs" / "000099").mkdir()
    (path / "runs" / "000099" / "x").write_text("not committed")
    log = next(p for p in path.iterdir() if p.suffix == ".log")
    log.write_bytes(log.read_bytes() + oplog.frame(b"c", b"3")[:-1])
    (path / "MANIFEST.json.tmp").write_text("half")
    with Store.open(spark, str(path)) as again:
        assert dict(again.scan()) == {b"a": b"1", b"b": b"2"}
        assert not (path / "runs" / "000099").exists() and again.stats()["runs"] == 2
        again.put(b"d", b"4")
    raw = (path / M.NAME).read_bytes()
    (path / M.NAME).write_bytes(raw[:-3])
    with pytest.raises(M.CorruptManifest):
        Store.open(spark, str(path))
    (path / M.NAME).write_bytes(raw)
    with Store.open(spark, str(path)) as again:
        assert dict(again.scan()) == {b"a": b"1", b"b": b"2", b"d": b"4"}


def test_failed_commit_stops_writes_but_not_reads(spark, tmp_path, monkeypatch):
    store = Store.open(spark, str(tmp_path / "s"))
    store.write(frame(spark, [(b"a", b"1", 1)]))
    monkeypatch.setattr(M, "save", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        store.write(frame(spark, [(b"b", b"1", 1)]))
    monkeypatch.undo()
    with pytest.raises(StoreFailed):
        store.put(b"c", b"1")
    assert store.get(b"a") == b"1" and store.get(b"b") is None
    store.close()


def test_damaged_run_is_noticed(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    store.write(frame(spark, [(b"%05d" % i, os.urandom(50), i) for i in range(2000)]))
    run = store.runs[0].path
    name = next(n for n in os.listdir(run) if n.endswith(".parquet"))
    for n in os.listdir(run):
        if n.endswith(".crc"):
            os.remove(os.path.join(run, n))
    with open(os.path.join(run, name), "r+b") as f:
        f.seek(20_000)
        b = f.read(1)
        f.seek(20_000)
        f.write(bytes([b[0] ^ 0x10]))
    with pytest.raises(Exception):
        store.read().collect()
    store.close()


def test_streaming_batches_take_effect_once(spark, tmp_path):
    ops = random_ops(300, 17)
    for i in range(3):
        frame(spark, ops[i * 100 : (i + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with Store.open(spark, str(tmp_path / "s")) as store:
        ingest(stream, store, str(tmp_path / "c"), "seq", "once", available_now=True).awaitTermination()
        got = pairs(store.read())
        assert got == model(ops)
        assert store.write(frame(spark, [(b"late", b"x", 1)]), order_by="seq", stream=("once", 0)) is None
        assert pairs(store.read()) == got
    started = live_view(spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live_now").outputMode("complete").trigger(availableNow=True).start()
    started.awaitTermination()
    assert {bytes(r["key"]): bytes(r["value"]) for r in spark.table("live_now").where("not is_delete").collect()} == model(ops)


def test_log_data_source(spark, tmp_path):
    oplog.register(spark)
    ops = random_ops(50, 19)
    frame(spark, ops).coalesce(1).select("key", "value", "is_delete").write.format(oplog.FORMAT).mode("append").save(str(tmp_path / "log"))
    log = spark.read.format(oplog.FORMAT).load(str(tmp_path / "log"))
    rows = log.orderBy("segment", "position").collect()
    assert [(bytes(r["key"]), None if r["is_delete"] else bytes(r["value"])) for r in rows] == [(k, v) for k, v, _ in ops]
    file = next((tmp_path / "log").glob("*.log"))
    file.write_bytes(file.read_bytes()[:-1])
    assert spark.read.format(oplog.FORMAT).load(str(tmp_path / "log")).count() == 49


def test_bloom_filters_spare_row_groups(spark, tmp_path):
    """A read of an absent key inside a run's range reads no rows with filters, and some without."""
    read = {}
    for bits in (0, 10):
        with Store.open(spark, str(tmp_path / f"s{bits}"), Options(bloom_bits_per_key=bits, row_group_bytes=1 << 16)) as store:
            store.write(spark.range(20_000).select(text_key(F.col("id") * 2, 16).alias("key"), F.encode(F.sha2(F.col("id").cast("string"), 256), "UTF-8").alias("value")))
            df = spark.read.schema(OPS).parquet(store.runs[0].path).where(F.col("key") == F.lit(b"%016d" % 9_001))
            assert df.collect() == []
            scans, todo = [], [df._jdf.queryExecution().executedPlan()]
            df._jdf.queryExecution().toRdd().count()
            while todo:
                p = todo.pop()
                if "Scan" in p.nodeName():
                    scans.append(p)
                todo += [p.children().apply(i) for i in range(p.children().size())]
            read[bits] = scans[0].metrics().apply("numOutputRows").value()
            assert store.get(b"%016d" % 9_001) is None and store.get(b"%016d" % 9_000) is not None
    assert read[10] == 0 < read[0]


def test_bulk_write_takes_nothing_that_would_be_lost(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), g, o) for k, v, g, o in rows], "key binary, value binary, is_delete boolean, at long")
    with Store.open(spark, str(tmp_path / "s")) as store:
        for rows, why in (([(b"a", b"1", False, None)], "null at"), ([(b"a", b"1", None, 1)], "null is_delete"), ([(b"a", b"1", False, 5), (b"a", b"2", False, 5)], "differ")):
            with pytest.raises(Exception, match=why):
                store.write(made(*rows), order_by="at")
        store.write(made((b"a", b"1", False, 5), (b"a", b"2", False, 6), (b"b", None, True, 5), (b"c", b"", False, 1), (b"c", b"", False, 1)), order_by="at")
        assert pairs(store.read()) == {b"a": b"2", b"c": b""}


def test_puts_before_and_after_a_bulk_write(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), Options(auto_compaction=False)) as store:
        store.put(b"a", b"old")
        store.put(b"b", b"old")
        store.write(frame(spark, [(b"a", b"bulk", 1)]))
        assert store.get(b"a") == b"bulk" and store.get(b"b") == b"old"
        store.put(b"a", b"new")
        assert store.get(b"a") == b"new" and pairs(store.read()) == {b"a": b"new", b"b": b"old"}
        store.flush()
        assert store.get(b"a") == b"new" and store.stats()["runs"] == 3
        store.compact_all()
        assert pairs(store.read()) == {b"a": b"new", b"b": b"old"}
        assert store.get(b"zz") is None and store.get(b"aa") is None and store.stats()["bloom_negatives"] >= 1


def test_snapshot_outlives_a_merge(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), Options(auto_compaction=False)) as store:
        store.write(frame(spark, [(b"a", b"1", 1), (b"b", b"1", 1)]))
        store.put(b"b", b"2")
        with store.snapshot() as then:
            read = then.read()
            store.put(b"c", b"3")
            store.delete(b"a")
            store.flush()
            store.compact_all()
            assert pairs(read) == pairs(then.read()) == {b"a": b"1", b"b": b"2"}
            assert pairs(then.scan(b"b")) == {b"b": b"2"}
        assert pairs(store.read()) == {b"b": b"2", b"c": b"3"}
        assert len(os.listdir(tmp_path / "s" / "runs")) == 1


def test_reads_and_puts_go_on_during_a_merge(spark, tmp_path, monkeypatch):
    from tidemark import store as module

    entered, leave, real = threading.Event(), threading.Event(), module.merge

    def slow(*args, **how):
        entered.set()
        assert leave.wait(60)
        return real(*args, **how)

    with Store.open(spark, str(tmp_path / "s"), Options(auto_compaction=False)) as store:
        for i in range(3):
            store.write(frame(spark, [(b"k", b"%d" % i, 1)]))
        monkeypatch.setattr(module, "merge", slow)
        merging = threading.Thread(target=store.compact_all)
        merging.start()
        assert entered.wait(60)
        store.put(b"x", b"1")
        assert store.get(b"k") == b"2" and store.get(b"x") == b"1" and pairs(store.read()) == {b"k": b"2", b"x": b"1"}
        store.flush()
        store.write(frame(spark, [(b"k", b"newer", 1)]))
        assert merging.is_alive()
        leave.set()
        merging.join()
        assert pairs(store.read()) == {b"k": b"newer", b"x": b"1"} and len(store.runs) == 3


def test_failed_merge_is_told(spark, tmp_path, monkeypatch):
    from tidemark import store as module

    store = Store.open(spark, str(tmp_path / "s"), Options(compaction_min_runs=2, auto_compaction=False))
    for i in range(2):
        store.write(frame(spark, [(b"k", b"%d" % i, 1)]))
    monkeypatch.setattr(module, "merge", lambda *_, **__: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.compact_all()
    store.put(b"still", b"there")  # the caller's failure alone
    store.close()
    with Store.open(spark, str(tmp_path / "s"), Options(compaction_min_runs=2)) as again:
        again.await_compactions()
        with pytest.raises(StoreFailed):
            again.put(b"a", b"1")
        assert again.get(b"k") == b"1" and again.get(b"still") == b"there"


def test_many_threads_on_one_store(spark, tmp_path):
    """Writers of their own keys, readers who must never see a key go back, and flushes and merges at once."""
    with Store.open(spark, str(tmp_path / "s"), Options(memtable_bytes=4_000, compaction_min_runs=2, sync_writes=False)) as store:
        stop, wrong, writers = threading.Event(), [], 6

        def write(t):
            for i in range(400):
                store.put(b"w%d-%02d" % (t, i % 20), b"%06d" % i)

        def read(seed):
            r, seen = random.Random(seed), {}
            while not stop.is_set():
                key = b"w%d-%02d" % (r.randrange(writers), r.randrange(20))
                got = store.get(key)
                if got is not None and got < seen.get(key, b""):
                    wrong.append((key, seen[key], got))
                seen[key] = max(seen.get(key, b""), got or b"")

        def scan():
            while not stop.is_set():
                with store.scan() as rows:
                    keys = [k for k, _ in rows]
                if keys != sorted(set(keys)):
                    wrong.append("order")

        pool = [threading.Thread(target=write, args=(t,)) for t in range(writers)]
        others = [threading.Thread(target=read, args=(i,)) for i in range(2)] + [threading.Thread(target=scan)]
        for t in pool + others:
            t.start()
        for t in pool:
            t.join()
        stop.set()
        for t in others:
            t.join()
        store.flush()
        store.await_compactions()
        assert not wrong
        assert dict(store.scan()) == {b"w%d-%02d" % (t, k): b"%06d" % (380 + k) for t in range(writers) for k in range(20)}
        stats = store.stats()
        assert stats["writes"] == 400 * writers and stats["flushes"] >= 1 and stats["compactions"] >= 1


CRASHING = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tidemark.store import Options, Store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
store = Store.open(spark, sys.argv[2], Options(memtable_bytes=3_000, compaction_min_runs=2))
n = int(sys.argv[3])
print("open", flush=True)
while True:
    key = b"k%03d" % (n % 97)
    if n % 7 == 3:
        store.delete(key)
    else:
        store.put(key, b"%08d" % n)
    print(n, flush=True)
    n += 1
"""


def test_killed_writers_lose_nothing_acknowledged(spark, tmp_path):
    """A process that writes, flushes and merges is killed several times; each time all it had acknowledged is there."""
    root, path, n = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), str(tmp_path / "s"), 0
    for i in range(3):
        child = subprocess.Popen([sys.executable, "-c", CRASHING, root, path, str(n)], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True)
        assert child.stdout.readline() == "open\n"
        timer = threading.Timer(1.5 + 1.3 * i, lambda child=child: os.killpg(child.pid, signal.SIGKILL))
        timer.start()
        acked = [int(x) for x in child.stdout if x.endswith("\n")]
        child.wait()
        n = acked[-1] + 1
    want = {}
    for i in range(n):
        want[b"k%03d" % (i % 97)] = None if i % 7 == 3 else b"%08d" % i
    with Store.open(spark, path) as store:
        got = dict(store.scan())
        next_ = b"k%03d" % (n % 97)  # the write that was under way may be there or not
        for key in set(want) | set(got):
            if key != next_:
                assert got.get(key) == want.get(key)


def test_two_appends_to_a_log_folder_stay(spark, tmp_path):
    oplog.register(spark)
    path = str(tmp_path / "log")
    for i in range(3):
        frame(spark, [(b"k%d" % i, b"v", 1), (b"same", b"%d" % i, 2)]).coalesce(1).select("key", "value", "is_delete").write.format(oplog.FORMAT).mode("append").save(path)
    rows = spark.read.format(oplog.FORMAT).load(path).orderBy("segment", "position").collect()
    assert [bytes(r["key"]) for r in rows] == [b"k0", b"same", b"k1", b"same", b"k2", b"same"]
    assert [bytes(r["value"]) for r in rows if r["key"] == b"same"] == [b"0", b"1", b"2"]
    frame(spark, [(b"z", None, 1)]).select("key", "value", "is_delete").write.format(oplog.FORMAT).mode("overwrite").save(path)
    assert [(bytes(r["key"]), r["is_delete"]) for r in spark.read.format(oplog.FORMAT).load(path).collect()] == [(b"z", True)]
    with pytest.raises(Exception, match="null"):
        spark.createDataFrame([(None, None, True)], "key binary, value binary, is_delete boolean").write.format(oplog.FORMAT).mode("append").save(path)
    assert spark.read.format(oplog.FORMAT).load(path).count() == 1


def test_scan_ranges(spark):
    ops = random_ops(600, 23)
    r, bounds = random.Random(24), []
    for i in range(40):
        low, high = sorted((b"k%03d" % r.randrange(90), b"k%03d" % r.randrange(90)))
        bounds.append((i, low, high))
    bounds += [(40, None, b"k010"), (41, b"k075", None), (42, None, None), (43, b"k020", b"k020")]
    table = spark.createDataFrame([(i, None if a is None else bytearray(a), None if b is None else bytearray(b)) for i, a, b in bounds], "range_id int, low binary, high binary")
    want = {(i, k) for i, a, b in bounds for k in model(ops) if (a is None or k >= a) and (b is None or k < b)}
    for most in (1, 4, 1000):
        got = [(x["range_id"], bytes(x["key"])) for x in reads.scan_ranges(frame(spark, ops), table, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert reads.scan_ranges(frame(spark, ops), table.limit(0)).count() == 0
