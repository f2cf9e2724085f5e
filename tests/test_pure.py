"""What needs no Spark: policy, keys, log framing, manifest, lock."""

import io
import os
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.bloom import shape
from tidemark.functions.keys import next_prefix
from tidemark.plans import manifest as M
from tidemark.plans.lock import DirectoryLock, Locked
from tidemark.plans.policy import pick
from tidemark.sources import oplog


@pytest.mark.parametrize(
    "sizes, least, expected",
    [
        ([100] * 4, 4, (0, 4)),
        ([10, 100, 100, 100, 100], 4, (1, 5)),
        ([100, 40, 100, 100], 3, None),
        ([1, 1, 1], 4, None),
        ([100, 200, 300, 600], 4, None),
        ([100, 200, 300, 400], 4, (0, 4)),
        ([100] * 40, 4, (0, 32)),
        ([], 2, None),
        ([5], 2, None),
    ],
)
def test_pick(sizes, least, expected):
    assert pick(sizes, least) == expected


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_next_prefix_bounds_exactly_the_prefix(prefix, key):
    top = next_prefix(prefix)
    assert key.startswith(prefix) == (key >= prefix and (top is None or key < top))


def test_bloom_shape():
    assert shape(1000, 10).probes == 7
    assert shape(1000, 10).bits % 64 == 0 and shape(1, 1).bits == 64
    assert shape(10, 0) is None and shape(10, -1) is None
    assert shape(10, 100).probes == 30


RECORDS = [(f"key{i}".encode(), None if i % 4 == 3 else b"value-" + b"x" * i) for i in range(20)]
FRAMES = [oplog.frame(k, v) for k, v in RECORDS]
LOG = b"".join(FRAMES)
ENDS = [sum(map(len, FRAMES[: i + 1])) for i in range(20)]


def replay(data):
    return [(k, v) for _, k, v in oplog.records(io.BytesIO(data))]


def test_log_round_trip():
    assert replay(LOG) == RECORDS
    assert replay(oplog.frame(b"", b"") + oplog.frame(b"", None)) == [(b"", b""), (b"", None)]


def test_log_cut_at_every_length_gives_the_whole_records():
    for n in range(len(LOG)):
        assert replay(LOG[:n]) == RECORDS[: sum(e <= n for e in ENDS)]


def test_log_with_a_flipped_bit_gives_the_records_before_it():
    for n in range(len(LOG)):
        flipped = LOG[:n] + bytes([LOG[n] ^ 0x10]) + LOG[n + 1 :]
        assert replay(flipped) == RECORDS[: sum(e <= n for e in ENDS)]


def test_group_commit_serves_waiting_writers(tmp_path):
    log = oplog.LogWriter(str(tmp_path / "000001.log"))
    guard, threads = threading.Lock(), []

    def work(t):
        for i in range(50):
            with guard:
                at = log.append(f"{t}-{i}".encode(), b"v")
            log.sync(at)
            assert log.synced >= at

    threads = [threading.Thread(target=work, args=(t,)) for t in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.syncs <= 400
    log.close()
    assert len(replay((tmp_path / "000001.log").read_bytes())) == 400


def test_failed_sync_stays_failed(tmp_path, monkeypatch):
    log = oplog.LogWriter(str(tmp_path / "000001.log"))
    at = log.append(b"k", b"v")
    monkeypatch.setattr(os, "fsync", lambda fd: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        log.sync(at)
    monkeypatch.undo()
    with pytest.raises(OSError):
        log.sync(at)


def some_run(i):
    return M.Run(i, f"/x/{i:06d}", 10 * i, i, "00", "ff")


def test_manifest_round_trip_and_damage(tmp_path):
    assert M.load(str(tmp_path)) is None
    m = M.Manifest(next_id=7, log_id=3, next_seq=9, runs=(some_run(2), some_run(1)), obsolete=("a",), streams={"q": 4})
    M.save(str(tmp_path), m)
    assert M.load(str(tmp_path)) == m
    raw = (tmp_path / M.NAME).read_bytes()
    for n in range(len(raw)):
        (tmp_path / M.NAME).write_bytes(raw[:n])
        with pytest.raises(M.CorruptManifest):
            M.load(str(tmp_path))
        (tmp_path / M.NAME).write_bytes(raw[:n] + bytes([raw[n] ^ 0x10]) + raw[n + 1 :])
        with pytest.raises(M.CorruptManifest):
            M.load(str(tmp_path))


def test_splice_keeps_places_and_wants_neighbours():
    runs = tuple(some_run(i) for i in (4, 3, 2, 1))
    m = M.Manifest(runs=runs)
    assert [r.id for r in m.spliced([runs[1], runs[2]], some_run(9)).runs] == [4, 9, 1]
    assert [r.id for r in m.spliced([runs[3]], None).runs] == [4, 3, 2]
    with pytest.raises(ValueError):
        m.spliced([runs[0], runs[2]], None)


def test_run_bounds():
    r = M.Run(1, "p", 1, 1, b"c".hex(), b"f".hex())
    assert r.meets(None, None) and r.meets(b"f", None) and r.meets(None, b"c\x00") and r.meets(b"a", b"d")
    assert not r.meets(None, b"c") and not r.meets(b"f\x00", None)


def test_lock_is_exclusive(tmp_path):
    lock = DirectoryLock(str(tmp_path))
    with pytest.raises(Locked):
        DirectoryLock(str(tmp_path))
    lock.release()
    DirectoryLock(str(tmp_path)).release()


@settings(max_examples=200)
@given(st.lists(st.integers(0, 1000), max_size=50), st.integers(2, 6))
def test_picked_groups_are_alike(sizes, least):
    got = pick(sizes, least)
    if got:
        a, b = got
        assert least <= b - a <= 32
        for i in range(a + 1, b):
            mean = sum(sizes[a:i]) // (i - a)
            assert mean // 2 <= sizes[i] <= 2 * mean
