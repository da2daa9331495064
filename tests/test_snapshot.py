import random

import pytest
from .helpers import commit, make_log

from tessera import MissingVersionError, SnapshotReader, local_storage
from tessera.operators.snapshot import build_snapshot, files_referenced_in_range
from tessera.plans import ops
from tessera.sources.layout import log_key
from tessera.sources.log import LogEntry, log_frame, read_logs


def test_adds_only(tmp_path):
    storage = make_log(tmp_path, ("a b", ""), ("c", ""), ("d", ""))
    assert build_snapshot(storage, 2) == ["a", "b", "c", "d"]
    assert build_snapshot(storage, 1) == ["a", "b", "c"]


def test_adds_and_removes(tmp_path):
    assert build_snapshot(make_log(tmp_path, ("a b c", ""), ("", "b")), 1) == ["a", "c"]


def test_remove_then_readd(tmp_path):
    storage = make_log(tmp_path, ("a", ""), ("", "a"), ("a", ""))
    assert [build_snapshot(storage, v) for v in range(3)] == [["a"], [], ["a"]]


def test_empty_entry(tmp_path):
    assert build_snapshot(make_log(tmp_path, ("", "")), 0) == []


def test_remove_wins_within_an_entry(tmp_path):
    assert build_snapshot(make_log(tmp_path, ("a b", "a ghost")), 0) == ["b"]


def test_order_is_bytewise(tmp_path):
    assert build_snapshot(make_log(tmp_path, ("é Z a \U0001f600 ￿", "")), 0) == ["Z", "a", "é", "￿", "\U0001f600"]


def test_reader_does_not_see_newer_versions(tmp_path):
    storage = make_log(tmp_path, ("a", ""))
    reader = SnapshotReader(storage)
    commit(storage, "b")
    assert reader.read() == ("a",) and reader.pinned_version == 0
    assert SnapshotReader(storage).read() == ("a", "b")


def test_reads_are_stable_and_interleave(tmp_path):
    storage = make_log(tmp_path, ("base", ""))
    reader = SnapshotReader(storage)
    for n in range(20):
        commit(storage, f"f{n}", "base" if n == 5 else "")
        assert reader.read() == ("base",)
    assert len(SnapshotReader(storage).read()) == 20


def test_explicit_version(tmp_path):
    storage = make_log(tmp_path, ("a b", ""), ("c", "b"))
    assert SnapshotReader(storage, 0).read() == ("a", "b")
    assert SnapshotReader(storage, 1).read() == ("a", "c")


def test_empty_table_and_absent_version(tmp_path):
    reader = SnapshotReader(local_storage(tmp_path))
    assert (reader.pinned_version, reader.read()) == (-1, ())
    with pytest.raises(MissingVersionError) as e:
        SnapshotReader(make_log(tmp_path, ("a", "")), 5)
    assert e.value.version == 1
    with pytest.raises(MissingVersionError):
        SnapshotReader(local_storage(tmp_path), -1)


def test_range_of_snapshots(tmp_path):
    storage = make_log(tmp_path, ("A B", ""), ("C", "B"), ("D", "A"))
    assert files_referenced_in_range(storage, 0, 0) == {"A", "B"}
    assert files_referenced_in_range(storage, 1, 2) == {"A", "C", "D"}
    assert files_referenced_in_range(storage, 0, 2) == {"A", "B", "C", "D"}
    assert files_referenced_in_range(storage, 2, 1) == set()
    with pytest.raises(MissingVersionError):
        files_referenced_in_range(storage, 0, 3)


def replay(entries, version):
    active = set()
    for e in entries[: version + 1]:
        active |= set(e.adds)
        active -= set(e.removes)
    return active


def test_plans_equal_a_replay(spark):
    """Random logs with repeated names, re-adds and ghost removes."""
    rng = random.Random(4)
    for _ in range(4):
        entries = [LogEntry(v, 0, rng.choices("abcdefg", k=rng.randint(0, 4)), rng.choices("abcdefg", k=rng.randint(0, 4))) for v in range(8)]
        table = ops.ops(log_frame(spark, entries)).cache()
        each = {v: replay(entries, v) for v in range(8)}
        found = {(r.at_version, r.file) for r in ops.snapshots(table, 0, 7).collect()}
        assert found == {(v, f) for v, files in each.items() for f in files}
        assert {r.file for r in ops.snapshot(table, 5).collect()} == each[5]
        assert {r.file for r in ops.referenced(table, 2, 4).collect()} == each[2] | each[3] | each[4]
        assert ops.referenced(table, 4, 2).count() == 0
        assert {r.at_version: r.n_files for r in ops.snapshot_sizes(table, 0, 7).collect()} == {v: len(f) for v, f in each.items()}
        assert {r.at_version: r.n_files for r in ops.snapshot_sizes(table, 3, 5).collect()} == {v: len(each[v]) for v in (3, 4, 5)}
        change = {(r.file, r.change) for r in ops.diff(table, 2, 6).collect()}
        assert change == {(f, "added") for f in each[6] - each[2]} | {(f, "removed") for f in each[2] - each[6]}
        table.unpersist()


def test_ops_keep_order_and_repeats(spark, tmp_path):
    storage = make_log(tmp_path, ("a a b", "c"))
    rows = ops.ops(log_frame(spark, read_logs(storage, 0))).collect()
    assert sorted((r.file, r.act, r.pos) for r in rows) == [("a", 0, 0), ("a", 0, 1), ("b", 0, 2), ("c", 1, 0)]


def test_reading_with_a_gap(tmp_path):
    storage = make_log(tmp_path, ("a", ""), ("b", ""), ("c", ""))
    storage.remove_file(log_key(1))
    assert SnapshotReader(storage, 0).read() == ("a",)
    with pytest.raises(MissingVersionError):
        SnapshotReader(storage)
