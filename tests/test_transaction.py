import multiprocessing
import os
import subprocess
import sys

import pytest
from .helpers import commit, data_files, make_log, put

from tessera import ConflictError, CrashPoint, HadoopStorage, LocalStorage, LogError, MissingVersionError, SnapshotReader, Table, Transaction, WriteConflictError, local_storage
from tessera.operators.gc import vacuum
from tessera.operators.recovery import recover_log
from tessera.operators.snapshot import files_referenced_in_range
from tessera.operators.transaction import with_retries
from tessera.sources.layout import STAGING, VERSIONS
from tessera.sources.log import latest_version, read_logs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_commits_in_sequence(tmp_path):
    storage = local_storage(tmp_path)
    assert Transaction(storage).base_version == -1
    assert [commit(storage, "a"), commit(storage, "b"), commit(storage, "", "a"), commit(storage)] == [0, 1, 2, 3]
    assert SnapshotReader(storage).read() == ("b",)
    assert latest_version(storage) == 3
    assert [e.version for e in read_logs(storage, 3)] == [0, 1, 2, 3]


def test_entry_keeps_order_and_repeats(tmp_path):
    storage = local_storage(tmp_path)
    commit(storage, "b a b", "z z")
    (entry,) = read_logs(storage, 0)
    assert (entry.adds, entry.removes) == (["b", "a", "b"], ["z", "z"])


def test_conflict_on_an_empty_table(tmp_path):
    storage = local_storage(tmp_path)
    one, two = Transaction(storage), Transaction(storage)
    one.add("a")
    two.add("b")
    one.commit()
    with pytest.raises(ConflictError) as e:
        two.commit()
    assert (e.value.expected, e.value.found) == (-1, 0)


def test_read_conflict_on_an_empty_base(tmp_path):
    storage = local_storage(tmp_path)
    one, two = Transaction(storage), Transaction(storage)
    one.add("a")
    two.track_read("a")
    one.commit()
    with pytest.raises(WriteConflictError):
        two.commit()


def test_files_are_placed_and_staging_is_gone(tmp_path):
    storage = local_storage(tmp_path)
    put(storage, f"{STAGING}/a.parquet", "bytes")
    commit(storage, "a.parquet b.parquet k=1/c.parquet")
    assert data_files(storage) == ["a.parquet", "b.parquet"]
    assert storage.read_all_text("data/a.parquet") == "bytes"
    assert storage.read_all_bytes("data/b.parquet") == b"" and storage.exists("data/k=1/c.parquet")
    assert not storage.exists(STAGING)
    assert storage.list_dir_filenames(VERSIONS) == ["0.json"]


def test_second_commit_of_an_object(tmp_path):
    txn = Transaction(local_storage(tmp_path))
    txn.commit()
    with pytest.raises(ConflictError):
        txn.commit()


def test_names(tmp_path):
    txn = Transaction(local_storage(tmp_path))
    for bad in ("", "/", "../x", "a/../b", "_hidden", ".hidden", "a/_b", "staging/x", "staging"):
        with pytest.raises(LogError):
            txn.add(bad)
    txn.add("/a//b.parquet/")
    txn.commit()
    assert SnapshotReader(txn.storage).read() == ("a/b.parquet",)


def test_bytes_are_never_lost_to_a_name(tmp_path):
    storage = local_storage(tmp_path)
    put(storage, f"{STAGING}/a", "old")
    commit(storage, "a")
    commit(storage, "", "a")
    commit(storage, "a")  # by name only: the file is still there
    put(storage, f"{STAGING}/a", "new")
    with pytest.raises(LogError):
        commit(storage, "a")
    assert storage.read_all_text("data/a") == "old" and latest_version(storage) == 2


#: (first writer, second writer's adds, removes, reads, error)
CASES = [
    ("x", "", "y", "", "", ConflictError),
    ("extra", "", "", "data", "data", ConflictError),
    ("", "shared", "", "shared", "shared", WriteConflictError),
    ("", "a", "c", "", "a", WriteConflictError),
    ("data", "", "z", "", "data", WriteConflictError),
    ("p", "", "q", "", "data", ConflictError),
]


@pytest.mark.parametrize(("adds1", "removes1", "adds2", "removes2", "reads2", "error"), CASES)
def test_conflicts(tmp_path, adds1, removes1, adds2, removes2, reads2, error):
    storage = local_storage(tmp_path)
    commit(storage, "data shared a")
    two = Transaction(storage)
    commit(storage, adds1, removes1)
    for f, take in ((adds2, two.add), (removes2, two.remove), (reads2, two.track_read)):
        for name in f.split():
            take(name)
    with pytest.raises(error) as e:
        two.commit()
    assert type(e.value) is error
    if error is WriteConflictError:
        assert (e.value.filename, e.value.conflicting_version) == (reads2, 1)
    assert latest_version(storage) == 1
    for name in adds2.split():
        assert not storage.exists(f"data/{name}")


def test_first_conflict_in_log_order(tmp_path):
    storage = local_storage(tmp_path)
    commit(storage, "a b c")
    txn = Transaction(storage)
    for name in "abc":
        txn.track_read(name)
    commit(storage, "z")
    commit(storage, "c", "b a")
    with pytest.raises(WriteConflictError) as e:
        txn.commit()
    assert (e.value.filename, e.value.conflicting_version) == ("c", 2)


def test_retry_after_conflict(tmp_path):
    storage = local_storage(tmp_path)
    commit(storage, "base")
    two = Transaction(storage)
    two.add("y")
    commit(storage, "x")
    with pytest.raises(ConflictError):
        two.commit()
    assert commit(storage, "y") == 2
    assert with_retries(storage, lambda t: t.add("w")) == 3
    assert SnapshotReader(storage).read() == ("base", "w", "x", "y")


def test_staging_of_others_survives(tmp_path):
    storage = local_storage(tmp_path)
    one, two = Transaction(storage), Transaction(storage)
    one._declare(["later"])
    put(storage, f"{one._own}/later", "bytes")
    two.add("now")
    two.commit()
    assert storage.read_all_text(f"{one._own}/later") == "bytes"


def _race(args):
    path, k = args
    storage = local_storage(path)
    won = []
    for n in range(15):
        try:
            won.append(commit(storage, f"w{k}-{n}"))
        except ConflictError:
            pass
    return won


def test_two_processes_race(tmp_path):
    with multiprocessing.get_context("spawn").Pool(2) as pool:
        won = pool.map(_race, [(str(tmp_path), k) for k in range(2)])
    every = sorted(won[0] + won[1])
    storage = local_storage(tmp_path)
    assert every == list(range(len(every))) and latest_version(storage) == len(every) - 1
    files = SnapshotReader(storage).read()
    assert len(files) == len(every) and all(storage.exists(f"data/{f}") for f in files)


def crash(path, point, *files):
    return subprocess.run([sys.executable, "-m", "tessera.tools.crash_commit", str(path), point, *files], cwd=ROOT, capture_output=True, text=True).returncode


def test_crash_before_publishing(tmp_path):
    storage = make_log(tmp_path, ("a", ""))
    assert crash(tmp_path, "after_fsync", "b") == 1
    assert latest_version(storage) == 0 and SnapshotReader(storage).read() == ("a",)
    assert any(n.endswith(".json.tmp") for n in storage.list_dir_filenames(VERSIONS))
    done = recover_log(storage)
    assert (done.valid_version, len(done.cleaned_tmp_files), done.was_clean) == (0, 1, False)
    assert storage.list_tree(STAGING) == []
    assert commit(storage, "b") == 1


def test_crash_after_publishing(tmp_path):
    storage = make_log(tmp_path, ("a", ""))
    put(storage, f"{STAGING}/b", "bytes")
    assert crash(tmp_path, "after_rename", "b") == 1
    assert latest_version(storage) == 1 and SnapshotReader(storage).read() == ("a", "b")
    assert storage.read_all_text("data/b") == "bytes"
    assert recover_log(storage).valid_version == 1
    assert commit(storage, "c") == 2 and storage.read_all_text("data/b") == "bytes"


def test_no_crash_and_usage(tmp_path):
    assert crash(tmp_path, "none", "a") == 0
    assert crash(tmp_path, "elsewhere") == 2
    assert SnapshotReader(local_storage(tmp_path)).read() == ("a",)
    assert CrashPoint("after_fsync") is CrashPoint.AFTER_FSYNC


class Failing(LocalStorage):
    """Raises once in the named method, for keys that hold a text, before or after doing the work."""

    def arm(self, method, text, after):
        real, left = getattr(LocalStorage, method), [1]

        def call(key, *args):
            hit = text in key and left and left.pop()
            if hit and not after:
                raise LogError(f"no {method}")
            out = real(self, key, *args)
            if hit:
                raise LogError(f"after {method}")
            return out

        setattr(self, method, call)


#: (method, part of the key, after the work is done, version published)
STEPS = [
    ("write_all_bytes", "intent", False, False), ("write_all_bytes", ".json.tmp", False, False), ("sync_for_durability", ".json.tmp", False, False),
    ("rename_no_overwrite", "versions", False, False), ("rename_no_overwrite", "versions", True, True), ("remove_file", "versions", False, True),
    ("sync_for_durability", "versions/1.json", False, True), ("remove_tree", "staging", False, True), ("remove_empty_dir", "staging", False, True),
]


@pytest.mark.parametrize(("method", "text", "after", "published"), STEPS)
def test_errors_around_the_commit_point(spark, tmp_path, method, text, after, published):
    """A commit that is in the log stands and keeps its files; one that is not leaves nothing behind."""
    table = Table(spark, Failing(tmp_path))
    table.append(spark.range(3).coalesce(1))
    txn = table.transaction()
    txn.add_dataframe(spark.range(4).coalesce(1))
    if method == "sync_for_durability" and text == "versions/1.json":
        real = table.storage.sync_for_durability
        table.storage.sync_for_durability = lambda key: _no(key) if key == "metadata/versions/1.json" else real(key)
    else:
        table.storage.arm(method, text, after)
    if published:
        assert txn.commit() == 1
    else:
        with pytest.raises(LogError):
            txn.commit()
    fresh = Table(spark, tmp_path)
    assert fresh.latest_version() == int(published)
    assert fresh.reader().df().count() == (7 if published else 3)
    assert len([f for f in data_tree(fresh.storage) if f.endswith(".parquet")]) == 1 + published


def _no(key):
    raise LogError(f"cannot sync {key}")


def data_tree(storage):
    return [f for f in storage.list_tree("data") if not f.startswith("staging/")]


class Vacuuming(LocalStorage):
    """Vacuums the table after each step of a writer."""

    busy = True

    def vacuum_now(self):
        if not self.busy:
            self.busy = True
            vacuum(local_storage(self.root))
            self.busy = False

    def write_all_bytes(self, key, data):
        super().write_all_bytes(key, data)
        self.vacuum_now()

    def rename_no_overwrite(self, source, target):
        super().rename_no_overwrite(source, target)
        self.vacuum_now()

    def sync_for_durability(self, key):
        super().sync_for_durability(key)
        self.vacuum_now()

    def list_tree(self, key):
        out = super().list_tree(key)
        self.vacuum_now()
        return out

    def remove_tree(self, key):
        self.vacuum_now()
        super().remove_tree(key)
        self.vacuum_now()


def test_vacuum_between_all_steps(spark, tmp_path):
    table = Table(spark, Vacuuming(tmp_path))
    table.append(spark.range(3))
    table.storage.busy = False
    txn = table.transaction()
    txn.add_dataframe(spark.range(4))
    txn.add_dataframe(spark.range(5))
    txn.add("by_name.parquet")
    txn.commit()
    table.storage.busy = True
    names = [f for f in table.reader().files if f != "by_name.parquet"]
    assert spark.read.parquet(*[table.storage.uri(f"data/{f}") for f in names]).count() == 12
    assert table.storage.exists("data/by_name.parquet")


def test_an_unreadable_intent_stops_the_vacuum(spark, tmp_path):
    table = Table(spark, tmp_path)
    table.append(spark.range(3))
    txn = table.transaction()
    txn.add_dataframe(spark.range(4))
    intent = f"{txn._own}/intent.json"
    whole = table.storage.read_all_text(intent)
    put(table.storage, intent, whole[:5])
    with pytest.raises(LogError):
        table.vacuum()
    put(table.storage, intent, whole)
    assert table.vacuum().deleted_files == []
    assert txn.commit() == 1 and table.reader().df().count() == 7


def test_vacuum_removes_folders_of_single_writes(spark, tmp_path):
    table = Table(spark, tmp_path)
    table.append(spark.range(3))
    table.overwrite(spark.range(4))
    assert len(os.listdir(tmp_path / "data")) == 2
    table.vacuum()
    assert len(os.listdir(tmp_path / "data")) == 1 and table.reader().df().count() == 4


def test_checkpoints(spark, tmp_path):
    storage = make_log(tmp_path, ("a b", ""), ("c", "a"), ("d", ""), ("", "b"))
    table = Table(spark, storage)
    before = [table.reader(v).files for v in range(4)]
    assert table.checkpoint(1) == 1 and table.checkpoint() == 3 and table.checkpoint(1) == 1
    assert [SnapshotReader(storage, v).files for v in range(4)] == before
    read = []
    storage.read_all_bytes = lambda key: read.append(key) or LocalStorage.read_all_bytes(storage, key)
    assert SnapshotReader(storage, 2).files == before[2]
    assert sorted(read) == ["metadata/checkpoints/1.json", "metadata/versions/1.json", "metadata/versions/2.json"]
    assert files_referenced_in_range(storage, 2, 3) == {"b", "c", "d"}
    # One of another log, or damaged, does not count; nor one whose versions recovery cut off.
    put(storage, "metadata/checkpoints/1.json", "{")
    assert SnapshotReader(storage, 2).files == before[2]
    put(storage, "metadata/versions/3.json", "BAD")
    recover_log(storage)
    assert not storage.exists("metadata/checkpoints/3.json")
    assert commit(storage, "e") == 3 and SnapshotReader(storage).files == ("b", "c", "d", "e")
    table.checkpoint(3)
    put(storage, "metadata/versions/3.json", '{"version":3,"timestamp":0,"adds":["f"],"removes":[]}')
    assert SnapshotReader(storage).files == ("b", "c", "d", "f")
    storage.remove_file("metadata/versions/0.json")
    with pytest.raises(MissingVersionError):
        SnapshotReader(storage)


def test_hadoop_entries_appear_whole(spark, tmp_path):
    """While an entry is being written no reader sees its key, and a second writer of it is refused."""
    storage = HadoopStorage(spark, f"file://{tmp_path}/t")
    seen = []
    create = storage._create

    def noted(key, data, overwrite):
        create(key, data[: len(data) // 2], overwrite)
        seen.append(latest_version(local_storage(tmp_path / "t")))
        create(key, data, True)

    storage._create = noted
    commit(storage, "a")
    commit(storage, "b")
    assert max(seen[: len(seen) // 2]) < 1 and latest_version(storage) == 1 and SnapshotReader(storage).files == ("a", "b")
    put(storage, "x", "1")
    put(storage, "y", "2")
    with pytest.raises(FileExistsError):
        storage.rename_no_overwrite("x", "y")
    assert storage.read_all_text("x") == "1" and storage.read_all_text("y") == "2"
    with pytest.raises(LogError):
        storage.rename_no_overwrite("none", "z")
    storage._scheme = "s3a"
    with pytest.raises(LogError):
        commit(storage, "c")
    assert latest_version(storage) == 1


def test_hadoop_rename_of_other_schemes(spark, tmp_path):
    """The rename that does not overwrite, as it is called on hdfs and abfs, on the one file system at hand."""
    storage = HadoopStorage(spark, f"file://{tmp_path}/t")
    storage._scheme = "hdfs"
    put(storage, "x", "1")
    put(storage, "y", "2")
    with pytest.raises(FileExistsError):
        storage.rename_no_overwrite("x", "y")
    storage.rename_no_overwrite("x", "d/z")
    assert storage.read_all_text("d/z") == "1" and not storage.exists("x") and storage.read_all_text("y") == "2"
