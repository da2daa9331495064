import json

import pytest
from .helpers import make_log, put

from tessera import CorruptedJsonError, DuplicateVersionError, LogEntry, LogError, MissingVersionError, Table, local_storage
from tessera.sources import layout
from tessera.sources.bulk import checked_log
from tessera.sources.storage import azure_sas_settings
from tessera.sources.log import atomic_write, cleanup_tmp_files, ensure_dirs, latest_version, log_frame, read_logs, versions, write_log


def test_write_and_read_one_entry(tmp_path):
    storage = make_log(tmp_path, ("a.parquet b.parquet", ""))
    (entry,) = read_logs(storage, 0)
    assert (entry.version, entry.adds, entry.removes) == (0, ["a.parquet", "b.parquet"], [])
    assert entry.timestamp > 1_600_000_000


def test_versions_are_contiguous(tmp_path):
    storage = make_log(tmp_path, ("a", ""))
    with pytest.raises(MissingVersionError) as e:
        write_log(storage, 2, ["b"], [])
    assert e.value.version == 1


def test_duplicate_version_is_rejected(tmp_path):
    storage = make_log(tmp_path, ("a", ""))
    with pytest.raises(DuplicateVersionError) as e:
        write_log(storage, 0, ["b"], [])
    assert e.value.version == 0
    assert read_logs(storage, 0)[0].adds == ["a"]


def test_missing_version_in_the_middle(tmp_path):
    storage = make_log(tmp_path, ("a", ""), ("b", ""), ("c", ""))
    storage.remove_file(layout.log_key(1))
    with pytest.raises(MissingVersionError) as e:
        read_logs(storage, 2)
    assert e.value.version == 1


def test_corruption_before_a_gap_is_reported_first(tmp_path):
    storage = make_log(tmp_path, ("a", ""), ("b", ""), ("c", ""))
    put(storage, layout.log_key(0), "{")
    storage.remove_file(layout.log_key(1))
    with pytest.raises(CorruptedJsonError):
        read_logs(storage, 2)


@pytest.mark.parametrize(
    "text",
    [
        "NOT VALID JSON {{{", "", "[]", '{"version":0,"timestamp":0,"adds":[]}', '{"version":0,"timestamp":0,"adds":[1],"removes":[]}',
        '{"version":"0","timestamp":0,"adds":[],"removes":[]}', '{"version":-1,"timestamp":0,"adds":[],"removes":[]}',
        '{"version":0,"timestamp":0,"adds":[],"removes":[]} trailing', '{"version":9223372036854775808,"timestamp":0,"adds":[],"removes":[]}',
        '{"version":0,"timestamp":true,"adds":[],"removes":[]}', '{"version":0,"timestamp":0,"adds":null,"removes":[]}', "\xff",
    ],
)
def test_corrupted_json(tmp_path, text):
    storage = make_log(tmp_path, ("a", ""))
    storage.write_all_bytes(layout.log_key(0), text.encode("latin-1"))
    with pytest.raises(CorruptedJsonError) as e:
        read_logs(storage, 0)
    assert e.value.version == 0


def test_unknown_fields_are_ignored_and_other_versions_accepted(tmp_path):
    storage = make_log(tmp_path, ("a", ""))
    put(storage, layout.log_key(0), json.dumps({"version": 99, "timestamp": 0, "adds": ["x", "x"], "removes": [], "more": 1}))
    assert read_logs(storage, 0) == [LogEntry(99, 0, ["x", "x"], [])]


def test_latest_version(tmp_path):
    storage = local_storage(tmp_path)
    assert latest_version(storage) == -1
    make_log(tmp_path, ("a", ""), ("b", ""), ("c", ""))
    assert latest_version(storage) == 2


def test_latest_version_ignores_other_names(tmp_path):
    storage = make_log(tmp_path, ("a", ""))
    for name in ("1.json.tmp", "7abc.json", "01.json", "x.json", "99999999999999999999.json", "5.txt"):
        put(storage, f"{layout.VERSIONS}/{name}", "x")
    assert latest_version(storage) == 0
    assert versions(storage) == [0]


def test_entry_is_compact_json_and_utf8(tmp_path):
    storage = make_log(tmp_path, ("é.parquet", ""))
    text = storage.read_all_text(layout.log_key(0))
    assert '"adds":["é.parquet"],"removes":[]' in text
    assert " " not in text


def test_atomic_write_leaves_no_tmp(tmp_path):
    storage = local_storage(tmp_path)
    ensure_dirs(storage)
    seen = []
    atomic_write(storage, LogEntry(0), lambda point: seen.append((point, storage.exists(layout.log_key(0)))))
    assert seen == [("after_fsync", False), ("after_rename", True)]
    assert storage.list_dir_filenames(layout.VERSIONS) == ["0.json"]


def test_cleanup_of_tmp_files(tmp_path):
    storage = make_log(tmp_path, ("a", ""))
    for name in ("1.json.tmp", "1.abc.json.tmp", ".json.tmp"):
        put(storage, f"{layout.VERSIONS}/{name}")
    assert cleanup_tmp_files(storage) == ["1.abc.json.tmp", "1.json.tmp"]


def test_log_frame(spark, tmp_path):
    storage = make_log(tmp_path, ("a b", ""), ("", "a"))
    rows = log_frame(spark, read_logs(storage, 1)).orderBy("version").collect()
    assert [(r.version, r.adds, r.removes) for r in rows] == [(0, ["a", "b"], []), (1, [], ["a"])]


def test_layout():
    assert layout.log_key(12) == "metadata/versions/12.json"
    assert layout.log_tmp_key(12) == "metadata/versions/12.json.tmp"
    assert layout.normalize(r" \a\\b//c/ ") == "a/b/c"
    assert [layout.is_safe(k) for k in ("a/b", "", ".", "a/../b", "a//b", "/a", "a/")] == [True, *[False] * 6]


def test_storage(tmp_path):
    storage = local_storage(tmp_path / "t")
    with pytest.raises(LogError):
        storage.read_all_text("none")
    storage.write_all_bytes("d/a", b"")
    storage.write_all_text("d/b", "é")
    assert storage.read_all_bytes("d/a") == b"" and storage.read_all_text("d/b") == "é"
    assert storage.list_dir_filenames("d") == ["a", "b"] and storage.list_dir_filenames("none") == []
    storage.mkdirs("d/e")
    assert storage.list_dir_filenames("d") == ["a", "b"]
    with pytest.raises(FileExistsError):
        storage.rename_no_overwrite("d/a", "d/b")
    with pytest.raises(LogError):
        storage.rename_no_overwrite("d/none", "d/c")
    storage.rename_no_overwrite("d/a", "x/y/c")
    assert not storage.exists("d/a") and storage.list_tree("x") == ["y/c"]
    assert storage.remove_file("d/none")
    storage.write_all_bytes("bytes", b"\xff\xfe")
    with pytest.raises(LogError):
        storage.read_all_text("bytes")
    storage.remove_tree("x")
    storage.remove_tree("x")
    assert not storage.exists("x")


def test_bulk_log(spark, tmp_path):
    storage = make_log(tmp_path, ("a b", ""), ("", "a"), ("é c", "b"))
    table = Table(spark, tmp_path)
    assert sorted(map(repr, table.log(bulk=True).collect())) == sorted(map(repr, table.log().collect()))
    assert table.log(1, bulk=True).count() == 2 and Table(spark, tmp_path / "none").log(bulk=True).count() == 0
    put(storage, layout.log_key(2), "")
    assert {r.version: r.ok for r in checked_log(spark, storage).collect()} == {0: True, 1: True, 2: False}
    for text, error in (("", CorruptedJsonError), ("BAD", CorruptedJsonError), (None, MissingVersionError)):
        put(storage, layout.log_key(1), text) if text is not None else storage.remove_file(layout.log_key(1))
        with pytest.raises(error) as e:
            table.log(2, bulk=True)
        assert e.value.version == 1


def test_azure_settings():
    assert azure_sas_settings("a.dfs.example.net", " ?sv=1&sig=x") == {
        "fs.azure.account.auth.type.a.dfs.example.net": "SAS", "fs.azure.sas.fixed.token.a.dfs.example.net": "sv=1&sig=x",
    }
    with pytest.raises(LogError):
        azure_sas_settings("a", "?")
