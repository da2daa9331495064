import pytest
from .helpers import commit, make_log, put

from tessera import InvariantViolation, Table, local_storage
from tessera.operators import invariants as inv
from tessera.operators.gc import vacuum
from tessera.operators.recovery import recover_log
from tessera.sources.layout import VERSIONS, log_key


def violated(f, *args):
    with pytest.raises(InvariantViolation) as e:
        f(*args)
    return e.value.invariant_name


def test_clean_and_empty_tables(spark, tmp_path):
    inv.assert_all_invariants(spark, local_storage(tmp_path / "empty"))
    storage = make_log(tmp_path / "t", ("a b", ""), ("c", "a"), ("a", ""))
    inv.assert_all_invariants(spark, storage)
    inv.assert_deterministic_snapshot(spark, storage, 1)
    assert Table(spark, tmp_path / "t").violations().count() == 0


def test_gap_and_mismatch(spark, tmp_path):
    storage = make_log(tmp_path, ("a", ""), ("b", ""), ("c", ""))
    text = storage.read_all_text(log_key(1))
    put(storage, log_key(1), text.replace('"version":1', '"version":9'))
    assert violated(inv.assert_contiguous_versions, spark, storage) == "contiguous_versions"
    storage.remove_file(log_key(1))
    assert violated(inv.assert_all_invariants, spark, storage) == "contiguous_versions"


def test_duplicate_versions(spark, tmp_path):
    storage = make_log(tmp_path, ("a", ""), ("b", ""))
    inv.assert_no_duplicate_versions(spark, storage)
    put(storage, f"{VERSIONS}/01.json", storage.read_all_text(log_key(1)))
    assert violated(inv.assert_no_duplicate_versions, spark, storage) == "no_duplicate_versions"


@pytest.mark.parametrize("entries", [[("x x", "")], [("x", ""), ("x", "")]])
def test_duplicate_files(spark, tmp_path, entries):
    storage = make_log(tmp_path, *entries)
    assert violated(inv.assert_no_duplicate_files, spark, storage, len(entries) - 1) == "no_duplicate_files"
    assert violated(inv.assert_all_invariants, spark, storage) == "no_duplicate_files"


@pytest.mark.parametrize("entries", [[("a", ""), ("", "phantom")], [("a", ""), ("", "a"), ("", "a")], [("a", "a a")]])
def test_ghost_removes(spark, tmp_path, entries):
    storage = make_log(tmp_path, *entries)
    assert violated(inv.assert_no_ghost_removes, spark, storage, len(entries) - 1) == "no_ghost_removes"
    assert "no_ghost_removes" in {r.invariant for r in Table(spark, tmp_path).violations().collect()}


def test_add_and_remove_in_one_entry_is_no_ghost(spark, tmp_path):
    inv.assert_no_ghost_removes(spark, make_log(tmp_path, ("a", "a")), 0)


def test_after_commits_recovery_and_vacuum(spark, tmp_path):
    storage = local_storage(tmp_path)
    for n in range(10):
        commit(storage, f"f{n}", f"f{n - 1}" if n else "")
    inv.assert_all_invariants(spark, storage)
    vacuum(storage, 2)
    put(storage, log_key(9), "BAD")
    recover_log(storage)
    commit(storage, "g", "f8")
    inv.assert_all_invariants(spark, storage)
