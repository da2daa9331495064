"""Versioned tables on Spark: a directory of Parquet files and a log of small JSON entries."""

from .errors import (
    ConflictError,
    CorruptedJsonError,
    DuplicateVersionError,
    InvariantViolation,
    LogError,
    MissingVersionError,
    WriteConflictError,
)
from .operators.gc import VacuumResult, vacuum
from .operators.invariants import assert_all_invariants
from .operators.reader import SnapshotReader
from .operators.recovery import RecoveryResult, recover_log, validate_log
from .operators.snapshot import build_snapshot, files_referenced_in_range
from .operators.transaction import CrashPoint, Transaction, with_retries
from .sources.log import LogEntry, atomic_write, cleanup_tmp_files, ensure_dirs, latest_version, read_logs, write_log
from .sources.storage import HadoopStorage, LocalStorage, StorageBackend, azure_sas_storage, local_storage, open_storage
from .table import Table

__all__ = [
    "ConflictError", "CorruptedJsonError", "CrashPoint", "DuplicateVersionError", "HadoopStorage", "InvariantViolation",
    "LocalStorage", "LogEntry", "LogError", "MissingVersionError", "RecoveryResult", "SnapshotReader", "StorageBackend",
    "Table", "Transaction", "VacuumResult", "WriteConflictError", "assert_all_invariants", "atomic_write",
    "azure_sas_storage", "build_snapshot", "cleanup_tmp_files", "ensure_dirs", "files_referenced_in_range",
    "latest_version", "local_storage", "open_storage", "read_logs", "recover_log", "vacuum", "validate_log",
    "with_retries", "write_log",
]
