"""The errors that the operators raise. All of them are LogErrors."""

from __future__ import annotations


class LogError(Exception):
    """A table's log or files cannot do what was asked."""


class DuplicateVersionError(LogError):
    def __init__(self, version: int) -> None:
        super().__init__(f"version {version} exists already")
        self.version = version


class MissingVersionError(LogError):
    """version is the first one that is absent."""

    def __init__(self, version: int) -> None:
        super().__init__(f"version {version} is missing")
        self.version = version


class CorruptedJsonError(LogError):
    def __init__(self, version: int, detail: str) -> None:
        super().__init__(f"version {version} is no log entry: {detail}")
        self.version = version


class ConflictError(LogError):
    """Another writer committed since the transaction began."""

    def __init__(self, expected: int, found: int) -> None:
        super().__init__(f"expected version {expected} to be the latest, found {found}")
        self.expected = expected
        self.found = found


class WriteConflictError(LogError):
    """Another writer changed a file that the transaction had read. Not a ConflictError."""

    def __init__(self, filename: str, conflicting_version: int) -> None:
        super().__init__(f"{filename} was read, and changed by version {conflicting_version}")
        self.filename = filename
        self.conflicting_version = conflicting_version


class InvariantViolation(LogError):
    def __init__(self, invariant_name: str, detail: str) -> None:
        super().__init__(f"{invariant_name}: {detail}")
        self.invariant_name = invariant_name
        self.detail = detail
