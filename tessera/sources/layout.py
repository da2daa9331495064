"""Where a table keeps its log and its files. Fixed: other programs read the same folders."""

from __future__ import annotations

import re

VERSIONS = "metadata/versions"
CHECKPOINTS = "metadata/checkpoints"
DATA = "data"
STAGING = "data/staging"
_ENTRY = re.compile(r"(\d+)\.json")
#: Versions are signed 64-bit numbers to Spark.
MAX_VERSION = 2**63 - 1


def log_key(version: int) -> str:
    return f"{VERSIONS}/{version}.json"


def log_tmp_key(version: int, token: str | None = None) -> str:
    """With a token the name is one writer's own."""
    return f"{VERSIONS}/{version}.{token}.json.tmp" if token else f"{VERSIONS}/{version}.json.tmp"


def checkpoint_key(version: int) -> str:
    return f"{CHECKPOINTS}/{version}.json"


def version_of(filename: str) -> int | None:
    """The version that a file name of the log folder stands for."""
    m = _ENTRY.fullmatch(filename)
    return int(m[1]) if m and int(m[1]) <= MAX_VERSION else None


def is_tmp(filename: str) -> bool:
    return filename.endswith(".json.tmp") and len(filename) > len(".json.tmp")


def data_key(name: str) -> str:
    return f"{DATA}/{name}"


def normalize(name: str) -> str:
    """A relative POSIX path: trimmed, with single slashes, and none at its ends."""
    return re.sub(r"/+", "/", name.strip().replace("\\", "/")).strip("/")


def is_safe(name: str) -> bool:
    """True for a normal relative path that stays inside its root."""
    return name != "" and name == normalize(name) and not any(part in ("", ".", "..") for part in name.split("/"))
