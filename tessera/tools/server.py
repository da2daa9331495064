"""A table over HTTP: python -m tessera.tools.server [--table PATH] [--listen HOST:PORT].

The table is PATH, or else what TESSERA_TABLE names: a folder, or a URI that
Hadoop opens, for which a local session is started. One request changes the
table at a time; commits of other processes are told apart by the log itself.
"""

from __future__ import annotations

import argparse
import json
import os
import threading
from collections.abc import Callable
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from ..errors import ConflictError, CorruptedJsonError, DuplicateVersionError, LogError, MissingVersionError, WriteConflictError
from ..operators.gc import vacuum
from ..operators.reader import SnapshotReader
from ..operators.recovery import recover_log, validate_log
from ..operators.transaction import Transaction
from ..sources.layout import STAGING, is_safe, normalize
from ..sources.log import latest_version
from ..sources.storage import StorageBackend, open_storage

_STATUS: tuple[tuple[type[Exception], int], ...] = (
    (ConflictError, 409), (WriteConflictError, 409), (DuplicateVersionError, 409),
    (MissingVersionError, 400), (CorruptedJsonError, 400), (LogError, 500), (ValueError, 400),
)


class NotFound(Exception):
    pass


def status_of(error: Exception) -> int:
    if isinstance(error, NotFound):
        return 404
    return next((code for kind, code in _STATUS if isinstance(error, kind)), 500)


def checked_key(key: str) -> str:
    if not is_safe(key):
        raise ValueError(f"unsafe key {key!r}")
    return key


def _number(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be an unsigned number")
    return value


class Service:
    """The endpoints, without HTTP."""

    def __init__(self, storage: StorageBackend) -> None:
        self.storage = storage
        self._changes = threading.Lock()

    def health(self) -> dict:
        return {"ok": True}

    def version(self) -> dict:
        return {"latest": latest_version(self.storage)}

    def snapshot(self, at: str | None) -> dict:
        if at is not None and not at.isdecimal():
            raise ValueError("at must be an unsigned number")
        reader = SnapshotReader(self.storage, None if at is None else int(at))
        return {"pinned_version": reader.pinned_version, "files": list(reader.files)}

    def validate(self) -> dict:
        return {"valid_through": validate_log(self.storage)}

    def recover(self) -> dict:
        with self._changes:
            return asdict(recover_log(self.storage))

    def vacuum(self, body: dict) -> dict:
        with self._changes:
            done = asdict(vacuum(self.storage, _number(body.get("retain_last_n", 1), "retain_last_n")))
        return {**done, "referenced_files": sorted(done["referenced_files"])}

    def commit(self, body: dict) -> dict:
        lists = {name: body.get(name, []) for name in ("adds", "removes", "read_set")}
        for name, values in lists.items():
            if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
                raise ValueError(f"{name} must be a list of strings")
            for v in values:
                checked_key(normalize(v))
        with self._changes:
            txn = Transaction(self.storage)
            for name, take in (("adds", txn.add), ("removes", txn.remove), ("read_set", txn.track_read)):
                for v in lists[name]:
                    take(v)
            return {"version": txn.commit()}

    def get_blob(self, key: str) -> bytes:
        if not self.storage.exists(checked_key(key)):
            raise NotFound(key)
        return self.storage.read_all_bytes(key)

    def put_blob(self, key: str, data: bytes) -> dict:
        """Into staging only: entries and committed files are not overwritten."""
        if not checked_key(key).startswith(f"{STAGING}/"):
            raise ValueError(f"only keys below {STAGING}/ can be written")
        self.storage.write_all_bytes(key, data)
        self.storage.sync_for_durability(key)
        return {"ok": True, "key": key, "bytes": len(data)}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args: object) -> None:
            pass

        def _send(self, status: int, data: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def _json_body(self) -> dict:
            given = json.loads(self._body() or b"{}")
            if not isinstance(given, dict):
                raise ValueError("the body must be an object")
            return given

        def _answer(self, f: Callable[[], object]) -> None:
            try:
                found = f()
            except Exception as e:  # every failure has a status
                self._send(status_of(e), json.dumps({"error": str(e), "type": type(e).__name__}).encode())
                return
            if isinstance(found, bytes):
                self._send(200, found, "application/json" if self.path.endswith(".json") else "application/octet-stream")
            else:
                self._send(200, json.dumps(found).encode())

        def _route(self, routes: dict[str, Callable[[], object]], blob: Callable[[str], object] | None) -> None:
            path = urlsplit(self.path).path
            if blob is not None and path.startswith("/v1/blob/"):
                self._answer(lambda: blob(unquote(path.removeprefix("/v1/blob/"))))
            elif path in routes:
                self._answer(routes[path])
            else:
                self._body()
                self._send(404, b'{"error":"no such endpoint"}')

        def do_GET(self) -> None:
            at = parse_qs(urlsplit(self.path).query).get("at", [None])[0]
            routes = {"/health": service.health, "/v1/version": service.version, "/v1/snapshot": lambda: service.snapshot(at)}
            self._route(routes, service.get_blob)

        def do_POST(self) -> None:
            routes = {
                "/v1/recover": lambda: (self._body(), service.recover())[1],
                "/v1/validate": lambda: (self._body(), service.validate())[1],
                "/v1/vacuum": lambda: service.vacuum(self._json_body()),
                "/v1/commit": lambda: service.commit(self._json_body()),
            }
            self._route(routes, None)

        def do_PUT(self) -> None:
            data = self._body()
            self._route({}, lambda key: service.put_blob(key, data))

    return Handler


def parse_listen(listen: str) -> tuple[str, int]:
    host, _, port = listen.rpartition(":")
    if not port.isdecimal() or not 0 <= int(port) < 65536:
        raise ValueError(f"{listen!r} is not HOST:PORT")
    return host or "127.0.0.1", int(port)


def make_server(storage: StorageBackend, listen: str = "127.0.0.1:8080") -> ThreadingHTTPServer:
    return ThreadingHTTPServer(parse_listen(listen), handler(Service(storage)))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera.tools.server")
    parser.add_argument("--table", default=os.environ.get("TESSERA_TABLE"))
    parser.add_argument("--listen", default="127.0.0.1:8080")
    given = parser.parse_args(args)
    if not given.table:
        parser.error("--table or TESSERA_TABLE is needed")
    spark = None
    if "://" in given.table and not given.table.startswith("file://"):  # a shared store, through Hadoop
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    make_server(open_storage(spark, given.table), given.listen).serve_forever()


if __name__ == "__main__":
    main()
