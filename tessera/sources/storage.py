"""Storage of a table's folder: a small interface, on a local disk or through Hadoop.

Only small things pass through here on the driver: log entries, listings,
deletes and moves. Rows go through Spark's own readers and writers.
"""

from __future__ import annotations

import errno
import os
import shutil
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import LogError
from .layout import normalize


class StorageBackend(ABC):
    """Files by a key relative to the table's root."""

    root: str

    @abstractmethod
    def exists(self, key: str) -> bool: ...

    @abstractmethod
    def read_all_bytes(self, key: str) -> bytes: ...

    @abstractmethod
    def write_all_bytes(self, key: str, data: bytes) -> None: ...

    @abstractmethod
    def mkdirs(self, key: str) -> None: ...

    @abstractmethod
    def remove_file(self, key: str) -> bool:
        """True if the file is gone now; a file that was absent counts."""

    @abstractmethod
    def rename_no_overwrite(self, source: str, target: str) -> None:
        """Moves a file; FileExistsError if target exists, LogError if source does not."""

    @abstractmethod
    def sync_for_durability(self, key: str) -> None: ...

    @abstractmethod
    def list_dir_filenames(self, key: str) -> list[str]:
        """Sorted names of the files right in a folder; none if it is missing."""

    @abstractmethod
    def list_tree(self, key: str) -> list[str]:
        """Sorted paths, relative to the folder, of all files below it."""

    @abstractmethod
    def remove_tree(self, key: str) -> None: ...

    @abstractmethod
    def remove_empty_dir(self, key: str) -> None: ...

    @abstractmethod
    def uri(self, key: str) -> str:
        """What Spark's readers and writers take for a key."""

    def read_all_text(self, key: str) -> str:
        try:
            return self.read_all_bytes(key).decode()
        except UnicodeDecodeError as e:
            raise LogError(f"{key} is not UTF-8") from e

    def write_all_text(self, key: str, text: str) -> None:
        self.write_all_bytes(key, text.encode())

    def mkdir_parents_for_file(self, key: str) -> None:
        self.mkdirs(os.path.dirname(key))


@contextmanager
def _as_log_error(what: str, key: str) -> Iterator[None]:
    try:
        yield
    except FileExistsError:
        raise
    except OSError as e:
        raise LogError(f"cannot {what} {key}: {e}") from e


class LocalStorage(StorageBackend):
    """A folder of a local or mounted file system."""

    def __init__(self, root: str | os.PathLike[str]) -> None:
        self.root = str(Path(root).resolve())

    def _at(self, key: str) -> str:
        return os.path.join(self.root, normalize(key))

    def exists(self, key: str) -> bool:
        return os.path.exists(self._at(key))

    def read_all_bytes(self, key: str) -> bytes:
        with _as_log_error("read", key):
            return Path(self._at(key)).read_bytes()

    def write_all_bytes(self, key: str, data: bytes) -> None:
        with _as_log_error("write", key):
            self.mkdir_parents_for_file(key)
            Path(self._at(key)).write_bytes(data)

    def mkdirs(self, key: str) -> None:
        with _as_log_error("make", key):
            os.makedirs(self._at(key), exist_ok=True)

    def remove_file(self, key: str) -> bool:
        try:
            os.remove(self._at(key))
        except FileNotFoundError:
            pass
        except OSError:
            return False
        return True

    def rename_no_overwrite(self, source: str, target: str) -> None:
        # A hard link is made or fails as one step, unlike a check followed by a rename.
        with _as_log_error("move", source):
            self.mkdir_parents_for_file(target)
            os.link(self._at(source), self._at(target))
        # The move is done; a second name left behind does no harm.
        self.remove_file(source)

    def sync_for_durability(self, key: str) -> None:
        with _as_log_error("sync", key):
            for path in (self._at(key), os.path.dirname(self._at(key))):
                fd = os.open(path, os.O_RDONLY)
                try:
                    os.fsync(fd)
                finally:
                    os.close(fd)

    def list_dir_filenames(self, key: str) -> list[str]:
        try:
            with os.scandir(self._at(key)) as entries:
                return sorted(e.name for e in entries if e.is_file())
        except (FileNotFoundError, NotADirectoryError):
            return []
        except OSError as e:
            raise LogError(f"cannot list {key}: {e}") from e

    def list_tree(self, key: str) -> list[str]:
        top = self._at(key)
        return sorted(os.path.relpath(os.path.join(d, n), top).replace(os.sep, "/") for d, _, names in os.walk(top) for n in names)

    def remove_tree(self, key: str) -> None:
        shutil.rmtree(self._at(key), ignore_errors=True)

    def remove_empty_dir(self, key: str) -> None:
        try:
            os.rmdir(self._at(key))
        except OSError as e:
            if e.errno not in (errno.ENOTEMPTY, errno.ENOENT, errno.EEXIST):
                raise LogError(f"cannot remove {key}: {e}") from e

    def uri(self, key: str) -> str:
        return "file://" + self._at(key)


class HadoopStorage(StorageBackend):
    """A folder of any file system that Hadoop opens: hdfs, abfss or wasbs with a SAS, s3a.

    Credentials are Hadoop settings of the session. A file is published by one
    rename that does not overwrite, so readers see it whole or not at all. That
    needs a store whose rename is atomic (ATOMIC, by scheme); a local disk gets a
    hard link. Other stores are refused unless the caller vouches, by
    single_writer, for one writer at a time.
    """

    #: Schemes of stores that rename without overwriting in one step.
    ATOMIC = ("hdfs", "webhdfs", "abfs", "abfss", "wasb", "wasbs", "ofs", "o3fs")

    def __init__(self, spark: SparkSession, root: str, single_writer: bool = False) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = path.getFileSystem(conf)
        top = self._fs.resolvePath(self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path("/")))
        self._scheme, self._single_writer, self._conf = top.toUri().getScheme(), single_writer, conf

    def _at(self, key: str):  # noqa: ANN202  a Java object
        key = normalize(key)
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def _do(self, what: str, key: str, f: Callable):  # noqa: ANN202
        from py4j.protocol import Py4JJavaError

        try:
            return f()
        except Py4JJavaError as e:
            raise LogError(f"cannot {what} {key}: {e.java_exception}") from e

    def exists(self, key: str) -> bool:
        return self._do("find", key, lambda: self._fs.exists(self._at(key)))

    def read_all_bytes(self, key: str) -> bytes:
        def read() -> bytes:
            stream = self._fs.open(self._at(key))
            try:
                return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()

        return self._do("read", key, read)

    def _create(self, key: str, data: bytes, overwrite: bool) -> None:
        stream = self._fs.create(self._at(key), overwrite)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()

    def write_all_bytes(self, key: str, data: bytes) -> None:
        self._do("write", key, lambda: self._create(key, data, True))

    def mkdirs(self, key: str) -> None:
        self._do("make", key, lambda: self._fs.mkdirs(self._at(key)))

    def remove_file(self, key: str) -> bool:
        try:
            return self._do("remove", key, lambda: self._fs.delete(self._at(key), False) or not self._fs.exists(self._at(key)))
        except LogError:
            return False

    def rename_no_overwrite(self, source: str, target: str) -> None:
        from py4j.protocol import Py4JJavaError

        if self._scheme != "file" and self._scheme not in self.ATOMIC and not self._single_writer:
            raise LogError(f"{self._scheme} has no atomic rename; open the storage with single_writer if one writer at a time is arranged for")
        self.mkdir_parents_for_file(target)
        try:
            self._rename(source, target)
        except Py4JJavaError as e:
            kind = e.java_exception.getClass().getSimpleName()
            if kind == "FileAlreadyExistsException":
                raise FileExistsError(target) from e
            raise LogError(f"cannot move {source} to {target}: {e.java_exception}") from e

    def _rename(self, source: str, target: str) -> None:
        if self._scheme == "file":
            files, at = self._jvm.java.nio.file.Files, lambda key: self._jvm.java.nio.file.Path.of(self._fs.resolvePath(self._at(key)).toUri())
            parent = at(os.path.dirname(target))
            files.createLink(parent.resolve(os.path.basename(target)), at(source))
            self.remove_file(source)
            return
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(self._fs.makeQualified(self._at(source)), self._fs.makeQualified(self._at(target)), options)

    def sync_for_durability(self, key: str) -> None:
        """Nothing to do: files are synced as they are written."""

    def list_dir_filenames(self, key: str) -> list[str]:
        if not self.exists(key):
            return []
        return self._do("list", key, lambda: sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(key)) if s.isFile()))

    def list_tree(self, key: str) -> list[str]:
        if not self.exists(key):
            return []

        def walk() -> list[str]:
            top = self._fs.makeQualified(self._at(key)).toString().rstrip("/")
            files, out = self._fs.listFiles(self._at(key), True), []
            while files.hasNext():
                out.append(files.next().getPath().toString()[len(top) + 1 :])
            return sorted(out)

        return self._do("list", key, walk)

    def remove_tree(self, key: str) -> None:
        self._do("remove", key, lambda: self._fs.delete(self._at(key), True))

    def remove_empty_dir(self, key: str) -> None:
        if self.exists(key) and not self._do("list", key, lambda: list(self._fs.listStatus(self._at(key)))):
            self._do("remove", key, lambda: self._fs.delete(self._at(key), False))

    def uri(self, key: str) -> str:
        return self._at(key).toString()


def local_storage(root: str | os.PathLike[str]) -> LocalStorage:
    return LocalStorage(root)


def azure_sas_settings(host: str, sas: str) -> dict[str, str]:
    """Hadoop settings that open a storage account's containers with a shared access signature."""
    token = sas.strip().lstrip("?&")
    if not host or not token:
        raise LogError("a host and a signature are needed")
    return {f"fs.azure.account.auth.type.{host}": "SAS", f"fs.azure.sas.fixed.token.{host}": token}


def azure_sas_storage(spark: SparkSession, host: str, container: str, sas: str) -> HadoopStorage:
    """A container by HTTPS, through Hadoop's own connector."""
    for name, value in azure_sas_settings(host, sas).items():
        spark.sparkContext._jsc.hadoopConfiguration().set(name, value)
    return HadoopStorage(spark, f"abfss://{container}@{host}")


def open_storage(spark: SparkSession | None, root: str | os.PathLike[str]) -> StorageBackend:
    """By path: a scheme other than file goes through Hadoop, where the setting tessera.singleWriter vouches for one writer."""
    path = str(root)
    if "://" in path and not path.startswith("file://"):
        if spark is None:
            raise LogError(f"{path} needs a session")
        return HadoopStorage(spark, path, spark.conf.get("tessera.singleWriter", "false") == "true")
    return LocalStorage(path.removeprefix("file://"))
