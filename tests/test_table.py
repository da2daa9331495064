import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tessera import ConflictError, LogError, SnapshotReader, Table, WriteConflictError, local_storage
from tessera.functions.sql import register_functions
from tessera.sources.storage import HadoopStorage
from tessera.streaming.log_source import LogStream
from tessera.tools import demo
from tessera.tools.server import make_server, parse_listen


def test_rows_by_version(spark, tmp_path):
    table = Table(spark, tmp_path)
    assert [table.append(spark.range(n)) for n in (3, 4)] == [0, 1]
    pinned = table.reader()
    table.overwrite(spark.range(100, 110))
    assert [table.reader(v).df().count() for v in range(3)] == [3, 7, 10]
    assert pinned.df().count() == 7
    assert table.rows_between(0, 1).count() == 4 and table.rows_between(2, 2).count() == 0
    plan = table.reader().df().where("id > 105").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,105)]" in plan


def test_overwrite_conflicts(spark, tmp_path):
    table = Table(spark, tmp_path)
    table.append(spark.range(3))
    txn = table.transaction()
    txn.track_reads_of(table.reader().df())
    written = txn.add_dataframe(spark.range(1))
    assert txn.read_set == set(table.reader().files)
    table.overwrite(spark.range(5))
    with pytest.raises(WriteConflictError):
        txn.commit()
    assert not any(table.storage.exists(f"data/{f}") for f in written)
    late = table.transaction()
    late.add_dataframe(spark.range(1))
    table.append(spark.range(1))
    with pytest.raises(ConflictError):
        late.commit()


def test_empty_snapshots_and_placeholders(spark, tmp_path):
    table = Table(spark, tmp_path)
    with pytest.raises(LogError):
        table.reader().df()
    assert table.reader().df("id long").count() == 0
    table.append(spark.range(3))
    txn = table.transaction()
    for f in table.reader().files:
        txn.remove(f)
    txn.commit()
    assert table.reader().df().columns == ["id"] and table.reader().df().count() == 0
    txn = table.transaction()
    txn.add("named.parquet")
    txn.commit()
    assert table.reader().df("id long").count() == 0
    table.append(spark.range(2))
    assert table.reader().df().count() == 2


def test_version_whose_files_are_gone(spark, tmp_path):
    table = Table(spark, tmp_path)
    table.append(spark.range(3))
    table.overwrite(spark.range(4))
    assert table.vacuum_plan(1).count() == len(table.vacuum(1).deleted_files) > 0
    with pytest.raises(LogError):
        table.reader(0).df()
    assert table.reader().df().count() == 4


def test_sql(spark, tmp_path):
    table = Table(spark, tmp_path)
    table.append(spark.range(3))
    table.append(spark.range(3))
    table.register("t")
    assert spark.sql("SELECT count(*) FROM t").first()[0] == 6
    assert spark.sql("SELECT max(version) FROM t_log").first()[0] == 1
    register_functions(spark)
    assert spark.sql(f"SELECT sum(n_adds) FROM table_versions('{tmp_path}')").first()[0] == len(table.reader().files)
    assert spark.sql(f"SELECT * FROM table_snapshot('{tmp_path}', 0)").count() == len(table.reader(0).files)


def test_log_as_a_stream(spark, tmp_path):
    table = Table(spark, tmp_path / "t")
    for name in ("a", "b"):
        txn = table.transaction()
        txn.add(name)
        txn.commit()
    spark.dataSource.register(LogStream)
    stream = spark.readStream.format("tessera_log").option("path", str(tmp_path / "t")).option("versionsPerPartition", "1").load()
    query = stream.writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    txn = table.transaction()
    txn.remove("a")
    txn.commit()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("SELECT version, file, act FROM log_rows ORDER BY version").collect()
    assert [tuple(r) for r in rows] == [(0, "a", 0), (1, "b", 0), (2, "a", 1)]


def test_hadoop_storage(spark, tmp_path):
    storage = HadoopStorage(spark, f"file://{tmp_path}/t")
    table = Table(spark, storage)
    table.append(spark.range(3))
    table.append(spark.range(4))
    assert table.reader().df().agg(F.count("*")).first()[0] == 7
    table.overwrite(spark.range(1))
    assert len(table.vacuum().deleted_files) > 0
    storage.write_all_text("data/x", "é")
    assert storage.read_all_text("data/x") == "é" and "x" in storage.list_dir_filenames("data")
    with pytest.raises(FileExistsError):
        storage.rename_no_overwrite("data/x", "metadata/versions/0.json")
    assert table.validate() == 2 and table.recover().was_clean
    assert SnapshotReader(local_storage(tmp_path / "t")).pinned_version == 2


def test_demo(spark, tmp_path):
    assert demo.isolation(spark, str(tmp_path / "1")) == [10, 10, 15]
    assert "expected version 0" in demo.conflict(spark, str(tmp_path / "2"))
    assert demo.recovery(spark, str(tmp_path / "3")) == [1, 2]
    assert demo.time_travel(spark, str(tmp_path / "4"))[:3] == [3, 7, 100]


@pytest.fixture
def call(tmp_path):
    server = make_server(local_storage(tmp_path), "127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def request(method, path, body=None):
        data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, method=method)
        try:
            with urllib.request.urlopen(r) as answer:
                raw = answer.read()
                return answer.status, json.loads(raw) if answer.headers["Content-Type"] == "application/json" else raw
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield request
    server.shutdown()
    server.server_close()


def test_server(call):
    assert call("GET", "/health") == (200, {"ok": True})
    assert call("GET", "/v1/version") == (200, {"latest": -1})
    assert call("POST", "/v1/vacuum", {})[0] == 500
    assert call("PUT", "/v1/blob/data/staging/a.parquet", b"bytes") == (200, {"ok": True, "key": "data/staging/a.parquet", "bytes": 5})
    assert call("POST", "/v1/commit", {"adds": ["a.parquet", "b"]}) == (200, {"version": 0})
    assert call("POST", "/v1/commit", {"removes": ["b"], "read_set": ["b"]}) == (200, {"version": 1})
    assert call("GET", "/v1/snapshot") == (200, {"pinned_version": 1, "files": ["a.parquet"]})
    assert call("GET", "/v1/snapshot?at=0") == (200, {"pinned_version": 0, "files": ["a.parquet", "b"]})
    assert call("GET", "/v1/snapshot?at=7")[0] == 400 and call("GET", "/v1/snapshot?at=abc")[0] == 400
    assert call("GET", "/v1/blob/data/a.parquet") == (200, b"bytes")
    assert call("GET", "/v1/blob/metadata/versions/0.json")[1]["adds"] == ["a.parquet", "b"]
    assert call("GET", "/v1/blob/data/none")[0] == 404 and call("GET", "/v1/blob/data/../x")[0] == 400
    assert call("PUT", "/v1/blob/metadata/versions/0.json", b"x")[0] == 400
    assert call("POST", "/v1/commit", {"adds": ["../x"]})[0] == 400 and call("POST", "/v1/commit", {"adds": "x"})[0] == 400
    assert call("POST", "/v1/validate") == (200, {"valid_through": 1})
    assert call("POST", "/v1/recover")[1]["was_clean"] is True
    assert call("POST", "/v1/vacuum", {"retain_last_n": 1})[1]["deleted_files"] == ["b"]
    assert call("POST", "/v1/vacuum", {"retain_last_n": -1})[0] == 400
    assert call("GET", "/nowhere")[0] == 404 and call("POST", "/v1/commit", b"{")[0] == 400


def test_listen():
    assert parse_listen("0.0.0.0:80") == ("0.0.0.0", 80) and parse_listen(":9") == ("127.0.0.1", 9)
    for bad in ("x", "h:p", "h:99999"):
        with pytest.raises(ValueError):
            parse_listen(bad)
