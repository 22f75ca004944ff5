from __future__ import annotations

import datetime
import gc
import io
import itertools
import json
import math
import struct
import threading
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pipeloom import errors as E
from pipeloom.cli import main
from pipeloom.engine import Engine, Step, Token
from pipeloom.sources.catalog import Catalog, parse_schema
from pipeloom.sources import csv as csv_source
from pipeloom.sources.csv import CsvDecoder, decode, import_csv, import_csv_file
from pipeloom.sources.jsonl import export_jsonl
from pipeloom.sources.lineitem import load_lineitem
from pipeloom.sources.parquet import export_parquet, import_parquet
from pipeloom.sources.store import Store
from pipeloom.streaming.incremental import prepare_stream, run_into_memory, run_into_table

COLUMNS = [("note", "STRING", True), ("amount", "INT64", False), ("number", "DOUBLE", True), ("day", "DATE", True)]
DAY = datetime.date(2000, 2, 29)


@pytest.fixture
def catalog(spark, tmp_path):
    found = Catalog.create(spark, str(tmp_path / "db"))
    found.declare_table("t", COLUMNS)
    return found


def put(catalog, rows, table="t"):
    append = catalog.begin_append(table)
    append.write(rows)
    append.commit()
    return append.token


def test_declare_and_inspect(spark, catalog):
    assert catalog.inspect_table("T").columns == tuple(COLUMNS)
    with pytest.raises(E.AlreadyExists):
        catalog.declare_table("T", COLUMNS)
    with pytest.raises(E.NotFound):
        catalog.inspect_table("u")
    for name, columns in [("1x", COLUMNS), ("u", []), ("u", [("a", "INT64", True), ("A", "INT64", True)]), ("u", [("a", "BOOL", True)])]:
        with pytest.raises(E.InvalidName):
            catalog.declare_table(name, columns)


def test_snapshots_and_resolution(spark, catalog):
    engine = Engine(spark, catalog)
    first = put(catalog, [("a", 1, 1.0, DAY)])
    before = engine.prepare("FROM t |> SELECT amount")
    append = catalog.begin_append("t")
    append.write([("b", 2, None, None)])
    assert catalog.resolve(append.token) is None
    append.commit()
    assert before.rows() == [(1,)]
    assert sorted(engine.prepare("FROM t |> SELECT amount").rows()) == [(1,), (2,)]
    assert catalog.resolve(first) == 2 and catalog.resolve(append.token) == 3
    catalog.reclaim()
    assert before.rows() == [(1,)]
    assert catalog.resolve(first) == 2


def test_abort_and_bad_cells(catalog):
    append = catalog.begin_append("t")
    append.write([("a", 1, 1.0, DAY)])
    append.abort()
    assert catalog.snapshot().entry("t")["files"] == []
    for row in [("a", None, 1.0, DAY), ("a", 2**63, 1.0, DAY), ("a", 1, 1, DAY), (1, 1, 1.0, DAY), ("a", 1, 1.0), ("x" * 65_537, 1, 1.0, DAY), ("a", True, 1.0, DAY)]:
        with pytest.raises(E.InputError):
            catalog.begin_append("t").write([row])


def test_two_writers(catalog):
    one, two = catalog.begin_append("t"), catalog.begin_append("t")
    one.write([("a", 1, None, None)])
    two.write([("b", 2, None, None)])
    assert two.commit() + 1 == one.commit()
    assert len(catalog.snapshot().entry("t")["files"]) == 2


CSV = b'AMOUNT,note,"day",number\r\n1,\\N,2000-02-29,1.5\n-2,"\\N",\\N,-Infinity\n+03,"a ""q"",\r\nb",0001-01-01,.5e1\n4,,9999-12-31,NaN'


def test_csv(spark, catalog):
    generation, rows, token = import_csv(catalog, "t", io.BytesIO(CSV))
    assert rows == 4 and catalog.resolve(token) == generation
    found = Engine(spark, catalog).prepare("FROM t |> ORDER BY amount").rows()
    assert [r[:2] for r in found] == [("\\N", -2), (None, 1), ('a "q",\r\nb', 3), ("", 4)]
    assert [r[3] for r in found] == [None, DAY, datetime.date(1, 1, 1), datetime.date(9999, 12, 31)]
    assert found[0][2] == -math.inf and found[2][2] == 5.0 and math.isnan(found[3][2])


@pytest.mark.parametrize(
    ("data", "offset"),
    [
        (b"", 0), (b"amount,note,day\n", 15), (b"amount,note,day,number\n", 0), (b"amount,note,day,other\n1,a,\\N,\\N\n", 16), (b"amount,amount,day,number\n", 7), (b"amount,note,day,number\n1,a\n", 26),
        (b"amount,note,day,number\n1,a,\\N,\\N,x\n", 33), (b"amount,note,day,number\n\\N,a,\\N,\\N\n", 23), (b"amount,note,day,number\n1 ,a,\\N,\\N\n", 23), (b"amount,note,day,number\n1,a\rb,\\N,\\N\n", 26), (b'amount,note,day,number\n1,"a"b,\\N,\\N\n', 28),
        (b'amount,note,day,number\n1,a"b,\\N,\\N\n', 26), (b'amount,note,day,number\n1,"a', 27), (b"amount,note,day,number\n1,\xff,\\N,\\N\n", 25), (b"amount,note,day,number\n1,a,2001-02-29,\\N\n", 27), (b"amount,note,day,number\n1,a,\\N,1e999\n", 30), (b"amount,note,day,number\n9223372036854775808,a,\\N,1\n", 23),
    ],
)
def test_csv_failures(data, offset):
    with pytest.raises(E.InputError) as failure:
        list(decode(data, COLUMNS))
    assert failure.value.byte_offset == offset


@pytest.mark.parametrize(("limits", "at"), [({"record_limit": 23}, b"3,aaa"), ({"field_limit": 8}, b"aaaaaaaaaaaaa"), ({"row_limit": 2}, b"3,aaa")])
def test_csv_limits(limits, at):
    data = b"amount,note,day,number\n1,a,\\N,\\N\n2,aaaaaa,\\N,1.5\n3,aaaaaaaaaaaaaaaaaaaa,\\N,2.5\n"
    with pytest.raises(E.InputError) as failure:
        list(decode(data, COLUMNS, **limits))
    assert failure.value.byte_offset == data.index(at)


def test_csv_decoder_batches():
    decoder = CsvDecoder(io.BytesIO(CSV), COLUMNS, 3)
    assert [len(decoder.next_batch()), len(decoder.next_batch()), decoder.next_batch()] == [3, 1, None]
    bad = CsvDecoder(io.BytesIO(CSV + b"\nx,a,\\N,\\N"), COLUMNS)
    for _ in range(2):
        with pytest.raises(E.InputError):
            bad.next_batch()


def test_csv_files_in_parallel(spark, catalog, tmp_path, monkeypatch):
    lines = ["amount,note,day,number"] + [f'{k},"n ""{k}""",\\N,{k}.5' for k in range(500)] + ["7,amount,\\N,1"]
    (tmp_path / "plain.csv").write_text("\r\n".join(lines))
    monkeypatch.setattr(csv_source, "import_csv", None)  # not needed: the executors decode both
    assert import_csv_file(catalog, "t", str(tmp_path / "plain.csv"))[1] == 501
    (tmp_path / "quoted.csv").write_bytes(CSV)  # with a line end inside quotes
    assert import_csv_file(catalog, "t", str(tmp_path / "quoted.csv"))[1] == 4
    monkeypatch.undo()
    (tmp_path / "bad.csv").write_text("\n".join([*lines, "x,y,\\N,1"]))
    with pytest.raises(E.InputError) as failure:
        import_csv_file(catalog, "t", str(tmp_path / "bad.csv"))
    assert failure.value.byte_offset == len("\n".join(lines)) + 1
    assert len(Engine(spark, catalog).prepare("FROM t").rows()) == 505


@pytest.fixture
def small_blocks(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def test_csv_records_across_blocks(spark, catalog, tmp_path, monkeypatch, small_blocks):
    """Records over several blocks, blocks inside one record, quotes and line ends in every place."""
    texts = ['"', "\n", '"\n"', "a\n" * 90, "\r\n,", '""', ",\n" * 40 + '"', "plain", "é\n" * 30, "", "x" * 200, '\n"' * 50]
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    lines = [f"{k},{quoted(texts[k % len(texts)])},\\N,{k}.5" for k in range(60)]
    (tmp_path / "x.csv").write_bytes("\r\n".join(["amount,note,day,number", *lines]).encode())
    assert spark.read.text(str(tmp_path / "x.csv")).select("_metadata.file_block_start").distinct().count() > 20
    monkeypatch.setattr(csv_source, "import_csv", None)
    assert import_csv_file(catalog, "t", str(tmp_path / "x.csv"))[1] == 60
    found = {r[0]: r[1] for r in Engine(spark, catalog).prepare("FROM t |> SELECT amount, note").rows()}
    assert found == {k: texts[k % len(texts)] for k in range(60)}


@pytest.mark.parametrize("tail", ['61,"open,\\N,1', '61,a"b,\\N,1\n62,"c\nd",\\N,1', '61,"a"b,\\N,1', '61,"a\n' * 3, '61,"a\n\n",\\N,x\n62,b,\\N,1'])
def test_csv_invalid_across_blocks(catalog, tmp_path, small_blocks, tail):
    """An invalid file fails at the same byte as in the sequential decoder, and nothing of it stays."""
    data = ("amount,note,day,number\n" + "".join(f'{k},"n\n{k}",\\N,1\n' for k in range(40)) + tail).encode()
    (tmp_path / "x.csv").write_bytes(data)
    with pytest.raises(E.InputError) as expected:
        list(decode(data, COLUMNS))
    with pytest.raises(E.InputError) as failure:
        import_csv_file(catalog, "t", str(tmp_path / "x.csv"))
    assert (failure.value.message, failure.value.byte_offset) == (expected.value.message, expected.value.byte_offset)
    assert catalog.snapshot().entry("t")["files"] == []


def test_csv_record_over_many_blocks_is_refused(catalog, tmp_path, monkeypatch, small_blocks):
    monkeypatch.setattr(csv_source, "MAX_RECORD", 300)
    (tmp_path / "x.csv").write_bytes(b'amount,note,day,number\n1,"' + b"a\n" * 400 + b'",\\N,1\n')
    with pytest.raises(E.InputError) as failure:
        import_csv_file(catalog, "t", str(tmp_path / "x.csv"))
    assert failure.value.message == "record is too long"


def test_csv_import_is_atomic(catalog):
    with pytest.raises(E.InputError):
        import_csv(catalog, "t", io.BytesIO(CSV + b"\nx,a,\\N,\\N"))
    assert catalog.snapshot().entry("t")["files"] == []


def test_jsonl(spark, catalog):
    put(catalog, [("é\0", 2**63 - 1, -0.0, DAY), (None, -1, math.nan, None)])
    out = io.StringIO()
    prepared = Engine(spark, catalog).prepare("FROM t |> ORDER BY amount DESC |> SELECT amount, note, number, day, amount, 1")
    assert export_jsonl(prepared, out) == 2
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [c["name"] for c in lines[0]["columns"]] == ["amount", "note", "number", "day", "amount", None]
    assert lines[1]["row"] == ["9223372036854775807", "é\0", "8000000000000000", "2000-02-29", "9223372036854775807", "1"]
    assert lines[2]["row"][2][:3] == "7ff" and lines[3] == {"complete": True, "rows": 2}
    for limits in ({"row_limit": 1}, {"byte_limit": 100}):
        with pytest.raises(E.ResourceError):
            export_jsonl(prepared, io.StringIO(), **limits)


def test_parquet_round_trip(spark, catalog, tmp_path):
    put(catalog, [("a", 1, -0.0, DAY), (None, 2, math.inf, None)])
    engine = Engine(spark, catalog)
    export_parquet(engine.prepare("FROM t"), str(tmp_path / "out"), single_file=True)
    catalog.declare_table("u", COLUMNS)
    import_parquet(catalog, "u", str(tmp_path / "out"))
    found = engine.prepare("FROM u |> ORDER BY amount").rows()
    assert found == [("a", 1, -0.0, DAY), (None, 2, math.inf, None)] and struct.pack(">d", found[0][2])[0] == 0x80
    for bad in ("FROM t |> SELECT amount, amount", "FROM t |> SELECT amount + 1"):
        with pytest.raises(E.InvalidName):
            export_parquet(engine.prepare(bad), str(tmp_path / "bad"))


@pytest.mark.parametrize(
    "table",
    [
        pa.table({"note": ["a"], "amount": pa.array([1], pa.int32()), "number": [1.0], "day": [DAY]}),
        pa.table({"note": ["a"], "amount": [1], "number": [1.0]}),
        pa.table({"note": ["a"], "amount": pa.array([None], pa.int64()), "number": [1.0], "day": [DAY]}),
        pa.table({"note": pa.array([], pa.string()), "amount": pa.array([], pa.int64()), "number": pa.array([], pa.float64()), "day": pa.array([], pa.date32())}),
    ],
)
def test_parquet_refused(catalog, tmp_path, table):
    pq.write_table(table, tmp_path / "in.parquet")
    with pytest.raises(Exception):  # noqa: B017 - the write itself fails on NULL in a required column
        import_parquet(catalog, "t", str(tmp_path / "in.parquet"))
    assert catalog.snapshot().entry("t")["files"] == []


LINE = "1|2|3|4|17|2116.23|0.04|0.02|N|O|1996-03-13|x|y|z|w|v|\n"


def test_lineitem_loader(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path / "db"))
    (tmp_path / "good").write_text(LINE + LINE.replace("17", "-inf").replace("|N|", "| |"))
    load_lineitem(catalog, str(tmp_path / "good"))
    found = Engine(spark, catalog).prepare("FROM lineitem |> ORDER BY l_quantity").rows()
    assert found[1] == (17.0, 2116.23, 0.04, 0.02, "N", "O", datetime.date(1996, 3, 13)) and found[0][0] == -math.inf
    for bad in (LINE.replace("17", "+17"), LINE.replace("17", "1e1"), LINE[:-2] + "\n", LINE.replace("|N|", "|NN|"), LINE.replace("03-13", "02-30"), LINE.replace("x", "x\r"), LINE.replace("x", "x" * 512)):
        (tmp_path / "bad").write_bytes(bad.encode())
        with pytest.raises(Exception):  # noqa: B017
            load_lineitem(catalog, str(tmp_path / "bad"))
    assert len(Engine(spark, catalog).prepare("FROM lineitem").rows()) == 2


def test_schema_files():
    assert parse_schema(b"table sales\r\nday date required\nregion  string nullable") == ("sales", [("day", "DATE", False), ("region", "STRING", True)])
    for bad, offset in [(b"sales\n", 0), (b"table s\na int nullable\n", 8), (b"table s\n\na int64 nullable", 8), (b"table s\na int64 maybe\n", 8)]:
        with pytest.raises(E.InputError) as failure:
            parse_schema(bad)
        assert failure.value.byte_offset == offset


def test_command_line(spark, tmp_path, capsys):
    db = ["--database", str(tmp_path / "db")]
    (tmp_path / "s").write_text("table sales\nday date required\nregion string required\namount int64 nullable\n")
    (tmp_path / "in.csv").write_text("day,region,amount\n2026-01-01,north,10\n2026-01-01,south,\\N\n")
    (tmp_path / "q").write_text("FROM sales |> AGGREGATE SUM(amount) AS total, COUNT(*) AS n GROUP AND ORDER BY region")

    def run(*args):
        code = main([*args], spark)
        return code, capsys.readouterr().out

    assert run("create-declared", *db)[0] == 0
    assert run("declare", *db, "--schema-file", str(tmp_path / "s"))[0] == 0
    code, out = run("import", *db, "--table", "sales", "--input", str(tmp_path / "in.csv"))
    token = out.split("transaction=")[1].strip()
    assert "status=durable" in run("resolve", *db, "--transaction", token)[1]
    assert "column[2]=amount:int64:nullable" in run("schema", *db, "--table", "sales")[1]
    out = run("query", *db, "--query-file", str(tmp_path / "q"))[1]
    assert "row=string:6e6f727468|int64:10|int64:1\nrow=string:736f757468|null|int64:1\nrow_count=2\nstatus=queried" in out
    assert "aggregate input=r0 ordered=true" in run("explain", *db, "--query-file", str(tmp_path / "q"))[1]
    assert run("export", *db, "--query-file", str(tmp_path / "q"))[1].count("\n") == 4
    assert run("create-declared", *db)[0] == 1
    with pytest.raises(SystemExit) as usage:
        main(["query", *db], spark)
    assert usage.value.code == 2


def test_cancellation(spark, catalog):
    put(catalog, [("a", k, None, None) for k in range(10)])
    token = Token()
    batches = Engine(spark, catalog).prepare("FROM t").batches(token, 2)
    next(batches)
    token.cancel()
    with pytest.raises(E.Cancelled):
        list(batches)


def test_cancellation_inside_a_job(spark):
    """A token stops a Spark job that has given no row yet."""
    slow = spark.range(4).select(F.expr("java_method('java.lang.Thread', 'sleep', 20000L)").alias("x"), "id")
    engine = Engine(spark)
    engine.register("slow", slow)
    token = Token()
    cursor = engine.prepare("FROM slow |> AGGREGATE MAX(x) AS x, COUNT(*) AS n").cursor(token)
    started = time.monotonic()
    assert cursor.step()[0] is Step.PROGRESS
    threading.Timer(1.0, token.cancel).start()
    kind, error = cursor.step()
    while kind is Step.PROGRESS:
        kind, error = cursor.step()
    assert kind is Step.FAILED and isinstance(error, E.Cancelled) and time.monotonic() - started < 10
    assert cursor.step() == (kind, error)
    status = spark.sparkContext.statusTracker()
    deadline = time.monotonic() + 10
    while status.getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not status.getActiveJobsIds()


def test_cursor_states(spark):
    engine = Engine(spark)
    engine.register("t", spark.range(600))
    prepared = engine.prepare("FROM t |> ORDER BY id |> SELECT id, DIV(100, 599 - id) AS d")
    cursor, seen = prepared.cursor(size=100), []
    kind, found = cursor.step()
    while kind in (Step.PROGRESS, Step.ROWS):
        seen.append(kind)
        kind, found = cursor.step()
    assert kind is Step.FAILED and isinstance(found, E.DivisionByZero) and cursor.step() == (kind, found)
    cursor = engine.prepare("FROM t |> ORDER BY id").cursor(size=250)
    sizes = []
    while (step := cursor.step())[0] in (Step.PROGRESS, Step.ROWS):
        sizes += [len(step[1])] if step[0] is Step.ROWS else []
    assert step == cursor.step() == (Step.FINISHED, None) and sizes == [250, 250, 100]
    closed = prepared.cursor()
    closed.close()
    assert closed.step()[0] is Step.FAILED


def test_reclaim_and_open_appends(spark, catalog):
    append = catalog.begin_append("t")
    append.write([("a", k, None, None) for k in range(5)])
    append._flush()
    with pytest.raises(E.Contention):
        catalog.reclaim()
    generation = append.commit()
    assert catalog.reclaim() > 0 and catalog.resolve(append.token) == generation
    assert Engine(spark, catalog).prepare("FROM t |> AGGREGATE COUNT(*) AS n").rows() == [(5,)]
    dropped = catalog.begin_append("t")
    dropped.write([("b", 1, None, None)])
    dropped._flush()
    del dropped
    gc.collect()
    catalog.reclaim()
    stale = catalog.begin_append("t")
    stale.write([("c", 1, None, None)])
    stale._flush()
    catalog.reclaim(lease_seconds=0)  # as if its process had died long ago
    with pytest.raises(E.Contention):
        stale.commit()
    stale.abort()
    assert len(catalog.store.names("data")) == 1
    assert Engine(spark, catalog).prepare("FROM t |> AGGREGATE COUNT(*) AS n").rows() == [(5,)]
    catalog.store.create("leases/cleanup", "another")
    for refused in (catalog.reclaim, lambda: catalog.begin_append("t")):
        with pytest.raises(E.Contention):
            refused()


def test_object_stores_are_refused(spark):
    class Fs:
        def getUri(self):
            return self

        def getScheme(self):
            return "s3a"

        def getFileSystem(self, _):
            return self

    class Fake(Store):
        def path(self, name):
            return Fs()

    with pytest.raises(E.Unsupported):
        Fake(spark, "s3a://bucket/db")


@pytest.mark.parametrize("chunk", [1, 3, 7, 64])
def test_csv_in_pieces(monkeypatch, chunk):
    """Pieces of any size give the rows and the failures of the whole."""
    whole = list(decode(CSV, COLUMNS))
    bad = [b"amount,note,day,number\n1,\"a\"b,\\N,\\N\n", b"amount,note,day,number\n1,a\rb,\\N,\\N\n", b"amount,note,day,number\n1,\"a", b"amount,note,day,number\n1,a,\\N,1e999\n", b"amount,note,day,number\r\n1,a\"b,\\N,1\r\n"]
    places = []
    for data in bad:
        with pytest.raises(E.InputError) as failure:
            list(decode(data, COLUMNS))
        places.append((failure.value.message, failure.value.byte_offset))
    monkeypatch.setattr(csv_source, "CHUNK", chunk)
    assert repr(list(decode(CSV, COLUMNS))) == repr(whole)
    for data, place in zip(bad, places, strict=True):
        with pytest.raises(E.InputError) as failure:
            list(decode(data, COLUMNS))
        assert (failure.value.message, failure.value.byte_offset) == place


def test_csv_reads_as_it_goes():
    class Endless(io.RawIOBase):
        def __init__(self):
            self.lines, self.seen = itertools.count(), b"amount,note,day,number\n"

        def read(self, size=-1):
            while len(self.seen) < size:
                self.seen += b"%d,a,\\N,1.5\n" % next(self.lines)
            out, self.seen = self.seen[:size], self.seen[size:]
            return out

    decoder = CsvDecoder(Endless(), COLUMNS, 1000)
    for k in range(200):
        assert decoder.next_batch()[0][1] == k * 1000


def test_failures_of_a_job_are_no_doubt(spark, catalog, tmp_path, monkeypatch):
    (tmp_path / "x.csv").write_text("amount,note,day,number\n1,a,\\N,1\n")

    def broken(*_):
        raise RuntimeError("an executor was lost")

    monkeypatch.setattr(csv_source, "parallel_rows", broken)
    with pytest.raises(RuntimeError):
        import_csv_file(catalog, "t", str(tmp_path / "x.csv"))
    assert catalog.store.names("data") == []


def test_streaming(spark, catalog, tmp_path):
    source = tmp_path / "stream"
    pq_rows = [{"k": k % 3, "v": k} for k in range(9)]
    spark.createDataFrame(pq_rows, "k long, v long").coalesce(1).write.parquet(str(source))
    engine = Engine(spark)
    engine.register("events", spark.readStream.schema("k long, v long").parquet(str(source)))
    catalog.declare_table("big", [("v", "INT64", True), ("twice", "INT64", True)])
    for _ in range(2):  # a restart from the checkpoint adds nothing twice
        query = run_into_table(engine, "FROM events |> WHERE v > 4 |> SELECT v, v * 2 AS twice", catalog, "big", str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    assert sorted(Engine(spark, catalog).prepare("FROM big").rows()) == [(v, 2 * v) for v in range(5, 9)]
    query = run_into_memory(engine, "FROM events |> AGGREGATE SUM(v) AS s GROUP BY k", "stream_sums", "complete")
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("stream_sums").collect()) == [(0, 9), (1, 12), (2, 15)]
    for bad in ("FROM events |> ORDER BY v", "FROM events |> LIMIT 1", "FROM events |> EXTEND COUNT(*) OVER ()"):
        with pytest.raises(E.Unsupported):
            prepare_stream(engine, bad)
