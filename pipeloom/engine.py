"""The engine: tables, prepared queries, results."""

from __future__ import annotations

import contextlib
import enum
import functools
import queue
import re
import threading
import uuid
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import errors as E
from .functions.scalars import MARK
from .operators.relational import dataframe
from .plans import logical as L
from .plans.binder import Binder
from .plans.explain import explain
from .plans.parser import parse

#: Rules of Catalyst that would evaluate rows that no result demands.
EXCLUDED = "org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation"
BATCH_ROWS = 256
WIDENED = {"tinyint": "INT64", "smallint": "INT64", "int": "INT64", "bigint": "INT64", "float": "DOUBLE", "double": "DOUBLE", "string": "STRING", "date": "DATE"}


@dataclass
class Table:
    """A named source: typed columns over a DataFrame.  ``stamps``: DATE column -> stored timestamp column."""

    name: str
    columns: list[tuple[str, str, bool]]
    frame: DataFrame
    stamps: dict[str, str]


def adapt(name: str, df: DataFrame, dates: tuple[str, ...] = ()) -> Table:
    """A DataFrame as a table: integers widen to INT64, float to DOUBLE, timestamps named in ``dates`` become DATE, other types go."""
    columns, selected, stamps = [], [], {}
    for f in df.schema.fields:
        stored = f.dataType.simpleString()
        type_ = WIDENED.get(stored)
        quoted = "`" + f.name.replace("`", "``") + "`"
        if f.name in dates and stored.startswith("timestamp"):
            stamps[f.name] = f"{f.name}__stamp"
            selected += [f"CAST({quoted} AS date) AS {quoted}", f"{quoted} AS `{stamps[f.name]}`"]
            columns.append((f.name, "DATE", True))
        elif type_:
            spark_type = {"INT64": "bigint", "DOUBLE": "double"}.get(type_, stored)
            selected.append(quoted if stored == spark_type else f"CAST({quoted} AS {spark_type}) AS {quoted}")
            columns.append((f.name, type_, True))
    return Table(name, columns, df.selectExpr(*selected), stamps)


class Token:
    """Cancels queries that run with it, also in the middle of a Spark job.  A cancelled token stays so."""

    def __init__(self) -> None:
        self._event = threading.Event()
        self._lock = threading.Lock()
        self._actions: list = []

    def cancel(self) -> None:
        with self._lock:
            self._event.set()
            actions, self._actions = self._actions, []
        for action in actions:
            action()

    def on_cancel(self, action) -> None:
        """Call ``action`` at cancellation, at once if that has been."""
        with self._lock:
            if not self._event.is_set():
                self._actions.append(action)
                return
        action()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()


class Step(enum.Enum):
    """What a step of a cursor found."""

    ROWS = "rows"
    PROGRESS = "progress"
    FINISHED = "finished"
    FAILED = "failed"


class Cursor:
    """One run of a prepared query, stepped by its reader.

    ``step`` gives (Step.ROWS, rows), (Step.PROGRESS, None) while Spark is at work,
    (Step.FINISHED, None) or (Step.FAILED, error); the last two stay.  Only FINISHED says
    that the rows seen are the complete answer.  Dropping or closing a cursor cancels its
    Spark jobs.  A Spark job runs in a thread of its own, at most ``AHEAD`` batches ahead.
    """

    AHEAD, WAIT = 4, 0.05

    def __init__(self, prepared: Prepared, token: Token | None = None, size: int = BATCH_ROWS):
        self._found: queue.Queue = queue.Queue(self.AHEAD)
        self._end: tuple | None = None
        self._closed = threading.Event()
        self._tag = f"pipeloom-{uuid.uuid4().hex}"
        self._context = prepared.engine.spark.sparkContext
        self.token = token or Token()
        args = (prepared, self.token, size, self._found, self._closed, self._tag)
        self._thread = threading.Thread(target=_run, args=args, daemon=True)
        stop = functools.partial(_stop, self._context, self._closed, self._tag)
        self.token.on_cancel(stop)
        self._finalizer = weakref.finalize(self, stop)
        self._thread.start()

    def step(self) -> tuple[Step, object]:
        if self._end is None and self.token.cancelled:
            self._end = (Step.FAILED, E.Cancelled("the query was cancelled"))
        if self._end is not None:
            return self._end
        try:
            kind, found = self._found.get(timeout=self.WAIT)
        except queue.Empty:
            return Step.PROGRESS, None
        if kind in (Step.FINISHED, Step.FAILED):
            self._end = (kind, found)
            self._finalizer.detach()
        return kind, found

    def close(self) -> None:
        """Abandon the run; a cursor that hasn't ended has failed then."""
        if self._end is None:
            self._end = (Step.FAILED, E.Cancelled("the cursor was closed"))
            self._finalizer()


def _stop(context, closed: threading.Event, tag: str) -> None:
    closed.set()
    try:
        context.cancelJobsWithTag(tag)
    except Exception:  # noqa: BLE001 - the context may have been stopped
        pass


def _run(prepared: Prepared, token: Token, size: int, found: queue.Queue, closed: threading.Event, tag: str) -> None:
    """Fill a cursor's queue; ends early once the cursor is closed."""

    def put(item: tuple) -> bool:
        while not closed.is_set():
            try:
                found.put(item, timeout=Cursor.WAIT)
                return True
            except queue.Full:
                continue
        return False

    context = prepared.engine.spark.sparkContext
    try:
        context.addJobTag(tag)
        batch: list[tuple] = []
        for row in prepared.dataframe().toLocalIterator():
            if closed.is_set():
                return
            batch.append(tuple(row))
            if len(batch) == size:
                if not put((Step.ROWS, batch)):
                    return
                batch = []
        if not batch or put((Step.ROWS, batch)):
            put((Step.FINISHED, None))
    except Exception as e:  # noqa: BLE001 - the reader gets it
        put((Step.FAILED, E.Cancelled("the query was cancelled") if token.cancelled else prepared.typed(e)))
    finally:
        with contextlib.suppress(Exception):
            context.removeJobTag(tag)


class Prepared:
    """A bound query over one snapshot of its tables."""

    def __init__(self, engine: Engine, text: str, plan: L.Plan):
        self.engine, self.text, self.plan = engine, text, plan

    @property
    def columns(self) -> list[tuple[str | None, str, bool]]:
        """(name, type, nullable) of each result column; unnamed ones have None."""
        return [(name, c.type, c.nullable) for name, c in self.plan.output]

    def logical_plan(self) -> str:
        return explain(self.plan)

    def dataframe(self) -> DataFrame:
        """The lazy result: Catalyst optimises the whole pipeline."""
        self.engine.configure()
        return dataframe(self.plan, lambda t: (t.frame, t.stamps))

    def rows(self) -> list[tuple]:
        """All rows on the driver; for small results."""
        try:
            return [tuple(r) for r in self.dataframe().collect()]
        except Exception as e:
            raise self.typed(e) from e

    def cursor(self, token: Token | None = None, size: int = BATCH_ROWS) -> Cursor:
        """Start a run, to be stepped through."""
        return Cursor(self, token, size)

    def batches(self, token: Token | None = None, size: int = BATCH_ROWS) -> Iterator[list[tuple]]:
        """The result in batches of at most ``size`` rows; only exhaustion means that it is complete."""
        cursor = self.cursor(token, size)
        try:
            while True:
                kind, found = cursor.step()
                if kind is Step.ROWS:
                    yield found
                elif kind is Step.FAILED:
                    raise found
                elif kind is Step.FINISHED:
                    return
        finally:
            cursor.close()

    def typed(self, error: Exception) -> Exception:
        """The engine's failure behind a Spark exception, else the exception."""
        return typed(error, self.plan.arithmetic, len(self.text.encode()))


def typed(error: Exception, arithmetic: list, length: int) -> Exception:
    text = str(error)
    found = re.search(rf"{MARK}\|(\w+)\|([^|]*)\|(\d+)\|(\d+)", text)
    if found:
        kind, operation, span = found[1], found[2], E.Span(int(found[3]), int(found[4]))
        return {"zero": lambda: E.DivisionByZero(span), "overflow": lambda: E.ArithmeticOverflow(operation, span), "domain": lambda: E.ArithmeticDomain(operation, span)}[kind]()
    if "ARITHMETIC_OVERFLOW" in text or "overflow" in text and "ArithmeticException" in text:
        return E.ArithmeticOverflow("arithmetic", arithmetic[0] if arithmetic else E.Span(0, length))
    return error


class Engine:
    """``strict`` keeps the language's size limits (text, tokens, stages, columns)."""

    def __init__(self, spark: SparkSession, catalog=None, strict: bool = True):
        self.spark, self.catalog, self.strict = spark, catalog, strict
        self.tables: dict[str, Table] = {}

    def configure(self) -> None:
        """Leave out, in this session, a rule that would raise errors of rows that no result demands.  Lazy results need it after this call; other queries only lose that one folding."""
        conf = self.spark.conf
        rules = conf.get("spark.sql.optimizer.excludedRules", None) or ""
        if EXCLUDED not in rules:
            conf.set("spark.sql.optimizer.excludedRules", f"{rules},{EXCLUDED}".strip(","))

    def register(self, name: str, df: DataFrame, dates: tuple[str, ...] = ()) -> None:
        """Make a DataFrame (a Parquet directory, say) a table for queries."""
        self.tables[name.lower()] = adapt(name, df, dates)

    def register_table(self, table: Table) -> None:
        self.tables[table.name.lower()] = table

    def prepare(self, text: str) -> Prepared:
        """Parse and bind; every name, type and constant failure is raised here."""
        snapshot = self.catalog.snapshot() if self.catalog else None
        found: dict[str, Table] = {}

        def lookup(name: str, span: E.Span) -> Table:
            key = name.lower()
            if key not in found:
                if key in self.tables:
                    found[key] = self.tables[key]
                elif snapshot and snapshot.has(name):
                    found[key] = snapshot.table(self.spark, name)
                else:
                    raise E.BindError("unknown table", span)
            return found[key]

        return Prepared(self, text, Binder(lookup, self.strict).bind(parse(text, self.strict)))

    def query(self, text: str) -> DataFrame:
        return self.prepare(text).dataframe()


def row_type(columns: list[tuple[str, str, bool]]) -> T.StructType:
    kinds = {"INT64": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.DateType()}
    return T.StructType([T.StructField(name, kinds[t], nullable) for name, t, nullable in columns])
