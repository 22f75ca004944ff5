"""Parquet import and export with exact type matching."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .. import errors as E
from ..engine import Prepared
from .catalog import Catalog


def import_parquet(catalog: Catalog, table: str, path: str, row_limit: int | None = None) -> tuple[int, str]:
    """Append a Parquet file or directory in one transaction: (generation, token).  An empty input is refused."""
    append = catalog.begin_append(table)
    try:
        df = catalog.spark.read.parquet(path)
        rows = df.limit((row_limit or 0) + 1).count() if row_limit is not None else df.limit(1).count()
        if rows == 0:
            raise E.InputError("no data rows")
        if row_limit is not None and rows > row_limit:
            raise E.ResourceError("input rows", rows, row_limit)
        append.write_dataframe(df)
        return append.commit(), append.token
    except BaseException:
        append.abort()
        raise


def exportable(prepared: Prepared) -> DataFrame:
    """The result, after its column names were found unique and valid."""
    seen: set[str] = set()
    for name, _, _ in prepared.columns:
        if name is None or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,31}", name) or name.lower() in seen:
            raise E.InvalidName(f"result column {name!r} needs a valid, unique name")
        seen.add(name.lower())
    return prepared.dataframe()


def export_parquet(prepared: Prepared, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """Write the result as uncompressed Parquet, in parallel unless ``single_file``."""
    df = exportable(prepared)
    try:
        (df.coalesce(1) if single_file else df).write.mode(mode).option("compression", "uncompressed").parquet(path)
    except Exception as e:
        raise prepared.typed(e) from e
