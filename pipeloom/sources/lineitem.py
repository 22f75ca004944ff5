"""Loader of pipe-delimited ``lineitem`` rows: 16 fields and a final ``|``, of which seven become columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog

#: The columns of the loaded table, with each one's place among the 16 fields.
COLUMNS = [
    ("l_quantity", "DOUBLE", 4),
    ("l_extendedprice", "DOUBLE", 5),
    ("l_discount", "DOUBLE", 6),
    ("l_tax", "DOUBLE", 7),
    ("l_returnflag", "STRING", 8),
    ("l_linestatus", "STRING", 9),
    ("l_shipdate", "DATE", 10),
]
MAX_ROW_BYTES = 512


def refuse(message: str, type_: str) -> Column:
    return F.raise_error(F.lit(f"lineitem input: {message}")).cast(type_)


def parse(lines: DataFrame) -> DataFrame:
    """Typed columns of text lines (column ``value``); a malformed line fails the job that reads it."""
    parts = F.split("value", r"\|", -1)
    whole = (F.size(parts) == 17) & (F.get(parts, 16) == "") & ~F.contains("value", F.lit("\r")) & (F.octet_length("value") < MAX_ROW_BYTES)
    good = lines.select(F.when(whole, parts).otherwise(refuse("expected 16 fields and a final |", "array<string>")).alias("f"))
    columns = []
    for name, type_, k in COLUMNS:
        text = F.get("f", k)
        if type_ == "DOUBLE":
            number = F.when(text == "inf", float("inf")).when(text == "-inf", float("-inf")).otherwise(text.cast("double"))
            ok = text.rlike(r"^(-?[0-9]+(\.[0-9]+)?|NaN|-?inf)$") & (F.length(text) <= 32)
            columns.append(F.when(ok, number).otherwise(refuse(f"{name} is no number", "double")).alias(name))
        elif type_ == "STRING":
            columns.append(F.when(text.rlike(r"^[\x20-\x7e]$"), text).otherwise(refuse(f"{name} is no printable byte", "string")).alias(name))
        else:
            day = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (text >= "0001"), F.try_to_date(text, "yyyy-MM-dd"))
            columns.append(F.coalesce(day, refuse(f"{name} is no date", "date")).alias(name))
    return good.select(*columns)


def read_lineitem(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path, lineSep="\n"))


def load_lineitem(catalog: Catalog, path: str, table: str = "lineitem") -> tuple[int, str]:
    """Declare ``lineitem`` if needed and append a whole input: (generation, token)."""
    if not catalog.snapshot().has(table):
        catalog.declare_table(table, [(n, t, False) for n, t, _ in COLUMNS])
    append = catalog.begin_append(table)
    try:
        append.write_dataframe(read_lineitem(catalog.spark, path))
        return append.commit(), append.token
    except BaseException:
        append.abort()
        raise
