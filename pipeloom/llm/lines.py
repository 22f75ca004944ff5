"""Line dedup by content-defined line chunks (operator 6, DataFrame functions only).

A text is split into lines; a rolling hash of ``window`` line hashes stands at each
gap between two lines, and a chunk is closed at a gap whose hash is below those of
``reach`` gaps on either side.  The cut depends on the lines around it alone, so
inserting a line elsewhere doesn't move it, and no chunk has fewer than ``reach`` + 1
lines (but a text that has fewer).  Of chunks of at least ``min_lines`` lines that
occur more than once in the corpus, every occurrence but the first (smallest id, then
earliest) is removed, after its bytes were compared with the first one's.

So all of an exact copy of two lines or more goes.  Of a passage inside other text the
chunks at its two ends stay, as they take in foreign lines, as do copies of one line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Fixed values of the rolling hash: modulus, and the factor of each older line.
MODULUS, FACTOR = 1_000_003, 31
REACH, WINDOW, MIN_LINES = 1, 2, 2
#: Occurrences of one chunk that are compared in one group; a more frequent chunk's first text goes to several.
SALT_ROWS = 512


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_bounds(lines: Column, reach: int, window: int) -> Column:
    """Array of (first line from 0, number of lines), one per chunk."""

    def rolled(hashes: Column, gap: Column) -> Column:
        """Hash of the ``window`` lines around the gap after line ``gap``, as many of them as there are."""
        total = F.lit(0).cast("long")
        for k in range(window):
            total = (total * FACTOR + F.coalesce(F.get(hashes, gap + (k + 1 - (window + 1) // 2)), F.lit(0).cast("long"))) % MODULUS
        return total

    def lowest(at: Column, i: Column) -> Column:
        found = F.lit(True)
        for k in range(1, reach + 1):
            found = found & (F.get(at, i) < F.get(at, i - k)) & (F.get(at, i) <= F.get(at, i + k))
        return found

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        gaps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        inner = F.when(n > 2 * reach + 1, F.sequence(F.lit(reach), n - 2 - reach)).otherwise(F.array().cast("array<int>"))
        cuts_of = lambda at: F.filter(inner, lambda i: lowest(at, i))
        return bound(
            bound(F.transform(gaps, lambda g: rolled(hashes, g)), cuts_of),
            lambda cuts: F.zip_with(F.concat(F.array(F.lit(0)), F.transform(cuts, lambda i: i + 1)), F.concat(F.transform(cuts, lambda i: i + 1), F.array(n)), lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))),
        )

    return bound(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long") % MODULUS), of)


def joined(lines: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, at + 1, n), "\n")


def dedup_lines(docs: DataFrame, reach: int = REACH, window: int = WINDOW, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left, plus n_lines and n_removed_lines.

    Null text stays null with 0 lines; empty text is one empty line; a text whose
    every line goes becomes empty.  Rows equal in id and text are one document
    (none of them removes the others' chunks); a null id comes after all others; of
    rows of one id with different texts the one with the smaller hash is first.  New
    columns whose names ``docs`` has already get underscores after their names.  An
    empty table gives no rows.
    """
    total, removed, key, gone, doc, key_r, unnamed = fresh(docs, "n_lines", "n_removed_lines", "text_key", "gone", "doc_key", "text_key_r", "unnamed")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    plain = keyed.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias(doc), F.col(key), F.col(text_col).alias("body"))
    found = bound(split(F.col("body")), lambda lines: F.transform(F.filter(chunk_bounds(lines, reach, window), lambda c: c["n"] >= min_lines), lambda c: bound(joined(lines, c["at"], c["n"]), lambda t: F.struct(c["at"].alias("at"), c["n"].alias("n"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("second"), t).alias("h2")))))
    chunks = plain.select(doc, key, F.explode(found).alias("c")).select(doc, key, "c.*")
    same = ["h1", "h2", "n"]
    firsts = chunks.groupBy(*same).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col(doc).isNull().alias(unnamed), doc, key, "at")).alias("first")).where("times > 1")
    # written, so that both sides of the join are plain exchanges, which AQE splits where a chunk is everywhere
    firsts = materialise(firsts.withColumn("salts", F.ceil(F.col("times") / SALT_ROWS).cast("long")).drop("times"), "repeated-chunks")
    is_first = F.struct(F.col("first")[doc], F.col("first")[key], F.col("first")["at"]).eqNullSafe(F.struct(doc, key, "at"))
    repeated = chunks.join(firsts, same).select(doc, key, F.struct("at", "n", "h1", "h2", "salts", is_first.alias("is_first")).alias("c"))
    per_doc = repeated.groupBy(doc, key).agg(F.collect_set("c").alias("cs"))
    held = plain.alias("p").join(per_doc.alias("r"), F.col(f"p.{doc}").eqNullSafe(F.col(f"r.{doc}")) & (F.col(f"p.{key}") == F.col(f"r.{key}")))
    cut_out = bound(split(F.col("body")), lambda lines: F.transform("cs", lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"), c["h1"].alias("h1"), c["h2"].alias("h2"), c["salts"].alias("salts"), c["is_first"].alias("is_first"), joined(lines, c["at"], c["n"]).alias("bytes"))))
    texts = held.select(f"p.{doc}", f"p.{key}", F.explode(cut_out).alias("c")).select(doc, key, "c.*")
    salted = [*same, "salt"]
    copied = texts.where("is_first").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    originals = copied.groupBy(*salted).agg(F.first("bytes").alias("original"))
    others = texts.where("not is_first").withColumn("salt", F.pmod(F.xxhash64(doc, key, "at"), F.col("salts")))
    verified = others.join(originals, salted).where("bytes = original")
    gone_from = verified.groupBy(doc, key).agg(F.collect_set(F.struct("at", "n")).alias(gone)).withColumnRenamed(key, key_r)
    out = keyed.join(gone_from, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(key_r)), "left")
    cut = F.size(F.coalesce(gone, F.array().cast("array<struct<at:int,n:int>>")))

    def kept(lines: Column) -> Column:
        """Line i stays unless one of the removed chunks covers it."""
        covered = lambda i: F.exists(gone, lambda c: (i >= c["at"]) & (i < c["at"] + c["n"]))
        return F.array_join(F.filter(lines, lambda x, i: ~covered(i)), "\n")

    text = F.when(cut > 0, bound(split(F.col(text_col)), kept)).otherwise(F.col(text_col))
    lines_gone = F.aggregate(F.coalesce(gone, F.array().cast("array<struct<at:int,n:int>>")), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split(F.col(text_col)))).cast("long")
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, n_lines.alias(total), lines_gone.alias(removed))
