"""A training corpus in five stages: language ID, line dedup, near-duplicate removal, source mixing, packing.

Each stage works on all that the stage before it kept and returns the columns of
``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.llm import language, lines, mixing, packing, shingles
from pipeloom.llm.common import discard, fresh, materialise, ship_code
from pipeloom.llm.queries import VOCABULARY


def one_per_text(docs: DataFrame) -> DataFrame:
    """Of rows with equal text the one with the smallest id, a null id last.  Rows with null text all stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    unnamed, row = fresh(docs, "unnamed", "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias(unnamed), "doc_id", *rest)).alias(row)
    kept = docs.where(F.col("text").isNotNull()).groupBy("text").agg(first).select("text", f"{row}.*").select(*docs.columns)
    return kept.unionByName(docs.where(F.col("text").isNull()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the others (null, empty or without letters) go.

    A null label or id is no reason to go; equal rows stay or go together; where no
    training row has a label, all documents with letters stay; of no documents none
    stays.  Columns named like the operator's results are the documents' own.
    """
    ship_code(spark)
    samples = language.train(docs.where(~language.held_out()))
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    (predicted,) = fresh(docs, "lang_pred")
    found = language.identify(docs, samples)
    return found.where(F.col(predicted) != language.UNDETERMINED).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand earlier; a document of which nothing is left goes.

    ``n_chars``, if there is such a column, follows the text.  Null and empty texts
    stay as they are; equal rows (id and text) don't take each other's lines; a null
    id comes last; of no documents none stays.  Columns named like the operator's
    results are the documents' own.
    """
    ship_code(spark)
    (removed,) = fresh(docs, "n_removed_lines")
    found = lines.dedup_lines(docs).where((F.col(removed) == 0) | (F.col("text") != ""))
    kinds = dict(docs.dtypes)
    return found.select(*(F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Of rows with equal text one stays, also where their ids are equal or null.  A row
    with a null id resembles no other; only its exact copies go.  Rows of one id with
    different texts are one document and stay or go together.  Null texts, and texts
    without words, are like no other: rows with null text stay, of equal ones without
    words one.  Of no documents none stays.  Columns named like the operator's results
    are the documents' own.
    """
    ship_code(spark)
    found = shingles.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return one_per_text(docs.join(gone, "doc_id", "left_anti").select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target mixture, in global pseudo-random order.

    A null source is a source of its own; a source without any text is not drawn;
    rows with equal ids are drawn equally often; of no documents none is drawn.
    Columns named like the operator's results are the documents' own.
    """
    ship_code(spark)
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in fixed-length sequences.

    Null text counts as empty; every row is packed, equal ones and ones with a null id
    too; of no documents there are no pieces; other columns are not read.
    """
    ship_code(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express language identification, the Jaccard join's components or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ship_code(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
