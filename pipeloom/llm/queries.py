"""The registered ``opN_*`` queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import string
import textwrap

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, language, licences, lines, mixing, neighbours, packing, shingles, substrings
from .common import table, with_code

VOCABULARY = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license_id", "canonical_sha256")


def known_texts() -> list[tuple[int, str]]:
    """Every known text as it stands, in capitals, and wrapped under a notice; ids below 0."""
    wrapped = lambda t: "\n\n".join("\n".join(textwrap.wrap(part, 72)) for part in t.split("\n"))
    forms = [form for _, t in licences.KNOWN for form in (t, t.upper(), "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + wrapped(t))]
    return [(-1 - k, form) for k, form in enumerate(forms)]


def license_scan_known_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over ``documents`` and the known texts in several forms, so that there is something to find."""
    known = spark.createDataFrame(known_texts(), "doc_id long, text string")
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(known))
    return found.select("doc_id", "license_id", "canonical_sha256")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = language.train(docs.where(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(chat.preference_pairs(table(spark, sf_dir, "conversations")))


def chat_preferences_shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference formatting where each conversation is chosen over itself with another last turn, so that all turns before are the prompt."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    other = turns.join(last, "conv_id").select((F.col("conv_id") * 2 + 1).alias("conv_id"), "turn", "role", F.when(F.col("turn") == F.col("last"), F.lit("No.")).otherwise(F.col("text")).alias("text"))
    found = chat.preference_pairs(turns.withColumn("conv_id", F.col("conv_id") * 2).unionByName(other))
    return digested(found)


def digested(found: DataFrame) -> DataFrame:
    texts = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return found.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", *texts, chat.shown(F.col("chosen_mask")).alias("chosen_mask"), chat.shown(F.col("rejected_mask")).alias("rejected_mask"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "copy", F.sha2("text", 256).alias("text_sha256"))


def queries() -> dict:
    return {f.__name__: with_code(f) for f in (op1_substring_dedup, op2_license_scan, op3_ngram_jaccard, op4_language_id, op5_embedding_dedup, op6_line_dedup, op7_best_fit_packing, op8_nearest_neighbours, op9_chat_preferences, op10_mix_sources, license_scan_known_texts, chat_preferences_shared_prefix)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op2_sql(source: str = "SELECT doc_id, text FROM documents") -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in licences.EQUIVALENT.items())
    known = ", ".join(f"('{digest}', '{name}')" for digest, name in sorted((licences.digests(licences.KNOWN) | licences.KNOWN_DIGESTS).items()))
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    notice, year, body = (f"regexp_matches(l, {quoted(p)})" for p in (licences.NOTICE, licences.YEAR, licences.BODY))
    return f"""
WITH rows AS ({source}),
lined AS (SELECT doc_id, array_to_string(list_filter(string_split({lower}, chr(10)), lambda l: NOT ({notice} AND ({year} OR NOT {body}))), chr(10)) AS t, text FROM rows),
bare AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN trim(regexp_replace(t, '{licences.SEPARATORS}', ' ', 'g'), ' ') END AS b FROM lined),
digests AS (SELECT doc_id, sha256(array_to_string(list_transform(string_split(b, ' '), lambda w: CASE w {cases} ELSE w END), ' ')) AS canonical_sha256 FROM bare)
SELECT doc_id, license_id, canonical_sha256 FROM digests LEFT JOIN (VALUES {known}) AS k(d, license_id) ON d = canonical_sha256
"""


def known_texts_sql() -> str:
    rows = ", ".join(f"({i}, {quoted(t)})" for i, t in known_texts())
    return op2_sql(f"SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {rows}) AS k(doc_id, text)")


#: The common turns of conversations 2k and 2k + 1, and what follows them in each.
OP9_SQL = """
WITH turns AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
pairs AS (SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id,
  count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM turns GROUP BY pair_id),
differ AS (SELECT a.pair_id, min(a.i) AS i FROM turns a LEFT JOIN turns b ON a.pair_id = b.pair_id AND b.side = 1 AND a.i = b.i AND a.role = b.role AND a.text = b.text
  WHERE a.side = 0 AND b.i IS NULL GROUP BY a.pair_id),
shared AS (SELECT p.*, coalesce(d.i - 1, n0) AS s FROM pairs p LEFT JOIN differ d USING (pair_id)),
shown AS (SELECT t.pair_id, t.side, t.i, t.role, s, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r, length(role) + 5 AS head FROM turns t JOIN shared USING (pair_id)),
placed AS (SELECT *, coalesce(sum(length(r)) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM shown WHERE i > s),
rest AS (SELECT pair_id, side, string_agg(r, '' ORDER BY i) AS body, string_agg((pos + head) || '-' || (pos + length(r)), ',' ORDER BY i) FILTER (role = 'assistant') AS mask FROM placed GROUP BY pair_id, side),
prompts AS (SELECT pair_id, string_agg(r, '' ORDER BY i) AS prompt FROM shown WHERE side = 0 AND i <= s GROUP BY pair_id)
SELECT q.pair_id, chosen_id, rejected_id, CAST(s AS INTEGER) AS prompt_turns, sha256(coalesce(prompt, '')) AS prompt_sha256,
  CASE WHEN n0 > 0 THEN sha256(coalesce(a.body, '')) END AS chosen_sha256, CASE WHEN n1 > 0 THEN sha256(coalesce(b.body, '')) END AS rejected_sha256,
  CASE WHEN n0 > 0 THEN coalesce(a.mask, '') END AS chosen_mask, CASE WHEN n1 > 0 THEN coalesce(b.mask, '') END AS rejected_mask
FROM shared q LEFT JOIN prompts USING (pair_id) LEFT JOIN rest a ON a.pair_id = q.pair_id AND a.side = 0 LEFT JOIN rest b ON b.pair_id = q.pair_id AND b.side = 1
"""

#: The same over conversations of which each is chosen over itself with another last turn.
SHARED_PREFIX_SQL = OP9_SQL.replace("FROM conversations", "FROM both_sides").replace(
    "WITH turns AS",
    """WITH last_turns AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
both_sides AS (SELECT conv_id * 2 AS conv_id, turn, role, text FROM conversations
  UNION ALL SELECT c.conv_id * 2 + 1, turn, role, CASE WHEN turn = last THEN 'No.' ELSE text END FROM conversations c JOIN last_turns l ON c.conv_id = l.conv_id),
turns AS""",
)

#: Levels of doubling in the SQL: windows of 20 words up to 20 * 2 ** LEVELS.
LEVELS = 24


def op1_sql() -> str:
    """Words covered by a window of 20 words that also starts earlier are removed; a window of twice the length is the pair of its halves."""
    doubled = ",\n".join(
        f"l{k + 1} AS MATERIALIZED (SELECT doc_id, s, c FROM (SELECT a.doc_id, a.s, min(a.doc_id * 4294967296 + a.s) OVER same AS c, count(*) OVER same AS n "
        f"FROM l{k} a JOIN l{k} b ON a.doc_id = b.doc_id AND b.s = a.s + {20 * 2**k} WINDOW same AS (PARTITION BY a.c, b.c)) WHERE n > 1)"
        for k in range(LEVELS)
    )
    longest = " UNION ALL ".join(f"SELECT doc_id, {20 * 2**k} AS size FROM l{k}" for k in range(LEVELS + 1))
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, unnest(list_transform(range(1, len(ws) - 18), lambda s: array_to_string(ws[s:s + 19], ' '))) AS body FROM w),
ranked AS MATERIALIZED (SELECT doc_id, s, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS r, min(doc_id * 4294967296 + s) OVER (PARTITION BY body) AS c, count(*) OVER (PARTITION BY body) AS n FROM windows),
l0 AS MATERIALIZED (SELECT doc_id, s, c FROM ranked WHERE n > 1),
{doubled},
longest AS (SELECT doc_id, max(size) AS size FROM ({longest}) GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE r > 1),
placed AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT p.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS body FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256, CAST(coalesce(size, 0) AS BIGINT) AS longest_repeat
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


#: Content-defined chunks of lines, cut at gaps whose hash is below both neighbours'; those of two lines or more that occur before are cut out.
OP6_SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
hashed AS (SELECT doc_id, text, ls, list_transform(ls, lambda x: CAST(('0x' || substr(md5(x), 1, 15)) AS BIGINT) % 1000003) AS hs FROM docs),
gaps AS (SELECT doc_id, text, ls, list_transform(range(1, len(ls)), lambda g: (hs[g] * 31 + hs[g + 1]) % 1000003) AS rs FROM hashed),
exploded AS (SELECT doc_id, text, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line,
  unnest(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i > 2 AND i < len(ls) AND rs[i - 1] < rs[i - 2] AND rs[i - 1] <= rs[i] THEN 1 ELSE 0 END)) AS opens FROM gaps),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, text ORDER BY i) AS c FROM exploded),
chunks AS (SELECT doc_id, text, c, count(*) AS k, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, c) AS r FROM chunks),
kept AS (SELECT doc_id, text, coalesce(sum(k) FILTER (k >= 2 AND r > 1), 0) AS gone, sum(k) AS n,
  coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (NOT (k >= 2 AND r > 1)), '') AS left_text FROM ranked GROUP BY doc_id, text)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(gone AS BIGINT) AS n_removed_lines, sha256(left_text) AS kept_sha256 FROM kept
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

#: Poisson counts with mean target share / share of characters, as sums of parts with a mean of 16 at most, each inverted at a number hashed from the id.
OP10_SQL = """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS mass FROM documents GROUP BY source),
shares AS (SELECT source, mass, CAST(floor(pow(CAST(mass AS DOUBLE), 0.5) * 1000000) AS BIGINT) AS share FROM sizes),
rates AS (SELECT source, CAST(share AS DOUBLE) / CAST(sum(share) OVER () AS DOUBLE) * CAST(sum(mass) OVER () AS DOUBLE) / CAST(mass AS DOUBLE) AS rate FROM shares WHERE mass > 0),
parts AS (SELECT source, CAST(greatest(ceil(rate / 16), 1) AS BIGINT) AS m, rate / greatest(ceil(rate / 16), 1) AS mean FROM rates),
terms AS (SELECT source, m, k, exp(sum(CASE WHEN k = 0 THEN -mean ELSE ln(mean) - ln(CAST(k AS DOUBLE)) END) OVER (PARTITION BY source ORDER BY k)) AS p
  FROM parts, range(0, 105) AS ks(k) WHERE k <= ceil(mean + 12 * sqrt(mean) + 40)),
below AS (SELECT source, m, list(c ORDER BY k) AS cs FROM (SELECT source, m, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source, m),
drawn AS (SELECT doc_id, d.source, text, cs, list_transform(range(0, m), lambda i: CAST(('0x' || substr(md5('mix:' || doc_id || CASE i WHEN 0 THEN '' ELSE ':' || i END), 1, 13)) AS BIGINT) / 4503599627370496.0) AS us
  FROM documents d JOIN below b ON d.source IS NOT DISTINCT FROM b.source),
counted AS (SELECT doc_id, source, text, list_sum(list_transform(us, lambda u: len(list_filter(cs, lambda x: u >= x)))) AS n FROM drawn)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, sha256(text) AS text_sha256
FROM (SELECT doc_id, source, text, unnest(range(0, CAST(n AS BIGINT))) AS copy FROM counted)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": op1_sql(), "op2_license_scan": op2_sql(), "op9_chat_preferences": OP9_SQL, "op6_line_dedup": OP6_SQL, "op10_mix_sources": OP10_SQL, "license_scan_known_texts": known_texts_sql(), "chat_preferences_shared_prefix": SHARED_PREFIX_SQL}
