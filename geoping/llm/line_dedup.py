"""Operator 13: line dedup.

Every text is split at line feeds; a line's key is the line without ASCII white space at
both ends, A-Z lower-cased. Lines are exploded with their position, keys are hashed
(128 bits), the distinct documents of each hash are counted, and the lines whose key is in
at least ``min_docs`` documents go, except in the document of the largest id that holds it.
What stays is put together again by position.

DataFrame functions only. The exploded rows carry positions and hashes, no text, and are a
stored table, read by the count and by the join back. A hot line costs little: documents are
counted by partial aggregation (distinct by hash and id first, then by hash), the join back
is an equi-join whose hot partitions Spark splits, and what comes back to a document are the
positions of its own lines. Lines never meet one by one: a document's kept positions are a
hashed set difference.

Defined results: null and empty texts have one empty line (a null text stays null); rows with
equal ids count as one document and each of them is cut by itself; null ids are one document,
before all others; keys under ``min_chars`` code points always stay; a text that loses all of
its lines becomes empty; ids may be of any type that has an order. An empty table gives an
empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import materialise, with_text

MIN_CHARS, MIN_DOCS = 20, 3
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def line_dedup(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row``, n_lines, n_dropped and ``kept`` (the remaining text) for every row of ``docs``."""
    texts = with_text(docs, text_col, keep + [id_col] if id_col not in keep else keep)
    of = F.col("row").getField(id_col)
    base = texts.select("row", F.struct(of.isNotNull().alias("known"), of.alias("id")).alias("doc"), F.col("text").isNull().alias("absent"),
                        _hash(F.coalesce("text", F.lit(""))).alias("copy"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    lines = (base.select("doc", "copy", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line")))
             .where(F.char_length("key") >= min_chars).select("doc", "copy", "pos", _hash(F.col("key")).alias("hash")))
    lines = materialise(lines, "line-hashes")
    common = (lines.groupBy("hash").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("last"))
              .where(F.col("docs") >= min_docs).select("hash", "last"))
    common = materialise(common, "line-common")  # a table of its own: the join shuffles both sides, and Spark splits its hot partitions
    gone = (lines.join(common.hint("merge"), "hash").where(F.col("doc") != F.col("last"))
            .groupBy("doc", "copy").agg(F.collect_set("pos").alias("gone")))
    cut = base.join(gone.hint("merge"), ["doc", "copy"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in keep]) if id_col not in keep else F.col("row")
    return cut.select(row.alias("row"), F.size("lines").cast("bigint").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), F.when(~F.col("absent"), kept).alias("kept"))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs, ["doc_id"]).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM texts),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT k.r, k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone
  FROM keys k LEFT JOIN common c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
