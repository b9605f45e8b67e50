"""Operator 8: mixing sources to target weights by hierarchical budgets.

A tree of three levels (domain, language, source) has a weight at every node; a
token budget flows from the root to the leaves. At every node the budget is shared
among the children by weight; a child that has fewer tokens than its share gives
the rest back to its siblings, again by weight, and only what all siblings together
cannot take goes up to the parent's siblings. (A node's capacity is the sum of its
leaves' capacities, so this is one pass from the root down, each level closed-form: the
children whose capacity is below the water level are filled, the others share the rest.)

A leaf's tokens come in seeded epochs: in each epoch its documents are ordered by
MD5 of seed, epoch and id. The leaf takes the prefix whose running token sum stays
within its budget; a document is taken once per epoch, ``max_epochs`` times at most.

A leaf may hold a third of all rows: its order is cut into 16 ** ``SLOT_DIGITS`` hash
ranges, whose token sums are added first; only the range in which the budget ends is sorted.

Defined results: null domains, languages and sources are nodes of their own; null or
empty texts have no tokens and are never selected; a null id is the empty text in the
order; equal ids are ordered by MD5 of their text; rows equal in id and text are taken or left
together; nodes without a weight have weight 1, negative weights count as 0; nodes of
weight 0 get nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoping.llm.common import materialise

SLOT_DIGITS = 3
LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Words ``[^\x20\x09-\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def _same(left: DataFrame, right: DataFrame, names: list[str] | tuple[str, ...], mark: str) -> Column:
    cond = F.lit(True)
    for c in names:
        cond = cond & left[c].eqNullSafe(right[f"{mark}{c}"])
    return cond


def _share(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds ``part``: each child's part of its parent's budget ``given``, by weight and below its capacity."""
    own = children.withColumn("root", F.lit(0)).withColumn("fill", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
    whole = Window.partitionBy("root", *parents)
    up_to = whole.orderBy(F.col("fill").asc_nulls_last(), F.col(child).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("below", F.sum("capacity").over(up_to)).withColumn("above", F.sum("weight").over(whole) - F.sum("weight").over(up_to))
    own = own.withColumn("full", F.coalesce(F.col("below") + F.col("fill") * F.col("above") <= F.col("given"), F.lit(False)))
    own = own.withColumn("taken", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole))
    own = own.withColumn("rest", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole))
    part = (F.when(F.col("full"), F.col("capacity").cast("double"))
            .when(F.col("rest") > 0, (F.col("given") - F.col("taken")) * F.col("weight") / F.col("rest")).otherwise(F.lit(0.0)))
    return own.withColumn("part", part)


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[tuple, float]], budget: float, max_epochs: int) -> DataFrame:
    """``leaves``: domain, lang, source, tokens. Adds the leaf's ``budget`` in whole tokens.

    ``weights``: per level a map from a path (tuple of the names from the domain down to the node) to a weight.
    """
    spark = leaves.sparkSession
    cur = leaves.withColumn("capacity", F.col("tokens") * max_epochs).withColumn("given", F.lit(float(budget)))
    for depth, level in enumerate(LEVELS, start=1):
        path = list(LEVELS[:depth])
        nodes = cur.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first("given").alias("given"))
        rows = [(*k, float(max(0.0, w))) for k, w in (weights.get(level) or {}).items()]
        named = spark.createDataFrame(rows, ", ".join([f"w_{c} string" for c in path] + ["w double"]))
        nodes = nodes.join(named, _same(nodes, named, path, "w_"), "left").withColumn("weight", F.coalesce("w", F.lit(1.0)))
        shared = _share(nodes, path[:-1], level).select(*[F.col(c).alias(f"n_{c}") for c in path], "part")
        cur = cur.join(shared, _same(cur, shared, path, "n_")).select(*LEVELS, "tokens", "capacity", F.col("part").alias("given"))
    return cur.select(*LEVELS, "tokens", F.floor(F.col("given") + 1e-6).cast("bigint").alias("budget"))


def _ordered(frame: DataFrame, seed: int) -> DataFrame:
    """Adds the order key of the epoch that is cut, and its slot."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("id")))
    return frame.withColumn("key", key).withColumn("slot", F.conv(F.substring("key", 1, SLOT_DIGITS), 16, 10).cast("int"))


def mix(docs: DataFrame, keep: list[str], domain: Column, lang: Column, source: Column, weights: dict, budget_share: float = 0.5, max_epochs: int = 2, seed: int = 11,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, epoch (from 1), domain, lang, source, tokens and budget of every selected copy of a row of ``docs``.

    The budget is ``budget_share`` of all tokens.
    """
    base = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), domain.cast("string").alias("domain"), lang.cast("string").alias("lang"), source.cast("string").alias("source"),
        F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("id"), F.md5(docs[f"`{text_col}`"].cast("string")).alias("t"), token_count(docs[f"`{text_col}`"].cast("string")).alias("tokens"))
    base = base.where("tokens > 0")
    thin = materialise(base.drop("row"), "mix-documents")
    leaves = thin.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = thin.agg(F.sum("tokens")).first()[0] or 0
    # whole epochs need no order; at most one epoch of a leaf is cut
    plan = leaf_budgets(leaves, weights, total * budget_share, max_epochs)
    plan = materialise(plan.select(*[F.col(c).alias(f"b_{c}") for c in LEVELS], "budget", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"),
                                   (F.col("budget") % F.col("tokens")).alias("left")), "mix-plan")
    cut = _ordered(thin.join(plan, _same(thin, plan, LEVELS, "b_")).where("left > 0"), seed)
    slots = cut.groupBy(*LEVELS, "slot").agg(F.sum("tokens").alias("slot_tokens"), F.first("left").alias("left"))
    before = Window.partitionBy(*LEVELS).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("room", F.col("left") - F.coalesce(F.sum("slot_tokens").over(before), F.lit(0)))
    ends = materialise(slots.where("room >= 0 and slot_tokens > room").select(*[F.col(c).alias(f"s_{c}") for c in LEVELS], F.col("slot").alias("s_slot"), "room"), "mix-ends")
    inside = cut.join(ends, _same(cut, ends, (*LEVELS, "slot"), "s_"))
    inside = inside.withColumn("sum", F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "id", "t")))
    limits = inside.where("sum <= room").groupBy(*[F.col(c).alias(f"l_{c}") for c in LEVELS]).agg(F.max(F.struct("key", "id", "t")).alias("limit"))
    plan = _with_limits(plan, ends, limits)
    rows = _ordered(base.join(plan, _same(base, plan, LEVELS, "b_")), seed)
    extra = (F.col("slot") < F.col("end_slot")) | ((F.col("slot") == F.col("end_slot")) & (F.struct("key", "id", "t") <= F.col("limit")))
    rows = rows.withColumn("times", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")).where("times > 0")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row", "epoch", "domain", "lang", "source", "tokens", "budget")


def _with_limits(plan: DataFrame, ends: DataFrame, limits: DataFrame) -> DataFrame:
    """The plan (a row per leaf) with the slot in which the budget ends and the last order key that fits there."""
    cond = F.lit(True)
    for c in LEVELS:
        cond = cond & plan[f"b_{c}"].eqNullSafe(ends[f"s_{c}"])
    out = plan.join(ends.drop("room"), cond, "left")
    cond = F.lit(True)
    for c in LEVELS:
        cond = cond & out[f"b_{c}"].eqNullSafe(limits[f"l_{c}"])
    out = out.join(limits, cond, "left")
    return materialise(out.select(*[f"b_{c}" for c in LEVELS], "budget", "whole", F.col("s_slot").alias("end_slot"), "limit"), "mix-limits")


#: The registered mix: long documents are the domain "book", all others "web".
BOOK_CHARS = 5000
WEIGHTS = {
    "domain": {("web",): 0.7, ("book",): 0.3},
    "lang": {(d, tongue): w for d in ("web", "book") for tongue, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))},
}
BUDGET_SHARE = 0.5
MAX_EPOCHS = 2
SEED = 11


def mixed_documents(docs: DataFrame) -> DataFrame:
    domain = F.when(docs["n_chars"] >= BOOK_CHARS, "book").otherwise("web")
    return mix(docs, docs.columns, domain, docs["lang"], docs["source"], WEIGHTS, BUDGET_SHARE, MAX_EPOCHS, SEED)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    domain = F.when(docs["n_chars"] >= BOOK_CHARS, "book").otherwise("web")
    out = mix(docs, ["doc_id"], domain, docs["lang"], docs["source"], WEIGHTS, BUDGET_SHARE, MAX_EPOCHS, SEED)
    return out.select("row.doc_id", "epoch", "domain", "lang", "source", "tokens", "budget")


def _level_sql(name: str, before: str, path: list[str], weight: str) -> str:
    cols, parents = ", ".join(path), ", ".join(path[:-1]) or "0"
    on = " AND ".join(f"c.{p} IS NOT DISTINCT FROM n.{p}" for p in path)
    return f"""
{name}_nodes AS (
  SELECT {cols}, sum(capacity) AS capacity, min(given) AS given, {weight} AS weight FROM {before} GROUP BY {cols}),
{name}_fill AS (
  SELECT *, sum(capacity) OVER o AS below, sum(weight) OVER w - sum(weight) OVER o AS above, capacity / weight AS fill
  FROM {name}_nodes
  WINDOW w AS (PARTITION BY {parents}), o AS (PARTITION BY {parents} ORDER BY capacity / weight, {path[-1]} NULLS FIRST ROWS UNBOUNDED PRECEDING)),
{name}_full AS (SELECT *, below + fill * above <= given AS filled FROM {name}_fill),
{name}_rest AS (
  SELECT *, sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER w AS taken, sum(CASE WHEN filled THEN 0.0 ELSE weight END) OVER w AS rest
  FROM {name}_full WINDOW w AS (PARTITION BY {parents})),
{name} AS (
  SELECT c.domain, c.lang, c.source, c.tokens, c.capacity,
    CASE WHEN n.filled THEN CAST(n.capacity AS DOUBLE) WHEN n.rest > 0 THEN (n.given - n.taken) * n.weight / n.rest ELSE 0.0 END AS given
  FROM {before} c JOIN {name}_rest n ON {on}),"""


ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, CASE WHEN n_chars >= {BOOK_CHARS} THEN 'book' ELSE 'web' END AS domain, lang, source, coalesce(CAST(doc_id AS VARCHAR), '') AS id, md5(text) AS t,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT * FROM base WHERE tokens > 0),
leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {MAX_EPOCHS} AS BIGINT) AS capacity,
    (SELECT CAST(sum(tokens) AS DOUBLE) * {BUDGET_SHARE} FROM docs) AS given
  FROM docs GROUP BY domain, lang, source),
{_level_sql("one", "leaves", ["domain"], "CAST(CASE domain WHEN 'web' THEN 0.7 WHEN 'book' THEN 0.3 ELSE 1.0 END AS DOUBLE)")}
{_level_sql("two", "one", ["domain", "lang"], "CAST(CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END AS DOUBLE)")}
{_level_sql("three", "two", ["domain", "lang", "source"], "CAST(1.0 AS DOUBLE)")}
plan AS (
  SELECT domain, lang, source, tokens AS leaf_tokens, CAST(floor(given + 1e-6) AS BIGINT) AS budget,
    CAST(floor(given + 1e-6) AS BIGINT) // tokens AS whole, CAST(floor(given + 1e-6) AS BIGINT) % tokens AS left_over
  FROM three),
ordered AS (
  SELECT d.*, p.budget, p.whole, p.left_over, md5('{SEED}:' || CAST(p.whole + 1 AS VARCHAR) || ':' || d.id) AS key
  FROM docs d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
summed AS (
  SELECT *, whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, id, t) <= left_over THEN 1 ELSE 0 END AS times FROM ordered)
SELECT doc_id, CAST(e AS INTEGER) AS epoch, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, budget
FROM summed, unnest(range(1, CAST(times AS BIGINT) + 1)) AS u(e)
"""
