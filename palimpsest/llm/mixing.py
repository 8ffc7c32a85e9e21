"""Operator 2: mixing sources to target weights.

Each document gets a hash-random key. Within a source, documents are taken in key order up to the source's exact word
budget; budgets above the source's size repeat it in whole epochs first. The cut is found without sorting anything
large: sizes are summed by key range (a range sort of a uniform key into `ranges` equal parts), prefix sums over the
ranges give the range where the budget ends, and only that range is ordered row by row. The cut is then one small row
for each source, which is joined to the documents.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; a null
doc_id hashes like the empty string; rows of equal key share the words left at the cut evenly, rounded down; an empty
table gives an empty result; extra columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, WORD, settled

RANGES = 4096
#: Keys have 60 bits: 15 hexadecimal digits of an MD5.
KEY_DIGITS = 15
RESULT = ("size", "source_size", "target", "taken", "epochs", "partial")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(column: Column, seed: int = 0) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[int], cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights over the total, capped at cap times the size, the excess reshared.

    Resharing by weight until no source is above its cap fills sources to a common level: targets are
    min(cap * size, weight * level). Sources are ordered by cap / weight; the level is the highest at which the rest fits.
    """
    ordered = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("__w", pick.cast("double")).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    full = Window.partitionBy().orderBy((F.col("__cap") / F.col("__w")), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    rest = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    tried = weighed.withColumn("__level", left / rest)
    fits = F.max(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.col("__level"))).over(everything)
    return tried.select("source", "source_size", F.least("__cap", F.coalesce(F.col("__w") * fits, F.col("__cap"))).alias("target"))


def mix(df: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: list[int] = (1, 2, 3), cap: float = 3.0, seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """df with size, source_size, target, taken (words, repeats counted), epochs (whole repeats) and partial (words of one more)."""
    base = df.drop(*RESULT)
    keyed = base.select(F.col(source).alias("source"), random_key(F.col(key), seed).alias("__key"), word_count(F.col(text)).alias("size"))
    width = -(-(16**KEY_DIGITS) // ranges)
    by_range = keyed.groupBy("source", F.floor(F.col("__key") / F.lit(width)).cast("int").alias("__range")).agg(F.sum("size").alias("__words"))
    sizes = by_range.groupBy("source").agg(F.sum("__words").alias("source_size"))
    goal = targets(sizes, list(weights), cap)
    goal = goal.withColumn("__epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    goal = goal.withColumn("__rest", F.floor(F.col("target")).cast("long") - F.col("__epochs") * F.col("source_size"))
    # Prefix sums over the ranges of a source: `ranges` rows a source at most.
    upto = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    summed = by_range.withColumn("__before", F.coalesce(F.sum("__words").over(upto), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    cut_range = summed.join(goal, same(summed, goal)).where((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__words")))
    cut_range = cut_range.select(summed["source"], "__range", (F.col("__rest") - F.col("__before")).alias("__left"))
    within = keyed.withColumn("__range", F.floor(F.col("__key") / F.lit(width)).cast("int"))
    within = within.join(cut_range, same(within, cut_range) & (within["__range"] == cut_range["__range"])).select(within["source"], "__key", "size", "__left")
    ties = within.groupBy("source", "__key").agg(F.sum("size").alias("__words"), F.max("__left").alias("__left"))
    upto_key = Window.partitionBy("source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    cut = ties.withColumn("__before", F.coalesce(F.sum("__words").over(upto_key), F.lit(0)))
    cut = cut.where((F.col("__before") <= F.col("__left")) & (F.col("__left") < F.col("__before") + F.col("__words")))
    cut = cut.select("source", F.col("__key").alias("__cut"), (F.col("__left") - F.col("__before")).alias("__part"), F.col("__words").alias("__tie"))
    plan = goal.join(cut, same(goal, cut), "left").select(goal["source"].alias("__source"), "source_size", "target", "__epochs", "__cut", "__part", "__tie")
    # One row a source. As a table its size is known before the join is planned: broadcast if small, else by sort and merge.
    plan = settled(plan, "mix")
    rows = base.withColumns({"__key": random_key(F.col(key), seed), "size": word_count(F.col(text))})
    rows = rows.join(plan, rows[source].eqNullSafe(plan["__source"]))
    # A range with no cut has a budget of whole epochs only.
    part = F.when(F.col("__key") < F.col("__cut"), F.col("size")).when(F.col("__key") == F.col("__cut"), F.floor(F.col("__part") * F.col("size") / F.col("__tie"))).otherwise(0).cast("long")
    rows = rows.withColumns({"epochs": F.col("__epochs"), "partial": F.coalesce(part, F.lit(0))})
    rows = rows.withColumns({"taken": (F.col("epochs") * F.col("size") + F.col("partial")).cast("long"), "source_size": F.col("source_size").cast("long")})
    return rows.select(*base.columns, *RESULT)


def materialise(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each document once for each epoch, and the first words of one that is cut. Documents with no words go once an epoch."""
    whole = F.col("epochs") + F.when((F.col("partial") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    cut = F.when((F.col("partial") > 0) & (F.col("partial") < F.col("size")), 1).otherwise(0)
    rows = mixed.withColumns({"__whole": whole.cast("int"), "__all": (whole + cut).cast("int")}).where("__all > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__all"))))
    part = F.when(F.col("__copy") > F.col("__whole"), first_words(F.col(text), F.col("partial"))).otherwise(F.col(text))
    return rows.withColumn(text, part).drop("__copy", "__whole", "__all")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by one space."""
    words = F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS s, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM docs GROUP BY source
), tried AS (
  SELECT *, 3.0::DOUBLE * s AS cap,
    (sum(s) OVER () - coalesce(sum(3.0::DOUBLE * s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sizes WINDOW before AS (ORDER BY 3.0::DOUBLE * s / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, s, least(cap, coalesce(w * max(level) FILTER (level <= cap / w) OVER (), cap)) AS target FROM tried
), budgets AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS epochs FROM goals
), placed AS (
  SELECT d.doc_id, d.size, b.s, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.s AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k RANGE UNBOUNDED PRECEDING) - sum(d.size) OVER (PARTITION BY d.source, d.k), 0)::BIGINT AS before,
    (sum(d.size) OVER (PARTITION BY d.source, d.k))::BIGINT AS tie
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, s AS source_size, target,
  epochs * size + CASE WHEN before + tie <= rest THEN size WHEN before < rest THEN ((rest - before) * size) // tie ELSE 0 END AS taken
FROM placed
"""
