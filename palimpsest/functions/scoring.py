"""The instruction score of a text, as Column expressions inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import rules as R
from palimpsest.functions.fuzzy import fuzzy_best
from palimpsest.functions.text import has_bidi, has_zero_width, is_plain, normalized_once, normalized_others, normalized_plain

FLAGS_S = "(?isU)"
#: For normalized text, which has no upper case.
FLAGS_N = "(?U)"


def is_phrase(text: Column) -> Column:
    """The single pattern of the earlier generations."""
    return F.coalesce(text, F.lit("")).rlike(FLAGS_S + R.PHRASES)


def signals(text: Column, norm: Column, plain: Column | None = None) -> dict[str, Column]:
    """Each rule but the fuzzy one, in the order in which reasons are given. plain: is_plain(text), where it is known already."""
    # What a plain text says, its normalized form says too.
    plain = is_plain(text) if plain is None else plain
    return {
        "direct_phrase": norm.rlike(FLAGS_N + R.DIRECT) | (~plain & text.rlike(FLAGS_S + R.DIRECT)),
        "control_bucket": norm.rlike(FLAGS_N + R.CONTROL),
        "role_bucket": norm.rlike(FLAGS_N + R.ROLE),
        "review_bucket": norm.rlike(FLAGS_N + R.REVIEW),
        "zero_width_present": has_zero_width(text),
        "bidi_controls_present": has_bidi(text),
    }


def hinted_at(signal: str) -> Column:
    """May the rule hold, by the column hints?"""
    return F.col("hints").bitwiseAND(1 << list(R.WEIGHTS).index(signal)) != 0


def scored(df: DataFrame, text: str, *, fuzzy: str = "indel", always: Column | None = None, hinted: bool = False) -> DataFrame:
    """df with t_norm, prompty, prompty_score, fuzzy_best, fuzzy_template and prompty_reasons.

    Rows that can't reach the flagged score even with a fuzzy match are dropped before the fuzzy function runs, unless
    `always` holds; that changes no result, as the fuzzy match adds a fixed amount. hinted: df has t_norm (null where it isn't
    known), hints (the rules that may hold, as bits) and sure (these do hold); other rules are not tried.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    if hinted:
        df = df.withColumn("__other", normalized_once(F.when(F.col("t_norm").isNull(), value)))
        df = df.withColumn("t_norm", F.coalesce("t_norm", "__other"))
        named = signals(value, F.col("t_norm"))
        named = {k: hinted_at(k) & (F.col("sure") | c) for k, c in named.items()}
    else:
        df = df.withColumn("__other", normalized_others(value))
        df = df.withColumn("t_norm", F.coalesce("__other", normalized_plain(value)))
        named = signals(value, F.col("t_norm"), F.col("__other").isNull())
    # A column that isn't deterministic keeps filters on the signals above them, so that each rule is matched once.
    df = df.withColumns({**{f"__{k}": F.coalesce(c, F.lit(False)) for k, c in named.items()}, "__row": F.monotonically_increasing_id()})
    base = sum((F.when(F.col(f"__{k}"), R.WEIGHTS[k]).otherwise(0) for k in named), F.lit(0))
    df = df.withColumn("__base", base).where("__row >= 0")
    if always is not None:
        df = df.where(always | (F.col("__base") >= R.FLAGGED_SCORE - (R.WEIGHTS["fuzzy_match"] if fuzzy != "off" else 0)))
    df = df.withColumn("__fuzzy", fuzzy_best(F.col("t_norm"), fuzzy))
    near = F.col("__fuzzy.best") >= R.FUZZY_THRESHOLD
    reasons = F.concat_ws(";", *(F.when(F.col(f"__{k}"), F.lit(k)) for k in named), F.when(near, F.lit("fuzzy_match")))
    score = (F.col("__base") + F.when(near, R.WEIGHTS["fuzzy_match"]).otherwise(0)).cast("int")
    df = df.withColumns({"prompty_score": score, "fuzzy_best": F.col("__fuzzy.best"), "fuzzy_template": F.col("__fuzzy.template"), "prompty_reasons": reasons})
    df = df.withColumn("prompty", F.col("prompty_score") >= R.FLAGGED_SCORE)
    return df.drop("__base", "__row", "__other", "__fuzzy", *(f"__{k}" for k in named))
