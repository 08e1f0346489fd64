"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (one combination of the margin columns). Each sweep
scales the cells' keep probabilities to one margin after the other until the
expected tokens of the sample have the target margins and the wanted total; no
probability exceeds 1. DataFrame functions only; what grows with the corpus is
one sum per cell, and the sweeps work on cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import null_safe_left
from ..stages import write_stage

#: Rounds in which values that fall short of their target pass on what they lack.
FILL_STEPS = 12
#: Words as the token measure: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of words of a text; none in a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def text_form(text: Column, words: Column) -> Column:
    """A stand-in for a topic where a table has none: the form of the text.

    ``table`` (a bar for every ten words or more), ``shout`` (more A-Z than a-z),
    else by length ``note`` (under 100 words), ``article`` or ``treatise`` (1000 words or more).
    """
    t = F.coalesce(text, F.lit(""))
    kept = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", ""))
    return (
        F.when(10 * kept("|") >= F.greatest(words, F.lit(1)), "table")
        .when(kept("A-Z") > kept("a-z"), "shout")
        .when(words < 100, "note").when(words < 1000, "article").otherwise("treatise")
    )


def uniform(id: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the id and the seed (52 bits of an MD5), the same on every run and engine."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def reachable_targets(values: DataFrame, wanted: float, steps: int = FILL_STEPS) -> DataFrame:
    """``target`` tokens of each row (tokens, weight): proportional to the weight, but no more than there are.

    What the short ones cannot give is shared out among the others by their
    weights, and again while that makes others short.
    """
    total = values.agg(F.sum("weight")).first()[0] or 1.0
    out = values.withColumn("target", F.lit(wanted) * F.col("weight") / F.lit(total))
    short = F.col("target") >= F.col("tokens")
    before = None
    for _ in range(steps):
        had, rest, count = out.agg(
            F.sum(F.when(short, F.col("tokens")).otherwise(0)), F.sum(F.when(~short, F.col("target")).otherwise(0.0)), F.count_if(short)
        ).first()
        if count == before:
            break
        before, factor = count, (wanted - float(had or 0)) / rest if rest else 1.0
        out = out.withColumn("target", F.when(short, F.col("tokens").cast("double")).otherwise(F.col("target") * F.lit(factor)))
    return out


def rake_cells(
    cells: DataFrame, margins: Sequence[str], tokens: str = "tokens", temper: float = 0.5,
    targets: Mapping[str, DataFrame] | None = None, sweeps: int = 10, keep_share: float = 0.5,
) -> DataFrame:
    """Add ``probability``: the share of each cell's tokens to keep, so that ``keep_share`` of all tokens stay.

    ``targets`` maps a margin to a table (that column, share); a margin without
    one aims at its own shares raised to ``temper`` (1 keeps the mix, 0 gives
    every value the same). Values missing from a target table aim at nothing.
    Values that have fewer tokens than they should get theirs in full, and the
    others share what is missing; no probability exceeds 1, and what that takes
    from a cell goes to the others of its margins in the next sweeps. A null value
    is a value of its own. A cell without tokens has no say and follows the others.
    """
    targets = targets or {}
    cells = write_stage(cells, "cells")
    total = float(cells.agg(F.sum(tokens)).first()[0] or 0)
    wanted = keep_share * total
    for m in margins:
        values = cells.groupBy(m).agg(F.sum(tokens).alias("tokens"))
        if m in targets:
            values = null_safe_left(values, targets[m].select(m, F.col("share").alias("weight")), [m]).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        else:
            values = values.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(temper))).otherwise(0.0))
        aims = reachable_targets(write_stage(values, "values"), wanted).select(m, F.col("target").alias(f"__t_{m}"))
        cells = null_safe_left(cells, aims, [m])
    cells = write_stage(cells.withColumn("probability", F.lit(float(keep_share))), "cells")
    for k in range(sweeps):
        for m in margins:
            now = F.sum(F.col(tokens) * F.col("probability")).over(Window.partitionBy(m))
            scaled = F.least(F.lit(1.0), F.col("probability") * F.col(f"__t_{m}") / F.col("__now"))
            cells = cells.withColumn("__now", now).withColumn("probability", F.when(F.col("__now") > 0, scaled).otherwise(F.col("probability"))).drop("__now")
        if k % 5 == 4 and k + 1 < sweeps:
            cells = write_stage(cells, "cells")
    return cells


def margin_report(raked: DataFrame, margins: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """(margin, value, tokens, target, expected) of every margin's values: what there is, what was aimed at, what the sample will hold."""
    parts = [
        raked.groupBy(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value")).agg(
            F.sum(tokens).alias("tokens"), F.max(f"__t_{m}").alias("target"), F.sum(F.col(tokens) * F.col("probability")).alias("expected"))
        for m in margins
    ]
    return reduce(DataFrame.unionByName, parts)


def mix_documents(
    docs: DataFrame, margins: Mapping[str, Column], id: str = "doc_id", text: str = "text", temper: float = 0.5,
    targets: Mapping[str, DataFrame] | None = None, sweeps: int = 10, keep_share: float = 0.5, seed: str = "mix",
    draw: Column | None = None,
) -> DataFrame:
    """Every document's (id, margin columns, n_tokens, probability, kept); about ``keep_share`` of all tokens are kept.

    ``margins`` names each margin and gives its expression over ``docs``. One row
    per input row. The draw follows from ``draw``, the id unless given: repeated
    ids share theirs, a null id draws as the text "null". A null or empty text has no tokens and follows its cell. Extra
    columns are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"), (F.col(id) if draw is None else draw).alias("draw"), *[c.alias(f"m_{k}") for k, c in margins.items()])
    names = [f"m_{k}" for k in margins]
    counted = write_stage(d.select("id", "draw", *names, count_words(F.col("t")).alias("n_tokens")), "counted")
    cells = counted.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    own = {f"m_{k}": t.withColumnRenamed(k, f"m_{k}") for k, t in (targets or {}).items()}
    raked = write_stage(rake_cells(cells, names, "tokens", temper, own, sweeps, keep_share).select(*names, "probability"), "raked")
    out = null_safe_left(counted, raked, names)
    return out.select(
        F.col("id").alias(id), *[F.col(f"m_{k}").alias(k) for k in margins], "n_tokens", "probability",
        (uniform(F.col("draw"), seed) < F.col("probability")).alias("kept"),
    )


def sample_documents(docs: DataFrame, margins: Mapping[str, Column], id: str = "doc_id", row: str | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with their keep probability.

    The decision is joined back on ``row``, a column that tells the rows apart, or
    else on the id (a null id matches the null id, repeated ids share one
    decision). The draw follows from that column's value. The probability's column
    is named ``keep_probability`` and replaces one of that name.
    """
    key = row or id
    mixed = mix_documents(docs, margins, key, **options)
    chosen = mixed.where("kept").groupBy(key).agg(F.max("probability").alias("keep_probability"))
    left = docs.drop("keep_probability")
    r = chosen.select(F.col(key).alias("__mix_id"), "keep_probability")
    return left.join(r, left[key].eqNullSafe(F.col("__mix_id")), "inner").drop("__mix_id")
