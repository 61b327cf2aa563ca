"""Mixing sources to target weights by subset sums over document lengths.

Targets. Sources in code point order (null last) have the weights 3, 1, 2, 3, 1, 2, ... and
share `budget` (150 %) of all words; no target is above `epochs` (2) times its source's
words, and what is cut off goes to the others by weight. That is a water level: target =
min(weight * level, cap), found from running sums over the sources.

Choice. A source first gives all its documents as often as its target allows whole
(0, 1 or 2 times). For the rest of the budget its documents are counted by exact length:

1. of all lengths alike, the share of the documents that the rest is of the source, but for
   SLACK times its longest document (DP_WORDS words at most). What rounding leaves of a
   length is carried on to the next ones, from a seeded start, so that lengths with a single
   document have their share too;
2. where documents are longer than DP_WORDS, single ones in a seeded order bring the last
   rest between 0 and 2 * DP_WORDS words;
3. a bounded-knapsack dynamic program over the lengths left, in a seeded order, chooses the
   reachable sum that is nearest to the last rest (of two equally near, the lower).

This runs as one small group per source whose rows are lengths, not documents. How many of
a length are taken decides the documents: the first ones by a seeded hash of doc_id, equal
ids by row. Their places are found by ranges of these (`ranks`), so no task holds a length.

No document is taken more than `epochs` times. Null and empty texts have size 0 and are
taken as size 0. Repeated rows are rows of their own. An empty table gives an empty result.
Reruns on the same table agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.ranks import ranked
from tillwise.llm.staging import Stages
from tillwise.llm.text import WORD_PATTERN

WEIGHTS = (3, 1, 2)
DP_WORDS, SLACK = 1 << 16, 8


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """source, source_size and target (words, as a double) of each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, above = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.array(*map(F.lit, weights))[(F.row_number().over(by_name) - 1) % len(weights)])
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    )
    # With the sources before this one at their caps, the rest share by weight.
    level = (F.sum("source_size").over(Window.partitionBy()) * budget - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    levels = sources.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("weight") * final, F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def nearest_sum(lengths: list[int], counts: list[int], goal: int) -> list[int]:
    """How many of each length to take, at most counts, for the sum nearest to the goal."""
    reach, steps = 1, []
    limit = goal + (min(lengths) if lengths else 0)
    mask = (1 << (limit + 1)) - 1
    for k, (length, count) in enumerate(zip(lengths, counts)):
        part = 1
        while count > 0 and not reach >> goal & 1:
            n = min(part, count)
            if length * n <= limit:
                steps.append((k, n, reach))
                reach |= reach << length * n & mask
            count -= n
            part *= 2
    low = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    high = reach >> (goal + 1)
    high = goal + (high & -high).bit_length() if high else None
    at = low if high is None or goal - low <= high - goal else high
    taken = [0] * len(lengths)
    for k, n, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += n
            at -= lengths[k] * n
    return taken


def fitted(lengths: np.ndarray, counts: np.ndarray, goal: float, seed: int = 7) -> np.ndarray:
    """How many documents of each length (positive, rising) to take once, for a sum near
    the goal."""
    total = int((lengths * counts).sum())
    goal = min(max(round(goal), 0), total)
    if not total:
        return np.zeros(len(lengths), np.int64)
    draw = np.random.default_rng(seed)
    kept_back = min(DP_WORDS, SLACK * int(lengths.max()))
    upto = np.floor(np.cumsum(counts) * (max(goal - kept_back, 0) / total) + draw.random()).astype(np.int64)
    taken = np.minimum(np.diff(upto, prepend=0), counts)
    rest = goal - int((lengths * taken).sum())
    order = draw.permutation(len(lengths))
    for k in (*order, *order):
        length = int(lengths[k])
        if rest < 0:
            n = -min(int(taken[k]), -(rest // length))
        elif rest > 2 * DP_WORDS:
            n = min(int(counts[k] - taken[k]), (rest - DP_WORDS) // length)
        else:
            break
        taken[k] += n
        rest -= n * length
    left = counts - taken
    fits = order[(left[order] > 0) & (lengths[order] <= 2 * rest)]
    taken[fits] += np.array(nearest_sum(lengths[fits].tolist(), left[fits].tolist(), rest), np.int64).reshape(-1)
    return taken


PLAN = "source string, size long, n long, whole long, extra long, source_size long, target double"


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    source_size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    whole = int(target // source_size) if source_size else 0
    lengths, counts = group["size"].to_numpy(), group["n"].to_numpy()
    some = lengths > 0
    extra = np.zeros(len(group), np.int64)
    extra[some] = fitted(lengths[some], counts[some], target - whole * source_size)
    return group.assign(whole=whole, extra=extra)[["source", "size", "n", "whole", "extra", "source_size", "target"]]


def planned(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """source, size, n, whole, extra, source_size, target: of the n documents of a source
    and length, all are taken `whole` times and `extra` of them once more."""
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    goals = targets(rows, weights, budget, epochs).withColumnRenamed("source", "s")
    return lengths.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s").groupBy("source").applyInPandas(_plan, PLAN)


def chosen(rows: DataFrame, plan: DataFrame, stages: Stages, seed: int = 11) -> DataFrame:
    """The rows (row, doc_id, source, size and more) with source_size, target and taken. Of a
    source and length the first `extra` by draw are taken once more; their places are found
    by ranges of the draw, so equal ids, which have one draw, are split as well."""
    same = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size"))
    group = F.concat(F.col("size").cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    dealt = (
        rows.alias("r")
        .join(plan.drop("n").alias("p"), same)
        .select("r.*", "whole", "extra", "source_size", "target")
        .withColumns({"draw": F.xxhash64(F.lit(seed), F.col("doc_id")), "group": group})
    )
    again = F.when(F.col("pos") < F.col("extra"), 1).otherwise(0)
    return (
        ranked(stages, "chosen", dealt, "group", ["draw", "doc_id", "row"])
        .withColumn("copies", F.col("whole") + again)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("n", "pos", "whole", "extra", "draw", "group")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), copies and taken (words)
    of every row."""
    stages = Stages(docs.sparkSession, "mixing")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size(F.col("text")).alias("size"))
    rows = stages.write(rows, "rows")
    return chosen(rows, stages.write(planned(rows, weights, budget, epochs), "plan"), stages).drop("row")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """The documents that the mix takes, all columns unchanged, with a column `copies`.
    A column of that name in the documents gives way."""
    stages = Stages(docs.sparkSession, "mixture")
    numbered = stages.write(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "documents")
    rows = numbered.select("row", "doc.doc_id", "doc.source", size(F.col("doc.text")).alias("size"))
    rows = stages.write(rows, "rows")
    taken = chosen(rows, stages.write(planned(rows, weights, budget, epochs), "plan"), stages).where("copies > 0").select("row", "copies")
    columns = [F.col("doc").getField(c).alias(c) for c in docs.columns if c != "copies"]
    return numbered.join(taken, "row").select(*columns, "copies")
