"""Mixing sources to target weights by pivotal dependent rounding.

Targets: the sources share a budget (a multiple of all sizes) by weight; a target stops at a multiple of
its source's size and the excess is shared again by weight among the others. A document of a source is
taken target / source size times: the whole part for sure, the fraction by dependent rounding. Two
fractional documents meet, and one passes words to the other, in a random direction with probabilities
that keep every expectation, until one of them is taken or left entirely. Words passed are words
received, so a source's total never changes; a group ends with one fractional document per source at most.

Distribution: documents are dealt to small groups by a hash of their id, whatever their source, so a hot
source is spread evenly. Each group's residual documents go to the next level of a reduction tree, until
one document per source is left, which a fair draw decides. Draws are hashes of the ids and the seed, so
reruns and recomputed tasks agree.

Edge cases: a null or empty text has size 0 and is taken 0 words. Null sources form one source, ranked
last. Null ids are dealt by their hash like others. Repeated rows are documents of their own; when copies
are applied to rows, rows that repeat an id share the largest count drawn for it. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import WORD, fresh_name, materialize, mix

GROUP = 1024  # documents of a group of the first level
FAN_IN = 32  # groups whose residuals meet at the next level

_FIELDS = "group long, source_id int, doc_id long, size long, base int, part double, decided boolean, taken long"


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, cap: float) -> list[float]:
    """The budget shared by weight; no target is above cap times its size, the excess is shared again."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] >= cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * float(sizes[i])
            left -= out[i]
            free.remove(i)
        left = max(left, 0.0)
    return out


def _draw(a: int, b: int, seed: int) -> float:
    x = np.array([(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed) & (2**64 - 1)], np.uint64)
    return float(mix(mix(x) + np.uint64(seed))[0] >> np.uint64(11)) / 2.0**53


def _settle(seed: int, last: bool):
    """Pivotal rounding of one group's fractional documents, source by source."""

    def over(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=mix(rows["doc_id"].fillna(0).to_numpy(np.int64).astype(np.uint64) + np.uint64(seed))).sort_values(["source_id", "order", "size"], kind="stable").reset_index(drop=True)
        part, size = rows["part"].to_numpy(float).copy(), rows["size"].to_numpy(np.int64)
        ids, source = rows["doc_id"].fillna(0).to_numpy(np.int64), rows["source_id"].to_numpy()
        held = -1
        for i in range(len(rows)):
            if held >= 0 and source[held] != source[i]:
                held = -1
            if not 0.0 < part[i] < 1.0:
                continue
            if held < 0:
                held = i
                continue
            sa, sb = float(size[held]), float(size[i])
            give, take = (1 - part[held]) * sa, part[i] * sb  # what held can get, what i can give
            up = min(give, take)
            back, room = part[held] * sa, (1 - part[i]) * sb
            down = min(back, room)
            if _draw(int(ids[held]), int(ids[i]), seed) * (up + down) < down:
                a = 1.0 if give <= take else part[held] + up / sa
                b = 0.0 if take <= give else part[i] - up / sb
            else:
                a = 0.0 if back <= room else part[held] - down / sa
                b = 1.0 if room <= back else part[i] + down / sb
            part[held], part[i] = min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)
            if 0.0 < part[i] < 1.0:
                held = i
            elif not 0.0 < part[held] < 1.0:
                held = -1
        if last:
            for i in np.flatnonzero((part > 0) & (part < 1)):
                part[i] = 1.0 if _draw(int(ids[i]), int(size[i]), seed + 1) < part[i] else 0.0
        rows["part"], rows["decided"] = part, (part <= 0) | (part >= 1)
        rows["taken"] = size * (rows["base"] + np.where(part >= 1, 1, 0))
        rows["group"] //= FAN_IN
        return rows[["group", "source_id", "doc_id", "size", "base", "part", "decided", "taken"]]

    return over


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size (words), source_size, target (of its source), taken (words, repeats counted).

    weights repeat over the sources in code point order, null last. The per-source totals, one row per
    source, are brought to the driver to set the targets: they are as many as the mix has weights."""
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(source_col).cast("string").alias("source"))
    sized = materialize(sized, "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("docs")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [int(r["total"]) for r in found]
    wanted = targets(totals, [weights[i % len(weights)] for i in range(len(found))], budget * sum(totals), cap)
    plan = spark.createDataFrame([(i, r["source"], t, w) for i, (r, t, w) in enumerate(zip(found, totals, wanted, strict=True))], "source_id int, of_source string, source_size long, target double")
    groups = max(1, math.ceil(sum(int(r["docs"]) for r in found) / GROUP))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    small = F.broadcast(plan) if len(found) <= 100_000 else plan
    level = (
        sized.join(small, F.col("source").eqNullSafe(F.col("of_source")))
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"), "source_id", "doc_id", "size", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("part"))
        .withColumn("part", F.when(F.col("size") > 0, F.col("part")).otherwise(F.lit(0.0)))
    )
    decided = []
    while True:
        last = groups == 1
        done = materialize(level.groupBy("group").applyInPandas(_settle(seed, last), _FIELDS), "mix-level")
        decided.append(done.where("decided"))
        if last:
            break
        level, groups = done.where("NOT decided").drop("decided", "taken"), math.ceil(groups / FAN_IN)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.join(small, "source_id").select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs as the mix takes them: left out, once, or repeated; all columns of docs."""
    id_col = params.get("id_col", "doc_id")
    key, copies, copy = map(fresh_name, ("id", "copies", "copy"))
    times = F.max((F.col("taken") / F.col("size")).cast("int")).alias(copies)
    taken = mix_sources(docs, **params).where("taken > 0").groupBy(F.col("doc_id").alias(key)).agg(times)
    rows = docs.join(taken, F.col(id_col).cast("long") == F.col(key))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[docs[c] for c in docs.columns])
