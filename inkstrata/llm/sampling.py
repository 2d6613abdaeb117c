"""Problem 4: a sample whose shares follow targets, with least numbers and a report of the gaps.

The targets give the margins of each category column; weights of the cells are raked by iterative
proportional fitting until all margins hold, each cell bounded by what is at hand.  Every record
draws a weighted exponential key; in a cell all weights are equal, so the records with the least
keys come first.  A cell's quota is met by a histogram of its keys: records of the bins below the
cut are all taken, and only the bin of the cut itself (one in BINS of a cell) is ranked.  Minimums
are repaired against the cells with most to spare, and what is missing is reported.

What is collected are counts of cells and bins, bounded by the number of targets.  Null and blank
categories or labels count nowhere; repeated ids are one record; a cell without records has share
zero; ties in the key are broken by id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of a cell's keys; rounds of the fitting and the change at which it ends.
BINS, ROUNDS, TOLERANCE = 1024, 200, 1e-9


def topic_key(col: Column) -> Column:
    """Topic without case, outer blanks and word separators."""
    return F.regexp_replace(F.lower(F.trim(col)), r"(?U)[\s_\-​./]+", "")


def label_key(col: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), F.lit(""))


def cells(samples: DataFrame, categories: DataFrame) -> DataFrame:
    """``sample_id, category, label`` of every distinct sample that counts somewhere; the last delivery holds."""
    topic = topic_key(F.split("domain", "/")[0])
    keys = categories.where("domain_key is not null and category is not null").select(topic_key(F.col("domain_key")).alias("topic"), "category").dropDuplicates(["topic"])
    rows = samples.where("sample_id is not null").select("sample_id", topic.alias("topic"), label_key(F.col("label")).alias("label"), "loaded_at")
    last = rows.groupBy("sample_id").agg(F.max_by(F.struct("topic", "label"), F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)))).alias("r")).select("sample_id", "r.*")
    return last.where("label is not null").join(F.broadcast(keys), "topic").select("sample_id", "category", "label")


def rake(share: np.ndarray, available: np.ndarray, margins: list[np.ndarray], total: float) -> np.ndarray:
    """Rows of each cell: raked to the targets' margins (``margins`` hold each cell's class), never more than is at hand."""
    wanted = share / share.sum() * total if share.sum() > 0 else share * 0.0
    rows = np.minimum(wanted, available).astype(float)
    for _ in range(ROUNDS):
        before = rows.copy()
        for classes in margins:
            for c in np.unique(classes):
                own = classes == c
                goal, now = wanted[own].sum(), rows[own].sum()
                if now > 0:
                    rows[own] = np.minimum(rows[own] * goal / now, available[own])
        if np.abs(rows - before).max(initial=0.0) < TOLERANCE:
            break
    return rows


def quotas(share: np.ndarray, least: np.ndarray, available: np.ndarray, margins: list[np.ndarray], total: int) -> np.ndarray:
    """Whole rows of each cell: raked, rounded by largest remainder, least numbers repaired from the cells furthest above theirs."""
    raked = rake(share, available.astype(float), margins, float(total))
    rows = np.floor(raked + 1e-9).astype(np.int64)
    order = np.argsort(-(raked - rows), kind="stable")
    for i in order[: max(0, int(round(raked.sum())) - int(rows.sum()))]:
        rows[i] += rows[i] < available[i]
    floor = np.minimum(least, available)
    rows = np.maximum(rows, floor)
    target = share * total
    while rows.sum() > total:  # at most one step a row added above
        spare = np.where(rows > floor, rows - target, -np.inf)
        if not np.isfinite(spare.max()):
            break
        rows[int(spare.argmax())] -= 1
    while rows.sum() < total and (rows < available).any():
        need = np.where((rows < available) & (share > 0), (target - rows) / np.maximum(target, 1e-9), -np.inf)
        if not np.isfinite(need.max()):
            break
        i = int(need.argmax())
        rows[i] += min(int(available[i] - rows[i]), max(1, int((total - rows.sum()) // 2)))
    return rows


def _plan(counts: DataFrame, targets: DataFrame) -> list[dict]:
    """Target, need, rows at hand and quota of each cell; as many rows as targets."""
    want = targets.where("category is not null and label is not null").select("category", label_key(F.col("label")).alias("key"), "label", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), "sample_rows")
    rows = [r.asDict() for r in want.join(counts.withColumnRenamed("label", "key"), ["category", "key"], "left").orderBy("category", "key").collect()]
    if not rows:
        return rows
    share, least, have = (np.array([r[c] or 0 for r in rows], float) for c in ("target_share", "min_rows", "available"))
    margins = [np.unique([r[c] for r in rows], return_inverse=True)[1] for c in ("category", "key")]
    total = int(max(r["sample_rows"] or 0 for r in rows))
    own = quotas(share, least.astype(np.int64), have.astype(np.int64), margins, total)
    for r, s, n in zip(rows, share, own.tolist(), strict=True):
        r |= {"available": int(r["available"] or 0), "quota": int(n), "needed": max(float(r["min_rows"]), float(s) * total), "total": total}
    return rows


def sample_report(found: DataFrame, targets: DataFrame) -> DataFrame:
    """``category, label, target_share, needed, available, quota, gap, unmet`` of each target cell."""
    counts = found.groupBy("category", "label").agg(F.count("*").alias("available"))
    rows = _plan(counts, targets)
    data = [(r["category"], r["label"], float(r["target_share"]), r["needed"], r["available"], r["quota"], max(0, math.ceil(r["needed"] - 1e-9) - r["quota"]), r["available"] < r["needed"]) for r in rows]
    return found.sparkSession.createDataFrame(data, "category string, label string, target_share double, needed double, available long, quota long, gap long, unmet boolean")


def draw(found: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The sample: ``sample_id, category, label, weight``."""
    spark = found.sparkSession
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:rake:"), F.col("sample_id"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = found.select("sample_id", "category", "label", u.alias("u"))
    binned = keyed.withColumn("bin", F.floor(F.col("u") * BINS).cast("int"))
    counts = binned.groupBy("category", "label", "bin").agg(F.count("*").alias("n"))
    rows = _plan(counts.groupBy("category", "label").agg(F.sum("n").alias("available")), targets)
    by_cell = {(r["category"], r["key"]): r for r in rows}
    wanted = targets.select("category", label_key(F.col("label")).alias("label")).distinct()
    hist: dict[tuple, list[tuple[int, int]]] = {}
    for r in counts.join(F.broadcast(wanted), ["category", "label"]).collect():  # at most BINS a target
        hist.setdefault((r.category, r.label), []).append((r.bin, r.n))
    cuts = []
    for cell, r in by_cell.items():
        left, at = r["quota"], BINS
        for b, n in sorted(hist.get(cell, [])):
            if n >= left:
                at = b
                break
            left -= n
        weight = r["quota"] / r["available"] if r["available"] else 0.0
        cuts.append((*cell, at, left, weight))
    table = spark.createDataFrame(cuts, "category string, label string, cut int, rest long, weight double")
    near = binned.join(F.broadcast(table), ["category", "label"]).where("rest > 0 and bin <= cut")
    # The exponential key -ln(u)/w falls with u in a cell of one weight, so the order by u is the order by key.
    rank = F.row_number().over(W.partitionBy("category", "label").orderBy("u", "sample_id"))
    at_cut = near.where("bin = cut").withColumn("rank", rank).where("rank <= rest").drop("rank")
    return near.where("bin < cut").unionByName(at_cut).select("sample_id", "category", "label", F.round("weight", 9).alias("weight"))
