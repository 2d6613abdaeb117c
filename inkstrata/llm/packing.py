"""Problem 8: documents of varying length into containers of fixed capacity.

Bulk-synchronous best-fit.  Sizes and gaps are whole numbers up to the capacity, so sorting either by
range means sorting its classes: equal sizes are one class, equal gaps are one class.  In a round the
items of the largest size left sweep upwards through the gaps for their successors (the least gap that
holds them), conflicts are settled by rank (the first items of a class take the first containers of a
gap class), the gaps are updated, and the next round begins.  Counting, ranking and the assignment run
over the documents, spread by hash; the sweeps of a capacity run in a task of that capacity and see
only classes, at most as many as the capacity has units, however many documents there are; nothing is
collected.  The outcome equals best-fit decreasing over the documents one by one.

A document larger than the capacity is split into full containers and a rest; others are never
split.  A document without tokens takes no room and is left out; so is a null text.  Equal sizes are
ranked by document, so the result is the same at every run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Members of a size class that are ranked together, about: a frequent class has as many parts as it needs.
PART = 50_000


def best_fit(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs ``(size, first_rank, count, first_container)`` and the number of containers, from the number of items of each size.

    A run puts the items of consecutive ranks of one size into consecutive containers.
    """
    gaps: dict[int, deque[tuple[int, int]]] = {}  # ranges of containers by gap
    order: list[int] = []
    runs: list[tuple[int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap > 0:
            if not gaps.get(gap):
                gaps[gap] = deque()
                insort(order, gap)
            gaps[gap].append((first, count))

    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        while left:
            at = bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, count = gaps[gap].popleft()
                take = min(count, left)
                if take < count:
                    gaps[gap].appendleft((first + take, count - take))
                if not gaps[gap]:
                    order.pop(at)
                runs.append((size, rank, take, first))
                leave(gap - size, first, take)
                rank, left = rank + take, left - take
            else:
                # No gap holds it: a new container takes as many as fit, best fit being the container just opened.
                each = capacity // size
                full, rest = divmod(left, each)
                for copies, bins in ((each, full), (rest, 1 if rest else 0)):
                    if bins and copies:
                        for c in range(copies):
                            runs.append((size, rank + c * bins, bins, opened))
                        leave(capacity - copies * size, opened, bins)
                        rank, left, opened = rank + copies * bins, left - copies * bins, opened + bins
    return runs, opened


def pack(items: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, container, id, piece, first_token, tokens`` for ``items(id, tokens)`` and ``specs(spec_id, capacity)``.

    ``specs`` is a table of a few rows; each capacity is packed by itself.
    """
    own = [(r.spec_id, r.capacity) for r in specs.where("spec_id is not null and capacity > 0").groupBy("spec_id").agg(F.max("capacity").cast("long").alias("capacity")).orderBy("spec_id").collect()]
    if not own:
        return items.sparkSession.createDataFrame([], f"spec_id string, container long, id {items.schema['id'].dataType.simpleString()}, piece int, first_token long, tokens long")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in own]))
    spec = items.where("tokens > 0").select("id", "tokens", each.alias("own")).select("id", "tokens", "own.*")
    number = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("tokens") / F.col("capacity")) - 1).cast("int")))
    pieces = spec.select("spec_id", "id", "capacity", "tokens", number.alias("piece"))
    size = F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity"))
    pieces = pieces.select("spec_id", "capacity", "id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), size.alias("size"), F.pmod(F.xxhash64("id", "piece"), F.lit(1 << 20)).alias("hash"))
    # Members of a size class are ranked in parts of it by hash, each behind those before: fine parts are counted, and put together until each holds about PART members.
    fine = pieces.groupBy("spec_id", "capacity", "size", F.shiftright("hash", 10).alias("fine")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("spec_id", "size").orderBy("fine").rowsBetween(W.unboundedPreceding, -1))
    fine = fine.withColumn("salt", F.floor(F.coalesce(upto, F.lit(0)) / PART).cast("int"))
    part = cut(fine.groupBy("spec_id", "capacity", "size", "salt").agg(F.sum("n").alias("n"), F.max("fine").alias("fine")))
    order = W.partitionBy("spec_id", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))

    def sweep(classes: pd.DataFrame) -> pd.DataFrame:
        runs, _ = best_fit(dict(zip(classes["size"].tolist(), classes["n"].tolist(), strict=True)), int(classes["capacity"].iloc[0]))
        out = pd.DataFrame(runs, columns=["size", "first_rank", "n", "first_container"])
        return out.assign(spec_id=classes["spec_id"].iloc[0])[["spec_id", "size", "first_rank", "n", "first_container"]]

    classes = part.groupBy("spec_id", "capacity", "size").agg(F.sum("n").alias("n"))
    runs = cut(classes.groupBy("spec_id").applyInPandas(sweep, "spec_id string, size long, first_rank long, n long, first_container long"))
    # The runs of each part: those that its ranks meet. Both sides are classes.
    meets = (F.col("first_rank") < F.col("before") + F.col("m")) & (F.col("first_rank") + F.col("n") > F.col("before"))
    of_part = part.select("spec_id", "size", "salt", "before", F.col("n").alias("m")).join(runs, ["spec_id", "size"]).where(meets)
    table = of_part.groupBy("spec_id", "size", "salt").agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("first_rank", "n", "first_container"))).alias("runs"))
    # Which part a member belongs to follows from the last fine part of each.
    bounds = part.groupBy("spec_id", "size").agg(F.sort_array(F.collect_list(F.struct("fine", "salt"))).alias("parts"))
    lookup = F.filter("parts", lambda p: p["fine"] >= F.shiftright("hash", 10))[0]["salt"]
    salted = pieces.join(F.broadcast(bounds), ["spec_id", "size"]).withColumn("salt", lookup).drop("parts")
    within = W.partitionBy("spec_id", "size", "salt").orderBy("hash", "id", "piece")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1).join(table, ["spec_id", "size", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    run = F.filter("runs", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") < r["first_rank"] + r["n"]))[0]
    placed = ranked.withColumn("run", run)
    return placed.select("spec_id", (F.col("run.first_container") + F.col("rank") - F.col("run.first_rank")).alias("container"), "id", "piece", "first_token", F.col("size").alias("tokens"))
