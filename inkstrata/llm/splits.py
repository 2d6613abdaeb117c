"""Problem 5: splits that keep records of one origin together.

Records and the keys they carry are the nodes of a graph, a record that carries a key an edge; a key
that names a record is that record's node.  Connected components come from alternating large-star
and small-star steps (each a grouped minimum and a join, so a key shared by a third of all records is
aggregated on the map side and never gathered), with a checkpoint after each round.  A component's
hash falls into one of the splits' proportional ranges.

Two keys are the same if they have the same letters and the same number, in whatever case, width,
separators or leading zeros; a key without a number, or with number zero, names nothing.  Null ids
take no part, repeated deliveries are one record, and a record without a key stands alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds after which the steps end in any case; each at least halves the depth of what is left.
ROUNDS = 60
# Digits and letters of other widths and scripts, and their plain forms.
_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970)])
_PLAIN = "0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz" + "0123456789" * 3


def entity_key(col: Column) -> Column:
    """Letters in lower case, a colon, and the number without leading zeros; null where there is no number but zero."""
    plain = F.lower(F.translate(col, _WIDE, _PLAIN))
    letters, number = F.regexp_replace(plain, r"[^\p{L}]", ""), F.regexp_replace(F.regexp_replace(plain, r"[^0-9]", ""), "^0+", "")
    return F.when(number != "", F.concat_ws(":", letters, number))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of an undirected graph ``(a, b)``; the component is its least node.

    Self-loops keep a lone node; nodes are strings; nulls are left out.
    """
    edges = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    state = cut(edges.where("a != b").distinct())
    before = None
    for _ in range(ROUNDS):
        # Large-star: every larger neighbour of a node is linked with the node's least neighbour (or itself).
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small-star: every smaller neighbour and the node itself are linked with the least one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        state = cut(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct())
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(state.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def record_groups(records: DataFrame) -> DataFrame:
    """``record_id, group_id, members`` for ``records(record_id, key)``: the least record of each group, in string order, and its size."""
    rows = records.where("record_id is not null").select("record_id", F.coalesce(entity_key(F.col("record_id")), F.concat(F.lit("id="), F.col("record_id"))).alias("node"), entity_key(F.col("key")).alias("key")).distinct()
    rows = cut(rows)
    component = connected_components(rows.select(F.col("node").alias("a"), F.coalesce("key", "node").alias("b")))
    placed = cut(rows.select("record_id", "node").distinct().join(component, "node").select("record_id", "component").distinct())
    groups = placed.groupBy("component").agg(F.min("record_id").alias("group_id"), F.count("*").alias("members"))
    return placed.join(groups, "component").select("record_id", "group_id", "members")


def assign_splits(groups: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds ``split``: the range of the shares into which the group's hash falls."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:group-split:"), F.col("group_id"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    total, upto, split = sum(shares.values()), 0.0, None
    for name, share in list(shares.items())[:-1]:
        upto += share / total
        split = F.when(u < upto, name) if split is None else split.when(u < upto, name)
    last = list(shares)[-1]
    return groups.withColumn("split", F.lit(last) if split is None else split.otherwise(last))
