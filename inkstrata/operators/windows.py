"""Tokens, count-based windows over them, and the aggregation of overlapping observations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import segment_prior, weighted_ai_fraction

_SPACE = " \t\n\x0b\f\r"


TOKEN_LIST = "array<struct<token_start:int,token_end:int>>"


def token_lists(df: DataFrame, doc: str, *keep: str, text: str = "text") -> DataFrame:
    """``doc, keep, tokens``: the runs without ASCII white space of each text as one list, so what is computed on a document's tokens needs no shuffle."""
    import re

    import numpy as np

    solid = re.compile(f"[^{_SPACE}]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = [], [0]
            for t in b.column(b.num_columns - 1).to_pylist():
                flat += [m.span() for m in solid.finditer(t)]
                ends.append(len(flat))
            both = np.array(flat, np.int32).reshape(-1, 2)
            own = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["token_start", "token_end"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)], [doc, *keep, "tokens"])

    rows = df.where(F.col(text).isNotNull()).select(doc, *keep, text)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows.rdd.getNumPartitions() < tasks:  # a few files: the texts are spread before they grow into tokens
        rows = rows.repartition(tasks, doc)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (doc, *keep))
    return rows.mapInArrow(run, f"{fields}, tokens {TOKEN_LIST}")


def word_tokens(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """``doc, pos, token_start, token_end`` of runs without ASCII white space, one row a token."""
    return token_lists(df, doc, text=text).select(doc, F.posexplode("tokens").alias("pos", "t")).select(doc, "pos", "t.token_start", "t.token_end")


def midpoint_label(spans: Column, start: Column, end: Column) -> Column:
    """Label of the last span that begins at or before the token's middle, the first span's before all."""
    return F.coalesce(F.try_element_at(F.filter(spans, lambda s: s["span_start"] * 2 <= start + end), F.lit(-1))["label"], F.try_element_at(spans, F.lit(1))["label"])


def window_bounds(n: Column, width: int = 512, stride: int = 256) -> Column:
    """Bounds of windows over n tokens; the last one ends at n."""
    single = F.array(F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")))
    many = F.concat(F.transform(F.sequence(F.lit(0), n - width - 1, F.lit(stride)), lambda lo: F.struct(lo.cast("int").alias("lo"), (lo + width).cast("int").alias("hi"))), F.array(F.struct((n - width).cast("int").alias("lo"), n.cast("int").alias("hi"))))
    return F.when(n <= width, single).otherwise(many)


def window_targets(tokens: DataFrame, doc: str, width: int = 512, stride: int = 256, mixed: float = 0.15) -> DataFrame:
    """Weighted AI fraction and mixed flag of each window, from labelled tokens ``doc, pos, label, chars`` (and ``n``, the document's tokens, where it is known)."""
    if "n" not in tokens.columns:
        tokens = tokens.join(tokens.groupBy(doc).agg((F.max("pos") + 1).alias("n")), doc)
    # The windows that hold a token follow from its place: those of the stride that begin at most a width before it, and the last one of the document.
    pos, n = F.col("pos"), F.col("n")
    low, high = F.greatest(F.lit(0), F.ceil((pos - width + 1) / F.lit(stride)).cast("int")), F.least(F.floor(pos / F.lit(stride)), F.floor((n - width - 1) / F.lit(stride))).cast("int")
    regular = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (k * stride).cast("int"))).otherwise(F.array().cast("array<int>"))
    last = F.when(pos >= n - width, F.array((n - width).cast("int"))).otherwise(F.array().cast("array<int>"))
    starts = F.when(n <= width, F.array(F.lit(0))).otherwise(F.concat(regular, last))
    inside = tokens.select(doc, "label", "chars", "n", F.explode(starts).alias("lo"))
    inside = inside.select(doc, "lo", F.least(F.col("lo") + width, F.col("n")).cast("int").alias("hi"), "label", "chars")
    chars = [F.sum(F.when(F.col("label") == c, F.col("chars")).otherwise(0)) for c in range(3)]
    share = [F.count_if(F.col("label") == c) for c in range(3)]
    return inside.groupBy(doc, "lo", "hi").agg(weighted_ai_fraction(*chars).alias("f_ai"), ((1.0 - F.greatest(*share) / F.count("*")) > mixed).alias("mixed"))


def sampled_windows(windows: DataFrame, doc: str, most: int, draw: Column) -> DataFrame:
    """At most so many windows a document, by the least draws."""
    return windows.withColumn("rank", F.row_number().over(W.partitionBy(doc).orderBy(draw, "lo"))).where(F.col("rank") <= most).drop("rank")


def center_weight(pos: Column, lo: Column, hi: Column) -> Column:
    """Triangle over the window, 0.05 at least."""
    centre = (hi - lo - 1) / F.lit(2.0)
    return F.greatest(F.lit(0.05), 1.0 - F.abs((pos - lo) - centre) / F.greatest(centre, F.lit(1.0)))


def overlap_aggregate(windows: DataFrame, doc: str, eps: float = 1e-6) -> DataFrame:
    """One row a token from ``doc, lo, hi, token_logits, segment_probs, mixed_prob``: mean logits, mean log priors, centre-weighted mixed log odds."""
    prior = windows.withColumn("prior", F.transform(segment_prior(F.col("segment_probs")), lambda p: F.log(F.greatest(p, F.lit(eps)))))
    q = F.least(F.greatest(F.col("mixed_prob"), F.lit(eps)), F.lit(1 - eps))
    rows = prior.withColumn("odds", F.log(q / (1 - q))).select(doc, "lo", "hi", "prior", "odds", F.posexplode("token_logits").alias("k", "logits")).withColumn("pos", F.col("lo") + F.col("k"))
    weight = center_weight(F.col("pos"), F.col("lo"), F.col("hi"))
    return rows.groupBy(doc, "pos").agg(*[F.avg(F.col("logits")[c]).alias(f"f{c}") for c in range(3)], *[F.avg(F.col("prior")[c]).alias(f"f{c + 3}") for c in range(3)], (F.sum(weight * F.col("odds")) / F.greatest(F.sum(weight), F.lit(eps))).alias("mixed_logodds"))


def runs(tokens: DataFrame, doc: str, pos: str, label: str) -> DataFrame:
    """``doc, run, run_start, run_end, label``: maximal runs of one label."""
    own = W.partitionBy(doc).orderBy(pos)
    change = F.coalesce((F.lag(label).over(own) != F.col(label)).cast("int"), F.lit(0))
    return tokens.withColumn("_c", change).withColumn("run", F.sum("_c").over(own)).groupBy(doc, "run").agg(F.min(pos).alias("run_start"), (F.max(pos) + 1).alias("run_end"), F.first(label).alias("label"))


def majority_vote(tokens: DataFrame, doc: str, unit: str, label: str, out: str = "voted") -> DataFrame:
    """Adds the most frequent label of each token's unit, the lower class on ties."""
    counts = tokens.groupBy(doc, unit, label).agg(F.count("*").alias("_n"))
    best = counts.groupBy(doc, unit).agg(F.min_by(label, F.struct(-F.col("_n"), label)).alias(out))
    return tokens.join(best, [doc, unit])


def unary(features: list[Column], intercepts: list[float], weights: list[list[float]], deltas: list[float]) -> list[Column]:
    """Potentials of the classes: weights times features plus intercept and offset."""
    out = []
    for b, row, d in zip(intercepts, weights, deltas, strict=True):
        total = F.lit(b + d)
        for f, w in zip(features, row, strict=True):
            total = total + f * w
        out.append(total)
    return out


def potts(mixed_logodds: Column, smooth: float = 4.0, gamma: float = 0.5) -> Column:
    """Penalty of a change of label after a token."""
    return F.least(F.lit(0.0), -smooth + gamma * mixed_logodds)


def ai_score(logits: Column) -> Column:
    """Log odds of assisted or generated against human."""
    top = F.array_max(logits)
    return F.log(F.exp(logits[1] - top) + F.exp(logits[2] - top)) + top - logits[0]
