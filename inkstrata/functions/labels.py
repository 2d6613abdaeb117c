"""Column functions on labels, spans, fractions and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HUMAN, ASSISTED, AI = 0, 1, 2
BUCKETS = 15


def weighted_ai_fraction(human: Column, assisted: Column, ai: Column) -> Column:
    """(assisted / 2 + ai) / all; 0 where there is nothing."""
    total = human + assisted + ai
    return F.coalesce(F.try_divide(0.5 * assisted + ai, total), F.lit(0.0))


def uniform_spans(length: Column, label: Column) -> Column:
    """One span over the whole text; none for an empty one."""
    span = F.struct(F.lit(0).cast("int").alias("span_start"), length.cast("int").alias("span_end"), label.cast("int").alias("label"))
    return F.when(length > 0, F.array(span)).otherwise(F.array().cast("array<struct<span_start:int,span_end:int,label:int>>"))


def span_chars(spans: Column, label: int) -> Column:
    """Characters under a label."""
    return F.aggregate(F.filter(spans, lambda s: s["label"] == label), F.lit(0).cast("long"), lambda n, s: n + (s["span_end"] - s["span_start"]))


def span_partition_ok(spans: Column, length: Column) -> Column:
    """Spans are ordered, gap-free and cover [0, length)."""
    end = F.aggregate(spans, F.lit(0), lambda at, s: F.when((at >= 0) & (s["span_start"] == at) & (s["span_end"] >= s["span_start"]), s["span_end"]).otherwise(F.lit(-1)))
    return F.coalesce(end == length, F.lit(False))


def pure_label(spans: Column) -> Column:
    """Label of a document that has only one; null otherwise."""
    kinds = F.array_distinct(F.transform(spans, lambda s: s["label"]))
    return F.when(F.size(kinds) == 1, kinds[0])


def document_truth(human: Column, ai: Column, total: Column) -> Column:
    """human from 0.90 human characters, ai from 0.80 generated ones, else mixed."""
    n = F.greatest(total, F.lit(1))
    return F.when(human / n >= 0.90, "human").when(ai / n >= 0.80, "ai").otherwise("mixed")


def clamp(f: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), f))


def bucket_of(f: Column) -> Column:
    """Nearest of 15 buckets, halves to even."""
    return F.bround(clamp(f) * (BUCKETS - 1)).cast("int")


def bucket_target(f: Column, sharpness: float = 1.0) -> Column:
    """Mass on the two buckets around f."""
    def spread(pos: Column) -> Column:
        low = F.floor(pos)
        hi, frac = F.least(low + 1, F.lit(BUCKETS - 1)), pos - low
        a, b = F.pow(1.0 - frac, F.lit(sharpness)), F.pow(frac, F.lit(sharpness))
        return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.when(low == hi, F.when(k == low, 1.0).otherwise(0.0)).otherwise(F.when(k == low, a / (a + b)).when(k == hi, b / (a + b)).otherwise(0.0)))

    return F.transform(F.array(clamp(f) * (BUCKETS - 1)), spread)[0]


def triangular_basis(f: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    return F.greatest(zero, 1.0 - 2.0 * f), F.greatest(zero, 1.0 - 2.0 * F.abs(f - 0.5)), F.greatest(zero, 2.0 * f - 1.0)


def segment_prior(probs: Column) -> Column:
    """Three class priors of a distribution over the buckets, normalised."""
    centres = [i / (BUCKETS - 1) for i in range(BUCKETS)]
    phi = [[max(0.0, 1 - 2 * f) for f in centres], [max(0.0, 1 - 2 * abs(f - 0.5)) for f in centres], [max(0.0, 2 * f - 1) for f in centres]]
    dot = lambda w: F.aggregate(F.zip_with(probs, F.array(*[F.lit(x) for x in w]), lambda p, x: p * x), F.lit(0.0), lambda x, y: x + y)
    sums = [dot(w) for w in phi]
    total = F.greatest(sums[0] + sums[1] + sums[2], F.lit(1e-12))
    return F.array(*[s / total for s in sums])


def soft_cross_entropy(target: Column, logits: Column) -> Column:
    """-sum t log softmax(logits)."""
    top = F.array_max(logits)
    norm = F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    return F.aggregate(F.zip_with(target, logits, lambda t, x: -t * (x - norm)), F.lit(0.0), lambda s, x: s + x)


def learning_rate(step: Column, base: float, warmup: int, steps: int) -> Column:
    """Linear warm-up, then a cosine to zero."""
    rest = (step - warmup) / float(max(1, steps - warmup))
    return F.when(step < warmup, base * step / float(max(1, warmup))).otherwise(base * 0.5 * (1.0 + F.cos(F.pi() * F.least(F.lit(1.0), rest))))
