"""Linear-chain decoding of a document's tokens: recursions that relational operators cannot express.

Each document is one list of its tokens, decoded by numpy in an Arrow worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transitions(mixed: np.ndarray, smooth: float, gamma: float) -> np.ndarray:
    """Penalty of a change between each token and the next; 0 for staying."""
    return np.minimum(0.0, -smooth + gamma * mixed[:-1])


def viterbi(unary: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Best labels; the lowest class on ties.

    All changes after a token cost the same, so the best predecessor of a class is the class itself
    or the best class overall. Plain floats: the states are too few for array operations to pay.
    """
    n, k = unary.shape
    if n == 0:
        return np.zeros(0, np.int64)
    rows, costs = unary.tolist(), change.tolist()
    score, back = rows[0], []
    for i in range(1, n):
        cost, top = costs[i - 1], max(score)
        first = score.index(top)
        moved, new, froms = top + cost, [], []
        for c in range(k):
            stay = score[c]
            # On a tie between staying and coming from the best class the lower class wins.
            come = first != c and (moved > stay or (moved == stay and first < c))
            froms.append(first if come else c)
            new.append((moved if come else stay) + rows[i][c])
        score = new
        back.append(froms)
    best = score.index(max(score))
    out = [best]
    for froms in reversed(back):
        best = froms[best]
        out.append(best)
    return np.array(out[::-1], np.int64)


def marginals(unary: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Posterior of each label at each token: forward-backward on scaled weights."""
    n, k = unary.shape
    if n == 0:
        return np.zeros((0, k))
    weight = np.exp(unary - unary.max(axis=1, keepdims=True)).tolist()
    factor = np.exp(change).tolist()
    ahead = [weight[0]]
    for i in range(1, n):
        before, f = ahead[-1], factor[i - 1]
        total = sum(before)
        row = [w * (b + f * (total - b)) for w, b in zip(weight[i], before, strict=True)]
        scale = sum(row) or 1.0
        ahead.append([x / scale for x in row])
    behind, out = [1.0] * k, [None] * n
    for i in range(n - 1, -1, -1):
        row = [a * b for a, b in zip(ahead[i], behind, strict=True)]
        scale = sum(row) or 1.0
        out[i] = [x / scale for x in row]
        if i:
            own = [w * b for w, b in zip(weight[i], behind, strict=True)]
            f, total = factor[i - 1], sum(own)
            behind = [x + f * (total - x) for x in own]
            scale = sum(behind) or 1.0
            behind = [x / scale for x in behind]
    return np.array(out)


def label_runs(labels: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    bounds = [0, *cuts.tolist(), len(labels)]
    return [(a, b, int(labels[a])) for a, b in zip(bounds, bounds[1:], strict=False)] if len(labels) else []


def merge_short_runs(labels: np.ndarray, least: int) -> np.ndarray:
    """Relabels the first run below the least length from its neighbours (the longer one, the lower class on ties) until none is left."""
    runs = label_runs(labels)
    i = 0
    while len(runs) > 1 and i < len(runs):
        lo, hi, _ = runs[i]
        if hi - lo >= least:
            i += 1
            continue
        before, after = (runs[i - 1] if i else None), (runs[i + 1] if i + 1 < len(runs) else None)
        if before and after and before[2] != after[2]:
            lengths = before[1] - before[0], after[1] - after[0]
            label = before[2] if lengths[0] > lengths[1] else after[2] if lengths[1] > lengths[0] else min(before[2], after[2])
        else:
            label = (before or after)[2]
        runs[i] = (lo, hi, label)
        if after and after[2] == label:
            runs[i : i + 2] = [(lo, after[1], label)]
        if before and before[2] == label:
            runs[i - 1 : i + 1] = [(before[0], runs[i][1], label)]
        i = 0 if i < 2 else i - 2  # everything before is long enough or was looked at
    out = labels.copy()
    for lo, hi, label in runs:
        out[lo:hi] = label
    return out


DECODED = "array<struct<label:int,merged:int,confidence:double>>"


def _one(u: np.ndarray, mixed: np.ndarray, smooth: float, gamma: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    change = transitions(mixed, smooth, gamma)
    labels = viterbi(u, change)
    return labels, merge_short_runs(labels, least), marginals(u, change).max(axis=1) if len(u) else np.zeros(0)


def decode_lists(docs: DataFrame, potentials: str, smooth: float = 4.0, gamma: float = 0.5, least: int = 32) -> DataFrame:
    """Adds ``decoded``, the decoded labels of a document's tokens, from a column of ``array<struct<u0,u1,u2,mixed_logodds>>`` in order; no row leaves its task."""
    rest = [c for c in docs.columns if c != potentials]
    rows = docs.select(*rest, potentials)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(rest))
            flat = lists.flatten()
            u = np.stack([np.asarray(flat.field(i), float) for i in range(3)], axis=1) if len(flat) else np.zeros((0, 3))
            mixed = np.asarray(flat.field(3), float)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            parts = [_one(u[e - n : e], mixed[e - n : e], smooth, gamma, least) for n, e in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]
            labels, merged, sure = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            own = pa.StructArray.from_arrays([pa.array(labels, pa.int32(), safe=False), pa.array(merged, pa.int32(), safe=False), pa.array(sure, pa.float64())], ["label", "merged", "confidence"])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), own)], [*rest, "decoded"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(run, f"{fields}, decoded {DECODED}" if rest else f"decoded {DECODED}")


def decode(tokens: DataFrame, doc: str, smooth: float = 4.0, gamma: float = 0.5, least: int = 32) -> DataFrame:
    """``label`` (Viterbi), ``merged`` (short runs merged) and ``confidence`` of tokens ``doc, pos, u0, u1, u2, mixed_logodds``."""
    order = F.sort_array(F.collect_list(F.struct("pos", "u0", "u1", "u2", "mixed_logodds")))
    lists = tokens.groupBy(doc).agg(order.alias("t")).select(doc, F.col("t.pos").alias("at"), F.transform("t", lambda t: F.struct(*[t[c].cast("double").alias(c) for c in ("u0", "u1", "u2", "mixed_logodds")])).alias("p"))
    out = decode_lists(lists, "p", smooth, gamma, least)
    return out.select(doc, F.explode(F.arrays_zip("at", "decoded")).alias("z")).select(doc, F.col("z.at").alias("pos"), "z.decoded.label", "z.decoded.merged", "z.decoded.confidence")
