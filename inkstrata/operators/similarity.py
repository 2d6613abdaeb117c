"""Similarity of vectors and texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query vectors that are sent to every task at once.
BLOCK = 4096


def nearest_by_cosine(queries: DataFrame, rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """``ident, nearest, cosine``: the nearest other row of each query, the lower id on ties.

    The query set goes out in blocks of BLOCK vectors (a bounded broadcast each); every task keeps one
    best row a query for each of its batches, which a grouped maximum merges. Null vectors take no part.
    """
    spark = queries.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    total = q.count()
    blocks = max(1, -(-total // BLOCK))
    kind = rows.schema[ident].dataType.simpleString()
    source = rows.where(F.col(vector).isNotNull()).select(ident, vector)
    out = None
    for b in range(blocks):
        own = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        ids, m = [r.id for r in own], np.array([r.v for r in own], np.float64)
        sent = spark.sparkContext.broadcast((ids, m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            qid, qm = sent.value
            for batch in batches:
                if not len(qid) or not batch.num_rows:
                    continue
                rid = np.array(batch.column(0).to_pylist(), dtype=object)
                m = np.array(batch.column(1).to_pylist(), np.float64)
                cos = np.round(qm @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, 9)
                cos[np.array(qid, dtype=object)[:, None] == rid[None, :]] = -np.inf
                order = np.argsort(rid, kind="stable")
                at = order[cos[:, order].argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(qid, batch.schema.field(0).type), pa.array(rid[at].tolist(), batch.schema.field(0).type), pa.array(cos[np.arange(len(qid)), at])], ["q", "nearest", "cosine"])

        part = source.mapInArrow(best, f"q {kind}, nearest {kind}, cosine double").where("cosine > double('-infinity')")
        out = part if out is None else out.unionByName(part)
    top = out.groupBy("q").agg(F.max_by(F.struct("nearest", "cosine"), F.struct("cosine", -F.col("nearest"))).alias("b")) if kind in ("bigint", "int") else out.groupBy("q").agg(F.max_by(F.struct("nearest", "cosine"), "cosine").alias("b"))
    return top.select(F.col("q").alias(ident), "b.nearest", "b.cosine")


# Texts -----------------------------------------------------------------------------------------------


def common_subsequence(a: list | str, b: list | str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); 1 for two empty texts."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """Best indel ratio among the common words and the common words with either rest; 1 where one side's words are all common."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not left or not right):
        return 1.0
    p, q = f"{common} {left}".strip(), f"{common} {right}".strip()
    return max(indel_ratio(p, q), *((indel_ratio(common, p), indel_ratio(common, q)) if common else (0.0,)))


def _grams(text: str, n: int) -> set[str]:
    t = " ".join(text.lower().split())
    return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else {t} - {""}


def lexical_similarity(a: str, b: str, n: int = 3) -> float:
    """The better of the indel ratio and the mean of token-set ratio and character n-gram overlap."""
    x, y = _grams(a, n), _grams(b, n)
    overlap = len(x & y) / len(x | y) if x and y else 0.0
    return max(indel_ratio(a, b), 0.5 * token_set_ratio(a, b) + 0.5 * overlap)


def verbatim_share(source: str, candidate: str) -> float:
    """Longest run of words of the candidate that stands in the source, over the candidate's words."""
    a, b = source.lower().split(), candidate.lower().split()
    best, row = 0, {}
    where: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        where.setdefault(w, []).append(i)
    for w in b:
        row = {i: row.get(i - 1, 0) + 1 for i in where.get(w, ())}
        best = max(best, max(row.values(), default=0))
    return best / len(b) if b else 0.0


#: Thresholds of the labels, most source clauses of a candidate.
KEPT, REWRITTEN, MEANING, MERGED = 0.88, 0.45, 0.62, 2


def soft_labels(source: str, target: str, semantic=None) -> list[tuple[int, int, int, float]]:  # noqa: ANN001
    """Start, end, label (0 kept, 1 rewritten, 2 new) and similarity of each clause of the target.

    ``semantic(candidates, clause)`` may give a further similarity of meaning.
    """
    from .rewrite import clauses

    own = [source[a:b] for a, b in clauses(source)]
    candidates = [c for k in range(1, MERGED + 1) for c in ("".join(own[i : i + k]) for i in range(len(own) - k + 1))] or [source]
    out: list[tuple[int, int, int, float]] = []
    for a, b in clauses(target):
        clause = target[a:b]
        if not clause.strip():
            out.append((a, b, out[-1][2] if out else 0, 1.0))
            continue
        lexical = max(lexical_similarity(c, clause) for c in candidates)
        meaning = semantic(candidates, clause) if semantic else 0.0
        out.append((a, b, 0 if lexical >= KEPT else 1 if lexical >= REWRITTEN or meaning >= MEANING else 2, lexical))
    return out


def edit_spans(pairs: DataFrame, ident: str, source: str, target: str) -> DataFrame:
    """``ident, spans, f_ai``: spans of equal label over the target and its weighted AI fraction."""
    kind = pairs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, share = [], []
            for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own, counts = [], [0, 0, 0]
                for a, e, label, _ in soft_labels(s, t):
                    counts[label] += e - a
                    if own and own[-1]["label"] == label:
                        own[-1]["span_end"] = e
                    else:
                        own.append({"span_start": a, "span_end": e, "label": label})
                spans.append(own)
                share.append((0.5 * counts[1] + counts[2]) / sum(counts) if sum(counts) else 0.0)
            st = pa.list_(pa.struct([("span_start", pa.int32()), ("span_end", pa.int32()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, st), pa.array(share, pa.float64())], [ident, "spans", "f_ai"])

    rows = pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(ident, source, target)
    return rows.mapInArrow(run, f"{ident} {kind}, spans array<struct<span_start:int,span_end:int,label:int>>, f_ai double")
