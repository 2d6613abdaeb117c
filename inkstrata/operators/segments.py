"""Segments of a document from the labels of its tokens, and the document's class; all on the document's own row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import document_truth, span_chars, weighted_ai_fraction

#: A segment: offsets in the text, label, mean confidence of its tokens.
SEGMENT = "struct<seg_start:long,seg_end:long,label:int,confidence:double>"


def segment_lists(docs: DataFrame, tokens: str, decoded: str, length: str) -> DataFrame:
    """Adds ``segments``, the runs of one label as ``array<SEGMENT>`` that covers the text: a run ends where its last token does, the last one where the text does.

    ``tokens`` and ``decoded`` are lists of equal length (offsets; label and confidence); a document without tokens has no segment.
    """
    rest = [c for c in docs.columns if c not in (tokens, decoded)]
    rows = docs.select(*rest, F.transform(tokens, lambda t: t["token_end"]).alias("ends"), F.transform(decoded, lambda d: d["merged"]).alias("labels"), F.transform(decoded, lambda d: d["confidence"]).alias("sure"))
    at = rest.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes = [], [0]
            ends, labels, sure = (b.column(len(rest) + k) for k in range(3))
            for n, e, y, c in zip(b.column(at).to_pylist(), ends, labels, sure, strict=True):
                e, y, c = (np.asarray(x.values) if x.is_valid else np.zeros(0) for x in (e, y, c))
                first = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1]))) if len(y) else np.zeros(0, np.int64)
                last = np.concatenate((first[1:], [len(y)])) - 1 if len(y) else first
                stop = e[last].tolist()
                if stop:
                    stop[-1] = n
                mean = np.add.reduceat(c, first) / (last - first + 1) if len(y) else c
                found += zip([0, *stop[:-1]], stop, y[first].tolist(), mean.tolist(), strict=False)
                sizes.append(len(found))
            cols = list(zip(*found, strict=True)) if found else [()] * 4
            own = pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], ["seg_start", "seg_end", "label", "confidence"])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), own)], [*rest, "segments"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(run, f"{fields}, segments array<{SEGMENT}>")


def verdict(found: Column, length: Column) -> Column:
    """``label`` (human, ai or mixed), ``f_ai`` and the three shares of characters of a document's segments."""
    spans = F.transform(found, lambda s: F.named_struct(F.lit("span_start"), s["seg_start"], F.lit("span_end"), s["seg_end"], F.lit("label"), s["label"]))
    human, assisted, ai = (span_chars(spans, c) for c in range(3))
    n = F.greatest(length, F.lit(1))
    return F.struct(document_truth(human, ai, length).alias("label"), weighted_ai_fraction(human, assisted, ai).alias("f_ai"), (human / n).alias("human"), (assisted / n).alias("assisted"), (ai / n).alias("ai"))
