"""The scorer as a plug-in, window observations from it, and explanations by leaving parts out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rewrite import sentences

#: A scorer maps texts to scores in [0, 1]; it runs in the workers, a batch at a time, and keeps its model there.
Scorer = Callable[[list[str]], list[float]]


@lru_cache(100_000)
def _weight(word: str) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)


def baseline_scorer(texts: list[str]) -> list[float]:
    """Mean hash weight of the words: a deterministic stand-in for a model, without any meaning."""
    out, seen = [], {}
    for t in texts:
        total = count = 0
        for piece in t.replace("\n", ". ").replace("。", ". ").split(". "):  # no word crosses these; texts that share pieces read them once
            if (known := seen.get(piece)) is None:
                words = re.findall(r"\w+", piece.lower())
                known = seen[piece] = sum(map(_weight, words)), len(words)
            total += known[0]
            count += known[1]
        out.append(total / 4294967296 / count if count else 0.5)
    return out


def score(df: DataFrame, text: str, scorer: Scorer = baseline_scorer, out: str = "score") -> DataFrame:
    """Adds the scorer's value; null for a null text."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            here = s.notna()
            values = pd.Series([None] * len(s), dtype="float64")
            values[here.to_numpy()] = scorer(s[here].tolist())
            yield values

    return df.withColumn(out, run(F.col(text)))


def observe_windows(windows: DataFrame, text: str, scorer: Scorer = baseline_scorer) -> DataFrame:
    """Adds ``segment_probs``, ``token_logits`` and ``mixed_prob`` to windows ``lo, hi`` of word tokens, all from one score a window."""
    from ..functions.labels import bucket_target

    scored = score(windows, text, scorer, "_s")
    odds = F.log(F.greatest(F.col("_s"), F.lit(1e-6)) / F.greatest(1 - F.col("_s"), F.lit(1e-6)))
    return scored.withColumns({"segment_probs": bucket_target(F.col("_s")), "token_logits": F.array_repeat(F.array(-odds, F.lit(0.0), odds), F.col("hi") - F.col("lo")), "mixed_prob": 1 - 2 * F.abs(F.col("_s") - 0.5)}).drop("_s")


#: Code points of the variants that are made and scored at once: bounds a worker's memory whatever a text's length.
CHARS = 1 << 22
#: Tasks that may share the parts of one document at most.
TASKS = 16


def _occlusion(df: DataFrame, ident: str, text: str, scorer: Scorer, cut: Callable[[str], list[tuple[int, int]]], most: int | None, least: int) -> DataFrame:
    """A part's effect is the fall of the score without it. Every part has its row; those of a long document are spread over tasks by (id, k)."""
    kind = df.schema[ident].dataType.simpleString()
    columns = [ident, "k", "part_start", "part_end", "effect"]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, chars = [], 0
            for i, t in zip(b[ident], b[text], strict=True):
                n = len(cut(t))
                if n < least:
                    continue
                n = n if most is None else min(n, most)
                step = max(1, CHARS // max(1, len(t)), -(-n // TASKS))
                for lo in range(0, n, step):
                    rows.append((i, t, lo, min(n, lo + step)))
                    chars += len(t)
                    if chars > CHARS:
                        yield pd.DataFrame(rows, columns=[ident, text, "lo", "hi"])
                        rows, chars = [], 0
            yield pd.DataFrame(rows, columns=[ident, text, "lo", "hi"])

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t, lo, hi in zip(b[ident], b[text], b["lo"], b["hi"], strict=True):
                base, parts, step = scorer([t])[0], cut(t), max(1, CHARS // max(1, len(t)))
                for at in range(lo, hi, step):
                    end = min(hi, at + step)
                    scores = scorer([t[:a] + t[e:] for a, e in parts[at:end]])
                    yield pd.DataFrame([(i, k, *parts[k], base - s) for k, s in zip(range(at, end), scores, strict=True)], columns=columns)

    rows = df.where(F.col(text).isNotNull()).select(ident, text).mapInPandas(spread, f"{ident} {kind}, {text} string, lo int, hi int")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, ident, "lo").mapInPandas(effects, f"{ident} {kind}, k int, part_start int, part_end int, effect double")


def word_occlusion(df: DataFrame, ident: str, text: str, scorer: Scorer = baseline_scorer, most: int | None = None) -> DataFrame:
    return _occlusion(df, ident, text, scorer, lambda t: [m.span() for m in re.finditer(r"\S+", t)], most, 1)


def sentence_occlusion(df: DataFrame, ident: str, text: str, scorer: Scorer = baseline_scorer, most: int | None = None) -> DataFrame:
    return _occlusion(df, ident, text, scorer, sentences, most, 2)


def word_scores(tokens: DataFrame, words: DataFrame, doc: str, value: str, mean: bool = False) -> DataFrame:
    """Token values summed (or averaged) over the word that holds the token's first character."""
    inside = tokens.join(words, doc).where((F.col("token_start") >= F.col("word_start")) & (F.col("token_start") < F.col("word_end")))
    return inside.groupBy(doc, "word_start", "word_end").agg((F.avg if mean else F.sum)(value).alias("score"))


def scaled(df: DataFrame, value: str, doc: str) -> DataFrame:
    """Adds ``scaled``: the value over the 95th percentile of its document's magnitudes, within [-1, 1]."""
    top = F.percentile(F.abs(F.col(value)), F.lit(0.95)).over(W.partitionBy(doc))
    return df.withColumn("scaled", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(value, top), F.lit(0.0)))))
