"""Problem 9: passages of evaluation items inside documents of a corpus.

MinHash containment search, partitioned by size.  The queries are the sentences of the items'
passages as sets of word shingles.  Framing is what stands apart from the longest paragraph (the
passage) in items of many different passages: such lines and their shingles are left out, while a
passage that several items share, in equal or reworked copies, is not.  Of a document only the
shingles that occur in some query matter for containment, so its set is cut to those before it is
hashed: a long document's set is then about as large as what it contains of the queries.  Documents
are partitioned by the size of that set; in the partition of sizes up to u the containment threshold
becomes a Jaccard threshold, which bounds u for the number of rows in a band so that a contained
sentence is found with a chance of RECALL at least.  Sets beyond the last partition are looked up in
an index from shingles to queries, which gives their containment exactly.  Candidates are verified by
exact shingle containment and by the aligned share of the sentence.

Items are handled in blocks of ITEMS, whose queries and band index go to every task (a bounded size,
whatever the corpus); each block is one pass over the documents, in which a document is hashed, looked
up and verified where it is read, so nothing of the corpus is shuffled or sent to the driver.

Null and blank texts match nothing; an item without a sentence of LEAST tokens has no query; equal
documents and equal items each get their own rows; ids may be of any type.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .canon import _tables, mix, plain, token_hashes
from .common import cut, pieces
from .overlap import kgrams, lcs
from .sentences import BoundaryModel

#: Tokens of a shingle (words; characters of unspaced scripts). Five words would lose sentences with a few words changed.
WORDS, CHARS = 3, 6
#: Different passages that may share a shingle or have a line beside them before it counts as framing, at least, and as a share of all passages.
SHARED, SHARED_PART = 3, 0.005
#: Items of a block; tokens of the shortest sentence.
ITEMS, LEAST = 2000, 6
#: Hash functions; least containment of a sentence's distinctive shingles; least share of its tokens found in order.
HASHES, CONTAINED, ALIGNED = 126, 0.35, 0.84
#: Least chance that a contained sentence becomes a candidate.
RECALL = 0.99


def recall(most: int, rows: int, query: int) -> float:
    """Least chance that a query of so many shingles, contained in a set of up to ``most``, shares a band of so many rows with it."""
    shared = min(k for k in range(query + 1) if k >= CONTAINED * query)
    jaccard = shared / max(query, query + most - shared)
    return 1 - (1 - jaccard**rows) ** (HASHES // rows)


def partitions() -> list[tuple[int, int]]:
    """Largest set of each size partition and rows of its bands: sizes up to which every query is found with RECALL. Sets beyond are exact."""
    found, low = [], 1
    for rows in (2, 1):
        most = low
        while all(recall(most + 1, rows, n) >= RECALL for n in range(3, 200)):
            most += 1
        if most > low:
            found.append((most, rows))
            low = most
    return found


PARTITIONS = partitions()


def shingles(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes and offsets of the plain forms, and the shingle at each token with the tokens where it is valid."""
    hashes, offsets, start, _ = token_hashes(forms, places=True)
    owner = np.repeat(np.arange(len(forms)), np.diff(offsets))
    kind, _ = _tables()
    first = np.cumsum([0, *(len(f) + 1 for f in forms[:-1])]) if forms else np.zeros(0, np.int64)
    cp = np.frombuffer("\0".join([*forms, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    unspaced = kind[cp[start + first[owner]]] == 2 if len(start) else np.zeros(0, bool)
    out, valid = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
    for k, mine in ((WORDS, ~unspaced), (CHARS, unspaced)):
        g = kgrams(hashes, k)
        ok = mine[: len(g)] & (owner[: len(g)] == owner[k - 1 :])
        out[: len(g)][ok], valid[: len(g)][ok] = g[ok], True
    return hashes, offsets, out, valid


@lru_cache(1)
def _seeds() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash of several non-empty sets that stand one behind the other, beginning at ``first``."""
    out = np.empty((len(first), HASHES), np.uint64)
    for j, seed in enumerate(_seeds()):
        out[:, j] = np.minimum.reduceat(mix(grams ^ seed), first)
    return out


def bands(sigs: np.ndarray, rows: int) -> np.ndarray:
    """Band keys of signatures, one row each; distinct over partitions and bands."""
    with np.errstate(over="ignore"):
        key = np.full((len(sigs), HASHES // rows), rows, np.uint64)
        for i in range(rows):
            key = mix(key * np.uint64(0x100000001B3) + sigs[:, i::rows])
        return mix(key + np.arange(key.shape[1], dtype=np.uint64)[None, :]).view(np.int64)


class Queries:
    """Sentences of a block of items: tokens, distinctive shingles, and the index of their band keys."""

    def __init__(self, items: list[tuple[object, str]], framing: set[int], common: set[int], model: BoundaryModel | None = None) -> None:
        model = model or BoundaryModel()
        self.item, self.tokens, self.grams = [], [], []
        for item, text in items:
            forms = [plain(text[a:b]) for a, b in model.units(text)]
            hashes, offsets, grams, valid = shingles(forms)
            for i in range(len(forms)):
                lo, hi = offsets[i], offsets[i + 1]
                tok = hashes[lo:hi]
                every = set(np.unique(grams[lo:hi][valid[lo:hi]]).tolist())
                own = every - common
                if len(own) < 3:
                    own = every  # a sentence of nothing but common phrases is searched as a whole
                if len(tok) < LEAST or line_key(tok) in framing or len(own) < 3:
                    continue
                self.item.append(item)
                self.tokens.append(tok)
                self.grams.append(np.array(sorted(own), np.uint64))
        self.sets = [frozenset(g.tolist()) for g in self.grams]
        every = np.concatenate([np.zeros(0, np.uint64), *self.grams])
        self.vocabulary = np.unique(every)
        # For each shingle of the vocabulary the queries that have it, one behind the other.
        self.size = np.array([len(g) for g in self.grams], np.int64)
        of = np.searchsorted(self.vocabulary, every)
        order = np.argsort(of, kind="stable")
        self.having = np.repeat(np.arange(len(self.grams)), self.size)[order]
        self.begin = np.searchsorted(of[order], np.arange(len(self.vocabulary) + 1))
        # Band keys of all queries, sorted, and the query of each.
        keys, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.grams:
            sigs = signatures(every, np.cumsum(np.concatenate(([0], self.size[:-1]))))
            for r in sorted({r for _, r in PARTITIONS}):
                k = bands(sigs, r)
                keys.append(k.ravel())
                number.append(np.repeat(np.arange(len(k)), k.shape[1]))
        flat, number = np.concatenate(keys), np.concatenate(number)
        order = np.argsort(flat, kind="stable")
        self.band, self.of_band = flat[order], number[order].astype(np.int32)

    def contained(self, grams: np.ndarray) -> np.ndarray:
        """Queries of whose shingles a set, all of the vocabulary, holds CONTAINED at least."""
        at = np.searchsorted(self.vocabulary, grams)
        count = np.zeros(len(self.grams), np.int64)
        for a, e in zip(self.begin[at].tolist(), self.begin[at + 1].tolist(), strict=True):
            count[self.having[a:e]] += 1  # a query has a shingle once
        return np.flatnonzero((count > 0) & (count >= CONTAINED * self.size))

    def candidates(self, first: np.ndarray, size: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of a set and query of each candidate, in order; the sets stand one behind the other in ``grams``."""
        sets, found, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        for most, r in PARTITIONS:
            mine = np.flatnonzero((size > low) & (size <= most))  # one shingle alone is less than CONTAINED of any query
            low = most
            if len(mine):
                begin = np.cumsum(np.concatenate(([0], size[mine][:-1])))
                k = bands(signatures(grams[np.repeat(first[mine] - begin, size[mine]) + np.arange(size[mine].sum())], begin), r)
                lo, hi = np.searchsorted(self.band, k.ravel(), "left"), np.searchsorted(self.band, k.ravel(), "right")
                hit = np.flatnonzero(hi > lo)
                count = hi[hit] - lo[hit]
                sets.append(np.repeat(mine[hit // k.shape[1]], count))
                found.append(self.of_band[np.repeat(lo[hit] - np.cumsum(np.concatenate(([0], count[:-1]))), count) + np.arange(count.sum())])
        for i in np.flatnonzero(size > PARTITIONS[-1][0]).tolist():
            k = self.contained(grams[first[i] : first[i] + size[i]])
            sets.append(np.full(len(k), i))
            found.append(k)
        both = np.unique(np.concatenate(sets) * max(1, len(self.grams)) + np.concatenate(found))
        return both // max(1, len(self.grams)), both % max(1, len(self.grams))


def line_key(tok: np.ndarray) -> int:
    return int(kgrams(tok, len(tok))[0]) if len(tok) else 0


_BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def _framing(text: str, model: BoundaryModel) -> tuple[int, set[int], set[int]]:
    """Key of an item's passage, keys of the lines that stand apart from it, and shingles of the whole."""
    paragraphs = [p for p in _BLANK_LINES.split(text.replace("\r\n", "\n")) if p.strip()]
    passage = max(paragraphs, key=len, default="")
    apart = [plain(p[a:b]) for p in paragraphs if p is not passage for a, b in model.units(p)]
    hashes, offsets, _, _ = shingles([plain(passage), *apart])
    keys = [line_key(hashes[offsets[i] : offsets[i + 1]]) for i in range(len(apart) + 1)]
    _, _, grams, valid = shingles([plain(p) for p in paragraphs])
    return keys[0], set(keys[1:]), set(np.unique(grams[valid]).tolist())


def framing_counts(items: DataFrame, item_id: str, text: str, model: BoundaryModel | None = None) -> DataFrame:
    """``kind, key`` of the lines that stand apart from, and the shingles that occur in items of, more than SHARED different passages, counted over all items."""
    model = model or BoundaryModel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            kinds, keys, passages = [], [], []
            for t in b.column(0).to_pylist():
                passage, lines, grams = _framing(t, model)
                kinds += ["line"] * len(lines) + ["gram"] * len(grams)
                keys += [*lines, *grams]
                passages += [passage] * (len(lines) + len(grams))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(passages, np.uint64).view(np.int64))], ["kind", "key", "passage"])

    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(text).distinct()
    seen = rows.mapInArrow(run, "kind string, key long, passage long").distinct()
    most = max(SHARED, int(SHARED_PART * rows.count()))
    return seen.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("kind", "key")


def contained_items(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, text: str = "text", model: BoundaryModel | None = None) -> DataFrame:
    """``doc, item, share``: documents that hold a whole sentence of an item's passage, and the best aligned share."""
    spark = docs.sparkSession
    doc_rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    item_rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    blocks = max(1, -(-item_rows.count() // ITEMS))
    shared = cut(framing_counts(items, item_id, text, model))
    found = None
    for block in range(blocks):
        own = [(r.item, r.text) for r in item_rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]  # a block of bounded size
        part = _search(doc_rows, _queries(own, shared, model or BoundaryModel()), item_rows.schema["item"].dataType)
        found = part if found is None else found.unionByName(part)
    return found


def _queries(items: list[tuple[object, str]], shared: DataFrame, model: BoundaryModel) -> Queries:
    spark = shared.sparkSession
    keys = {(kind, k) for _, t in items for kind, own in zip(("line", "gram"), _framing(t, model)[1:], strict=True) for k in own}
    common: dict[str, set[int]] = {"line": set(), "gram": set()}
    if keys:  # only those of this block's own lines and shingles
        mine = spark.createDataFrame([(kind, int(np.uint64(k).view(np.int64))) for kind, k in keys], "kind string, key long")
        for r in mine.join(shared, ["kind", "key"], "left_semi").collect():
            common[r.kind].add(int(np.int64(r.key).view(np.uint64)))
    return Queries(items, common["line"], common["gram"], model)


def _search(doc_rows: DataFrame, queries: Queries, item_type: DataType) -> DataFrame:
    sent = doc_rows.sparkSession.sparkContext.broadcast(queries)  # bounded by ITEMS
    arrow_type = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for b in pieces(batches, 1):
            hashes, offsets, grams, valid = shingles([plain(t) for t in b.column(1).to_pylist()])
            at = np.minimum(np.searchsorted(q.vocabulary, grams), len(q.vocabulary) - 1) if len(q.vocabulary) else np.zeros(len(grams), np.int64)
            known = valid & (q.vocabulary[at] == grams) if len(q.vocabulary) else np.zeros(len(grams), bool)
            # Each document's shingles once, sorted by document.
            hit = np.flatnonzero(known)
            owner = np.searchsorted(offsets, hit, "right") - 1
            order = np.lexsort((grams[hit], owner))
            own, g = owner[order], grams[hit][order]
            new = np.concatenate(([True], (own[1:] != own[:-1]) | (g[1:] != g[:-1]))) if len(g) else np.zeros(0, bool)
            own, g = own[new], g[new]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(g) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate((first, [len(g)])))
            best: dict[tuple[int, object], float] = defaultdict(float)
            last, holds = -1, frozenset()
            for i, k in zip(*(x.tolist() for x in q.candidates(first, size, g)), strict=True):
                if i != last:
                    last, holds = i, frozenset(g[first[i] : first[i] + size[i]].tolist())
                if len(q.sets[k] & holds) < CONTAINED * len(q.sets[k]):
                    continue
                d = int(own[first[i]])
                lo, hi = offsets[d], offsets[d + 1]
                share = held(q.tokens[k], q.grams[k], hashes[lo:hi], grams[lo:hi], known[lo:hi])
                if share >= least_share(len(q.tokens[k])):
                    best[d, q.item[k]] = max(best[d, q.item[k]], share)
            rows = pa.array([d for d, _ in best], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([i for _, i in best], arrow_type), pa.array(list(best.values()), pa.float64())], ["doc", "item", "share"])

    dk = doc_rows.schema["doc"].dataType.simpleString()
    return doc_rows.mapInArrow(run, f"doc {dk}, item {item_type.simpleString()}, share double")


def least_share(tokens: int) -> float:
    """Least share of a sentence's tokens in order: ALIGNED, or all but one in a short one."""
    return min(ALIGNED, (tokens - 1) / tokens - 1e-9)


def held(query: np.ndarray, distinctive: np.ndarray, tok: np.ndarray, grams: np.ndarray, valid: np.ndarray) -> float:
    """Share of a query's tokens that stand in order in the best stretch of a document; 0 below the least shingle containment."""
    at = np.flatnonzero(valid & np.isin(grams, distinctive))
    if len(np.unique(grams[at])) < CONTAINED * len(distinctive):
        return 0.0
    n, best = len(query), 0.0
    own, words = kgrams(query, WORDS), query.tolist()
    place = {int(x): i for i, x in enumerate(own.tolist())}
    place |= {int(x): i for i, x in enumerate(kgrams(query, CHARS).tolist())}
    tried: set[int] = set()
    for p in at.tolist():
        start = p - place.get(int(grams[p]), 0)
        if any(abs(start - t) <= 3 for t in tried):
            continue
        tried.add(start)
        a = max(0, start - 4)
        best = max(best, lcs(words, tok[a : start + n + 4].tolist()) / n)
        if best == 1.0:
            break
    return best
