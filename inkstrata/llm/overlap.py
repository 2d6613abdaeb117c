"""Problem 2: the same or nearly the same record in training and evaluation splits.

Winnowing: of every window of rolling k-gram hashes the least is a record's fingerprint.
Fingerprints are joined across the splits, shared k-grams of each candidate pair are chained where
they are collinear, the gaps between them are aligned, and the aligned share of the longer record
decides.

Copies (equal token sequences) are collapsed to a class before anything is joined, so a text that
fills a third of the table costs one record.  Fingerprints are counted (with map-side partial
counts) before they are joined: of those that are frequent on both sides a record leaves out only as
many of the most frequent as do not matter for a match that shares KEPT of them (prefix filtering).
KEPT is an average, not a bound: a match that shares less can be lost.

Null and blank texts and rows without split take no part; a text without any letter or digit has no
tokens and takes no part; repeated ids are taken once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .canon import mix, plain, token_hashes
from .common import cut, pieces

#: Tokens of a k-gram and k-grams of a window, for records of up to SHORT and from LONG tokens; those between have both kinds.
SCALES = ((2, 1, 7, 10), (4, 1, 0, 56), (5, 7, 40, 1 << 60))
#: A fingerprint shared by at most so many pairs of classes is joined for all its records, one beyond for those that need it.
PAIRS = 200
SHARE = 0.85
#: Part of a record's fingerprints that a match is taken to share (a share of 0.85 leaves about a third on average, not at least), and part that must meet in the join (one at least).
KEPT, SEEDED = 0.3, 0.06
#: Ids of records to align that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Words of the bitmap that sifts fingerprints (8 MB at most, whatever the data).
BITMAP_WORDS = 1 << 20


def kgrams(tokens: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of k tokens of a flat array."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + tokens[i : i + n]
    return mix(h)


def winnow(hashes: np.ndarray, owner: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of each window of w consecutive hashes of one owner; all of an owner with fewer than w: its least."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    left = np.repeat(first + size, size) - np.arange(n)  # hashes of the owner from here on
    best = np.arange(n)
    value = hashes.copy()
    for i in range(1, w):
        if n > i:
            other = hashes[i:]
            take = (other < value[: n - i]) & (left[: n - i] > i)
            value[: n - i][take] = other[take]
            best[: n - i][take] = np.flatnonzero(take) + i
    whole = (left >= w) | (np.arange(n) == np.repeat(first, size))
    return np.unique(best[whole])


def fingerprints(forms: list[str]) -> tuple[list[int], list[bytes], list[list[int]]]:
    """Number of tokens, class key and fingerprints of each plain form."""
    hashes, offsets = token_hashes(forms)
    count = np.diff(offsets)
    owner = np.repeat(np.arange(len(forms)), count)
    prints: list[list[int]] = [[] for _ in forms]
    for k, w, least, most in SCALES:
        keep = (count >= least) & (count <= most) & (count > 0)
        mine = keep[owner]
        tok, own = hashes[mine], owner[mine]
        grams = kgrams(tok, k)
        if len(grams):
            inside = own[: len(grams)] == own[k - 1 :]
            grams, gown = grams[inside] ^ np.uint64(k), own[: len(inside)][inside]
            at = winnow(grams, gown, w)
            grams, gown = grams[at], gown[at]
            cuts = np.searchsorted(gown, np.arange(len(forms) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                prints[i] += np.unique(grams[cuts[i] : cuts[i + 1]]).astype(np.int64).tolist()
    raw = hashes.tobytes()
    import xxhash

    keys = []
    for i in range(len(forms)):
        key = xxhash.xxh3_128_digest(raw[8 * offsets[i] : 8 * offsets[i + 1]])
        keys.append(key)
        if count[i] and not prints[i]:  # shorter than a k-gram: the whole record is its fingerprint
            prints[i] = [int.from_bytes(key[:8], "little", signed=True)]
    return count.tolist(), keys, prints


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, k: int = 5) -> int:
    """Tokens in common, in order: chain of collinear k-grams that are unique in both, gaps aligned exactly."""
    ga, gb = kgrams(a, k), kgrams(b, k)
    ua, ia, ca = np.unique(ga, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(gb, return_index=True, return_counts=True)
    ua, ia, ub, ib = ua[ca == 1], ia[ca == 1], ub[cb == 1], ib[cb == 1]
    _, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    pa_, pb_ = ia[xa], ib[xb]
    order = np.argsort(pa_, kind="stable")
    pa_, pb_ = pa_[order].tolist(), pb_[order].tolist()
    # Longest chain that increases in both records (patience sorting).
    from bisect import bisect_left

    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pb_)
    for i, y in enumerate(pb_):
        j = bisect_left(tails, y)
        if j == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[j], at[j] = y, i
        back[i] = at[j - 1] if j else -1
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append((pa_[i], pb_[i]))
        i = back[i]
    total = x = y = 0
    al, bl = a.tolist(), b.tolist()
    for s, t in reversed(chain):
        if s < x or t < y:  # overlaps the seed before: it adds what reaches beyond on one diagonal
            over = max(x - s, y - t)
            if over >= k or s - t != x - y:
                continue
            s, t, run = s + over, t + over, k - over
        else:
            run = k
            total += lcs(al[x:s], bl[y:t])
        total += run
        x, y = s + run, t + run
    return total + lcs(al[x:], bl[y:])


def _records(df: DataFrame, id_col: str, text: str, side: str) -> DataFrame:
    """``id, train, meta, c1, c2, prints``; meta is the number of tokens, c1 and c2 are the class key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            counts, keys, prints = fingerprints([plain(t) for t in b.column(2).to_pylist()])
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(prints, pa.list_(pa.int64()))], ["id", "train", "n", "c1", "c2", "prints"])
            yield out.filter(pa.compute.greater(out.column(2), 0))

    rows = df.select(F.col(id_col).alias("id"), F.col(side).alias("train"), F.col(text).alias("text")).where("id is not null and train is not null and text is not null")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, train boolean, n int, c1 long, c2 long, prints array<long>")


def _tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            hashes, offsets = token_hashes([plain(t) for t in b.column(1).to_pylist()])
            short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(short))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tokens array<int>")


def _sifted(prints: DataFrame, shared: DataFrame) -> DataFrame:
    """Drops most rows whose fingerprint is not among ``shared`` before they are shuffled, by a bitmap of at most BITMAP_WORDS longs."""
    words = 1 << 10
    count = shared.count()
    while words < BITMAP_WORDS and words * 8 < count:
        words *= 2
    h = F.xxhash64("fp")
    word, bit = F.pmod(h, F.lit(words)).cast("int"), F.shiftright(h, 40).bitwiseAND(63).cast("int")
    bits = shared.select(word.alias("word"), F.expr("shiftleft(1L, cast(shiftright(xxhash64(fp), 40) & 63 as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    kept = prints.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(bits), "word")  # its size is bounded by the number of words
    return kept.where(F.expr("(shiftright(bits, bit) & 1L) = 1L")).select("fp", "rep", "meta")


def cross_split_pairs(df: DataFrame, id_col: str, train: str, text: str = "text", share: float = SHARE) -> DataFrame:
    """Pairs ``train_id, other_id, coverage``: records of either side whose texts share at least ``share`` of the longer one's tokens, in order.

    ``train`` names a boolean column: true for training records, false for the others, null for rows that take no part.
    """
    records = cut(_records(df, id_col, text, train))
    cls = ["c1", "c2"]
    members = records.select(*cls, "id", "train").distinct()
    classes = members.groupBy(*cls).agg(F.min("id").alias("rep"), F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("o"), F.count("*").alias("copies"))
    # One record of each class, without moving the fingerprints: only rows of classes with copies need to be told whether they stand for their class.
    told = cut(members.join(classes.where("copies > 1"), cls).select("id", (F.col("id") == F.col("rep")).alias("stands"), "t", "o").groupBy("id").agg(F.bool_or("stands").alias("stands"), F.bool_or("t").alias("t"), F.bool_or("o").alias("o")))
    if told.count() <= BROADCAST_IDS:
        told = F.broadcast(told)
    reps = records.select(F.col("id").alias("rep"), "n", "prints", "train").join(told.withColumnRenamed("id", "rep"), "rep", "left").where("stands is null or stands")
    of_t, of_o = F.coalesce("t", "train"), F.coalesce("o", ~F.col("train"))
    # Side flags, tokens and number of fingerprints travel as one number.
    meta = (F.col("n").cast("long") * (1 << 32) + F.least(F.size("prints"), F.lit((1 << 29) - 1)) * 4 + F.when(of_t, 2).otherwise(0) + F.when(of_o, 1).otherwise(0)).alias("meta")
    prints = reps.select("rep", meta, F.explode("prints").alias("fp"))
    is_t, is_o = F.col("meta").bitwiseAND(2) > 0, F.col("meta").bitwiseAND(1) > 0
    sides = F.sum(F.when(is_t, 1 << 31).otherwise(0) + F.when(is_o, 1).otherwise(0)).alias("sides")
    nt, no = F.shiftright("sides", 31), F.col("sides").bitwiseAND((1 << 31) - 1)
    shared = cut(prints.groupBy("fp").agg(sides).where((nt > 0) & (no > 0)).select("fp", (nt * no).alias("pairs")))
    rare, frequent = shared.where(F.col("pairs") <= PAIRS), shared.where(F.col("pairs") > PAIRS)
    useful = cut(_sifted(prints, rare).join(rare.select("fp"), "fp").select("fp", "rep", "meta"))
    # Prefix rule: of P fingerprints a match shares KEPT * P on average; one that does shares SEEDED * P among all but the (KEPT - SEEDED) * P most frequent
    # ones. Only those are left out, and only where they are frequent: such a match keeps enough to be found.
    size_of = F.shiftright("meta", 2).bitwiseAND((1 << 29) - 1)
    own = W.partitionBy("rep")
    some = _sifted(prints, frequent).join(frequent, "fp").withColumn("frequent", F.count("*").over(own)).where(F.col("frequent") > (KEPT - SEEDED) * size_of)
    more = some.withColumn("rank", F.row_number().over(own.orderBy("pairs", "fp"))).where(F.col("rank") <= F.col("frequent") - (KEPT - SEEDED) * size_of + 1)
    useful = useful.unionByName(more.select("fp", "rep", "meta"))
    a, b = useful.where(is_t).alias("a"), useful.where(is_o).alias("b")
    n, size = (lambda x: F.shiftright(f"{x}.meta", 32)), (lambda x: F.shiftright(f"{x}.meta", 2).bitwiseAND((1 << 29) - 1))
    near = (F.col("a.fp") == F.col("b.fp")) & (F.col("a.rep") != F.col("b.rep")) & (F.least(n("a"), n("b")) >= share * F.greatest(n("a"), n("b")))
    seeds = a.join(b, near).select(F.least("a.rep", "b.rep").alias("x"), F.greatest("a.rep", "b.rep").alias("y"), F.least(size("a"), size("b")).alias("size"), "a.fp")
    pairs = cut(seeds.groupBy("x", "y").agg(F.count("fp").alias("seeds"), F.first("size").alias("size")).where(F.col("seeds") >= F.greatest(F.lit(1.0), SEEDED * F.col("size"))).select("x", "y"))
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    text_of = cut(_tokens(df.where(F.col(text).isNotNull()).join(wanted, df[id_col] == wanted["id"], "left_semi"), id_col, text).dropDuplicates(["id"]))
    both = pairs.join(text_of.select(F.col("id").alias("x"), F.col("tokens").alias("tx")), "x").join(text_of.select(F.col("id").alias("y"), F.col("tokens").alias("ty")), "y")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share_of = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.asarray(v.values).view(np.uint32).astype(np.uint64) for v in (x, y))
                longer = max(len(p), len(q))
                pu, pc = np.unique(p, return_counts=True)
                qu, qc = np.unique(q, return_counts=True)
                _, i, j = np.intersect1d(pu, qu, assume_unique=True, return_indices=True)
                share_of.append(aligned(p, q) / longer if np.minimum(pc[i], qc[j]).sum() >= share * longer else 0.0)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share_of, pa.float64())], ["x", "y", "coverage"])
            yield out.filter(pa.compute.greater_equal(out.column(2), share - 1e-9))

    kind = df.schema[id_col].dataType.simpleString()
    near_pairs = both.select("x", "y", "tx", "ty").mapInArrow(align, f"x {kind}, y {kind}, coverage double")
    # Back to all members of the classes.
    named = classes.select("rep", *cls, "t", "o")
    links = near_pairs.select(F.explode(F.array(F.struct("x", "y", "coverage"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "coverage"))).alias("l")).select("l.*")
    sure = named.where("t and o").select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("coverage"))
    linked = links.unionByName(sure)
    of = lambda side, key, name: members.where(side).join(named.select("rep", *cls), cls).select(F.col("rep").alias(key), F.col("id").alias(name))
    return linked.join(of("train", "x", "train_id"), "x").join(of("not train", "y", "other_id"), "y").select("train_id", "other_id", "coverage")
