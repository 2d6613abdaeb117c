"""Problem 3: exact token counts of documents and their totals by source, language and domain.

Documents beyond OVERSIZED code points are cut, but only where the tokenizer's own pattern proves
that no token can span the place: its pieces are runs of letters, of digits or of other signs, each
with at most a leading blank.  Behind a letter or digit, before a blank or a sign of another kind,
a piece always ends, and how the rest is cut depends only on what follows.  So the counts of the
parts add up to that of the whole.  The parts are spread over the workers by hash, counted and
summed; other documents are counted where they are read.  Slices are rolled up from one partial
aggregate.

Null texts count as documents without tokens; null, blank and unevenly written keys come together
(blank ones as ``unknown``); repeated rows count each time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .langid import CODE_OF

#: Vocabulary file, size from which a document is cut, and size of its parts.
TOKENIZER, OVERSIZED, PART = "byte_bpe_multi_50k.tiktoken", 16_384, 8_192
_CUT = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])|(?<=\p{L})(?=[\p{P}\p{N}])|(?<=\p{N})(?=[\p{P}\p{L}])")


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoding(path: str):  # noqa: ANN201
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("inkstrata", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> list[str]:
    """Parts of about ``size`` code points whose token counts add up to the text's; longer where no cut is proven."""
    out, start = [], 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def _counted(path: str):  # noqa: ANN202
    """Replaces the last column, a text, by its number of tokens (0 for none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in pieces(batches, -1):
            found = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int64())], [*b.schema.names[:-1], "tokens"])

    return count


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part of each text, which is the last column; ``part`` before it."""
    for b in batches:
        for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
            found = parts(t)
            own = b.slice(i, 1).take(pa.array([0] * len(found)))
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], [*b.schema.names[:-1], "part", "text"])


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _parts_of_large(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep, part, tokens`` of the documents beyond OVERSIZED, spread over the workers."""
    large = rows.where(F.length("text") > OVERSIZED).select(*keep, "text")
    return large.mapInArrow(_parted, f"{_fields(rows, list(keep))}, part int, text string").repartition(*keep, "part", F.xxhash64("text"))


def document_tokens(df: DataFrame, id_col: str, text: str = "text", path: str | None = None) -> DataFrame:
    """``id, tokens`` of every row with a text (0 for an empty one); rows with an equal id each have their own."""
    path = path or vocabulary_path()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    small = rows.where(F.length("text") <= OVERSIZED).mapInArrow(_counted(path), f"id {kind}, tokens long")
    keyed = rows.withColumn("key", F.xxhash64("text"))
    counted = _parts_of_large(keyed, "id", "key").mapInArrow(_counted(path), f"id {kind}, key long, part int, tokens long")
    # Rows of equal id and text have equal counts: their parts are summed together and shared out again.
    whole = counted.groupBy("id", "key").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("part") == 0).cast("int").alias("rows"))
    return small.unionByName(whole.select("id", F.explode(F.array_repeat(F.expr("tokens div rows"), F.col("rows"))).alias("tokens")))


def clean_key(col: Column) -> Column:
    """One form of an unevenly written key: before the first slash, without outer blanks, in lower case."""
    word = F.lower(F.trim(F.regexp_replace(F.split(col, "/")[0], r"(?U)\s+", " ")))
    return F.coalesce(F.nullif(word, F.lit("")), F.lit("unknown"))


def clean_language(col: Column) -> Column:
    """Language of a code, a regional code or a name; other labels as they are, in lower case."""
    codes = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    word = clean_key(col)
    base = F.split(word, "[-_]")[0]
    return F.coalesce(codes[word], codes[base], word)


def token_budget(df: DataFrame, id_col: str, text: str, source: str, language: str, domain: str, path: str | None = None) -> DataFrame:
    """Documents, code points and tokens of every slice: by source, by language, by domain, by all three, and in all."""
    path = path or vocabulary_path()
    keys = ["source", "lang", "domain"]
    keyed = df.select(clean_key(F.col(source)).alias("source"), clean_language(F.col(language)).alias("lang"), clean_key(F.col(domain)).alias("domain"), F.length(text).alias("chars"), F.col(text).alias("text"))
    # Each row is counted where it is read and needs no id; the first part of a cut document stands for it.
    small = keyed.where(F.coalesce(F.length("text"), F.lit(0)) <= OVERSIZED).mapInArrow(_counted(path), f"{_fields(keyed, [*keys, 'chars'])}, tokens long")
    large = _parts_of_large(keyed, *keys, "chars").mapInArrow(_counted(path), f"{_fields(keyed, [*keys, 'chars'])}, part int, tokens long")
    one = small.select(*keys, F.lit(1).alias("documents"), F.coalesce("chars", F.lit(0)).alias("chars"), "tokens")
    first = F.col("part") == 0
    many = large.select(*keys, F.when(first, 1).otherwise(0).alias("documents"), F.when(first, F.col("chars")).otherwise(0).alias("chars"), "tokens")
    slices = one.unionByName(many).groupBy(*keys).agg(F.sum("documents").alias("documents"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    keys = [F.col("source"), F.col("lang"), F.col("domain")]
    rolled = slices.groupingSets([keys, keys[:1], keys[1:2], keys[2:], []], *keys).agg(F.grouping_id().alias("g"), *(F.sum(c).alias(c) for c in ("documents", "chars", "tokens")))
    level = F.create_map(*[F.lit(x) for pair in ((0, "slice"), (3, "source"), (5, "language"), (6, "domain"), (7, "all")) for x in pair])
    return rolled.select(level[F.col("g").cast("int")].alias("level"), "source", "lang", "domain", "documents", "chars", "tokens")
