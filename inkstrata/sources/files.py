"""Readers and writers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAID_SCHEMA = ", ".join(f"{c} string" for c in ("id", "source_id", "model", "attack", "domain", "title", "generation"))
SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("span_start", "span_end", "label")]))
DOCUMENT_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("humanizer", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])


def read_raid_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns text, multi-line fields, an empty field is an empty text."""
    return spark.read.schema(RAID_SCHEMA).options(header=True, multiLine=True, escape='"').csv(path).na.fill("")


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines of one or more paths or globs. Strict reading fails at a torn line; else torn lines are kept apart in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*struct.fields, T.StructField("_corrupt_record", T.StringType())])
    # Lines are parsed by expression: columns are pruned in the parser, and a query may look at the torn lines alone.
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(paths).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")


def existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The paths that the patterns match, sorted; a pattern that matches nothing stands for itself."""
    from py4j.java_gateway import java_import

    jvm, out = spark._jvm, []
    java_import(jvm, "org.apache.hadoop.fs.Path")
    for p in patterns:
        path = jvm.Path(p)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        out += sorted(str(f.getPath()) for f in found) if found else [p]
    return out


def text_field(spark: SparkSession, paths: str | list[str], field: str = "text") -> DataFrame:
    """One field of JSON lines as ``text``; torn lines and empty texts are left out."""
    rows = sound_lines(read_json_lines(spark, paths, T.StructType([T.StructField(field, T.StringType())])))
    return rows.select(F.col(field).alias("text")).where("text is not null and text != ''")


def write_splits(df: DataFrame, path: str, ident: str, spec: dict, seed: int = 0) -> dict[str, int]:
    """Documents as JSON lines, a folder a split, in the order of a hash of their ids, and ``spec.json`` with the parameters and the number of rows of each split."""
    import json

    from ..functions.text import uniform

    counts = {r[0]: r[1] for r in df.groupBy("split").count().collect()}  # a row a split
    mixed = df.withColumn("_u", uniform(seed, "shuffle", F.col(ident))).repartitionByRange("split", "_u").sortWithinPartitions("split", "_u", ident).drop("_u")
    write_documents(mixed, path, by="split")
    one = df.sparkSession.createDataFrame([(json.dumps(spec | {"seed": seed, "documents": counts}, sort_keys=True),)], "value string")
    one.coalesce(1).write.mode("overwrite").text(f"{path}-spec")
    return counts


def write_pairs(df: DataFrame, path: str) -> None:
    """Appends pairs as JSON lines; the commit of a batch is all or nothing."""
    df.select("id", "source_id", "source", "target", "instruction", "intensity", "generator", "tier", "source_name").write.mode("append").json(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report of bounded size as one JSON file in a folder."""
    import json

    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_mined(cases: DataFrame, counters: DataFrame, path: str) -> dict:
    """Mined cases as JSON lines and their counters beside them."""
    cases.write.mode("overwrite").json(path)
    stats = counters.first().asDict()
    write_report(cases.sparkSession, stats, f"{path}_stats")
    return stats


def cached_subset(spark: SparkSession, folder: str, key: tuple, make) -> DataFrame:  # noqa: ANN001
    """What ``make()`` gives, kept as Parquet in a shared folder under the hash of its parameters: the same parameters read it again."""
    import hashlib

    path = f"{folder.rstrip('/')}/{hashlib.md5(repr(key).encode()).hexdigest()}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sound_lines(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents as JSON lines, spans as triples, torn lines left out."""
    rows = sound_lines(read_json_lines(spark, paths, DOCUMENT_SCHEMA))
    return rows.withColumn("spans", F.transform("spans", lambda s: F.struct(s[0].alias("span_start"), s[1].alias("span_end"), s[2].alias("label"))))


def write_documents(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> int:
    """Writes documents as JSON lines (one folder a split with ``by``) and returns their number; spans that are no partition of their text stop it."""
    from pyspark.sql import Observation

    from ..functions.labels import span_partition_ok

    sound = F.coalesce(span_partition_ok(F.col("spans"), F.length("text")), F.lit(False))
    seen = Observation("documents")
    checked = df.withColumn("spans", F.when(sound, F.col("spans")).otherwise(F.raise_error(F.concat(F.lit("spans are no partition of document "), F.col("id")))))
    rows = checked.withColumn("spans", F.transform("spans", lambda s: F.array(s["span_start"], s["span_end"], s["label"]))).observe(seen, F.count("*").alias("n"))
    writer = rows.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)
    return seen.get["n"]


def read_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Samples as JSON lines; the domain is headed by the recipe."""
    rows = sound_lines(read_json_lines(spark, paths, "text string, label string, generator string, domain string, pair_id string, recipe string"))
    return rows.withColumn("domain", F.concat_ws("/", F.nullif("recipe", F.lit("")), "domain"))


def write_samples(df: DataFrame, path: str, recipe: str) -> None:
    """Appends samples of a recipe; the commit of a batch is all or nothing."""
    df.withColumn("recipe", F.lit(recipe)).write.mode("append").json(path)


_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, tabs and breaks as blanks, runs of blanks as one, blank lines between paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    blank = {f"{_NS}{n}" for n in ("tab", "br", "cr")}
    paragraphs = ("".join(n.text or "" if n.tag == f"{_NS}t" else " " * (n.tag in blank) for n in p.iter()) for p in root.iter(f"{_NS}p"))
    tidy = (re.sub(r"\s{2,}", " ", p).strip() for p in paragraphs)
    return "\n\n".join(p for p in tidy if p)


SUFFIX = re.compile(r"\.(docx|txt|md)$", re.IGNORECASE)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of .docx, .txt and .md files; null for a file that cannot be read."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(name: str, content: bytes) -> str | None:
            try:
                return docx_text(content) if name.lower().endswith(".docx") else content.decode("utf-8")
            except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                return None

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [one(p, c) for p, c in zip(b["path"], b["content"], strict=True)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.col("path").rlike(r"(?i)\.(docx|txt|md)$")).select("path", "content").mapInPandas(extract, "path string, text string")


def boundary_documents(df: DataFrame, ident: str, text: str, change: str, least: int = 60) -> DataFrame:
    """``ident, text, spans``: human up to the word at which the author changes, generated from there; rows out of range are left out."""

    @F.pandas_udf("int")
    def offset(texts: pd.Series, words: pd.Series) -> pd.Series:
        def one(t: str | None, k: float | None) -> int | None:
            starts = [m.start() for m in re.finditer(r"\S+", t)] if t is not None and k == k and k is not None else []
            return starts[int(k)] if len(starts) >= least and 0 < k < len(starts) else None

        return pd.Series([one(t, k) for t, k in zip(texts, words, strict=True)], dtype="Int32")

    cut = df.withColumn("_cut", offset(F.col(text), F.col(change))).where("_cut is not null")
    span = lambda a, b, c: F.struct(a.cast("int").alias("span_start"), b.cast("int").alias("span_end"), F.lit(c).alias("label"))
    return cut.select(ident, F.col(text).alias("text"), F.array(span(F.lit(0), F.col("_cut"), 0), span(F.col("_cut"), F.length(text), 2)).alias("spans"))
