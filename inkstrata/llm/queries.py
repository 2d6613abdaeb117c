"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canon, langid, leak, overlap, packing, pairs, sampling, sentences, splits, tokens
from .common import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and differ in their characters."""
    return canon.same_look_pairs(table(spark, sf_dir, "documents"), "doc_id").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical text, as a hash and a length."""
    return canon.canonical_text(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5("canonical").alias("canonical_md5"), F.length("canonical").alias("canonical_chars"))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.lower(F.trim("split"))
    side = F.when(split == "train", True).when(split.isin("eval", "calibration", "test"), False)
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", split.alias("split"), side.alias("in_train"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training document and one of another split that share at least 85 % of the longer one's words in order."""
    pairs = overlap.cross_split_pairs(_sides(spark, sf_dir).drop("source", "split"), "doc_id", "in_train")
    return pairs.select(F.least("train_id", "other_id").alias("doc_id_a"), F.greatest("train_id", "other_id").alias("doc_id_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: documents, those that overlap with training documents, and their mean coverage."""
    docs = _sides(spark, sf_dir)
    pairs = overlap.cross_split_pairs(docs.drop("source", "split"), "doc_id", "in_train")
    best = pairs.groupBy(F.col("other_id").alias("doc_id")).agg(F.max("coverage").alias("coverage"), F.count("*").alias("links"))
    source = F.coalesce(F.nullif(F.lower(F.trim(F.split("source", "/")[0])), F.lit("")), F.lit("unknown"))
    other = docs.where("not in_train and text is not null").select("doc_id", "split", source.alias("source")).join(best, "doc_id", "left")
    return other.groupBy("split", "source").agg(F.count("*").alias("documents"), F.count("coverage").alias("overlapping"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


def p3_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, code points and tokens by source, language, domain, all three, and in all."""
    return tokens.token_budget(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "domain"), "doc_id", "text", "source", "lang", "domain")


def p3_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.document_tokens(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cells(table(spark, sf_dir, "hf_samples").select("sample_id", "domain", "label", "loaded_at"), table(spark, sf_dir, "domain_categories"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target cells for which too few samples are at hand."""
    return sampling.sample_report(_cells(spark, sf_dir), table(spark, sf_dir, "mix_targets")).where("unmet").select("category", "label")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target cell: rows needed, at hand and drawn, and the gap that is left."""
    return sampling.sample_report(_cells(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn sample."""
    return sampling.draw(_cells(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    raid = table(spark, sf_dir, "raid_samples").select(F.col("id").alias("record_id"), F.col("source_id").alias("key"))
    hf = table(spark, sf_dir, "hf_samples").select(F.col("sample_id").alias("record_id"), F.col("pair_id").alias("key"))
    return splits.record_groups(raid.unionByName(hf))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that belong with at least one other, and the least record of their group."""
    return _origins(spark, sf_dir).where("members > 1").select("record_id", "group_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's group and split."""
    return splits.assign_splits(_origins(spark, sf_dir), {"train": 0.8, "validation": 0.1, "test": 0.1}).select("record_id", "group_id", "split")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last delivery of each sample: its label's language and the segments of its text."""
    label = F.when(F.contains(F.col("domain"), F.lit("/")), F.element_at(F.split("domain", "/"), -1))
    rows = table(spark, sf_dir, "hf_samples").select("sample_id", "text", "loaded_at", F.trim(label).alias("label"))
    counts = langid.fit_languages(rows, "text", "label", "sample_id")
    found = langid.language_segments(rows.where("sample_id is not null"), "text", ["sample_id", "label", "loaded_at"], counts)
    return found.groupBy("sample_id").agg(F.max_by(F.struct("label", "segments"), F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)))).alias("last")).select("sample_id", "last.*")


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every sample with its language and confidence."""
    return _languages(spark, sf_dir).select("sample_id", F.posexplode("segments").alias("segment", "s")).select("sample_id", "segment", F.col("s.start").alias("seg_start"), "s.lang", "s.confidence")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose label is missing or wrong, and the segments of mixed samples."""
    codes = F.create_map(*[F.lit(x) for pair in langid.CODE_OF.items() for x in pair])
    word = F.lower("label")
    rows = _languages(spark, sf_dir).withColumn("code", F.coalesce(codes[word], codes[F.split(word, "[-_]")[0]]))
    mixed = F.size("segments") > 1
    off = (F.size("segments") == 1) & (F.col("code").isNull() | (F.col("code") != F.col("segments")[0]["lang"]))
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.try_element_at("segments", F.lit(1))["lang"].alias("lang")))
    many = F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["lang"].alias("lang")))
    return rows.where(mixed | off).select("sample_id", F.explode(F.when(mixed, many).otherwise(one)).alias("s")).select("sample_id", F.col("s.start").alias("seg_start"), "s.lang")


def p7_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect of every edit pair with the classifier's score."""
    label = F.when(F.contains(F.col("domain"), F.lit("/")), F.element_at(F.split("domain", "/"), -1))
    labelled = table(spark, sf_dir, "hf_samples").select("sample_id", "text", label.alias("label"))
    reference = langid.fit_parser(labelled, "text", "label", "sample_id")
    return pairs.broken_pairs(table(spark, sf_dir, "edit_pairs"), "id", reference, order="loaded_at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defects of the edit pairs."""
    return p7_defects(spark, sf_dir).select("id", "defect")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    items = cut(tokens.document_tokens(table(spark, sf_dir, "documents"), "doc_id"))
    specs = table(spark, sf_dir, "pack_capacities").select("spec_id", F.col("capacity_tokens").alias("capacity"))
    return packing.pack(items, specs).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, pieces and share of the room used, for each capacity."""
    specs = table(spark, sf_dir, "pack_capacities").select("spec_id", "capacity_tokens")
    used = p8_containers(spark, sf_dir).groupBy("spec_id", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    per = used.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return per.join(F.broadcast(specs), "spec_id").select("spec_id", "capacity_tokens", "containers", "pieces", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole sentence of an evaluation item's passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leak.contained_items(docs, "doc_id", table(spark, sf_dir, "eval_items"), "item_id", model=sentences.fit_on(docs))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence unit of every document."""
    return sentences.sentence_units(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


def p3_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and code points by source, by domain and in all, from the token totals."""
    rows = p3_token_budget(spark, sf_dir).where("level in ('source', 'domain', 'all')")
    return rows.select("level", F.coalesce("source", "domain").alias("slice"), "documents", "chars")


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a place, for each capacity: all with a text."""
    rows = p8_containers(spark, sf_dir).select("spec_id", "doc_id").distinct()
    return rows.groupBy("spec_id").agg(F.count("*").alias("documents"))


def p10_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits within each document's sentence units: all of them, each once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    units = p10_found(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_start", "sent_end"))).alias("units"))  # a document's own units
    rows = docs.where("text is not null").join(units, "doc_id")
    said = F.array_join(F.transform("units", lambda u: F.substring(F.col("text"), u["sent_start"].cast("int") + 1, (u["sent_end"] - u["sent_start"]).cast("int"))), "")
    return rows.select("doc_id", F.length(F.regexp_replace(said, r"[^\p{L}\p{Nd}]", "")).cast("long").alias("letters"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_canonical, p2_found, p2_report, p3_token_budget, p3_document_tokens, p3_slices, p4_found, p4_report, p4_sample, p5_found, p5_splits, p6_found, p6_languages, p7_found, p7_defects, p8_containers, p8_fill, p8_placed, p9_found, p10_found, p10_letters)}
# SQL for the queries that SQL can say -----------------------------------------------------------------
_TOPIC = lambda c: rf"regexp_replace(lower(trim({c})),'[\s_\-./]+','','g')"
_LABEL = r"nullif(lower(regexp_replace(label,'^\s+|\s+$','','g')),'')"
_P4 = f"""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, {_TOPIC("split_part(domain,'/',1)")} AS topic, {_LABEL} AS l FROM hf_samples WHERE sample_id IS NOT NULL ORDER BY sample_id, loaded_at DESC),
k AS (SELECT DISTINCT {_TOPIC('domain_key')} AS topic, category FROM domain_categories), c AS (SELECT category, l, count(*) AS n FROM s JOIN k USING (topic) WHERE l IS NOT NULL GROUP BY ALL)
SELECT t.category, t.label FROM mix_targets t LEFT JOIN c ON c.category=t.category AND c.l=lower(trim(t.label)) WHERE coalesce(n,0)<greatest(min_rows, target_share*sample_rows)"""
_KEY = lambda c: f"CASE WHEN regexp_replace(regexp_replace(lower(translate({c},'{splits._WIDE}','{splits._PLAIN}')),'[^0-9]','','g'),'^0+','')<>'' THEN regexp_replace(lower(translate({c},'{splits._WIDE}','{splits._PLAIN}')),'[^\\p{{L}}]','','g')||':'||regexp_replace(regexp_replace(lower(translate({c},'{splits._WIDE}','{splits._PLAIN}')),'[^0-9]','','g'),'^0+','') END"
_P5 = f"""WITH RECURSIVE r AS (SELECT DISTINCT id AS record_id, source_id AS key FROM raid_samples UNION SELECT DISTINCT sample_id, pair_id FROM hf_samples),
n AS (SELECT DISTINCT record_id, coalesce({_KEY('record_id')},'id='||record_id) AS node, {_KEY('key')} AS key FROM r WHERE record_id IS NOT NULL),
e AS (SELECT node AS a, key AS b FROM n WHERE key IS NOT NULL AND key<>node UNION SELECT key, node FROM n WHERE key IS NOT NULL AND key<>node),
reach(node, root) AS (SELECT node, node FROM n UNION SELECT e.b, reach.root FROM reach JOIN e ON reach.node=e.a),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1), m AS (SELECT DISTINCT record_id, c FROM n JOIN comp USING (node)),
g AS (SELECT c, min(record_id) AS group_id, count(*) AS members FROM m GROUP BY 1)
SELECT record_id, group_id FROM m JOIN g USING (c) WHERE members>1"""
_SPLIT_DRAW = "('0x'||substr(md5('0:group-split:'||group_id),1,8))::BIGINT/4294967296.0::DOUBLE"
_P5_SPLITS = _P5.replace("SELECT record_id, group_id FROM m JOIN g USING (c) WHERE members>1", f"SELECT record_id, group_id, CASE WHEN {_SPLIT_DRAW}<0.8 THEN 'train' WHEN {_SPLIT_DRAW}<0.8::DOUBLE+0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM m JOIN g USING (c)")
_CLEAN = lambda c: rf"coalesce(nullif(lower(trim(regexp_replace(split_part({c},'/',1),'[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+',' ','g'))),''),'unknown')"
_P3_SLICES = f"WITH d AS (SELECT {_CLEAN('source')} AS source, {_CLEAN('domain')} AS domain, coalesce(length(text),0) AS n FROM documents) SELECT 'source' AS level, source AS slice, count(*)::BIGINT AS documents, sum(n)::BIGINT AS chars FROM d GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*)::BIGINT, sum(n)::BIGINT FROM d GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*)::BIGINT, sum(n)::BIGINT FROM d"
_P8_PLACED = "SELECT spec_id, (SELECT count(*) FROM documents WHERE length(text)>0)::BIGINT AS documents FROM pack_capacities WHERE capacity_tokens>0"
_P10_LETTERS = r"SELECT doc_id, length(regexp_replace(text,'[^\p{L}\p{Nd}]','','g'))::BIGINT AS letters FROM documents WHERE regexp_matches(text,'[^\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}\x{0085}]')"
ORACLE: dict[str, str] = {"p3_slices": _P3_SLICES, "p4_found": _P4, "p5_found": _P5, "p5_splits": _P5_SPLITS, "p8_placed": _P8_PLACED, "p10_letters": _P10_LETTERS}
