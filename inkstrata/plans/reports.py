"""Queries of prediction, evaluation and corpus handling; registered beside those of the catalog."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import windows as N
from . import catalog as C
from .catalog import SCORED, SPLIT, TOKENS, WS, query, table, u

# Prediction ------------------------------------------------------------------------------------------
_RUNS = f"(WITH g AS (SELECT *, predicted<>lag(predicted) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM {C.GUESSED}), r AS (SELECT *, sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g), s AS (SELECT doc_id, run, max(token_end) AS e, any_value(predicted) AS label FROM r GROUP BY ALL) SELECT s.doc_id, run, label, coalesce(lag(e) OVER (PARTITION BY s.doc_id ORDER BY run),0) AS seg_start, CASE WHEN lead(run) OVER (PARTITION BY s.doc_id ORDER BY run) IS NULL THEN n_chars ELSE e END AS seg_end FROM s JOIN documents d ON d.doc_id=s.doc_id)"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_chars, segments``: segments of surrogate token labels, without the chain."""
    from ..operators.segments import segment_lists

    docs = table(spark, sf_dir, "documents").where("spans is not null and size(spans) > 0")
    rows = N.token_lists(docs, "doc_id", "spans", "n_chars")

    def label(t, pos):  # noqa: ANN001, ANN202
        own = N.midpoint_label(F.col("spans"), t["token_start"], t["token_end"])
        return F.named_struct(F.lit("merged"), F.when(X.uniform(0, "guess", F.col("doc_id"), pos) < 0.9, own).otherwise((own + 1) % 3), F.lit("confidence"), F.lit(1.0))

    labelled = rows.where(F.size("tokens") > 0).select("doc_id", "n_chars", "tokens", F.transform("tokens", label).alias("decoded"))
    return segment_lists(labelled, "tokens", "decoded", "n_chars")


@query(f"SELECT doc_id, run::BIGINT AS run, seg_start::BIGINT AS seg_start, seg_end::BIGINT AS seg_end, label::INT AS label FROM {_RUNS}")
def predicted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that cover each text, from runs of surrogate token labels."""
    rows = _observed(spark, sf_dir).select("doc_id", F.posexplode("segments").alias("run", "s"))
    return rows.select("doc_id", F.col("run").cast("long").alias("run"), "s.seg_start", "s.seg_end", "s.label")


_SHARE = lambda c: f"coalesce(sum(seg_end-seg_start) FILTER (WHERE label={c}),0)/greatest(any_value(n_chars),1)::DOUBLE"


@query(f"WITH s AS (SELECT r.*, d.n_chars FROM {_RUNS} r JOIN documents d USING (doc_id)), f AS (SELECT doc_id, count(*) AS segments, {_SHARE(0)} AS human, {_SHARE(1)} AS assisted, {_SHARE(2)} AS ai FROM s GROUP BY doc_id) SELECT doc_id, segments::INT AS segments, round(human,9) AS human, round(assisted,9) AS assisted, round(ai,9) AS ai, round(0.5::DOUBLE*assisted+ai,9) AS f_ai, CASE WHEN human>=0.9 THEN 'human' WHEN ai>=0.8 THEN 'ai' ELSE 'mixed' END AS verdict FROM f")
def document_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, shares of characters, weighted AI fraction and verdict of each document."""
    from ..operators.segments import verdict

    rows = _observed(spark, sf_dir).withColumn("v", verdict(F.col("segments"), F.col("n_chars")))
    return rows.select("doc_id", F.size("segments").alias("segments"), *[F.round(f"v.{c}", 9).alias(c) for c in ("human", "assisted", "ai", "f_ai")], F.col("v.label").alias("verdict"))


@query(f"WITH s AS (SELECT r.*, d.n_chars FROM {_RUNS} r JOIN documents d USING (doc_id)), f AS (SELECT doc_id, {_SHARE(0)} AS human, {_SHARE(2)} AS ai FROM s GROUP BY doc_id) SELECT truth, CASE WHEN human>=0.9 THEN 'human' WHEN ai>=0.8 THEN 'ai' ELSE 'mixed' END AS verdict, count(*)::BIGINT AS documents FROM f JOIN (SELECT doc_id, truth FROM {SCORED}) USING (doc_id) GROUP BY ALL")
def prediction_against_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by true class (from one table) and predicted class (from another), joined by id."""
    s = F.col("spans")
    truth = table(spark, sf_dir, "documents").where("spans is not null and text is not null").select("doc_id", L.document_truth(L.span_chars(s, 0), L.span_chars(s, 2), F.col("n_chars")).alias("truth"))
    return document_predictions(spark, sf_dir).select("doc_id", "verdict").join(truth, "doc_id").groupBy("truth", "verdict").agg(F.count("*").alias("documents"))


# Evaluation ------------------------------------------------------------------------------------------
_GENERATOR = "meta['generator']"


@query(f"SELECT level, source, generator, n::BIGINT AS n, fpr, fnr, mixed_accuracy FROM (SELECT CASE WHEN grouping(source)=0 THEN 'source' WHEN grouping(generator)=0 THEN 'generator' ELSE 'all' END AS level, source, generator, {C._RATES}, count(*) FILTER (WHERE truth='ai') AS ai FROM (SELECT s.*, {_GENERATOR} AS generator FROM {SCORED} s JOIN documents d USING (doc_id)) GROUP BY GROUPING SETS ((source),(generator),())) WHERE level<>'generator' OR (generator IS NOT NULL AND ai>0)")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates in all, by source and by generator, from one partial aggregate; generators with no generated text are left out."""
    meta = table(spark, sf_dir, "documents").select("doc_id", F.try_element_at("meta", F.lit("generator")).alias("generator"))
    rows = C._scored(spark, sf_dir).join(meta, "doc_id")
    s, g, t, p = (F.col(c) for c in ("source", "generator", "truth", "predicted"))
    level = F.when(F.grouping("source") == 0, "source").when(F.grouping("generator") == 0, "generator").otherwise("all")
    out = rows.groupingSets([[s], [g], []], s, g).agg(level.alias("level"), F.count("*").alias("n"), M.ratio((t == "human") & (p != "human"), t == "human").alias("fpr"), M.ratio((t == "ai") & (p != "ai"), t == "ai").alias("fnr"), M.ratio((t == "mixed") & (p == "mixed"), t == "mixed").alias("mixed_accuracy"), F.count_if(t == "ai").alias("ai"))
    kept = out.where((F.col("level") != "generator") | (F.col("generator").isNotNull() & (F.col("ai") > 0))).drop("ai")
    return C._rounded(kept, "fpr", "fnr", "mixed_accuracy")


@query(f"SELECT generator, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE predicted<>'ai')/count(*)::DOUBLE,9) AS fnr FROM (SELECT s.*, {_GENERATOR} AS generator FROM {SCORED} s JOIN documents d USING (doc_id)) WHERE truth='ai' AND coalesce(generator,'')<>'' GROUP BY 1")
def fnr_by_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed share of the generated documents of each generator."""
    meta = table(spark, sf_dir, "documents").select("doc_id", F.try_element_at("meta", F.lit("generator")).alias("generator"))
    rows = C._scored(spark, sf_dir).where("truth = 'ai'").join(meta.where("coalesce(generator, '') != ''"), "doc_id")
    return rows.groupBy("generator").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("predicted") != "ai") / F.count("*"), 9).alias("fnr"))


_WINDOWED = f"(SELECT b.doc_id, sum(w*round({u('segment', 'b.doc_id', 'lo')}*14))/(14.0::DOUBLE*sum(w)) AS score FROM {C.BOUNDS(TOKENS)} b GROUP BY 1)"
_TRUTHS = f"(SELECT doc_id, truth FROM {SCORED})"


def _window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, score, truth``: surrogate fractions of a document's windows, weighted by their tokens."""
    docs = N.token_lists(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.size("tokens").alias("n")).where("n > 0")
    part = F.transform(N.window_bounds(F.col("n"), 64, 32), lambda w: F.named_struct(F.lit("w"), w["hi"] - w["lo"], F.lit("f"), F.round(X.uniform(0, "segment", F.col("doc_id"), w["lo"]) * 14)))
    mass = F.aggregate(F.col("p"), F.lit(0.0), lambda s, x: s + x["w"] * x["f"]) / (14.0 * F.aggregate(F.col("p"), F.lit(0).cast("long"), lambda s, x: s + x["w"]))
    return docs.select("doc_id", part.alias("p")).select("doc_id", mass.alias("score")).join(C._scored(spark, sf_dir).select("doc_id", "truth"), "doc_id")


@query(f"WITH s AS (SELECT score, truth FROM {_WINDOWED} JOIN {_TRUTHS} USING (doc_id)) SELECT truth, count(*)::BIGINT AS documents, round(avg(score),6) AS mean_f_ai FROM s GROUP BY 1")
def segment_head_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean token-weighted fraction of each true class."""
    return _window_scores(spark, sf_dir).groupBy("truth").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 6).alias("mean_f_ai"))


@query(f"WITH s AS (SELECT round(score,6) AS score, truth='ai' AS positive FROM {_WINDOWED} JOIN {_TRUTHS} USING (doc_id) WHERE truth IN ('human','ai')), r AS (SELECT positive, rank() OVER (ORDER BY score)+(count(*) OVER (PARTITION BY score)-1)/2.0::DOUBLE AS rk FROM s), a AS (SELECT round((sum(rk) FILTER (WHERE positive)-count(*) FILTER (WHERE positive)*((count(*) FILTER (WHERE positive))+1)/2.0::DOUBLE)/((count(*) FILTER (WHERE positive))*(count(*) FILTER (WHERE NOT positive)))::DOUBLE,9) AS auroc FROM r), n AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS m FROM s WHERE NOT positive), " + ", ".join(f"t{k} AS (SELECT round((count(*) FILTER (WHERE positive AND score>=t))/(count(*) FILTER (WHERE positive))::DOUBLE,9) AS tpr FROM s, (SELECT coalesce(max(score) FILTER (WHERE rn=floor({f}::DOUBLE*m)), max(score)+1e-9) AS t FROM n))" for k, f in ((10, 0.1), (1, 0.01))) + " SELECT auroc, t10.tpr AS tpr_at_10, t1.tpr AS tpr_at_1 FROM a, t10, t1")
def segment_head_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC and true positive rates at 10 % and 1 % false positives of the token-weighted fractions."""
    rows = _window_scores(spark, sf_dir).where("truth in ('human', 'ai')").select(F.round("score", 6).alias("score"), (F.col("truth") == "ai").alias("positive"))
    one = M.auroc(rows, "score", "positive")
    for f, name in ((0.1, "tpr_at_10"), (0.01, "tpr_at_1")):
        one = one.crossJoin(F.broadcast(M.tpr_at_fpr(rows, "score", "positive", f).select(F.col("tpr").alias(name))))  # one row each
    return C._rounded(one, "auroc", "tpr_at_10", "tpr_at_1")


@query(f"WITH p AS (SELECT doc_id, k, ({u('bucket', 'doc_id', 'k')}+1e-9) AS x FROM documents, range(15) t(k)), q AS (SELECT doc_id, k, x/sum(x) OVER (PARTITION BY doc_id) AS p FROM p), f AS (SELECT doc_id, sum(p*k/14.0::DOUBLE) AS f FROM q GROUP BY 1) SELECT round(avg(abs(f-t)),6) AS mae, round(avg(f) FILTER (WHERE t>=0.95)-avg(f) FILTER (WHERE t<=0.05),6) AS pole_gap, count(*)::BIGINT AS documents FROM f JOIN (SELECT doc_id, ({C._CHARS(2)}+0.5::DOUBLE*{C._CHARS(1)})/n_chars AS t FROM documents WHERE spans IS NOT NULL AND n_chars>0) USING (doc_id)")
def training_eval_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error of the fraction and the gap between its poles, from surrogate bucket distributions."""
    s = F.col("spans")
    docs = table(spark, sf_dir, "documents").where("spans is not null and n_chars > 0")
    mass = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: X.uniform(0, "bucket", F.col("doc_id"), k) + 1e-9)
    rows = docs.select(mass.alias("x"), ((L.span_chars(s, 2) + 0.5 * L.span_chars(s, 1)) / F.col("n_chars")).alias("t"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    moment = F.aggregate(F.transform("x", lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v)
    rows = rows.select("t", (moment / total / 14.0).alias("f"))
    mean = lambda c: F.avg(F.when(c, F.col("f")))
    return rows.agg(F.round(F.avg(F.abs(F.col("f") - F.col("t"))), 6).alias("mae"), F.round(mean(F.col("t") >= 0.95) - mean(F.col("t") <= 0.05), 6).alias("pole_gap"), F.count("*").alias("documents"))


# Scores and explanations ---------------------------------------------------------------------------------
_LOGITS = [f"({u(f'logit{c}', 'doc_id', 'pos')}*6-3)" for c in range(3)]


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.word_tokens(table(spark, sf_dir, "documents"), "doc_id")
    return rows.withColumn("z", F.array(*[X.uniform(0, f"logit{c}", F.col("doc_id"), F.col("pos")) * 6 - 3 for c in range(3)]))


@query(f"SELECT doc_id, round(avg(ln(exp({_LOGITS[1]})+exp({_LOGITS[2]}))-{_LOGITS[0]}),6) AS ai_score, count(*)::BIGINT AS tokens FROM {TOKENS} GROUP BY 1")
def ai_score_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log odds of assisted or generated against human over a document's tokens, from surrogate logits."""
    return _logits(spark, sf_dir).groupBy("doc_id").agg(F.round(F.avg(N.ai_score(F.col("z"))), 6).alias("ai_score"), F.count("*").alias("tokens"))


@query(f"SELECT doc_id, pos::INT AS pos, round((exp({_LOGITS[2]})+0.5::DOUBLE*exp({_LOGITS[1]}))/(exp({_LOGITS[0]})+exp({_LOGITS[1]})+exp({_LOGITS[2]})),6) AS heat FROM {TOKENS}")
def token_heat_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax weight of generated plus half that of assisted, for each word."""
    e = [F.exp(F.col("z")[c]) for c in range(3)]
    return _logits(spark, sf_dir).select("doc_id", "pos", F.round((e[2] + 0.5 * e[1]) / (e[0] + e[1] + e[2]), 6).alias("heat"))


@query(f"SELECT doc_id, k::INT AS bucket, round(sum(w*q)/sum(w),9) AS mass FROM (SELECT b.doc_id, w, k, CASE WHEN floor({u('histogram', 'b.doc_id', 'lo')}*15)=k THEN 1.0::DOUBLE ELSE 0 END AS q FROM {C.BOUNDS(TOKENS)} b, range(15) t(k)) GROUP BY 1, 2")
def bucket_histogram_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's window tokens in each of the 15 buckets, windows weighted by their length."""
    docs = N.token_lists(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.size("tokens").alias("n")).where("n > 0")
    part = F.transform(N.window_bounds(F.col("n"), 64, 32), lambda w: F.named_struct(F.lit("w"), w["hi"] - w["lo"], F.lit("k"), F.floor(X.uniform(0, "histogram", F.col("doc_id"), w["lo"]) * 15).cast("int")))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["w"])
    own = lambda k: F.aggregate(F.filter("p", lambda x: x["k"] == k), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    bars = F.array(*[own(k) for k in range(15)])
    return docs.select("doc_id", part.alias("p")).select("doc_id", F.posexplode(F.transform(bars, lambda b: b / total)).alias("bucket", "mass")).select("doc_id", "bucket", F.round("mass", 9).alias("mass"))


@query(f"WITH z AS (SELECT doc_id, c, exp({u('humanizer', 'doc_id', 'c')}*4) AS e FROM documents, range(4) t(c) WHERE text IS NOT NULL) SELECT doc_id, c::INT AS class, round(e/sum(e) OVER (PARTITION BY doc_id),9) AS probability FROM z")
def humanizer_probabilities_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over the four document classes, from surrogate logits."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array(*[F.exp(X.uniform(0, "humanizer", F.col("doc_id"), F.lit(c)) * 4) for c in range(4)]).alias("e"))
    rows = docs.select("doc_id", F.aggregate("e", F.lit(0.0), lambda a, v: a + v).alias("total"), F.posexplode("e").alias("class", "x"))
    return rows.select("doc_id", "class", F.round(F.col("x") / F.col("total"), 9).alias("probability"))


@query(f"SELECT doc_id, lo::INT AS lo, (2*w)::INT AS length, (w-1)::INT AS first_last, (2*w-1)::INT AS last, w::INT AS supervised_from, (64*2-2*w)::INT AS padding FROM {C.BOUNDS(TOKENS)}")
def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows given twice in a row: length, index of the last token of either copy, first supervised index, and pads to the batch's width."""
    docs = N.token_lists(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.size("tokens").alias("n")).where("n > 0")
    w = docs.select("doc_id", F.explode(N.window_bounds(F.col("n"), 64, 32)).alias("w")).select("doc_id", "w.lo", (F.col("w.hi") - F.col("w.lo")).alias("n"))
    ids = F.sequence(F.col("lo"), F.col("lo") + F.col("n") - 1)
    twice = w.select("doc_id", "lo", "n", F.concat(ids, ids).alias("ids"))
    padded = twice.select("*", F.concat("ids", F.array_repeat(F.lit(-1), (128 - F.size("ids")).cast("int"))).alias("row"))
    return padded.select("doc_id", "lo", F.size("ids").alias("length"), (F.col("n") - 1).alias("first_last"), (F.size("ids") - 1).alias("last"), F.col("n").alias("supervised_from"), F.size(F.filter("row", lambda x: x == -1)).alias("padding"))


# Corpus handling -------------------------------------------------------------------------------------
_SOURCE_KEY = "coalesce(nullif(lower(trim(source_id)),''), md5(substr(lower(trim(regexp_replace(generation,'" + WS + "',' ','g'))),1,600)))"


@query(f"SELECT {SPLIT(_SOURCE_KEY)} AS split, count(*)::BIGINT AS samples, count(DISTINCT {_SOURCE_KEY})::BIGINT AS sources FROM {C.RAID} WHERE stratum IS NOT NULL GROUP BY 1")
def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples split by the hash of their source, or of their text where they name none: all of one source fall into one split."""
    rows = table(spark, sf_dir, "raid_samples").withColumn("chars", F.length(F.regexp_replace("generation", f"^{X.ASCII_WS}|{X.ASCII_WS}$", ""))).where("chars >= 400")
    last = rows.groupBy("id").agg(F.max_by(F.struct("source_id", "model", "attack", "generation"), "loaded_at").alias("r")).select("r.*")
    last = last.where(S.raid_stratum(F.col("model"), F.col("attack")).isNotNull())
    key = F.coalesce(F.nullif(F.lower(F.trim("source_id")), F.lit("")), X.content_key(F.col("generation")))
    sizes = last.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return sizes.groupBy(S.split_of(F.col("key")).alias("split")).agg(F.sum("n").alias("samples"), F.count("*").alias("sources"))


@query(f"SELECT doc_id, {u('shuffle', 'doc_id')} AS u FROM documents ORDER BY u, doc_id LIMIT 100 OFFSET 50")
def shuffled_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents 50 to 150 of a global order by hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.uniform(0, "shuffle", F.col("doc_id")).alias("u"))
    return rows.orderBy("u", "doc_id").offset(50).limit(100)


@query("SELECT doc_id, len(spans)::INT AS spans, spans[1].span_end::BIGINT AS span_end, spans[1].label::INT AS label FROM (SELECT doc_id, [{'span_start':0,'span_end':n_chars,'label':CASE WHEN humanizer=0 THEN 0 ELSE 2 END}] AS spans FROM documents WHERE text IS NOT NULL AND n_chars>0 AND humanizer IN (0,1,2))")
def uniform_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one author as a single span over the whole text."""
    rows = table(spark, sf_dir, "documents").where("text is not null and n_chars > 0 and humanizer in (0, 1, 2)")
    span = L.uniform_spans(F.length("text"), F.when(F.col("humanizer") == 0, 0).otherwise(2))
    return rows.select("doc_id", span.alias("spans")).select("doc_id", F.size("spans").alias("spans"), F.col("spans")[0]["span_end"].cast("long").alias("span_end"), F.col("spans")[0]["label"].alias("label"))


@query(f"SELECT label::INT AS label, count(*)::BIGINT AS tokens FROM (SELECT label FROM {C.LABELLED} ORDER BY {u('tokens', 'doc_id', 'pos')}, doc_id, pos LIMIT 5000) GROUP BY 1")
def token_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of 5,000 tokens drawn by hash without replacement."""
    draw = X.uniform(0, "tokens", F.col("doc_id"), F.col("pos"))
    return C._tokens(spark, sf_dir).select("label", draw.alias("u"), "doc_id", "pos").orderBy("u", "doc_id", "pos").limit(5000).groupBy("label").agg(F.count("*").alias("tokens"))


@query(f"WITH k AS (SELECT DISTINCT {C.KEY} AS k FROM documents WHERE lower(trim(split)) IN ('eval','calibration','test') AND text IS NOT NULL) SELECT lower(trim(split)) AS split, count(*)::BIGINT AS documents FROM documents WHERE lower(trim(split))='train' AND text IS NOT NULL AND {C.KEY} NOT IN (SELECT k FROM k) GROUP BY 1")
def train_without_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents whose content key no held-out document has."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.lower(F.trim("split")).alias("split"), X.content_key(F.col("text")).alias("k"))
    held = rows.where(F.col("split").isin("eval", "calibration", "test")).select("k").distinct()
    return rows.where("split = 'train'").join(held, "k", "left_anti").groupBy("split").agg(F.count("*").alias("documents"))


_MODELS = {"local": ("l-small", "l-large"), "api": ("a-one", "a-two", "a-three"), "hf": ("h-one",)}
_PICK = "CASE " + " ".join(f"WHEN tier='{t}' THEN ([{','.join(repr(m) for m in ms)}])[(1+floor({u('model', 'doc_id')}*{len(ms)}))::INT]" for t, ms in _MODELS.items()) + " END"


@query(f"SELECT tier, model, count(*)::BIGINT AS documents FROM (SELECT *, {_PICK} AS model FROM (SELECT doc_id, CASE WHEN {u('tier', 'doc_id')}<0.5 THEN 'local' WHEN {u('tier', 'doc_id')}<0.8 THEN 'api' ELSE 'hf' END AS tier FROM documents)) GROUP BY ALL")
def tier_then_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier by weight and a model of the tier by weight, by document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", S.weighted_choice(X.uniform(0, "tier", F.col("doc_id")), C._TIERS).alias("tier"))
    draw = X.uniform(0, "model", F.col("doc_id"))
    model = F.coalesce(*[F.when(F.col("tier") == t, S.weighted_choice(draw, dict.fromkeys(ms, 1.0))) for t, ms in _MODELS.items()])
    return docs.withColumn("model", model).groupBy("tier", "model").agg(F.count("*").alias("documents"))


# Recipes over the tables of this project ---------------------------------------------------------------
@query(f"SELECT 'fineweb_edu/web' AS domain, 'human' AS generator, 'human' AS label, count(*)::BIGINT AS samples, sum(length(t))::BIGINT AS chars FROM (SELECT regexp_replace(text,'^{WS}|{WS}$','','g') AS t FROM documents WHERE humanizer=0 AND text IS NOT NULL) WHERE length(t) BETWEEN 500 AND 12000")
def recipe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human documents through a recipe of plain texts: length band, domain headed by the recipe's key."""
    from ..sources.recipes import accepted

    return accepted(table(spark, sf_dir, "documents").where("humanizer = 0"), "fineweb_edu").groupBy("label", "generator", "domain").agg(F.count("*").alias("samples"), F.sum(F.length("text")).alias("chars"))


_PAIRED = f"(SELECT * FROM (SELECT regexp_replace(source,'^{WS}|{WS}$','','g') AS source, regexp_replace(target,'^{WS}|{WS}$','','g') AS target, CASE WHEN intensity='heavy' THEN 'Rewritten' ELSE 'Edited' END AS kind, generator FROM edit_pairs WHERE intensity IS NOT NULL) WHERE length(source)>=300 AND length(target)>=300 AND source<>target)"


@query(f"SELECT intensity, instruction, source_name, count(*)::BIGINT AS pairs FROM (SELECT DISTINCT ON (id) * FROM (SELECT *, 'mgt_pairs-'||md5(source||chr(10)||chr(10)||target) AS id, CASE WHEN kind='Rewritten' THEN 'heavy' ELSE 'medium' END AS intensity, lower(kind) AS instruction, 'mgt-xx' AS source_name FROM {_PAIRED}) ORDER BY id, intensity) GROUP BY ALL")
def recipe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited pairs through a pair recipe: both sides of the least length, one row a pair, drawn by hash."""
    from ..sources.recipes import sample_pairs

    raw = table(spark, sf_dir, "edit_pairs").where("intensity is not null")
    shaped = raw.select(F.col("source").alias("Original text"), F.col("target").alias("Modified text"), F.when(F.col("intensity") == "heavy", "Rewritten").otherwise("Edited").alias("Type"), F.col("generator").alias("LLM used"))
    return sample_pairs(shaped, "mgt_pairs", 1 << 30).groupBy("intensity", "instruction", "source_name").agg(F.count("*").alias("pairs"))



# Twins of queries that the catalog has without SQL ---------------------------------------------------------
_BLANK = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"WITH w AS (SELECT id, list_filter(string_split_regex(lower(source),'{_BLANK}'), lambda x: x<>'') AS a, list_filter(string_split_regex(lower(target),'{_BLANK}'), lambda x: x<>'') AS b, length(regexp_replace(target,'^{WS}|{WS}$','','g')) AS chars FROM {C.EDITS} WHERE source IS NOT NULL AND target IS NOT NULL), x AS (SELECT id, unnest(a) AS t, generate_subscripts(a,1) AS i FROM w), y AS (SELECT id, unnest(b) AS t, generate_subscripts(b,1) AS j FROM w), m AS (SELECT id, i, j, i-row_number() OVER (PARTITION BY id, j-i ORDER BY i) AS g, j-i AS d FROM x JOIN y USING (id, t)), r AS (SELECT id, max(n) AS best FROM (SELECT id, count(*) AS n FROM m GROUP BY id, d, g) GROUP BY id) SELECT id, round(CASE WHEN len(b)=0 THEN 0 ELSE coalesce(best,0)/len(b)::DOUBLE END,6) AS share, chars>=400 AND round(CASE WHEN len(b)=0 THEN 0 ELSE coalesce(best,0)/len(b)::DOUBLE END,12)<=0.25 AS accepted FROM w LEFT JOIN r USING (id)")
def verbatim_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of words taken over from the source; words are runs without white space."""
    from ..operators.similarity import verbatim_share

    @F.pandas_udf("double")
    def share(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([verbatim_share(a, b) for a, b in zip(s, t, strict=True)], dtype="float64")

    rows = C._edits(spark, sf_dir).where("source is not null and target is not null").select("id", share("source", "target").alias("share"), F.length(X.strip(F.col("target"))).alias("chars"))
    return rows.select("id", F.round("share", 6).alias("share"), ((F.col("chars") >= 400) & (F.col("share") <= 0.25)).alias("accepted"))


_TURN = f"7*{u('augment', 'doc_id')}"
_PURE = "(SELECT doc_id, text, n_chars, list_distinct(list_transform(spans, lambda s: s.label)) AS ls FROM documents WHERE text IS NOT NULL AND spans IS NOT NULL AND NOT (regexp_matches(coalesce(domain,''),'^(french_instruct|aya/)') AND list_contains(list_transform(spans, lambda s: s.label),0)))"


@query(f"SELECT doc_id, ls[1]::INT AS label, CASE WHEN {_TURN}<2 THEN 'wrapped' ELSE 'flat' END AS kind, length(text)::INT AS chars FROM {_PURE} WHERE len(ls)=1 AND ls[1] IN (0,2) AND {_TURN}<4")
def augment_same_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrapped and flattened copies of the augmentation: as long as their documents."""
    return C.augment_pools(spark, sf_dir).where("kind != 'crop'").select("doc_id", "label", "kind", "chars")


@query("SELECT count(*)::BIGINT AS documents, count(*)::BIGINT AS partitions FROM documents WHERE text IS NOT NULL")
def transform_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rewritten text's spans are still a partition of it (those without spans have none to keep)."""
    from ..operators.rewrite import transform_documents

    out = transform_documents(table(spark, sf_dir, "documents"), "doc_id")
    ok = (F.size("spans") == 0) | L.span_partition_ok(F.col("spans"), F.length("text"))
    return out.agg(F.count("*").alias("documents"), F.count_if(ok).alias("partitions"))


@query("SELECT doc_id, n_chars::BIGINT AS covered FROM documents WHERE spans IS NOT NULL AND len(spans)>0 AND text IS NOT NULL AND regexp_matches(text,'[^ \\t\\n\\x0B\\f\\r]')")
def segment_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that the decoded segments of each text cover: all of them."""
    seg = C.document_segments(spark, sf_dir)
    return seg.groupBy("doc_id").agg(F.sum(F.col("seg_end") - F.col("seg_start")).cast("long").alias("covered"))


@query(f"SELECT id, length(target)::BIGINT AS covered FROM {C.EDITS} WHERE source IS NOT NULL AND target IS NOT NULL AND length(target)>0")
def edit_span_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that the labelled spans of each edited text cover: all of them."""
    from ..operators.similarity import edit_spans

    out = edit_spans(C._edits(spark, sf_dir), "id", "source", "target")
    return out.select("id", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["span_end"] - x["span_start"]).alias("covered")).where("covered > 0")
