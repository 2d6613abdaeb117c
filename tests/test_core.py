"""Core operators: exact values, invariants and brute force."""

import io
import itertools
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.functions import labels as L
from inkstrata.functions import text as X
from inkstrata.operators import decode as D
from inkstrata.operators import metrics as M
from inkstrata.operators import rewrite as R
from inkstrata.operators import sampling as S
from inkstrata.operators import similarity as Y
from inkstrata.operators import windows as N


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_fractions_and_buckets(spark):
    lit = F.lit
    f = lambda a, b, c: L.weighted_ai_fraction(lit(float(a)), lit(float(b)), lit(float(c)))
    r = one(spark, a=f(100, 0, 0), b=f(0, 0, 100), c=f(0, 100, 0), d=f(50, 20, 30), e=f(0, 0, 0))
    assert tuple(r) == pytest.approx((0, 1, 0.5, 0.4, 0))
    t = one(spark, x=L.bucket_target(lit(0.5)), lo=L.bucket_target(lit(0.0)), hi=L.bucket_target(lit(1.0)), half=L.bucket_of(lit(2.5 / 14)))
    assert sum(t.x) == pytest.approx(1) and sum(p * i / 14 for i, p in enumerate(t.x)) == pytest.approx(0.5)
    assert t.lo[0] == 1 and t.hi[14] == 1 and t.half == 2
    for k, c in ((0, 0), (7, 1), (14, 2)):
        p = one(spark, p=L.segment_prior(F.array(*[lit(1.0 if i == k else 0.0) for i in range(15)]))).p
        assert int(np.argmax(p)) == c and sum(p) == pytest.approx(1)


def test_window_bounds(spark):
    b = lambda n: [tuple(x) for x in one(spark, w=N.window_bounds(F.lit(n))).w]
    w = b(1200)
    assert w[0] == (0, 512) and w[-1] == (688, 1200) and all(hi - lo == 512 for lo, hi in w)
    assert b(100) == [(0, 100)] and b(512) == [(0, 512)] and b(513) == [(0, 512), (1, 513)]


def test_window_targets(spark):
    rows = [("a", i, 0 if i < 90 else 2, 1) for i in range(100)] + [("b", i, 0 if i < 70 else 2, 1) for i in range(100)]
    out = {r.doc: (round(r.f_ai, 9), r.mixed) for r in N.window_targets(spark.createDataFrame(rows, "doc string, pos int, label int, chars long"), "doc").collect()}
    assert out == {"a": (0.1, False), "b": (0.3, True)}


def test_midpoint_labels(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("span_start"), F.lit(b).alias("span_end"), F.lit(c).alias("label")) for a, b, c in ((0, 4, 0), (4, 8, 2))])
    r = one(spark, **{f"t{i}": N.midpoint_label(spans, F.lit(2 * i), F.lit(2 * i + 2)) for i in range(4)})
    assert tuple(r) == (0, 0, 2, 2)


def test_span_checks(spark):
    span = "array<struct<span_start:int,span_end:int,label:int>>"
    rows = [(1, [(0, 3, 0), (3, 5, 2)], 5), (2, [(0, 3, 0), (4, 5, 2)], 5), (3, [(0, 4, 1)], 5), (4, None, 5), (5, [], 0)]
    df = spark.createDataFrame(rows, f"id int, spans {span}, n int")
    assert [r.ok for r in df.select("id", L.span_partition_ok(F.col("spans"), F.col("n")).alias("ok")).orderBy("id").collect()] == [True, False, False, False, True]
    assert [r.p for r in df.select("id", L.pure_label(F.col("spans")).alias("p")).orderBy("id").collect()] == [None, None, 1, None, None]


def test_viterbi_and_marginals_by_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(20):
        u = rng.normal(size=(6, 3)).round(1 if trial % 2 else 6)
        change = D.transitions(rng.normal(size=6) * 4, 1.0, 0.5)
        value = lambda p: sum(u[i, x] for i, x in enumerate(p)) + sum(change[i] for i in range(5) if p[i] != p[i + 1])
        paths = list(itertools.product(range(3), repeat=6))
        assert value(D.viterbi(u, change).tolist()) == pytest.approx(max(map(value, paths)))
        weight = {p: math.exp(value(p)) for p in paths}
        total = sum(weight.values())
        m = D.marginals(u, change)
        for i in range(6):
            for c in range(3):
                assert m[i, c] == pytest.approx(sum(w for p, w in weight.items() if p[i] == c) / total)
    u = rng.normal(size=(25, 3))
    e = np.exp(u - u.max(axis=1, keepdims=True))
    assert np.allclose(D.marginals(u, np.zeros(24)), e / e.sum(axis=1, keepdims=True))
    assert D.viterbi(np.zeros((0, 3)), np.zeros(0)).size == 0 and D.marginals(np.zeros((1, 3)), np.zeros(0)).shape == (1, 3)


def test_smoothing_and_short_runs():
    u = np.tile([2.0, 0.0, 0.0], (60, 1))
    u[30:] = [0.0, 0.0, 2.0]
    u[10] = [0.0, 0.0, 2.0]
    assert D.label_runs(D.viterbi(u, np.full(59, -4.0))) == [(0, 30, 0), (30, 60, 2)]
    a = np.array([0] * 40 + [2] * 5 + [0] * 40)
    assert D.label_runs(D.merge_short_runs(a, 32)) == [(0, 85, 0)]
    b = np.array([0] * 40 + [2] * 40)
    assert (D.merge_short_runs(b, 32) == b).all()

    def plain(x, least):
        x = x.copy()
        while True:
            runs = D.label_runs(x)
            short = next((i for i, r in enumerate(runs) if r[1] - r[0] < least), None)
            if len(runs) < 2 or short is None:
                return x
            before, after = (runs[short - 1] if short else None), (runs[short + 1] if short + 1 < len(runs) else None)
            if not before or not after:
                label = (before or after)[2]
            elif before[1] - before[0] == after[1] - after[0] or before[2] == after[2]:
                label = min(before[2], after[2])
            else:
                label = max((before, after), key=lambda r: r[1] - r[0])[2]
            x[runs[short][0] : runs[short][1]] = label

    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.repeat(rng.integers(0, 3, 12), rng.integers(1, 9, 12))
        assert (D.merge_short_runs(x, 6) == plain(x, 6)).all()


def test_votes_and_runs(spark):
    rows = [("d", i, i // 6, 0 if i < 6 else 2) for i in range(12)]
    rows[2], rows[9] = ("d", 2, 0, 2), ("d", 9, 1, 0)
    df = spark.createDataFrame(rows, "doc string, pos int, unit int, label int")
    assert [r.voted for r in N.majority_vote(df, "doc", "unit", "label").orderBy("pos").collect()] == [0] * 6 + [2] * 6
    runs = sorted((r.run_start, r.run_end, r.label) for r in N.runs(df, "doc", "pos", "label").collect())
    assert runs == [(0, 2, 0), (2, 3, 2), (3, 6, 0), (6, 9, 2), (9, 10, 0), (10, 12, 2)]


def test_rank_metrics_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, positive boolean")
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.auroc(df, "score", "positive").first().auroc == pytest.approx(wins)
    assert M.auroc(df.where("positive"), "score", "positive").first().auroc is None
    k = int(0.1 * len(neg))
    threshold = sorted(neg, reverse=True)[k - 1]
    r = M.tpr_at_fpr(df, "score", "positive", 0.1).first()
    assert r.threshold == threshold and r.tpr == pytest.approx(sum(s >= threshold for s in pos) / len(pos))
    assert M.tpr_at_fpr(df, "score", "positive", 0.0).first().threshold == pytest.approx(max(neg) + 1e-9)
    loss = lambda t: sum(s >= t for s in neg) / len(neg) + sum(s < t for s in pos) / len(pos)
    best = min(sorted({s for s, _ in rows}), key=lambda t: (round(loss(t), 9), t))
    assert M.best_threshold(df, "score", "positive").first().threshold == best


def test_boundaries(spark):
    t, p = [0] * 20 + [2] * 30, [0] * 26 + [2] * 24
    rows = [("a", i, x, y) for i, (x, y) in enumerate(zip(t, p))] + [("b", i, 0, 0) for i in range(5)] + [("c", i, int(i > 20), 0) for i in range(50)]
    out = {r.doc: (r.precision, r.recall, r.f1) for r in M.boundary_scores(spark.createDataFrame(rows, "doc string, pos int, t int, p int"), "doc", "pos", "t", "p").collect()}
    assert out == {"a": (1, 1, 1), "b": (1, 1, 1), "c": (0, 0, 0)}


def test_content_keys_and_splits(spark):
    texts = ["Hello   World", "hello world ", "hello\n\tworld", "hello there"]
    keys = [r.k for r in spark.createDataFrame([(t,) for t in texts], "text string").select(X.content_key(F.col("text")).alias("k")).collect()]
    assert keys[0] == keys[1] == keys[2] != keys[3]
    splits = {r.s: r.n for r in spark.range(5000).select(S.split_of(F.concat(F.lit("src-"), "id")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert set(splits) == {"train", "eval", "calibration", "test"} and 3800 < splits["train"] < 4200


def test_admission(spark):
    long = " ".join(["word"] * 60)
    rows = [(2, long.upper(), "b"), (1, long, "a"), (3, "short", "c"), (4, None, "d")]
    out = S.admit(spark.createDataFrame(rows, "id int, text string, rank string"), "text", F.col("id")).collect()
    assert [(r.id, r["rank"]) for r in out] == [(1, "a")]


def test_domain_mix():
    q = S.mix_quota({"reference": 50_000, "creative": 3_000, "news": 900, "web": 2_500})
    total = sum(q.values())
    assert q["reference"] / total < 0.35 and q["creative"] / total > 0.15
    scarce = {"reference": 50_000, "creative": 20_000, "professional": 60}
    assert sum(S.mix_quota(scarce).values()) < 0.1 * 70_060
    assert sum(S.mix_quota(scarce, min_keep=0.5).values()) >= 0.5 * 70_060
    assert S.mix_quota({"x": 3}) == {"x": 3}


def test_sentences_and_clauses():
    text = "He left, because it was raining very hard; she stayed home. “Well?” Nobody knew that.\n\nThe end  "
    for cut in (R.sentences, R.clauses):
        spans = cut(text)
        assert "".join(text[a:b] for a, b in spans) == text
    assert R.realign("a b c", ["a", "c"]) == [(0, 1), (4, 5)] and R.realign("a b", ["b", "a"]) == []


@pytest.mark.parametrize("name", sorted(R.TRANSFORMS))
def test_transforms_keep_spans(name):
    a = "However, numerous individuals utilize this landscape — “robustly”, Olé. " * 3
    b = "The Old Soldier Observed 10 Oxen Slowly crossing étroit fields. " * 20
    text, spans = R.transform(a + b, [(0, len(a), 2), (len(a), len(a + b), 0)], [name], 11)
    assert text != a + b and len(spans) == 2
    assert spans[0][0] == 0 and spans[0][1] == spans[1][0] and spans[1][1] == len(text)


@pytest.mark.parametrize("pattern", R.PATTERNS)
def test_splice(pattern):
    human, ai = "One two. Three four. Five six. Seven eight.", "Alpha one. Beta two. Gamma three."
    text, spans = R.splice(human, ai, pattern, 7)
    assert {s[2] for s in spans} == {0, 2}
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_layout(spark):
    wrapped = "The quick brown fox jumps over the lazy dog and\nthen it runs away from the farm until the night\nfalls over the hills and all the animals go to\nsleep in their places near the old wooden barn."
    clean = "One paragraph here.\n\nAnother paragraph here."
    assert R.normalize_layout(clean) == clean and R.unwrap(clean) == clean
    assert R.unwrap(wrapped) == wrapped.replace("\n", " ") == R.normalize_layout(wrapped)
    assert R.normalize_layout("Intro:\n\n- one\n- two\n\nEnd.") == "Intro:\n\n- one\n- two\n\nEnd."
    flat = " ".join(f"Sentence number {i} has some words." for i in range(50))
    assert R.normalize_layout(flat).count("\n\n") >= 3 and R.normalize_layout(" \n ") == ""
    assert len(R.wrap(flat, 80)) == len(flat) and R.crop("a b", 1) is None
    r = one(spark, a=X.reflow(F.lit("one\r\ntwo\n\n1 / 3\n\nthree  four\nco-\nop")), b=X.hard_wrapped(F.lit(wrapped)), c=X.hard_wrapped(F.lit(clean)))
    assert r.a == "one two\n\nthree four co-op" and r.b and not r.c


def test_similarity():
    same, other = "the five words are equal", "nothing here matches at all"
    assert Y.verbatim_share(same, same) == 1 and Y.verbatim_share(same, other) == 0
    assert Y.indel_ratio("", "") == 1 and Y.indel_ratio("abcd", "abed") == 0.75
    assert Y.token_set_ratio("a b c", "c b") == 1 and Y.token_set_ratio("", "a") == 0
    s = "The committee met in the old town hall. Nobody expected the vote to fail."
    kept = Y.soft_labels(s, "Nobody expected the vote to fail. The committee met in the old town hall. ")
    assert {x[2] for x in kept} == {0}
    mixed = {x[2] for x in Y.soft_labels(s, s + " Purple engines whistle beyond quiet galaxies.")}
    assert {0, 2} <= mixed


def test_recipes(spark):
    from inkstrata.sources.recipes import RECIPES

    assert len(RECIPES) == 112
    rows = lambda name, df: [tuple(r)[:4] for r in RECIPES[name](df).collect()]
    assert rows("mage", spark.createDataFrame([(" hi ", "1", "cmv_human"), ("yo", "0", "cmv_machine_continuation_t0_11b"), ("", "1", "x")], "text string, label string, src string")) == [("hi", "human", "human", "cmv"), ("yo", "ai", "t0_11b", "cmv")]
    conv = spark.createDataFrame([(json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": " answer "}]), "English", None), ("broken", "English", None)], "conversation string, language string, model string")
    assert rows("wildchat", conv) == [("answer", "ai", "gpt-4", "chat")]
    both = spark.createDataFrame([(7, "human words", "machine words")], "id int, human_text string, ai_text string")
    assert [(r.label, r.pair_id) for r in RECIPES["dmitva"](both).collect()] == [("human", "7"), ("ai", "7")]
    chat = spark.createDataFrame([("user", "x", None), ("llm", "y", "none")], "role string, plain_text string, model string")
    assert rows("sharechat_claude", chat) == [("y", "ai", "claude:claude", "sharechat/claude")]
    assert rows("yelp", spark.createDataFrame([("a<br />b\\nc",)], "text string"))[0][0] == "a\nb\nc"


def test_files(spark, tmp_path):
    from inkstrata.sources import files as IO

    (tmp_path / "d.jsonl").write_text('{"id":"a","text":"abc","spans":[[0,1,0],[1,3,2]],"humanizer":3,"source":"s","meta":{"k":"v"}}\n{"id": "torn\n', encoding="utf-8")
    docs = IO.read_documents(spark, str(tmp_path / "d.jsonl"))
    assert [(r.id, [tuple(s) for s in r.spans]) for r in docs.collect()] == [("a", [(0, 1, 0), (1, 3, 2)])]
    assert IO.write_documents(docs, str(tmp_path / "out")) == 1
    assert IO.read_documents(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception, match="no partition"):
        IO.write_documents(docs.withColumn("text", F.lit("abcd")), str(tmp_path / "bad"))
    (tmp_path / "r.csv").write_text('id,source_id,model,attack,domain,title,generation\n1,,human,none,news,t,"two\nlines"\n', encoding="utf-8")
    r = IO.read_raid_csv(spark, str(tmp_path / "r.csv")).first()
    assert r.source_id == "" and r.generation == "two\nlines"
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "f" / "b.txt").write_text("plain", encoding="utf-8")
    (tmp_path / "f" / "c.pdf").write_bytes(b"x")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in IO.read_text_files(spark, str(tmp_path / "f")).collect()} == {"a.docx": "One two\n\nThree", "b.txt": "plain"}
    cut = IO.boundary_documents(spark.createDataFrame([("x", " ".join(["w"] * 70), 10), ("y", "w w", 1), ("z", " ".join(["w"] * 70), 0)], "id string, text string, at int"), "id", "text", "at")
    assert [(r.id, [tuple(s) for s in r.spans]) for r in cut.collect()] == [("x", [(0, 20, 0), (20, 139, 2)])]


def test_streaming(spark, tmp_path):
    from inkstrata.streaming import ingest as G

    (tmp_path / "in").mkdir()
    text = " ".join(["word"] * 60)
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"id": str(i), "text": t, "at": "2026-01-01T00:00:00"}) for i, t in enumerate([text, text.upper(), "short"])), encoding="utf-8")
    rows = G.admitted(G.stream_samples(spark, str(tmp_path / "in"), "id string, text string, at timestamp"), "text", "at")
    G.write_splits(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_calibration(spark):
    from inkstrata.operators.calibrate import Calibrator, fit_multinomial, grid_search

    rng = random.Random(2)
    rows = [("d", i, 0 if i < 100 else 2, *[rng.random() + (1.5 if k == (0 if i < 100 else 2) else 0) for k in range(3)], 0.0, 0.0, 0.0, 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc string, pos int, label int, f0 double, f1 double, f2 double, f3 double, f4 double, f5 double, mixed_logodds double")
    cal = fit_multinomial(df)
    assert cal.intercepts[1] == -20 and cal.weights[1] == [0.0] * 6
    best = grid_search(df, "doc", "label", cal, (0.0, 4.0), (0.0,))
    assert best.smooth in (0.0, 4.0)
    assert Calibrator().potentials(df).select("u0").first().u0 == pytest.approx(rows[0][3])


def test_scorer(spark):
    from inkstrata.operators import scorer as Z

    df = spark.createDataFrame([(1, "One two. Three four."), (2, None), (3, "One only.")], "id int, text string")
    assert [r.score is None for r in Z.score(df, "text").orderBy("id").collect()] == [False, True, False]
    out = Z.sentence_occlusion(df, "id", "text").orderBy("k").collect()
    base, left = Z.baseline_scorer(["One two. Three four.", "Three four."])
    assert [r.id for r in out] == [1, 1] and out[0].effect == pytest.approx(base - left)


def test_occlusion_covers_every_part(spark):
    from inkstrata.operators import scorer as Z

    long = " ".join(f"Sentence w{i} has its own words." for i in range(450))
    df = spark.createDataFrame([(1, long), (2, "One two. Three four.")], "id int, text string")
    out = Z.sentence_occlusion(df, "id", "text").where("id = 1").orderBy("k").collect()
    parts = R.sentences(long)
    assert [(r.k, r.part_start, r.part_end) for r in out] == [(k, *p) for k, p in enumerate(parts)] and len(out) == 450
    a, e = parts[-1]
    base, left = Z.baseline_scorer([long, long[:a] + long[e:]])
    assert out[-1].effect == pytest.approx(base - left)
    assert Z.word_occlusion(df, "id", "text").where("id = 1").count() == len(long.split())
    assert Z.sentence_occlusion(df, "id", "text", most=3).count() == 5


def test_augment_pools_takes_whole_classes(spark, tmp_path):
    from inkstrata.plans import catalog as C

    words = " ".join(f"w{i}" for i in range(200))
    rows = [(i, words, "aya/x" if i < 40 else "web", [(0, len(words), 2 * (i % 2))]) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string, domain string, spans array<struct<span_start int, span_end int, label int>>").write.parquet(f"{tmp_path}/documents.parquet")
    out = C.augment_pools(spark, str(tmp_path)).collect()
    kept = {i for i in range(800) if i >= 40 or i % 2}  # noisy human ones are left out
    assert len(out) == len(kept) and {r.doc_id for r in out} == kept
    share = {k: sum(r.kind == k for r in out) / len(out) for k in ("wrapped", "flat", "crop")}
    assert share == pytest.approx({"wrapped": 2 / 7, "flat": 2 / 7, "crop": 3 / 7}, abs=0.06)


def test_nearest_by_cosine(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id long, v array<double>")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = n @ n.T
    np.fill_diagonal(cos, -2)
    got = {r.id: r.nearest for r in Y.nearest_by_cosine(df.where("id % 20 = 0"), df, "id", "v").collect()}
    assert got == {i: int(cos[i].argmax()) for i in (0, 20, 40)}


def test_queries_have_docs_and_known_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(f.__doc__ for f in e.queries().values())
