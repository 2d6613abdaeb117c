"""Segments, recipes' rows, files and reports."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.operators import decode as D
from inkstrata.operators import sampling as S
from inkstrata.operators import segments as G
from inkstrata.operators import windows as N
from inkstrata.sources import files, recipes

LONG = "The old treaty was read aloud in the village before the rain came down again. " * 9


def test_segments_cover_and_verdict(spark):
    text = "aa bb cc dd ee"
    df = spark.createDataFrame([("d", text, [0, 0, 2, 2, 2]), ("e", "", []), ("n", None, [])], "doc string, text string, y array<int>")
    rows = N.token_lists(df, "doc", "y").withColumn("n", F.when(F.col("doc") == "d", 14).otherwise(0).cast("long"))
    rows = rows.withColumn("decoded", F.transform("y", lambda y: F.named_struct(F.lit("merged"), y, F.lit("confidence"), F.lit(0.5)))).drop("y")
    got = {r.doc: r for r in G.segment_lists(rows, "tokens", "decoded", "n").withColumn("v", G.verdict(F.col("segments"), F.col("n"))).collect()}
    assert [tuple(s) for s in got["d"].segments] == [(0, 5, 0, 0.5), (5, 14, 2, 0.5)]
    assert got["d"].v.label == "mixed" and abs(got["d"].v.ai - 9 / 14) < 1e-12
    assert got["e"].segments == [] and set(got) == {"d", "e"}


def test_decode_of_rows_equals_decode_of_lists(spark):
    rng = np.random.default_rng(5)
    rows = [(d, p, *map(float, rng.normal(size=3)), float(rng.normal())) for d in range(4) for p in range(30)]
    tokens = spark.createDataFrame(rows, "doc long, pos int, u0 double, u1 double, u2 double, mixed_logodds double")
    got = {(r.doc, r.pos): (r.label, r.merged) for r in D.decode(tokens.orderBy(F.rand(1)), "doc", 1.0, 0.5, 3).collect()}
    for d in range(4):
        own = np.array([r[2:5] for r in rows if r[0] == d])
        change = D.transitions(np.array([r[5] for r in rows if r[0] == d]), 1.0, 0.5)
        labels = D.viterbi(own, change)
        merged = D.merge_short_runs(labels, 3)
        assert [got[d, p] for p in range(30)] == list(zip(labels.tolist(), merged.tolist(), strict=True))


def test_quota_meets_its_floor():
    counts = {d: 1000 * (i + 1) for i, d in enumerate(S.DOMAIN_MIX)} | {"web": 7}
    for floor in (0.0, 0.3, 0.7, 0.95, 1.0):
        kept = S.mix_quota(counts, min_keep=floor)
        assert sum(kept.values()) >= floor * sum(counts.values()) - 1 and all(kept[d] <= counts[d] for d in kept)
    assert S.mix_quota({}) == {}


CASES = {
    "claude_evol": ({"output": LONG}, ("ai", "claude-evol-instruct", "instruct")),
    "claude_opus": ({"response": LONG}, ("ai", "claude-opus-4.7", "instruct")),
    "french_alpaca": ({"output": LONG}, ("ai", "gpt-french-alpaca", "instruct/french")),
    "claude_modern": ({"messages": json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": LONG}])}, ("ai", "claude-sonnet-4.6/opus-4.8", "instruct")),
    "wildchat48": ({"language": "Polish", "model": "m", "conversation": json.dumps([{"role": "assistant", "content": LONG}])}, ("ai", "m", "chat/polish")),
    "french_instruct": ({"author": "", "conversation": json.dumps([{"role": "assistant", "content": "no", "text": LONG}])}, ("ai", "french-chatbot", "instruct/french")),
    "arena140k": ({"model_a": "x", "language": "en", "conversation_a": json.dumps([{"role": "assistant", "content": [{"type": "text", "text": LONG}, {"type": "image", "text": "no"}]}])}, ("ai", "x", "arena/en")),
}


@pytest.mark.parametrize("name", CASES)
def test_recipe_rows(spark, name):
    raw, (label, generator, domain) = CASES[name]
    df = spark.createDataFrame([tuple(raw.values())], ", ".join(f"`{c}` string" for c in raw))
    assert [tuple(r)[:4] for r in recipes.RECIPES[name](df).collect()] == [(LONG.strip(), label, generator, domain)]


def test_arena_content_as_list_column(spark):
    turn = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"
    df = spark.createDataFrame([([("assistant", [("text", "a" + LONG), (None, "b" + LONG)])], "x", "en")], f"conversation_a {turn}, model_a string, language string")
    assert recipes.RECIPES["arena100k"](df).first().text == ("a" + LONG + "\n" + "b" + LONG).strip()
    gone = spark.createDataFrame([("Arabic", json.dumps([{"role": "assistant", "content": LONG}]))], "language string, conversation string")
    assert recipes.RECIPES["wildchat48"](gone).count() == 0


def test_every_recipe_takes_rows_without_its_columns(spark):
    df = spark.createDataFrame([("x",)], "nothing string")
    for name, recipe in recipes.RECIPES.items():
        assert recipe(df).columns == ["text", "label", "generator", "domain", "pair_id"], name


def test_sampled_recipe_and_pairs(spark):
    df = spark.createDataFrame([(f"{i} {LONG}",) for i in range(12)] + [("short",)], "text string")
    assert recipes.sample_recipe(df, "fineweb_edu", 5, 3).count() == 5
    pairs = spark.createDataFrame([(f"{i} {LONG}", json.dumps([f"{i} again {LONG}"])) for i in range(6)] + [("a", json.dumps(["b"])), (LONG, json.dumps([LONG]))], "text string, paraphrases string")
    got = recipes.sample_pairs(pairs, "chatgpt_paraphrase", 4).collect()
    assert len(got) == 4 and all(r.id == r.source_id and r.id.startswith("chatgpt_paraphrase-") and r.tier == "hf" and r.source_name == "hf-paraphrase" for r in got)


def test_docx_blanks():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>One  two</w:t><w:tab/><w:t>three</w:t><w:br/><w:t>four</w:t><w:cr/></w:r></w:p><w:p/><w:p><w:r><w:t>Last.</w:t></w:r></w:p></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.docx_text(data.getvalue()) == "One two three four\n\nLast."


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), "abcd", [(0, 4, 0)], 0, "s", {}, "train" if i % 2 else "test") for i in range(8)], "id string, text string, spans array<struct<span_start:int,span_end:int,label:int>>, humanizer int, source string, meta map<string,string>, split string")
    assert files.write_splits(docs, str(tmp_path / "c"), "id", {"name": "x"}) == {"train": 4, "test": 4}
    assert files.read_documents(spark, str(tmp_path / "c" / "split=train")).count() == 4
    spec = json.loads(spark.read.text(str(tmp_path / "c-spec")).first()[0])
    assert spec["name"] == "x" and spec["documents"] == {"train": 4, "test": 4}
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [files.cached_subset(spark, str(tmp_path), ("f", 1), make).count() for _ in range(2)] == [3, 3] and made == [1]
    (tmp_path / "b.jsonl").write_text('{"body": "x"}\n{torn\n{"body": ""}\n')
    (tmp_path / "a.jsonl").write_text('{"body": "y"}\n')
    paths = files.existing(spark, [str(tmp_path / "*.jsonl"), str(tmp_path / "none.jsonl")])
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["a.jsonl", "b.jsonl", "none.jsonl"]
    assert {r.text for r in files.text_field(spark, paths[:2], "body").collect()} == {"x", "y"}
    assert files.write_mined(spark.range(2), spark.createDataFrame([(2,)], "seen int"), str(tmp_path / "m")) == {"seen": 2}
