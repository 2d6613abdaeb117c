"""Canonical forms, sentence units, languages, pairs and token counts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import canon, langid, pairs, sentences, tokens

LOOKS = [("Тhе саt", "The cat"), ("ｔｅｓｔ １２", "test 12"), ("café", "café"), ("a b", "a b"), ("a​b", "ab"), ("x\r\ny", "x\ny"), ("ﬁsh", "fish"), ("non‑stop", "non-stop"), ("ｶﾞ", "ガ")]
DIFFERENT = [("cafe", "café"), ("x2", "x²"), ("Abc", "abc"), ("“a”", '"a"'), ("a b", "a  b"), ("a\nb", "a\n\nb")]


@pytest.mark.parametrize("a,b", LOOKS)
def test_same_look(a, b):
    t = canon.transducer()
    assert t.apply(a) == t.apply(b) and t.native(a) == t.native(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visible_difference_stays(a, b):
    t = canon.transducer()
    assert t.apply(a) != t.apply(b)


def test_native_alphabet():
    assert canon.canonical("B 1982 г. сyдья") == "В 1982 г. судья"
    assert canon.canonical("Тhе treаty") == "The treaty"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_second_pass_changes_nothing(s):
    t = canon.transducer()
    once = t.apply(s)
    assert t.apply(once) == once


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é漢字かな-.\n ् िक", max_size=60))
def test_batch_tokens_equal_single(s):
    form = canon.plain(s)
    _, _, a, b = canon.token_hashes([form], places=True)
    assert [form[x:y] for x, y in zip(a, b)] == canon.tokens(s)


def test_pairs(spark):
    rows = [(1, "The cat", "x"), (2, "Тhе cаt", None), (3, "The cat", "x"), (4, None, "x"), (5, " ", "x"), (6, "", "x"), (7, "The  cat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form_key string")
    got = {tuple(r) for r in canon.same_look_pairs(df, "doc_id").collect()}
    assert got == {(1, 2), (2, 3)}
    assert canon.same_look_pairs(df.limit(0), "doc_id").count() == 0
    assert [r.canonical for r in canon.canonical_text(df.where("doc_id in (2, 4)").orderBy("doc_id")).collect()] == ["The cat", None]


def units(text):
    return [text[a:b] for a, b in sentences.BoundaryModel().units(text)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Dr. Smith paid 3.5 dollars, i.e. little. He left.", ["Dr. Smith paid 3.5 dollars, i.e. little.", "He left."]),
        ("“It works!” said Ann. Next one.", ["“It works!” said Ann.", "Next one."]),
        ("The shop sold books, pens, etc. They closed at 5:10 p.m. Nobody came.", ["The shop sold books, pens, etc.", "They closed at 5:10 p.m.", "Nobody came."]),
        ("Er kam am 2. Mai an. Dann ging er.", ["Er kam am 2. Mai an.", "Dann ging er."]),
        ("他来了。“很好！”他说。她走了。", ["他来了。", "“很好！”他说。", "她走了。"]),
        ("「よい！」と彼は言った。次の日。", ["「よい！」と彼は言った。", "次の日。"]),
        ("Title\n\n1. First item.\n2. Second item\n\nEnd.", ["Title", "1. First item.", "2. Second item", "End."]),
        ("It stops here.The next one begins. See a_v2.17.txt now.", ["It stops here.", "The next one begins.", "See a_v2.17.txt now."]),
        ("Он пришёл, т. е. приехал. «Да!» — сказал он. Конец.", ["Он пришёл, т. е. приехал.", "«Да!» — сказал он.", "Конец."]),
        ("  \n ", []),
    ],
)
def test_sentences(text, expected):
    assert units(text) == expected


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab A.!? \n“”。、-1)", max_size=80))
def test_units_cover_all_but_blanks(s):
    cover = sentences.BoundaryModel().units(s)
    assert "".join("".join(s[a:b].split()) for a, b in cover) == "".join(s.split())
    assert all(a < b and not s[a].isspace() and not s[b - 1].isspace() for a, b in cover)
    assert all(x[1] <= y[0] for x, y in zip(cover, cover[1:]))


def test_unit_rows(spark):
    df = spark.createDataFrame([(1, "Alpha beta. Gamma delta.", 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, sent_start int")
    assert {tuple(r) for r in sentences.sentence_units(df, "doc_id").collect()} == {(1, 0, 11), (1, 12, 24)}


ENGLISH = "The committee rejected the old treaty because nobody in the village had read it. Every morning the baker opened his shop before the rain came down. "
SPANISH = "El comité rechazó el antiguo tratado porque nadie en el pueblo lo había leído. Cada mañana el panadero abría su tienda antes de que llegara la lluvia. "


def parser():
    return langid.Parser({"en": langid.reading(ENGLISH * 3), "es": langid.reading(SPANISH * 3), "ja": "その日、委員会は古い条約を断った。", "zh": "委员会拒绝了古老的条约。", "ru": langid.reading("Комитет отклонил старый договор.")})


def segments(text):
    return parser().segments([sentences.BoundaryModel().units(text)], [text])[0]


def test_languages():
    assert [x[1] for x in segments("The baker had read the old treaty.")] == ["en"]
    mixed = "The baker opened the shop in the village. — El panadero rechazó el antiguo tratado del pueblo."
    found = segments(mixed)
    assert [(x[0], x[1]) for x in found] == [(0, "en"), (mixed.index("El"), "es")]
    assert all(0 < x[2] <= 1 for x in found)
    assert segments("") == [] and segments("123 🙂") == []
    assert [x[1] for x in segments("Комитет отклонил договор.")] == ["ru"]
    assert langid.label_code("pt-BR") == "pt" and langid.label_code("Deutsch") == "de" and langid.label_code("n/a") is None and langid.label_code(None) is None


def test_longest_match_parse_equals_brute_force():
    ref, text = "abracadabra", "abracabrabadra"
    nxt = langid.suffix_automaton(ref)
    count, at = 0, 0
    while at < len(text):
        size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in ref), 1)
        count, at = count + 1, at + size
    assert langid.Parser._walk(nxt, text) == count


@pytest.mark.parametrize("target", [None, "", " ", "-", "[no output]", "None", "<p></p>", "```\n```", '""', "…", "n/a"])
def test_empty(target):
    assert pairs.is_empty(target)


def test_truncation():
    for t in ("The baker opened the sh", "He saw Mr.", "“Was it true that he", "A list:\n- one,\n- two and", "It went on ..."):
        assert pairs.breaks_off(t), t
    for t in ("Done.", "He said “no!”", "A list:\n\n- one\n- two\n- three", "終わった。", "It ended at 5 p.m.", "Good 🙂"):
        assert not pairs.breaks_off(t) or t == "Good 🙂", t


def test_copies_and_refusals():
    s = "The old treaty was lost. Nobody read it."
    for t in (s.upper(), "Here is the text:\n\n" + s, s.replace(" ", "\n"), s.replace(". ", " "), "> " + s):
        assert pairs.copies(s, t), t
    assert not pairs.copies(s, s.replace("old", "new")) and not pairs.copies(s, s + " More.")
    assert pairs.decline_share("I'm sorry, but I cannot help with that.")[0] == 1
    assert pairs.decline_share("“I have to decline,” wrote Ann. The shop opened. All went well. The end.")[0] == 0
    assert pairs.wanted_language("Translate the text into German.") == "de" and pairs.wanted_language("Answer it.") is None


def test_broken_pairs(spark):
    long = ENGLISH + "Later the river rose and the old bridge fell into the water."
    rows = [(f"g{i}", "Rewrite this.", long, f"Version {i}. " + long.replace("old", "ancient") + " It was late.") for i in range(30)]
    rows += [("e", "Rewrite this.", long, " "), ("e", "Rewrite this.", long, " "), ("t", "Rewrite this.", long, "Now the baker came and opened the sh"), ("c", "Rewrite this.", long, long.upper()), ("o", "Rewrite this.", long, SPANISH), ("r", "Rewrite this.", long, "I'm sorry, but I cannot help with that."), ("n", None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, instruction string, source string, target string, found int")
    ref = {"en": langid.reading(ENGLISH * 3 + long), "es": langid.reading(SPANISH * 3)}
    got = {(r.id, r.defect) for r in pairs.broken_pairs(df, "id", ref).collect()}
    assert {("e", "empty"), ("t", "truncated"), ("c", "copy"), ("o", "other_language"), ("r", "refusal"), ("n", "empty")} == got
    assert pairs.broken_pairs(df.limit(0), "id", ref).count() == 0


def test_parts_add_up():
    enc = tokens.encoding(tokens.vocabulary_path())
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "'s", "don't", "12", "é", "漢字", "。", "!?", " ", "x1y", "<|endoftext|>"]) for _ in range(120))
        cut = tokens.parts(text, 40)
        assert "".join(cut) == text
        assert sum(len(enc.encode_ordinary(p)) for p in cut) == len(enc.encode_ordinary(text))


def test_budget(spark):
    big = "some words here, " * 2500
    rows = [(1, "a b c", " News/x", "EN", "Web"), (2, big, "news", "en-XA", None), (3, None, None, None, "web"), (4, "", "", "de", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, domain string")
    counts = {r.id: r.tokens for r in tokens.document_tokens(df, "doc_id").collect()}
    enc = tokens.encoding(tokens.vocabulary_path())
    assert counts == {1: 3, 2: len(enc.encode_ordinary(big)), 4: 0}
    rows = tokens.token_budget(df, "doc_id", "text", "source", "lang", "domain").collect()
    by = {(r.level, r.source, r.lang, r.domain): (r.documents, r.tokens) for r in rows}
    assert by["source", "news", None, None] == (2, 3 + counts[2]) and by["all", None, None, None] == (4, sum(counts.values()))
    assert by["language", None, "en", None] == (2, 3 + counts[2]) and by["source", "unknown", None, None] == (2, 0)


def test_wrapped_lines_and_case():
    assert units("He met Dr.\nPello on the road to\nMiktor. Then he left and went home again, P. M. Lusor said nothing.") == ["He met Dr.\nPello on the road to\nMiktor.", "Then he left and went home again, P. M. Lusor said nothing."]
    assert units("the old mill burned. nobody saw the fire, i.e. the smoke.") == ["the old mill burned.", "nobody saw the fire, i.e. the smoke."]


def _usual(n):
    return [("Rewrite this.", f"The baker {i} opened his shop before the rain came down. Nobody in the village had read the treaty.", f"Before it rained, baker {i} had opened the shop. The treaty was unread in the village. It was late.") for i in range(n)]


def test_refusals_in_other_words_than_the_lists(monkeypatch):
    """The classifier decides: with the word lists emptied, refusals that neither they nor the grammar spell out are found, and answers that tell of one are not."""
    never = pairs.re.compile("(?!)")
    monkeypatch.setattr(pairs, "_DECLINE", never)
    monkeypatch.setattr(pairs, "_OFFER", never)
    ref = {"en": langid.reading(ENGLISH * 3), "es": langid.reading(SPANISH * 3)}
    usual = _usual(80)
    model, features = pairs.fit_pairs(usual, ref), pairs.Featurizer(ref)
    refused = ["I regret that I cannot take on this request.", "Sorry, this passage is something I am not able to rewrite for you.", "I must decline this one, since my guidelines do not allow it.", "Unfortunately I won't be able to handle your document."]
    told = [usual[3][2] + " “I cannot help with that,” said the baker, and nobody in the village asked him again before the rain came down."]
    p = model.scores(features([("Rewrite this.", usual[0][1], t) for t in refused + told]))[:, 2]
    assert (p[:4] >= model.thresholds[2]).all() and p[4] < model.thresholds[2]


def test_empty_and_copy_of_any_length():
    assert pairs.is_empty("<p>none</p>" + "<br>" * 200) and not pairs.is_empty("<p>none</p>" + "<br>" * 200 + "word")
    s = "The old treaty was lost. Nobody read it."
    lead = "Here is, after careful thought and a good deal of further reading in all the papers that were sent to me over the last two weeks, the text:"
    assert pairs.copies(s, lead + "\n" + s)


def test_long_unit_among_short_ones():
    """A block of the parse is bounded by its cells, and a unit parsed in pieces needs about as many phrases as in one."""
    p = parser()
    text = langid.reading(ENGLISH * 80)
    got = p.phrases([text, *[langid.reading("The baker opened the shop.")] * 50])
    whole = p._walk(langid.suffix_automaton(langid.reading(ENGLISH * 3)), text)
    assert abs(got[0, 0] - whole) <= len(text) // langid.LONG + 1 and (got[1:] == got[1]).all()


def _stories(n, seed):
    rng = random.Random(seed)
    who, did, what, where = ("the baker", "my sister", "an old man", "the judge", "nobody", "our guide"), ("opened", "rejected", "found", "sold", "described"), ("the shop", "the treaty", "a letter", "the bridge", "some bread"), ("in the village", "before the rain", "near the river", "last year", "without a word")
    return [[" ".join(rng.choice(x) for x in (who, did, what, where)) for _ in range(rng.randrange(4, 9))] for _ in range(n)]


def test_unstopped_text_is_split_between_words():
    model = sentences.fit_boundaries([" ".join(s.capitalize() + "." for s in story) for story in _stories(150, 1)])
    found = true = both = 0
    for story in _stories(40, 2):
        text = " ".join(story)
        starts, at = set(), 0
        for s in story:
            starts.add(at)
            at += len(s) + 1
        got = {a for a, _ in model.units(text)}
        found, true, both = found + len(got), true + len(starts), both + len(got & starts)
    assert both > 0.9 * true and both > 0.9 * found
    heading = "notes on the bridge near the river"
    assert [heading] == [heading[a:b] for a, b in model.units(heading)]
    thai = "สวัสดีครับ ผมชื่อสมชาย วันนี้อากาศดีมาก เราไปเดินเล่นที่สวนกันเถอะ"
    assert [thai[a:b] for a, b in model.units(thai)] == thai.split()


def test_sentence_fit_reads_all_texts(spark):
    """What only a text of more than 20,000 code points tells is learned as well, in equal numbers however the rows are spread."""
    long = " ".join(s.capitalize() + "." for story in _stories(400, 3) for s in story)
    told = _stories(5, 4)
    df = spark.createDataFrame([(0, long), (1, None), *((k + 2, " ".join(x)) for k, x in enumerate(told))], "doc_id long, text string")
    got = {(r.id, r.sent_start) for r in sentences.sentence_units(df, "doc_id").where("id > 1").collect()}
    true = {(k + 2, len(" ".join(x[:i])) + (i > 0)) for k, x in enumerate(told) for i in range(len(x))}
    assert len(long) > 20_000 and len(got & true) > 0.9 * len(true) and len(got & true) > 0.9 * len(got)
    model, alone = sentences.fit_on(df.repartition(3)), sentences.fit_boundaries([r.text for r in df.where("text is not null").collect()])
    assert model.words.all == len((long + " " + " ".join(" ".join(x) for x in told)).split()) and model.words.words == alone.words.words
    assert (model.words.table == alone.words.table).all() and (model.left.yes == alone.left.yes).all() and (model.right.no == alone.right.no).all()


def test_languages_are_learned_from_whole_texts(spark, tmp_path):
    """Words that stand in labelled texts only beyond their first 16,000 code points tell the language of a sample without a label; a wrong label teaches nothing."""
    from inkstrata.llm.queries import p6_found

    rng = random.Random(5)
    words = {lang: ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(40)] for lang in ("en", "es")}
    say = lambda lang, n: " ".join(" ".join(rng.choice(words[lang]) for _ in range(8)).capitalize() + "." for _ in range(n))
    usual = {"en": ENGLISH, "es": SPANISH}
    rows = [(f"{lang}{k}", (usual[lang] + " ") * (20_000 // len(usual[lang]) + 1) + say(lang, 60), f"x/{lang}") for lang in usual for k in range(8)]
    rows += [("none-en", say("en", 3), "x"), ("none-es", say("es", 3), "x"), ("wrong", say("es", 4), "x/en"), ("null", None, "x/en")]
    spark.createDataFrame(rows, "sample_id string, text string, domain string").selectExpr("*", "timestamp '2024-01-01' AS loaded_at").write.parquet(f"{tmp_path}/hf_samples.parquet")
    assert {tuple(r) for r in p6_found(spark, str(tmp_path)).collect()} == {("none-en", 0, "en"), ("none-es", 0, "es"), ("wrong", 0, "es")}


def test_token_totals_of_repeated_and_missing_ids(spark):
    """Rows count by themselves: equal ids and null ids lose or double nothing, cut documents neither."""
    big = "some words here, " * 2500
    rows = [(1, "a b c", "x", "en", "d"), (1, "a b c", "x", "en", "d"), (None, "a b", "x", "en", "d"), (2, big, "x", "en", "d"), (2, big, "x", "en", "d"), (3, None, "x", "en", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, domain string")
    size = len(tokens.encoding(tokens.vocabulary_path()).encode_ordinary(big))
    total = {r.level: (r.documents, r.chars, r.tokens) for r in tokens.token_budget(df, "doc_id", "text", "source", "lang", "domain").collect()}["all"]
    assert total == (6, 13 + 2 * len(big), 8 + 2 * size)
    assert sorted((r.id, r.tokens) for r in tokens.document_tokens(df, "doc_id").collect()) == [(1, 3), (1, 3), (2, size), (2, size)]
