"""Overlaps, leaks, samples, splits and containers."""

import random

import numpy as np
import pytest

from inkstrata.llm import leak, overlap, packing, sampling, splits


def lcs_plain(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        assert overlap.lcs(a, b) == lcs_plain(a, b)


def test_alignment_of_reworked_text():
    rng = random.Random(2)
    a = [rng.randrange(10_000) for _ in range(300)]
    b = [x for x in a if rng.random() > 0.05]
    p, q = (np.array(x, np.uint64) for x in (a, b))
    assert overlap.aligned(p, q) == lcs_plain(a, b)


def test_winnow_guarantee():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 500).astype(np.uint64)
    at = set(overlap.winnow(h, np.repeat([0, 1], 250), 6).tolist())
    for owner in (0, 250):
        assert all(any(j in at for j in range(i, i + 6)) for i in range(owner, owner + 245))


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    rows, texts = [], []
    for _ in range(60):
        texts.append(words(rng, rng.randrange(8, 160)))
    for i, t in enumerate(list(texts)):
        kind = i % 4
        u = list(t)
        for _ in range(int(len(u) * (0, 0.05, 0.1, 0.4)[kind])):
            u[rng.randrange(len(u))] = f"n{rng.randrange(9999)}"
        texts.append(u)
    sides = [rng.choice([True, False]) for _ in texts]
    rows = [(i, " ".join(t), s, "x") for i, (t, s) in enumerate(zip(texts, sides))] + [(900, None, True, "x"), (901, " ", False, "x"), (902, "a b c d e f g h", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, in_train boolean, fp string")
    got = {(min(r.train_id, r.other_id), max(r.train_id, r.other_id)) for r in overlap.cross_split_pairs(df, "doc_id", "in_train").collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sides[i] != sides[j] and lcs_plain(texts[i], texts[j]) >= 0.85 * max(len(texts[i]), len(texts[j]))}
    assert got == want


def test_overlap_of_copies_and_empty(spark):
    df = spark.createDataFrame([(1, "one two three", True), (2, "One, two three!", False), (3, "ONE TWO THREE", True)], "doc_id long, text string, in_train boolean")
    assert {tuple(r)[:2] for r in overlap.cross_split_pairs(df, "doc_id", "in_train").collect()} == {(1, 2), (3, 2)}
    assert overlap.cross_split_pairs(df.limit(0), "doc_id", "in_train").count() == 0


def test_leaks(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(["The", *(f"name{rng.randrange(9999)}" for _ in range(12))]) + "."
    items = [(i, f"Use only the text below.\n\n{sentence()} {sentence()}\n\nExplain your choice.") for i in range(30)]
    docs, want = [], set()
    for i, (item, text) in enumerate(items):
        own = text.split("\n\n")[1].split(". ")[0]
        body = [sentence() for _ in range(20)]
        if i % 3 == 0:
            body[7] = own + "."
            want.add((i, item))
        elif i % 3 == 1:
            body[3] = own.replace(own.split()[5], "changed").upper() + "."
            want.add((i, item))
        else:
            body[3] = " ".join(own.split()[:4]) + " and so on with other things."
        docs.append((i, "Use only the text below. " + " ".join(body), "x"))
    docs += [(100, None, "x"), (101, "", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, band string")
    t = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    assert {(r.doc, r.item) for r in leak.contained_items(d, "doc_id", t, "item_id").collect()} == want
    assert leak.contained_items(d, "doc_id", t.limit(0), "item_id").count() == 0


def test_leak_candidates_whatever_the_size(spark):
    low = 1
    for most, rows in leak.PARTITIONS:
        assert most > low and all(leak.recall(most, rows, n) >= leak.RECALL for n in range(3, 400))
        low = most
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, sentence(14)) for i in range(300)]
    reworked = {}
    for i, t in items:  # 2 words of 14 changed: 5 to 6 of 12 shingles stay
        w = t.split()
        w[4], w[9] = word(), word()
        reworked[i] = " ".join(w)
    # One long document quotes all items, so its set is far beyond the last partition.
    docs = [(1, " ".join(reworked.values())), (2, reworked[7]), (3, " ".join(sentence(14) for _ in range(300)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = leak.contained_items(d, "doc_id", spark.createDataFrame(items, "item_id long, text string"), "item_id").collect()
    assert {(r.doc, r.item) for r in found} == {(1, i) for i, _ in items} | {(2, 7)}


def test_leaks_of_equal_items(spark):
    text = "Seven grey herons waited beside the frozen canal before dawn."
    items = [(i, text) for i in range(6)] + [(9, "The copper kettle sang while nobody in the kitchen was listening.")]
    d = spark.createDataFrame([(1, f"Before it. {text} After it."), (2, "Nothing of the sort stands here.")], "doc_id long, text string")
    found = leak.contained_items(d, "doc_id", spark.createDataFrame(items, "item_id long, text string"), "item_id").collect()
    assert {(r.doc, r.item) for r in found} == {(1, i) for i in range(6)}


def test_quotas():
    share, least = np.array([0.4, 0.3, 0.2, 0.1]), np.array([0, 0, 0, 30])
    have = np.array([1000, 10, 1000, 20])
    margins = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    q = sampling.quotas(share, least, have, margins, 100)
    assert q.sum() == 100 and (q <= have).all() and q[3] == 20 and q[1] == 10
    exact = sampling.rake(share, np.full(4, 1e9), margins, 100.0)
    assert np.allclose(exact, share * 100)


def test_sample(spark):
    rows = [(f"s{i}", "news/en" if i % 2 else "Web Pages/en", "human" if i % 3 else " AI ", None) for i in range(600)] + [("s1", "news/en", "human", None), ("x", "other/en", "ai", None), ("y", "news/en", None, None), (None, "news/en", "ai", None)]
    s = spark.createDataFrame(rows, "sample_id string, domain string, label string, loaded_at timestamp")
    c = spark.createDataFrame([("news", "news"), ("web_pages", "web")], "domain_key string, category string")
    t = spark.createDataFrame([("news", "human", 0.4, 2, 100), ("news", "ai", 0.1, 2, 100), ("web", "human", 0.4, 2, 100), ("web", "ai", 0.1, 150, 100)], "category string, label string, target_share double, min_rows long, sample_rows long")
    cells = sampling.cells(s, c)
    assert cells.count() == 600
    report = {(r.category, r.label): r for r in sampling.sample_report(cells, t).collect()}
    assert [k for k, r in report.items() if r.unmet] == [("web", "ai")]
    drawn = sampling.draw(cells, t).collect()
    assert len({r.sample_id for r in drawn}) == len(drawn)
    for k, r in report.items():
        assert sum((d.category, d.label) == k for d in drawn) == r.quota
    assert sampling.draw(cells.limit(0), t).count() == 0


def components_plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(130)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(300)]
    got = {r.node: r.component for r in splits.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == components_plain(edges)


def test_groups(spark):
    rows = [("rd-0001", "RD_2"), ("rd-0002", None), ("hf-1", "rd-２"), ("hf-2", "pr 9"), ("hf-3", "PR#0009"), ("hf-4", "pr-0"), ("hf-5", "none"), ("hf-5", "none"), (None, "pr-9"), ("hf-6", "")]
    df = spark.createDataFrame(rows, "record_id string, key string")
    got = {r.record_id: (r.group_id, r.members) for r in splits.record_groups(df).collect()}
    assert got == {"rd-0001": ("hf-1", 3), "rd-0002": ("hf-1", 3), "hf-1": ("hf-1", 3), "hf-2": ("hf-2", 2), "hf-3": ("hf-2", 2), "hf-4": ("hf-4", 1), "hf-5": ("hf-5", 1), "hf-6": ("hf-6", 1)}
    assigned = splits.assign_splits(splits.record_groups(df), {"train": 0.5, "test": 0.5}).collect()
    assert len({(r.group_id, r.split) for r in assigned}) == len({r.group_id for r in assigned})
    assert splits.record_groups(df.limit(0)).count() == 0


def best_fit_plain(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, g in enumerate(bins) if g >= s]
        if fits:
            i = min(fits, key=lambda j: bins[j])
            bins[i] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.randrange(20, 200)
    sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400))]
    classes = {s: sizes.count(s) for s in set(sizes)}
    runs, opened = packing.best_fit(classes, capacity)
    used = {}
    for size, _, n, first in runs:
        for b in range(first, first + n):
            used[b] = used.get(b, 0) + size
    assert max(used.values()) <= capacity and sum(used.values()) == sum(sizes) and len(used) == opened
    assert opened == best_fit_plain(sizes, capacity)


def test_containers(spark):
    rng = random.Random(8)
    items = spark.createDataFrame([(i, rng.choice([1, 5, 17, 64, 100, 700])) for i in range(500)] + [(600, 0)], "id long, tokens long")
    specs = spark.createDataFrame([("a", 64), ("b", 300)], "spec_id string, capacity long")
    rows = packing.pack(items, specs).collect()
    sizes = {r.id: r.tokens for r in items.collect() if r.tokens}
    for spec, cap in (("a", 64), ("b", 300)):
        own = [r for r in rows if r.spec_id == spec]
        used, per = {}, {}
        for r in own:
            used[r.container] = used.get(r.container, 0) + r.tokens
            per.setdefault(r.id, []).append(r)
        assert max(used.values()) <= cap
        assert {i: sum(r.tokens for r in p) for i, p in per.items()} == sizes
        assert all(len(p) == 1 for i, p in per.items() if sizes[i] <= cap)
    assert packing.pack(items.limit(0), specs).count() == 0


def _sentence(rng, n=15):
    return " ".join("w" + format(rng.getrandbits(40), "x") for _ in range(n)).capitalize() + "."


def test_one_passage_of_four_questions(spark):
    """A passage that several items share, in equal or reworked copies, is no framing; what stands beside many passages is."""
    rng = random.Random(21)
    passage = " ".join(_sentence(rng) for _ in range(4))
    items = [(f"i{k}", f"Read the following text with care.\n\n{passage}\n\n{_sentence(rng, 7)}") for k in range(4)]
    reworked = [_sentence(rng) for _ in range(3)]
    items += [(f"r{k}", "Read the following text with care.\n\n" + " ".join([*reworked, _sentence(rng, 5)])) for k in range(6)]
    docs = [(1, _sentence(rng) + " " + passage), (2, "Read the following text with care. " + _sentence(rng)), (3, reworked[1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(items, "item_id string, text string")
    found = {(r.doc, r.item) for r in leak.contained_items(d, "doc_id", t, "item_id").collect()}
    assert found == {(1, f"i{k}") for k in range(4)} | {(3, f"r{k}") for k in range(6)}


def test_many_leaks_in_one_document(spark):
    """A document that holds hundreds of items' sentences: all are found."""
    rng = random.Random(22)
    leaked = [_sentence(rng) for _ in range(500)]
    d = spark.createDataFrame([(1, " ".join(leaked))], "doc_id long, text string")
    t = spark.createDataFrame([(k, s + " " + _sentence(rng)) for k, s in enumerate(leaked)], "item_id long, text string")
    assert {r.item for r in leak.contained_items(d, "doc_id", t, "item_id").collect()} == set(range(500))


def test_one_size_of_many_items(spark, monkeypatch):
    """A size that most items have is ranked in several parts; every piece still has one container, and none is overfull."""
    monkeypatch.setattr(packing, "PART", 40)
    items = spark.createDataFrame([(i, 10 if i % 3 else 1 + i % 29) for i in range(1500)], "id long, tokens long")
    rows = packing.pack(items, spark.createDataFrame([("a", 64)], "spec_id string, capacity long")).collect()
    used = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.tokens
    assert len(rows) == 1500 and max(used.values()) <= 64
    assert len(used) == best_fit_plain([r.tokens for r in items.collect()], 64)


def test_copies_of_two_spellings(spark):
    """Copies of a spelling do not meet each other, only those of the other spelling."""
    rows = [(i, "The old cat") for i in range(40)] + [(100 + i, "The old cat") for i in range(3)] + [(200, "The o​ld cat"), (300, "another"), (301, "another")]
    from inkstrata.llm import canon

    got = {tuple(r) for r in canon.same_look_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    want = {(i, 100 + k) for i in range(40) for k in range(3)} | {(i, 200) for i in range(40)} | {(100 + k, 200) for k in range(3)}
    assert got == want


def test_leaks_with_sentences_learned_from_all_documents(spark, tmp_path):
    """An item without stops is parted by what one document of more than 20,000 code points tells; a document with one of its sentences is found."""
    from inkstrata.llm.queries import p9_found

    rng = random.Random(7)
    who, did, what, where = ("the baker", "my sister", "an old man", "the judge", "nobody", "our guide"), ("opened", "rejected", "found", "sold", "described"), ("the shop", "the treaty", "a letter", "the bridge", "some bread"), ("in the village", "before the rain", "near the river", "last year", "without a word")
    every = [" ".join((a, b, c, d)) for a in who for b in did for c in what for d in where]
    rng.shuffle(every)
    own, rest = every[:6], every[6:]
    long = " ".join(x.capitalize() + "." for x in rest)
    spark.createDataFrame([(1, long), (2, f"Something else was said. {own[3].capitalize()}. Then it rained.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, " ".join(own))], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert len(long) > 20_000 and (2, 9) in {(r.doc_id, r.item_id) for r in p9_found(spark, str(tmp_path)).collect()}
