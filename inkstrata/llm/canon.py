"""Problem 1: one form for texts that look the same.

A longest-match transducer over grapheme clusters.  Its mapping is compiled once per process from
the Unicode character database (widths, joined forms, kinds of blank and hyphen, invisible
characters) and from the look-alike table below, checked for conflicts, and then applied to a text
in one left-to-right pass.  What a reader can see (accents, raised digits, letter case, quotation
marks, the number of blanks and line breaks) is kept.

Look-alike letters come out in the alphabet of their word: the unambiguous letters of the word
decide, and where it has none those of the whole text.  Both are properties of the visible form,
so two texts that look alike always get the same result.

Edge cases: null stays null; an empty or blank text maps to its blanks and takes no part in pairs;
equal texts are no pair; extra columns of the input are never looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces

# Letters of the Cyrillic and Greek alphabets and the Latin letters they look like.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝӏАВЕКМНОРСТХІЅЈУԌԚԜӀҺ", "aeopcyxisjhdqwlABEKMHOPCTXISJYGQWIh", strict=True))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳν", "oABEZHIKMNOPTYXjv", strict=True))
# Compatibility forms that a reader can tell from their plain letters.
VISIBLE_TAGS = ("<super>", "<sub>", "<font>", "<circle>", "<fraction>", "<square>", "<vertical>")
VISIBLE = set("ſẛϐϑϒϓϔϕϖϰϱϲϴϵϹ…‥﹍﹎﹏")
# Blanks, line breaks, hyphens and invisible characters.
BREAKS = "\r\x0b\x0c\x85  "
HYPHENS = "‐‑﹣－"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"


def _spell(ch: str) -> str | None:
    """Output of one code point, None where it stays as it is (before composition)."""
    if ch in HYPHENS:
        return "-"
    if ch in BREAKS:
        return "\n"
    cat = unicodedata.category(ch)
    if ch == "\t" or cat == "Zs":
        return " "
    if ch in INVISIBLE or cat == "Cf" or "︀" <= ch <= "️" or "\U000e0000" <= ch <= "\U000e0fff" or (cat == "Cc" and ch != "\n"):
        return ""
    if ch in CYRILLIC:
        return CYRILLIC[ch]
    if ch in GREEK:
        return GREEK[ch]
    parts = unicodedata.decomposition(ch)
    if parts and parts[0] == "<":
        tag = parts.split(" ")[0]
        plain = unicodedata.normalize("NFKD", ch)
        if tag in VISIBLE_TAGS or ch in VISIBLE or plain[:1] == " ":
            return None
        return "".join(CYRILLIC.get(x, GREEK.get(x, x)) for x in plain)
    if "⺀" <= ch <= "⿟" or parts:
        plain = unicodedata.normalize("NFD", ch)
        return "".join(CYRILLIC.get(x, GREEK.get(x, x)) for x in plain)
    return None


#: Code points with anything to map: below the CJK ideographs, the compatibility forms and the tag characters.
SCANNED = (range(0x00, 0x3400), range(0xF900, 0x10000), range(0xE0000, 0xE1000))


class _Table(dict):
    """Code point to output; those without an entry stay as they are."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


class Transducer:
    """Compiled mapping; ``apply`` gives the form with Latin look-alikes, ``native`` the readable one."""

    def __init__(self) -> None:
        self.single: dict[str, str] = {}
        marks = []
        for code in (c for r in SCANNED for c in r):
            ch = chr(code)
            cat = unicodedata.category(ch)
            if cat == "Cn" or 0x20 <= code < 0x7F:
                continue
            if cat[0] == "M" and unicodedata.combining(ch):
                marks.append(code)
            out = _spell(ch)
            if out is not None and (out := unicodedata.normalize("NFC", out)) != ch:
                self.single[ch] = out
        self._check()
        # A cluster of one code point is looked up in the table; longer ones (a base, its marks, invisible characters between them) are found by the scan, the longest first.
        self.table = _Table({ord(c): o for c, o in self.single.items()})
        hidden, mark = _ranges(sorted(ord(c) for c, o in self.single.items() if o == "")), _ranges(marks)
        self.mark, self.touched = re.compile(f"[{mark}]"), re.compile(f"[{mark}{_ranges(sorted(map(ord, self.single)))}]")
        self.scan = re.compile(f"[^\\s{hidden}](?:[{hidden}]*[{mark}])+|[{_ranges(sorted(map(ord, self.single)))}]")
        self.cluster = lru_cache(200_000)(self._cluster)

    def _check(self) -> None:
        """No output may be mapped again: the mapping is free of conflicts and a second pass changes nothing."""
        for ch, out in self.single.items():
            for x in out:
                again = self.single.get(x)
                if again is not None and again != x:
                    raise ValueError(f"conflict: {ch!r} -> {out!r} -> {again!r}")

    def _cluster(self, cluster: str) -> str:
        plain = "".join(self.single.get(c, c) for c in cluster)
        plain = "".join(CYRILLIC.get(x, GREEK.get(x, x)) for x in unicodedata.normalize("NFD", plain))
        return unicodedata.normalize("NFC", plain)

    def apply(self, text: str) -> str:
        if "\r" in text:
            text = text.replace("\r\n", "\n")
        if (text.isascii() and "\r" not in text and "\t" not in text) or self.touched.search(text) is None:
            return text
        if self.mark.search(text) is None:
            form = text.translate(self.table)
        else:
            cluster = self.cluster
            form = self.scan.sub(lambda m: cluster(m[0]), text)
        return unicodedata.normalize("NFC", form)  # a mark that was a sign of its own (half-width voicing) joins its base

    def native(self, text: str) -> str:
        form = self.apply(text)
        if form.isascii() or not _FOREIGN.search(form):
            return form
        counts = {a: len(p.findall(form)) for a, p in _OWN.items()}
        whole = max(counts, key=lambda a: (counts[a], a))

        def word(m: re.Match) -> str:
            w = m[0]
            own = {a: len(p.findall(w)) for a, p in _OWN.items()}
            alphabet = max(own, key=lambda a: (own[a], a == whole))
            if not own[alphabet]:
                alphabet = whole
            return w if alphabet == "latin" else unicodedata.normalize("NFC", unicodedata.normalize("NFD", w).translate(_BACK[alphabet]))

        return _WORD.sub(word, form)


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a regular expression's character class."""
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(re.escape(chr(codes[i])) + ("-" + re.escape(chr(codes[j])) if j > i else ""))
        i = j + 1
    return "".join(out)


_LATIN_LIKE = set(CYRILLIC.values()) | set(GREEK.values())
_FOREIGN = re.compile("[Ͱ-ԯ]")
_WORD = re.compile(r"[^\W\d_]+")
_OWN = {"latin": re.compile("[" + "".join(c for c in map(chr, [*range(65, 91), *range(97, 123)]) if c not in _LATIN_LIKE) + "]"), "cyrillic": re.compile("[Ѐ-ԯ]"), "greek": re.compile("[Ͱ-Ͽ]")}
_BACK = {a: {ord(v): k for k, v in reversed(t.items())} for a, t in (("cyrillic", CYRILLIC), ("greek", GREEK))}


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def canonical(text: str) -> str:
    return transducer().native(text)


# Tokens for comparing texts by their words --------------------------------------------------------

#: Scripts written without spaces: each character is a token.
UNSPACED = "々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿"
_MARKS = "̀-ͯؐ-ًؚ-ٰٟऀ-ःऺ-ॏ॑-ॗॢॣ"
_HYPHEN = re.compile(r"-[ ]*(?:\n[ ]*)?(?=[^\W\d_])")


def _unhyphen(m: re.Match) -> str:
    return "" if m.start() and m.string[m.start() - 1].isalpha() else m[0]


def plain(text: str) -> str:
    """Canonical form in lower case without hyphens inside words, at a line's end or not."""
    form = transducer().apply(text).lower()
    return _HYPHEN.sub(_unhyphen, form) if "-" in form else form


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point (0 parts words, 1 belongs to a word, 2 is a word by itself) and the powers of the word hash."""
    codes = np.arange(0x110000, dtype=np.uint32)
    codes[0xD800:0xE000] = 32
    kind = np.char.isalnum(codes.view("U1")).astype(np.uint8)
    for chars, k in ((_MARKS, 1), (UNSPACED, 2)):
        for lo, hi in re.findall("(.)(?:-(.))?", chars):
            kind[ord(lo) : ord(hi or lo) + 1] = k
    kind[0] = 0
    powers = np.empty(4096, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        for i in range(1, len(powers)):
            powers[i] = powers[i - 1] * np.uint64(0x9E3779B97F4A7C15)
    return kind, powers


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def token_hashes(forms: list[str], places: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the tokens of all ``forms`` (results of :func:`plain`), whole batch at once.

    Returns the hashes, where each text's begin (one more than texts) and, with ``places``, each
    token's start and end in its text.
    """
    kind, powers = _tables()
    cp = np.frombuffer("\0".join([*forms, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kind[cp]
    before = np.concatenate((np.zeros(1, np.uint8), k[:-1]))
    start = np.flatnonzero((k == 2) | ((k == 1) & (before != 1)))
    ends = np.flatnonzero(cp == 0)
    if len(start):
        after = np.concatenate((k[1:], np.zeros(1, np.uint8)))
        stop = np.flatnonzero((k == 2) | ((k == 1) & (after != 1))) + 1
        within = k > 0
        at = np.arange(len(cp)) - np.repeat(np.concatenate((np.zeros(1, np.int64), start)), np.diff(np.concatenate((np.zeros(1, np.int64), start, [len(cp)]))))
        with np.errstate(over="ignore"):
            value = np.where(within, (cp.astype(np.uint64) + np.uint64(1)) * powers[at % 4096], np.uint64(0))
            hashes = mix(np.add.reduceat(value, start))
    else:
        stop, hashes = start, np.zeros(0, np.uint64)
    offsets = np.concatenate((np.zeros(1, np.int64), np.searchsorted(start, ends)))
    if not places:
        return hashes, offsets
    first = np.repeat(np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1)), np.diff(offsets))
    return hashes, offsets, start - first, stop - first


_TOKENS = re.compile(f"[^\\W_{UNSPACED}]+|[{UNSPACED}]")
_TOKENS_MARKED = re.compile(f"(?:[^\\W_{UNSPACED}]|[{_MARKS}])+|[{UNSPACED}]")
_HAS_MARKS = re.compile(f"[{_MARKS}]")


def tokens(text: str) -> list[str]:
    """Words (characters where the script has no spaces) without case, layout, punctuation and hyphenation; of one text."""
    form = plain(text)
    return (_TOKENS_MARKED if _HAS_MARKS.search(form) else _TOKENS).findall(form)


# Operator ------------------------------------------------------------------------------------------


def canonical_text(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """Adds ``out``, the readable canonical form of ``text``; null stays null."""

    @F.pandas_udf("string")
    def form(s):  # noqa: ANN001, ANN202
        f = transducer().native
        return s.map(f, na_action="ignore")

    return df.withColumn(out, form(F.col(text)))


def canonical_keys(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``id``, ``form_key`` (two 64-bit hashes of the canonical form) and ``raw_key`` (of the text itself); null and blank texts are left out."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = transducer().apply
        for b in pieces(batches, 1):
            ids, forms, raws = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                form = apply(t)
                if form.isspace() or not form:
                    continue
                ids.append(i)
                forms.append(xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")))
                raws.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], ["id", "form_key", "raw_key"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, form_key binary, raw_key binary")


def same_look_pairs(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Pairs (id_a < id_b) of rows whose texts differ but have one canonical form.

    Texts are read and brought to their form once.  Classes of equal texts stand for their members
    until the end: forms with a single spelling, however many copies they have, cost one row and
    yield nothing; of the others the pairs of different spellings are formed, and only those are
    expanded to the rows, so copies of one spelling never meet each other.
    """
    keys = cut(canonical_keys(df, id_col, text).distinct())
    spellings = keys.groupBy("form_key", "raw_key").agg(F.count("*").alias("n"))
    several = spellings.groupBy("form_key").agg(F.count("*").alias("n")).where("n > 1").select("form_key")
    own = spellings.join(several, "form_key", "left_semi").select("form_key", "raw_key")
    x, y = own.withColumnRenamed("raw_key", "x"), own.withColumnRenamed("raw_key", "y")
    unlike = x.join(y, "form_key").where("x < y").select("x", "y")
    members = lambda name, out: keys.select(F.col("raw_key").alias(name), F.col("id").alias(out))
    pairs = unlike.join(members("x", "p"), "x").join(members("y", "q"), "y").where("p != q")
    return pairs.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()
