"""Column functions on text. Offsets and lengths are code points; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and the ASCII class for results that other engines must reproduce.
UNICODE_WS, ASCII_WS = r"(?U)\s+", r"[ \t\n\x0B\f\r]+"
# Signs of code or tool traces.
CODE_MARKERS = ("```", "def ", "import ", "function(", "const ", "#include", "</", "{}", "});")
# Latin letters and their Cyrillic look-alikes, zero-width characters, typographic punctuation.
LATIN, CYRILLIC = "aceopxyABEHKMOPT", "асеорхуАВЕНКМОРТ"
ZERO_WIDTH = "​‌‍⁠"
PUNCTUATION = (("—", " - "), ("–", "-"), ("’", "'"), ("“", '"'), ("”", '"'))


def uniform(seed: int, op: str, *keys: Column) -> Column:
    """Uniform draw in [0, 1) that depends only on seed, operator and key, the same in every engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{op}:"), F.concat_ws(":", *keys))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def collapse(text: Column, ws: str = ASCII_WS) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, ws, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def content_key(text: Column, ws: str = ASCII_WS) -> Column:
    """Fingerprint of the first 600 normalised characters, the reference's key: equal for texts that differ in case and white space only, and for longer texts that differ beyond that opening only."""
    return F.md5(F.substring(F.lower(collapse(text, ws)), 1, 600))


def words(text: Column, ws: str = ASCII_WS) -> Column:
    return F.filter(F.split(text, ws), lambda w: w != "")


def word_count(text: Column, ws: str = ASCII_WS) -> Column:
    return F.size(words(text, ws))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def code_markers(text: Column) -> Column:
    total = F.lit(0).cast("long")
    for m in CODE_MARKERS:
        total = total + occurrences(text, m)
    return total


def letter_share(text: Column) -> Column:
    """Share of letters and white space; 0 for an empty text."""
    return F.length(F.regexp_replace(text, r"[^\p{L} \t\n\x0B\f\r]", "")) / F.greatest(F.length(text), F.lit(1))


def is_prose(text: Column) -> Column:
    return (code_markers(text) < 3) & (letter_share(text) > 0.80)


def latin_look_alikes(text: Column) -> Column:
    """Inverse of the look-alike attack: Cyrillic letters of the table to Latin ones, same length."""
    return F.translate(text, CYRILLIC, LATIN)


def cyrillic_look_alikes(text: Column) -> Column:
    return F.translate(text, LATIN, CYRILLIC)


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, f"[{ZERO_WIDTH}]", "")


def plain_punctuation(text: Column) -> Column:
    for a, b in PUNCTUATION:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def flatten_lines(text: Column) -> Column:
    """Line breaks to blanks, same length."""
    return F.translate(text, "\n", " ")


def bind(value: Column, f) -> Column:  # noqa: ANN001
    """f(value) with the value computed once: what a lambda refers to from outside is computed anew for each element."""
    return F.transform(F.array(value), f)[0]


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Set of character n-grams of the lower-cased, collapsed text; a shorter text is its own only element, an empty one has none."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))
    none = F.array().cast("array<string>")
    return bind(F.lower(collapse(text)), lambda t: F.when(F.length(t) >= n, grams(t)).when(F.length(t) > 0, F.array(t)).when(t.isNotNull(), none))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    ratio = lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"])))
    return bind(F.struct(a.alias("a"), b.alias("b")), ratio)


def hard_wrapped(text: Column) -> Column:
    """Most lines stop near a common width without ending a sentence."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^{ASCII_WS}|{ASCII_WS}$", "")), lambda x: x != "")

    def verdict(s: Column) -> Column:
        n, width = F.size(s["lines"]), s["width"]
        inner = F.slice(s["lines"], F.lit(1), F.greatest(n - 1, F.lit(0)))
        wrapped = F.size(F.filter(inner, lambda x: (F.length(x) >= F.lit(0.75) * width) & ~x.rlike("[.!?…:;»\"”)]$")))
        return (n >= 4) & (width >= 40) & (wrapped / F.greatest(n - 1, F.lit(1)) >= 0.4)

    at = lambda x: (F.floor(F.lit(0.9) * (F.size(x) - 1)) + 1).cast("int")
    sized = bind(lines, lambda x: F.struct(x.alias("lines"), F.when(F.size(x) > 0, F.try_element_at(F.array_sort(F.transform(x, F.length)), at(x))).alias("width")))
    return bind(sized, verdict)


def reflow(text: Column) -> Column:
    """Joins the lines of each paragraph: CR LF, form feeds, page numbers, line-end hyphens and runs of blanks."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\f"), F.lit("\n\n"))
    t = F.regexp_replace(t, r"\n\s*\d+\s*/\s*\d+\s*\n", "\n\n")
    t = F.regexp_replace(t, r"(?U)(\w)-\n\s*(\w)", "$1-$2")
    paragraph = lambda p: F.regexp_replace(F.array_join(F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != ""), " "), r"[ \t]{2,}", " ")
    return F.array_join(F.filter(F.transform(F.split(t, r"\n\s*\n"), paragraph), lambda x: x != ""), "\n\n")


def sentence_pieces(text: Column) -> Column:
    """Sentences with their trailing blanks; a piece of blanks only goes with the next one."""
    marked = F.regexp_replace(F.regexp_replace(text, "(?U)([.!?…][\"'”’)\\]]*\\s+)", "$1\u0001"), "(\\n\\s*\\n)", "$1\u0001")
    pieces = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    glued = F.aggregate(
        pieces,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda acc, p: F.when(strip(F.concat(acc["open"], p)) == "", F.struct(acc["done"].alias("done"), F.concat(acc["open"], p).alias("open"))).otherwise(
            F.struct(F.array_append(acc["done"], F.concat(acc["open"], p)).alias("done"), F.lit("").alias("open"))
        ),
        lambda acc: F.when((F.size(acc["done"]) == 0) & (acc["open"] != ""), F.array(acc["open"])).otherwise(acc["done"]),
    )
    return glued
