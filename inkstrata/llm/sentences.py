"""Problem 10: sentence units of texts in any language and layout.

A hidden-event n-gram language model: between any two words stands an unseen event, boundary or none.
Where a sign stands in the gap (a stop, a quotation mark, a line break), its class and the tokens left
and right of it (two on either side, backing off to one) score both events.  Where only a blank or
nothing stands, an n-gram model of words with boundary tokens scores them: the chance of a boundary
behind the two words to the left and of the two words to the right at a sentence's beginning, against
that of the words going on.  How much such a gap may be a boundary at all depends on how unlikely it
is that a writer who uses stops would use none for so many words (from the lengths of the fitted
units), so unpunctuated texts and scripts are split and others are not.  A chain over all gaps of a
block ties neighbouring events together, and forward-backward posteriors decide.  The model starts
from the priors below and is re-estimated (Baum-Welch over gaps, with the ends and starts of blocks as
observed boundaries) on all texts: one pass collects each chain of neighbouring gaps with its number,
and the words, n-grams and lengths of the units that the priors give; the rounds run over the distinct
chains.  Counts of events and of n-grams stand in tables of a fixed size, whatever the corpus: a
token's or n-gram's place is its hash, and the least of two places counts for an n-gram.

Layout gives events that are observed: a blank line, a list item's marker, a line that a hard wrap
cannot have ended.  Gaps within quoted speech are none.  Scripts without cases, blanks or stops use
the same events with their own classes.

Null text gives no unit, as does a text of blanks; offsets are code points of the text as stored;
each row is handled by itself, repeated rows give repeated units.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canon import UNSPACED, mix, token_hashes, transducer
from .common import cut, pieces

# Shortened words that something follows, and those that may also end a sentence.
ABBREVIATIONS = set(
    "dr mr mrs ms prof st no nos fig figs vol vols pp cf eg ie approx vs ca jr ch sec eq al gen col capt rev hon dept ed eds "
    "nr vgl bzw evtl ggf inkl abb bd hr fr hrsg tel str ing "
    "sr sra srta srs dña ud uds pág págs núm ej vid "
    "mme mlle mm env réf art chap "
    "sig sigg dott ing avv pag cap "
    "dhr mevr bijv blz zgn ca nl "
    "проф ул рис стр см тов гр им акад "
    "डॉ श्री प्रो कि मी".split()
)
MAY_END = set("etc usw ecc enz pm am p.m a.m inc ltd co corp jr т.д т.п др г гг в вв руб тыс usf".split())
REPORTING = set("said asked rief fragte gritó preguntó dijo gridò chiese disse riep vroeg zei gritou perguntou disse s'est сказал сказала спросил спросила cried shouted replied と".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())

# Words that something of the same sentence follows.
LEADING = set(
    "of to the a an in on at by for with from and or but that which near outside "
    "de la le les du des à au aux en un une et ou que el los las del al y con por para il lo gli di da nel e che per do dos das no na em um uma com "
    "der die den dem das ein eine einen im am auf von zu und oder bei vor nach het een van op te met voor bij "
    "в на с к у из от до по за и для о об के का की में से ने को من في على إلى عن".split()
)

STOPS = ".!?。！？｡।॥؟۔…‥．"
QUOTES = '"“”„«»「」『』'
_HIDDEN = "­​‌‍⁠﻿"
_EVENT = re.compile(f"[{STOPS}{QUOTES}\\n]")
_STOP_RUN, _BLANKS = re.compile(f"[{STOPS}]+"), re.compile(r"\s*")
_MARKER = re.compile(r"(?:[-*•–·‣▪]|\d{1,3}[.)]|[A-Za-z][)]|[(]\w{1,2}[)])[^\S\n]+(?=\S)")
_CLOSE = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", '"': '"'}
_AFTER = set(")]）］】")
_SKIP = re.compile(f"[\\s{_HIDDEN}]*")
_OPENERS = "([{（【“„«「『\"'‘¿¡"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SOLID = re.compile(r"\S+")
_DAY = re.compile(r"\d{1,2}\.\s+([^\W\d_]+)")
_CJK = re.compile(f"[{UNSPACED}]")
_FOLLOWS = re.compile(r"\s+([^\W\d_]+)")


_ODD_CASE = re.compile(r"(?:^|\n\n)[a-zà-ÿа-я]{2,}[^\n.)]*\.|(?:[A-ZÀ-Þ]{2,} ){4}|(?:[А-Я]{2,} ){3}")
_ITEM = re.compile(r"[^\S\n]*(?:\d{1,3}|[A-Za-z])$")
_BULLETS = "-*•–·‣▪"


def _shape(ch: str) -> str:
    if "぀" <= ch <= "鿿" or ch == "々":
        return "cjk"
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "lower" if ch.islower() else "upper" if ch.isupper() or ch.istitle() else "letter"
    return "open" if ch in _OPENERS else "other"


# The model's priors (log odds of a boundary) by class of the left and the right token.
LEFT_PRIOR = {"word": 1.5, "short": 0.5, "abbr": -7.0, "mayend": 0.0, "initial": -5.0, "letter": -2.0, "number": -0.5, "ordinal": -0.5, "ask": 2.5, "wide": 5.0, "danda": 5.0, "dots": -1.5, "widedots": -6.0, "closed": 1.0, "quoted": -1.5, "foreign": -2.5}
RIGHT_PRIOR = {"lower": -6.0, "upper": 1.5, "letter": 1.0, "digit": -0.7, "cjk": 1.0, "open": 1.5, "other": -0.5}
#: Texts of a fit in one task (the driver of problem 7's languages), rounds, and how many observations the prior of a token's weight stands for.
FIT_DOCUMENTS, ROUNDS, PRIOR = 1500, 2, 6.0
#: Places of the tables of events (each side) and of n-grams (each of two rows).
EVENTS, GRAMS = 1 << 20, 1 << 22
#: Expected events are summed as whole millionths, so their order does not matter.
MILLION = 1_000_000
#: Share of blocks whose writer uses no stops, chance of a stop in one all the same; mean words (characters of unspaced scripts) of a unit before the fit; strength of backing off.
UNSTOPPED, STRAY, WORDS, SIGNS, BACK = 0.01, 0.01, 16.0, 28.0, 2.0
#: Log odds that a blank adds between characters of scripts that use none between words.
BLANK = 3.0


ABBREVIATIONS, MAY_END, REPORTING = ({transducer().apply(w) for w in words} for words in (ABBREVIATIONS, MAY_END, REPORTING))


def _sparse(x: np.ndarray) -> tuple[tuple[int, ...], str, np.ndarray, np.ndarray]:
    at = np.flatnonzero(x)
    return x.shape, x.dtype.str, at.astype(np.int32), x.ravel()[at]


def _dense(shape: tuple[int, ...], kind: str, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)), kind)
    out[at] = value
    return out.reshape(shape)


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts, most of them small, in few bytes."""
    large = np.flatnonzero(counts > 254)
    return pickle.dumps((zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1), large, counts[large]))


def _unsqueezed(value: bytes) -> np.ndarray:
    small, at, large = pickle.loads(value)
    out = np.frombuffer(zlib.decompress(small), np.uint8).astype(np.int64)
    out[at] = large
    return out


class Ngrams:
    """Counts of the words and runs of two and three of them in the fitted units, and of those at their beginnings and ends; and the units' lengths."""

    _TAGS = {"one": 1, "two": 2, "three": 3, "first": 4, "first two": 5, "last": 6, "last two": 7}

    def __init__(self) -> None:
        self.table: np.ndarray | None = None  # two rows of GRAMS counts
        self.usual = [0, 0]  # what a place of each row holds of other keys: its median
        self.lengths = [np.zeros(1), np.zeros(1)]
        self.words = self.all = 0
        self.least: dict[tuple[bool, int], int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None if self.table is None else [_squeezed(row) for row in self.table]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.table = None if self.table is None else np.stack([_unsqueezed(row).astype(np.uint32) for row in self.table])

    @classmethod
    def keys(cls, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes of the units, and the keys of all that is counted in them."""
        h, at = token_hashes([u.lower() for u in units])
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        some, pair = size > 0, size > 1
        same = [owner[: -k or None] == owner[k:] for k in (0, 1, 2)]
        first, last = at[:-1][some], at[1:][some] - 1
        found = [cls._key("one", h), cls._key("two", h[:-1], h[1:])[same[1]], cls._key("three", h[:-2], h[1:-1], h[2:])[same[2]], cls._key("first", h[first]), cls._key("last", h[last])]
        begin, end = at[:-1][pair], at[1:][pair] - 1
        found += [cls._key("first two", h[begin], h[begin + 1]), cls._key("last two", h[end - 1], h[end])]
        return h, np.concatenate(found)

    @classmethod
    def _key(cls, tag: str, *tokens: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = np.full(len(tokens[0]), cls._TAGS[tag], np.uint64)
            for t in tokens:
                key = mix(key * np.uint64(0x100000001B3) + t)
        return key

    @staticmethod
    def places(key: np.ndarray) -> list[np.ndarray]:
        """Place of each key in either row."""
        return [(key & np.uint64(GRAMS - 1)).view(np.int64), (key >> np.uint64(32) & np.uint64(GRAMS - 1)).view(np.int64)]

    def _n(self, tag: str, *tokens: np.ndarray) -> np.ndarray:
        key = self._key(tag, *tokens)
        if self.table is None:
            return np.zeros(len(key))
        counts = [np.maximum(row[at].astype(float) - usual, 0) for row, at, usual in zip(self.table, self.places(key), self.usual, strict=True)]
        return np.minimum(*counts)

    def odds(self, h: np.ndarray) -> np.ndarray:
        """Log odds of a boundary in each gap between the words of a stretch without signs."""
        units = sum(float(x.sum()) for x in self.lengths)
        if len(h) < 2 or not self.all:
            return np.full(max(0, len(h) - 1), -math.log(WORDS - 1))
        usual = (self._n("one", h) + 0.5) / (self.all + 0.5 * self.words + 1)
        one, first, last = self._n("one", h), self._n("first", h), self._n("last", h)
        two, first_two, last_two = self._n("two", h[:-1], h[1:]), self._n("first two", h[:-1], h[1:]), self._n("last two", h[:-1], h[1:])
        three = self._n("three", h[:-2], h[1:-1], h[2:])
        ends = (last + BACK * units / self.all) / (one + BACK)  # a boundary behind a word
        ends[1:] = (last_two + BACK * ends[1:]) / (two + last_two + BACK)
        begins = (first + BACK * usual) / (units + BACK)  # a word behind a boundary
        goes = (two + BACK * usual[1:]) / (one[:-1] + BACK)  # a word behind a word
        on = goes.copy()
        on[1:] = (three + BACK * goes[1:]) / (two[:-1] + BACK)  # behind two words
        begins_two = (first_two + BACK * goes) / (first[:-1] + BACK)  # a second word behind a boundary and a word
        gap = np.log(ends[:-1]) - np.log1p(-np.minimum(ends[:-1], 1 - 1e-9)) + np.log(begins[1:]) - np.log(on)
        gap[:-1] += np.log(begins_two[1:]) - np.log(on[1:])
        return gap

    def stopless(self, words: int, unspaced: bool, stops: int) -> float:
        """Chance that a stretch of so many words comes from a writer who uses no stops, where so many stand in its block."""
        lengths, mean = self.lengths[unspaced], SIGNS if unspaced else WORDS
        total = float(lengths.sum())
        if total > 50:
            mean = max(4.0, float((lengths * np.arange(len(lengths))).sum()) / total)
            longest = len(lengths) - 1
            beyond = (float(lengths[words:].sum()) + 0.5 * math.exp(-max(0, words - longest) / mean)) / (total + 0.5)
        else:
            beyond = math.exp(-words / mean)
        prior = UNSTOPPED * STRAY ** min(stops, 100)
        return prior / (prior + (1 - prior) * beyond)

    def needed(self, unspaced: bool, stops: int) -> int:
        """Least words of a stretch that is more likely than not written without stops."""
        key = unspaced, min(stops, 100)
        if key not in self.least:
            low, high = 1, 1
            while self.stopless(high, *key) <= 0.5:
                low, high = high, 2 * high
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if self.stopless(middle, *key) > 0.5 else (middle + 1, high)
            self.least[key] = low
        return self.least[key]


def _words(piece: str, unspaced: bool) -> int:
    return len(_CJK.findall(piece)) if unspaced else len(piece.split())


@lru_cache(100_000)
def _place(token: str, *pair: str) -> int:
    return zlib.crc32("\t".join((token, *pair)).encode("utf-8", "surrogatepass")) % EVENTS


class Side:
    """Expected boundaries and other events around the tokens, and the pairs of tokens, on one side of the gaps."""

    def __init__(self, yes: np.ndarray, no: np.ndarray, base: float) -> None:
        self.yes, self.no, self.base = yes, no, base
        self.known: dict[tuple[str, ...], float] = {}

    def __getstate__(self) -> tuple:
        return _sparse(self.yes), _sparse(self.no), self.base

    def __setstate__(self, state: tuple) -> None:
        self.__init__(_dense(*state[0]), _dense(*state[1]), state[2])

    def weight(self, token: str, pair: tuple[str, str]) -> float:
        """Log odds of a boundary at a pair of tokens, at the single one where the pair is rare, over those of all gaps."""
        found = self.known.get((token, *pair))
        if found is None:
            at, both = _place(token), _place(*pair)
            share = (float(self.yes[at]) + PRIOR * self.base) / (float(self.yes[at]) + float(self.no[at]) + PRIOR)
            seen = float(self.yes[both]) + float(self.no[both])
            if seen >= 2 - 1e-3:  # pairs of tokens back off to the single one
                share = (float(self.yes[both]) + PRIOR * share) / (seen + PRIOR)
            share = min(max(share, 1e-9), 1 - 1e-9)
            found = 0.5 * (math.log(share / (1 - share)) - math.log(self.base / (1 - self.base)))  # both sides tell of the same events: half each
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[(token, *pair)] = found
        return found


    def weights(self, at: np.ndarray, both: np.ndarray) -> np.ndarray:
        """:meth:`weight` of many places of single tokens and of pairs."""
        yes, no = self.yes.astype(float), self.no.astype(float)
        share = (yes[at] + PRIOR * self.base) / (yes[at] + no[at] + PRIOR)
        seen = yes[both] + no[both]
        share = np.clip(np.where(seen >= 2 - 1e-3, (yes[both] + PRIOR * share) / (seen + PRIOR), share), 1e-9, 1 - 1e-9)
        return 0.5 * (np.log(share / (1 - share)) - math.log(self.base / (1 - self.base)))


class BoundaryModel:
    """Events left and right of the gaps, and the n-gram model of words; picklable, of a bounded size."""

    def __init__(self, left: Side | None = None, right: Side | None = None, words: Ngrams | None = None) -> None:
        self.left, self.right, self.words = left, right, words or Ngrams()

    def weight(self, left: str, before: str, word: str, after: str) -> float:
        """Log odds that the fit adds to the priors of a gap."""
        if self.left is None or self.right is None:
            return 0.0
        return self.left.weight(left, (before, left)) + self.right.weight(word, (word, after))

    def units(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each unit, without outer blanks."""
        return self._between(text, self.boundaries(text))

    @staticmethod
    def _between(text: str, boundaries: list[tuple[float, int]]) -> list[tuple[int, int]]:
        out, start = [], 0
        for _, cut in [*boundaries, (1.0, len(text))]:
            piece = text[start:cut]
            inner = piece.strip()
            if inner:
                a = start + piece.index(inner[0]) if piece[0].isspace() else start
                out.append((a, a + len(inner)))
            start = cut
        return out

    def boundaries(self, text: str, chains: Counter | None = None) -> list[tuple[float, int]]:
        """Posterior and place of each gap whose event is a boundary; ``chains`` gets the chains of neighbouring gaps with signs."""
        cuts: list[tuple[float, int]] = []
        block: list[tuple[float, int, int]] = []
        seen: list[tuple] | None = None if chains is None else []
        begun, chain = 0, []
        for kind, score, place, words in self._gaps(text, seen):
            if kind == "sure":
                cuts += self._decided(text, begun, place, block)
                block, begun = [], place
                cuts.append((1.0, place))
            if chains is not None and chain and (kind == "sure" or words >= 2):
                chains[tuple(chain)] += 1
                chain = []
            if kind == "gap":
                block.append((score, place, words))
                if seen is not None:
                    chain.append(seen[-1])
        if chains is not None and chain:
            chains[tuple(chain)] += 1
        return cuts + self._decided(text, begun, len(text), block)

    def _decided(self, text: str, a: int, b: int, signs: list[tuple[float, int, int]]) -> list[tuple[float, int]]:
        """Boundaries of a block: gaps with signs, and those between words in stretches that more likely than not are written without stops."""
        if b - a < SHORTEST:
            return _decide(signs)
        likely = [place for score, place, _ in signs if score > -1.0]
        stops = len(likely) + (text[:b].rstrip()[-1:] in STOPS if b == len(text) else text[a:b].rstrip()[-1:] in STOPS)
        taken, more = {place for _, place, _ in signs}, []
        own = _BLANKLESS.search(text, a, b) is not None
        least = SHORTEST if own else min(2 * self.words.needed(False, stops) - 1, self.words.needed(True, stops))
        for lo, hi in zip([a, *likely], [*likely, b], strict=True):
            if hi - lo >= least:
                more += [x for x in self._plain(text[lo:hi], lo, stops) if not taken.intersection(range(x[1] - 2, x[1] + 3))]
        return _decide(sorted([*signs, *more], key=lambda x: x[1]) if more else signs)

    def _plain(self, piece: str, at: int, stops: int) -> list[tuple[float, int, int]]:
        """Gaps between words of a stretch without a likely sign, which begins at ``at``: score, place and words since the gap before.

        None may be a boundary with a higher chance than that of the stretch being written without stops, so where this is no
        more than a half the gaps need not be scored.
        """
        blankless = _BLANKLESS.search(piece) is not None and 2 * len(_BLANKLESS.findall(piece)) > len(piece)  # Thai and its like: blanks part clauses, not words
        unspaced = not blankless and _CJK.search(piece) is not None and 2 * len(_CJK.findall(piece)) > len(piece)
        chance = 1.0 if blankless else self.words.stopless(_words(piece, unspaced), unspaced, stops)
        if chance <= 0.5:
            return []
        low = piece.lower()
        h, _, start, end = token_hashes([low if len(low) == len(piece) else piece], places=True)
        if len(h) < 2:
            return []
        odds = self.words.odds(h)
        blank = np.array([piece[e:s].isspace() for e, s in zip(end[:-1].tolist(), start[1:].tolist(), strict=True)])
        if blankless:
            odds = np.where(blank, 1.0, -20.0)
        elif unspaced:
            odds = odds + np.where(blank, BLANK, 0.0)
        else:
            odds[[not any(map(str.isspace, piece[e:s])) for e, s in zip(end[:-1].tolist(), start[1:].tolist(), strict=True)]] = -20.0  # words are parted by blanks
        p = chance / (1 + np.exp(-np.clip(odds, -30, 30)))
        score = np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-9))
        out, before = [], 0
        for i in np.flatnonzero(score > LOWEST).tolist():
            place = int(start[i + 1])
            while place > int(end[i]) and piece[place - 1] in _OPENERS:
                place -= 1
            out.append((float(score[i]), at + place, i + 1 - before))
            before = i + 1
        return out

    def _gaps(self, text: str, seen: list | None = None) -> Iterator[tuple[str, float, int, int]]:
        n, closing, until, pos, last_place, last_cut = len(text), "", -1, 0, 0, 0
        all_caps, widths, begun = text.isupper(), None, False
        find = _EVENT.search
        while m := find(text, pos):
            a, b = m.span()
            pos, first = b, m[0]
            if first in QUOTES:
                if a < until:
                    continue
                close = _CLOSE.get(first)
                if close:
                    end = text.find("\n\n", b)
                    at = text.find(close, b, end if end >= 0 else n)
                    if at < 0 and first in "„“":
                        at = text.find('"', b, end if end >= 0 else n)
                    if 0 <= at:
                        until, closing = at, text[at]
                continue
            stop = ""
            if first in STOPS:
                stop = text[a : (b := _STOP_RUN.match(text, a).end())]
                if stop == "." and _MARKER.match(text, line := text.rfind("\n", 0, a) + 1) and _ITEM.match(text[line:a]):
                    continue
                j = b
                quoted = closed = False
                while j < n:
                    c = text[j]
                    if c == " " and j + 1 != until:
                        break
                    if j == until or (c in '”»」』"' and j < until and c == closing):
                        quoted, until, j = True, -1, j + 1
                    elif c in _AFTER:
                        closed, j = True, j + 1
                    elif c in _HIDDEN:
                        j += 1
                    elif c.isspace() and c != "\n" and j + 1 < n and j + 1 == until:
                        j += 1
                    elif c in STOPS and (quoted or closed):
                        j += 1
                    else:
                        break
                if j < until:
                    continue
                pos = j
                k = j + 1 if text[j : j + 1] == " " and text[j + 1 : j + 2].isalnum() else _SKIP.match(text, j).end()
                if k >= n:
                    break
                gap = text[j:k]
                if "\n" in gap:
                    pos = k  # the line break is part of this gap
                    breaks = gap.count("\n")
                    if breaks > 1 or _MARKER.match(text, k) and not self._ordinal(text, k):
                        yield "sure", 9.0, j, 0
                        last_place = last_cut = j
                        continue
                score = self._score(text, a, stop, j, k, quoted, closed, all_caps, seen)
                if score is None:
                    continue
                if "\n" in gap:
                    score += 0.5
                    if seen is not None:
                        seen[-1] = (*seen[-1][:-1], True)
                words = text.count(" ", last_place, a) if not _CJK.match(text, a - 1) else a - last_place
                last_place, last_cut = j, j if score > 0 else last_cut
                yield "gap", score, j, words
                continue
            # A line break after no stop: a and b where the blanks around it begin and end.
            while a and text[a - 1].isspace():
                a -= 1
            pos = b = _BLANKS.match(text, b).end()
            if b >= n or not begun and not (begun := bool(text[:a].strip())):
                continue
            if text.count("\n", a, b) > 1:
                until = -1
                yield "sure", 9.0, a, 0
                last_place = last_cut = a
                continue
            if widths is None:
                widths = max(map(len, text.split("\n")))
            line = a - (text.rfind("\n", 0, a) + 1)
            word = _SOLID.match(text, b)[0]
            room = widths - line - (1 if _CJK.match(word) else 1 + len(word))
            if text[a - 1] in "-‐­" and _shape(text[b]) == "lower":
                continue
            if _MARKER.match(text, b) and (room >= 0 or text[b] in _BULLETS or _MARKER.match(text, a - line)):
                yield "sure", 9.0, a, 0
                last_place = last_cut = a
                continue
            if a < until:
                continue
            # What stands on its own line begins there; a sentence that began before goes on.
            began = _BLANKS.match(text, last_cut).end()
            if began != _BLANKS.match(text, a - line).end() and not _MARKER.match(text, began):
                continue
            if room < 0 or text[max(0, a - 12) : a].rpartition(" ")[2].lower() in LEADING or (_shape(text[b]) == "lower" and not _MARKER.match(text, b)) or text[a - 1] in ",;—–(，、،":
                continue
            yield "sure", 9.0, a, 0
            last_place = a
    @staticmethod
    def _ordinal(text: str, k: int) -> bool:
        """A day's number before a month at the start of a wrapped line is no marker."""
        m = _DAY.match(text, k)
        return bool(m) and m[1].lower() in MONTHS

    def _score(self, text: str, a: int, stop: str, j: int, k: int, quoted: bool, closed: bool, all_caps: bool, seen: list | None) -> float | None:
        """Log odds of a boundary between what ends at j and what begins at k; None where no gap can be."""
        right = text[k]
        dash = right in "—–-"
        if dash:
            k = _SKIP.match(text, k + 1).end()
            right = text[k] if k < len(text) else " "
        shape = _shape(right)
        bare = j == k
        head = text[max(0, a - 24) : a].split()
        raw = head[-1].lstrip(_OPENERS) if head and not text[a - 1].isspace() else ""
        base = stop[0]
        if quoted:
            left, cls = "q" + base, "quoted"
        elif base in "。！？｡":
            left, cls = base, "wide"
        elif base in "।॥":
            left, cls = base, "danda"
        elif base in "…‥" or stop.startswith(".."):
            cls = "widedots" if raw and _CJK.match(raw[-1]) else "dots"
            left = cls
        elif closed:
            left, cls = ")" + base, "closed"
        elif base in "!?؟！？":
            left, cls = base, "ask"
        else:
            prev = head[-2] if len(head) > 1 and raw else ""
            left, cls, core, letters = _dot(raw, prev if prev.endswith(".") else "", all_caps)
            # The blank after a stop may be missing: only between a whole word and a capital.
            if bare and (
                not (shape in ("upper", "open") or (shape == "letter" and not right.isascii()))
                or len(letters) < 2 or core.isdigit() or (core.isupper() and not all_caps) or not core.replace("-", "").replace("’", "").isalpha()
            ):
                return None
        rw = _WORD.match(text, k)
        word = _folded(rw[0]) if rw else right
        if shape == "cjk":
            word = right
        if all_caps and shape == "upper":
            shape = "letter"
        if shape == "lower" and cls in ("word", "short", "ask") and not bare and (text.islower() or (not any(map(str.isupper, text[k : k + 50])) and _odd_case(text))):
            shape = "letter"  # a text, or a part of it, in one case: nothing follows from the small letter
        if bare and cls in ("ask",) and shape in ("lower", "digit", "other"):
            return None
        before = head[-2] if len(head) > 1 and raw else ""
        follows = _FOLLOWS.match(text, rw.end()) if rw else None
        after = follows[1] if follows else ""
        long = shape == "upper" and len(word) > 6
        prior = LEFT_PRIOR[cls] + RIGHT_PRIOR[shape]
        if quoted and shape in ("cjk", "letter") and not dash:
            prior -= 4.0
        floor = cls == "danda" or cls == "wide" and (word != "と" or not quoted)
        more = 0.0
        if (quoted or all_caps) and word in REPORTING:
            more -= 8.0
        if cls == "ordinal" and (word in MONTHS or shape == "upper" and len(raw) <= 2 and word in MONTHS):
            more -= 8.0
        if cls in ("dots", "widedots") and shape == "upper":
            more += 1.5
        if seen is not None:
            seen.append((prior, floor, more, left, before, word, after, long, False))  # the last: whether a line break stands in the gap
        score = prior + self.weight(left, before, word, after)
        return (max(score, 3.0) if floor else score) + more


@lru_cache(4)
def _odd_case(text: str) -> bool:
    return _ODD_CASE.search(text) is not None


@lru_cache(100_000)
def _folded(word: str) -> str:
    return transducer().apply(word).lower()


@lru_cache(100_000)
def _dot(raw: str, prev: str, all_caps: bool) -> tuple[str, str, str, str]:
    """Token and class of a word before a single dot, the word and its part after the last inner dot; prev: the word before it, if that ends in a dot."""
    word = _folded(raw)
    core = word.replace("'", "’").rpartition("’")[2] or word
    letters = core.rpartition(".")[2]
    left = "." + (core if len(core) <= 6 else "word")
    joined = core
    if prev and len(core) <= 2:
        joined = _folded(prev).lstrip(_OPENERS) + core
        left = "." + joined if len(joined) <= 6 else left
    if (joined in MAY_END or core in MAY_END) and not (prev and joined != core and len(raw) == 1 and raw.isupper() and not all_caps):
        cls = "mayend"
    elif core in ABBREVIATIONS or letters in ABBREVIATIONS and "." in core:
        cls = "abbr"
    elif core.isdigit():
        cls = "ordinal" if len(core) <= 2 else "number"
        left = "." + cls
    elif len(letters) == 1:
        up = raw[-1:].isupper() and not all_caps
        cls = "initial" if up and "." not in core else "letter"
        left = "." + cls if up else left
    elif letters and "\u0900" <= letters[0] <= "\u097f":
        cls = "foreign"
    else:
        cls = "word" if len(core) > 3 else "short"
    return left, cls, core, letters


#: Code points of the shortest stretch that may hold a boundary without a sign, and log odds below which such a gap cannot change its neighbours.
SHORTEST, LOWEST = 24, -6.0
_BLANKLESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
#: Log odds between the events of neighbouring gaps: two boundaries with no or one word between them are rare.
NEAR = -1.5


def _decide(block: list[tuple[float, int, int]]) -> list[tuple[float, int]]:
    """Forward-backward over the two events of a block's gaps."""
    if not block:
        return []
    if len(block) == 1:
        s, place, _ = block[0]
        return [(1 / (1 + math.exp(-min(s, 30))), place)] if s > 0 else []
    fwd, odds = [], 0.0
    for i, (s, _, words) in enumerate(block):
        pull = 0.0
        if i and words < 2:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            pull = math.log1p(p * math.expm1(NEAR))
        odds = s + pull
        fwd.append(odds)
    back, out = 0.0, []
    for i in range(len(block) - 1, -1, -1):
        s, place, words = block[i]
        total = fwd[i] + back
        if total > 0:
            out.append((1 / (1 + math.exp(-min(total, 30))), place))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s + back))))
        back = math.log1p(p * math.expm1(NEAR)) if words < 2 else 0.0
    return out[::-1]


#: A gap of a chain: whether the chain begins with it, its number, its score apart from the tokens' weights (to which a floor may apply and more is added),
#: the places of the single tokens and of the pairs on either side, and of the right ones as they are counted.
GAP = np.dtype([("first", "?"), ("n", "<i8"), ("prior", "<f4"), ("floor", "?"), ("more", "<f4"), *((c, "<i4") for c in ("left", "left two", "right", "right two", "counted", "counted two"))])


def _gaps_of(chains: Counter) -> np.ndarray:
    """The chains as an array of gaps; a long word with a capital counts as its shape."""
    rows = []
    for chain, n in chains.items():
        for i, (prior, floor, more, left, before, word, after, long, line) in enumerate(chain):
            right, two = _place(word), _place(word, after)
            rows.append((i == 0, n, prior, floor, more + 0.5 * line, _place(left), _place(before, left), right, two, _place("upper") if long else right, _place("upper", after) if long else two))
    return np.array(rows, GAP)


def _expected(gaps: np.ndarray, model: BoundaryModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """Expected boundaries and all events, in millionths, at each place of either side; the last place has those of all single tokens."""
    score = gaps["prior"].astype(float)
    if model.left is not None and model.right is not None:
        score += model.left.weights(gaps["left"], gaps["left two"]) + model.right.weights(gaps["right"], gaps["right two"])
    score = np.where(gaps["floor"], np.maximum(score, 3.0), score) + gaps["more"]
    p = np.where(score > 0, 1 / (1 + np.exp(-np.clip(score, 0, 30))), 0.0)
    first = np.flatnonzero(gaps["first"])
    size = np.diff(np.append(first, len(gaps)))
    for a, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        p[a : a + k] = 0.0
        for q, i in _decide([(x, i, 0 if i else 2) for i, x in enumerate(score[a : a + k].tolist())]):
            p[a + i] = q
    yes, every = gaps["n"] * np.rint(p * MILLION), gaps["n"] * float(MILLION)
    out = []
    for single, pair in (("left", "left two"), ("counted", "counted two")):
        sums = [np.bincount(gaps[single], x, EVENTS + 1) + np.bincount(gaps[pair], x, EVENTS + 1) for x in (yes, every)]
        sums[0][EVENTS], sums[1][EVENTS] = yes.sum(), every.sum()
        out.append((sums[0], sums[1]))
    return out


def _sides(sums: list[tuple[np.ndarray, np.ndarray]]) -> BoundaryModel:
    """The model of expected boundaries and all events in millionths."""
    found = []
    for yes, every in sums:
        yes, every = yes / MILLION, every / MILLION
        found.append(Side(yes[:EVENTS].astype(np.float32), (every - yes)[:EVENTS].astype(np.float32), float((yes[EVENTS] + 1) / (every[EVENTS] + 2))))
    return BoundaryModel(*found)


class Collected:
    """What a fit needs of texts: chains of gaps, words with their number, n-grams and lengths of the units that the priors give."""

    def __init__(self) -> None:
        self.model, self.chains, self.table = BoundaryModel(), Counter(), np.zeros((2, GRAMS), np.uint32)
        self.lengths, self.keys, self.held = (Counter(), Counter()), [], 0

    def add(self, texts: list[str]) -> tuple[np.ndarray, int]:
        """Takes in some texts; the hashes of their different words, and the number of all words."""
        units = [text[a:b] for text in texts for a, b in self.model._between(text, self.model.boundaries(text, self.chains))]
        if not units:
            return np.zeros(0, np.uint64), 0
        for u in units:
            signs = 0 if u.isascii() or not _CJK.search(u) else len(_CJK.findall(u))
            if 2 * signs > len(u):
                self.lengths[1][signs] += 1
            else:
                self.lengths[0][_words(u, False)] += 1
        h, keys = Ngrams.keys(units)
        self.keys.append(keys)
        self.held += len(keys)
        if self.held > GRAMS:
            self.flush()
        return np.unique(h), len(h)

    def flush(self) -> None:
        """Counts the keys held, many at once."""
        for row, at in zip(self.table, Ngrams.places(np.concatenate([np.zeros(0, np.uint64), *self.keys])), strict=True):
            row += np.bincount(at, minlength=GRAMS).astype(np.uint32)
        self.keys, self.held = [], 0


def _ngrams(table: np.ndarray, words: int, all_words: int, lengths: list[dict[int, int]]) -> Ngrams:
    out = Ngrams()
    out.table, out.words, out.all = table, words, all_words
    out.usual = [int(np.median(row)) for row in table]
    for kind, found in enumerate(lengths):
        out.lengths[kind] = np.zeros(max(found, default=0) + 1)
        for size, n in found.items():
            out.lengths[kind][size] = n
    return out


def fit_boundaries(texts: list[str]) -> BoundaryModel:
    """Estimates the weights: expected counts of events around each token and each pair of tokens, ends of blocks being observed boundaries; and the n-gram model of words."""
    got = Collected()
    words, total = np.zeros(0, np.uint64), 0
    for k in range(0, len(texts), 100):
        h, n = got.add(texts[k : k + 100])
        words, total = np.union1d(words, h), total + n
    got.flush()
    gaps, model = _gaps_of(got.chains), BoundaryModel()
    for _ in range(ROUNDS):
        model = _sides(_expected(gaps, model))
    return BoundaryModel(model.left, model.right, _ngrams(got.table, len(words), total, list(got.lengths)))


#: Kinds of what is collected over all texts: chains, words, the rows of n-grams, lengths of units (spaced, unspaced).
CHAIN, WORD, GRAM, LENGTH = 0, 1, 2, 4
#: Places of a part of a table, which is summed at once; chains and words that a task holds at most before it hands them on.
PART, HELD = 1 << 16, 100_000


def _collected(rows: DataFrame) -> DataFrame:
    """``kind, part, value``: what a fit needs of all rows of the one column of texts, squeezed."""
    def row(kind: int, part: int, value: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([value], pa.binary())], ["kind", "part", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, words, more, total = Collected(), np.zeros(0, np.uint64), [], 0
        for b in pieces(batches, 0):
            h, n = got.add(b.column(0).to_pylist())
            more.append(h)
            total += n
            if sum(map(len, more)) > 10 * HELD:
                words, more = np.unique(np.concatenate([words, *more])), []
            if len(got.chains) > HELD:
                yield row(CHAIN, 0, zlib.compress(_gaps_of(got.chains).tobytes(), 1))
                got.chains = Counter()
            if len(words) > 10 * HELD:
                yield from (row(WORD, k, words[words % np.uint64(64) == k].tobytes()) for k in range(64))
                words = words[:0]
        if got.chains:
            yield row(CHAIN, 0, zlib.compress(_gaps_of(got.chains).tobytes(), 1))
        if total:
            got.flush()
            words = np.unique(np.concatenate([words, *more]))
            yield from (row(WORD, k, words[words % np.uint64(64) == k].tobytes()) for k in range(64))
            yield row(WORD, -1, pickle.dumps(total))
            for kind in (0, 1):
                yield row(LENGTH + kind, 0, pickle.dumps(got.lengths[kind]))
                yield from (row(GRAM + kind, k // PART, _squeezed(got.table[kind][k : k + PART])) for k in range(0, GRAMS, PART))

    return rows.mapInArrow(run, "kind int, part int, value binary")


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each part of a table, of the words (their number) and of the lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], object] = {}
        for b in batches:
            for kind, part, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                old = sums.get((kind, part))
                if kind == WORD and part >= 0:
                    new = np.frombuffer(value, np.uint64)
                    sums[kind, part] = new if old is None else np.union1d(old, new)
                elif kind in (GRAM, GRAM + 1):
                    new = _unsqueezed(value)
                    sums[kind, part] = new if old is None else old + new
                else:  # numbers and counters
                    new = pickle.loads(value)
                    sums[kind, part] = new if old is None else old + new
        for (kind, part), x in sums.items():
            value = _squeezed(x) if kind in (GRAM, GRAM + 1) else pickle.dumps(len(x) if kind == WORD and part >= 0 else x)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([value], pa.binary())], ["kind", "part", "value"])

    return rows.repartition("kind", "part").mapInArrow(run, "kind int, part int, value binary")


def _packed(rows: DataFrame, pack: Callable[[Iterator[pa.RecordBatch]], bytes]) -> bytes:
    """The one value that ``pack`` makes of all rows, in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pack(batches)], pa.binary())], ["value"])

    return rows.repartition(1).mapInArrow(run, "value binary").first().value


def _round(chains: DataFrame, model: BoundaryModel) -> BoundaryModel:
    """One round of the estimation over the distinct chains."""
    sent = chains.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            for value in b.column(0).to_pylist():
                new = _expected(np.frombuffer(zlib.decompress(value), GAP), sent.value)
                sums = new if sums is None else [(x + u, y + v) for (x, y), (u, v) in zip(sums, new, strict=True)]
        for side, (yes, every) in enumerate(sums or []):
            at = np.flatnonzero(every)
            for k in range(0, len(at), PART):
                part = at[k : k + PART]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), side, np.int32)), pa.array(part), pa.array(yes[part].astype(np.int64)), pa.array(every[part].astype(np.int64))], ["side", "place", "yes", "every"])

    total = chains.mapInArrow(run, "side int, place long, yes long, every long").groupBy("side", "place").agg(F.sum("yes").alias("yes"), F.sum("every").alias("every"))

    def pack(batches: Iterator[pa.RecordBatch]) -> bytes:
        sums = [(np.zeros(EVENTS + 1), np.zeros(EVENTS + 1)) for _ in range(2)]
        for b in batches:
            side, place, yes, every = (np.asarray(c) for c in b.columns)
            for k in (0, 1):
                mine = side == k
                sums[k][0][place[mine]], sums[k][1][place[mine]] = yes[mine], every[mine]
        return pickle.dumps(_sides(sums))

    out = pickle.loads(_packed(total, pack))
    sent.unpersist()
    return out


def fit_on(df: DataFrame, text: str = "text") -> BoundaryModel:
    """Fits on all texts of a column, whatever their number and length; the driver gets the model's tables only."""
    found = cut(_collected(df.select(F.col(text).alias("t")).where("t is not null")))
    chains = found.where(F.col("kind") == CHAIN).select("value")
    model = BoundaryModel()
    for _ in range(ROUNDS):
        model = _round(chains, model)

    def pack(batches: Iterator[pa.RecordBatch]) -> bytes:
        table, lengths, words = np.zeros((2, GRAMS), np.uint32), [Counter(), Counter()], [0, 0]
        for b in batches:
            for kind, part, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind in (GRAM, GRAM + 1):
                    table[kind - GRAM, part * PART : (part + 1) * PART] = np.minimum(_unsqueezed(value), (1 << 32) - 1)
                elif kind == WORD:
                    words[part < 0] += pickle.loads(value)
                else:
                    lengths[kind - LENGTH] += pickle.loads(value)
        return pickle.dumps(_ngrams(table, *words, lengths))

    rest = _merged(found.where(F.col("kind") != CHAIN))
    return BoundaryModel(model.left, model.right, pickle.loads(_packed(rest, pack)))


def sentence_units(df: DataFrame, id_col: str, text: str = "text", model: BoundaryModel | None = None) -> DataFrame:
    """``id, sent_start, sent_end`` of every unit of every text."""
    sent = df.sparkSession.sparkContext.broadcast(model or fit_on(df, text))  # tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in pieces(batches, 1):
            ids, starts, ends = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                units = model.units(t)
                ids += [i] * len(units)
                starts += [u[0] for u in units]
                ends += [u[1] for u in units]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "sent_start", "sent_end"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sent_start long, sent_end long")
