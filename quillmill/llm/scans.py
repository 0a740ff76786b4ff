"""Noise in text from scanned pages: broken words, misread glyphs, running headers, page numbers.

Every word of the corpus gets its count and a skip-gram vector: the sum of random signatures of
the words around it, frequent ones weighed down (a random projection of the skip-gram matrix,
which is additive, so partitions learn alone and add up). A rare word is linked to frequent ones
when a plausible glyph edit leads from one to the other and their vectors agree. Texts are read once: a filter of
fixed size tells which of their words may be linked, and those few meet their links by a join. At each place
the words around it choose among the linked words. Chinese glyphs are linked the same way inside their
two neighbours. Whether a word was broken at a line end is decided by how often it stands whole, and how often as
a compound inside lines. Furniture is found by comparing first and last lines over the pages of a paper; the
rest is reflowed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, filterfalse, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmill.llm.glyphs import canonical
from quillmill.session import cut

# What a print shows and what it is misread as, as pairs.
GLYPH_EDITS = (
    "e>c c>e t>f f>t o>0 l>1 i>1 i>! l>! a>o o>a s>5 h>b b>h g>9 q>9 b>8 b>6 z>2 i>l l>i n>ri ri>n d>cl cl>d u>ii m>rn rn>m in>m m>in w>vv li>h h>li "
    "nn>rm u>n n>u o>c y>v v>y tt>ft fi>h"
)
# Chinese characters that differ by a stroke, as pairs; either may stand for the other.
HAN_PAIRS = (
    "量暈 未末 果杲 统绕 析折 日曰 受爱 设没 入人 己已 已巳 土士 干千 大太 大犬 天夭 王玉 主王 刀力 几九 木本 术木 本木 目自 白自 田由 由甲 甲申 午牛 今令 "
    "我找 住往 侯候 准淮 治冶 拆折 析拆 续绩 经径 组祖 间问 问闪 同冋 体休 休体 处外 变峦 查杳 着看 看着 时吋 明朋 期朝 验脸 检捡 侧测 例列 例倒 位泣 "
    "失矢 士土 上土 下不 不丕 小少 工土 比此 此比 反友 及乃 记纪 计汁 究穷 间闻 均约 线钱 低抵 高髙 究宄 值植 数教 晴睛 睡唾 眠眼 照熙 义叉 又叉 两丙 "
    "方万 万方 乎平 平乎 于干 千于 亚业 开井 升开 川州 巾中 币市 市巾 风凤 厂广 历厉 车东 乐东 束東 来耒 米来 末米 采釆 免兔 鸟乌 拨拔 遣遗 崇祟"
).split()
#: Components of a word vector.
DIMS = 32
#: A word of letters only is misread if its neighbour is so many times as frequent; with a digit or sign inside; a Chinese glyph.
RATIO, RATIO_MIXED, RATIO_HAN = 5.0, 1.0, 3.0
#: Cosine from which the vectors of a linked pair agree.
AGREE = 0.25
#: A word of letters, or one with a digit or sign inside, is one of its own if less than this share of it, with so many traced occurrences granted,
#: comes from pages with traces of print.
TRACES, TRACES_MIXED, GRANTED = 0.55, 0.45, 4

#: Words a worker holds before it hands its sums on; words summed at once, whose arrays stay in the processor's cache.
HELD_WORDS, PART_WORDS = 300_000, 10_000
#: Bits of the filter of linked words: BITS each, MOST_BITS (64 MB) at most; more links only let more words through to the join.
BITS, MOST_BITS = 24, 1 << 29
#: Words a reader remembers its answers for.
REMEMBERED = 300_000
#: A word as frequent as this share is weighed down in a context.
FREQUENT = 1e-3

_ODD_CLASS = "̀-ͯͰ-ΰγ-֏​-‏⁠﻿ﬀ-ﬆ０-ｚ⼀-⿟  -  "
_UNUSUAL, _WIDE = re.compile(f"[{_ODD_CLASS}]"), re.compile(f"[{_ODD_CLASS}一-鿿]")
_TOKEN = re.compile(r"!?[^\W_一-鿿]+(?:![^\W_一-鿿]+)*")
# the second leaps from one line end to the next; a blank before one asks for the first. _LEFT reads backwards
_SIGN, _LINE_END = re.compile(r"[-¬\xad‐‑][ \t]*\r?\n\s*(?=[^\W\d_])"), re.compile(r"\n(?<=[-¬\xad‐‑ \t\r]\n)\s*(?=[^\W\d_])")
_LEFT, _RIGHT = re.compile(r"\n?[ \t]*([^\W\d_]+)"), re.compile(r"[^\W\d_]+")
_TRACE = re.compile(r"[015!9](?<=[^\W\d_].)[^\W\d_]")
_NUMBERISH = re.compile(r"^(?=.*\d)[\dlios]*[lios][\dlios]*$")
_LATIN_IN_HAN = re.compile(r"(?<=[A-Za-z])\r?\n(?=[a-z])")
_MOSTLY_HAN = re.compile(r"[一-鿿][^\n]{0,40}[一-鿿][^\n]{0,40}[一-鿿]")
_HAN_GAP = re.compile(r"(?<=[一-鿿，。、；：（）])\r?\n(?=[一-鿿，。、；：（）])")
# the same for texts without \r
_LATIN_END, _HAN_END = re.compile(r"\n(?<=[A-Za-z]\n)(?=[a-z])"), re.compile(r"\n(?<=[一-鿿，。、；：（）]\n)(?=[一-鿿，。、；：（）])")

_FROM_MISREAD: dict[str, list[str]] = {}
for _p in GLYPH_EDITS.split():
    _true, _mis = _p.split(">")
    _FROM_MISREAD.setdefault(_mis, []).append(_true)
_TWINS: dict[str, set[str]] = {}
for _p in HAN_PAIRS:
    _TWINS.setdefault(_p[0], set()).add(_p[1])
    _TWINS.setdefault(_p[1], set()).add(_p[0])
_TWIN, _NOT_HAN = re.compile(f"[{''.join(_TWINS)}]"), re.compile("[^一-鿿][^一-鿿]*")
_MIS = sorted(_FROM_MISREAD, key=len, reverse=True)


def line_breaks(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """(start of the left part, its end, start of the right part, left, sign, right) of words broken at line ends."""
    out = []
    places = [(m.start() - 1, m.end()) for m in _LINE_END.finditer(text)]
    if any(text[sign] in " \t\r" for sign, _ in places):
        places = [m.span() for m in _SIGN.finditer(text)]
    for sign, right in places:
        left = _LEFT.match(text[max(0, sign - 60) : sign][::-1])
        if left:
            start, end = sign - left.end(1), sign - left.start(1)
            out.append((start, end, right, text[start:end], text[sign], _RIGHT.match(text, right).group()))
    return out


def plain(text: str) -> str:
    """The text without unusual characters; line ends stay, but for those inside Latin words of Chinese lines."""
    if text.isascii() or not _WIDE.search(text):
        return text
    text = canonical(text) if _UNUSUAL.search(text) else text
    return (_LATIN_IN_HAN if "\r" in text else _LATIN_END).sub("", text) if _MOSTLY_HAN.search(text) else text


def glyph_sources(word: str) -> set[str]:
    """What the word can be a misreading of, one edit away. Chinese: its middle glyph between the neighbours."""
    if word[0] == "\1":
        return set()
    if word[0] == "\0":
        return {f"\0{word[1]}{y}{word[3]}" for y in _TWINS.get(word[2], ())}
    found = set()
    for mis in _MIS:
        at = word.find(mis)
        while at >= 0:
            for true in _FROM_MISREAD[mis]:
                found.add(word[:at] + true + word[at + len(mis) :])
            at = word.find(mis, at + 1)
    found.discard(word)
    return found


def _ranges(signs: list[int]) -> str:
    """Code points in order as ranges of a pattern's class."""
    starts = [a for a, before in zip(signs, [-1, *signs]) if a != before + 1]
    ends = [a for a, after in zip(signs, [*signs[1:], -1]) if after != a + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


# bytes of Latin-1 in lower case; what a word may not hold becomes a space; with \1 for signs of words outside it, and with exclamation marks
_LATIN = bytes(ord(chr(b).lower()) if _TOKEN.fullmatch(chr(b)) else 32 for b in range(256))
_MARKED = bytes(b if b in b"\1!" else x for b, x in enumerate(_LATIN))
# runs of signs outside Latin-1 (a class in front lets the search leap to the next), and those of them that stand in words but for Chinese ones; beyond the first plane _TOKEN tells
_WIDE_SIGNS = re.compile("([^\0-\xff一-鿿，。、；：（）“”][^\0-\xff一-鿿，。、；：（）“”]*)")
_OUTSIDE = re.compile(f"[{_ranges([i for i in range(256, 1 << 16) if _TOKEN.fullmatch(chr(i))])}\U00010000-\U0010ffff]")
_LONE = re.compile("!(?=[ !]|$)")
_JOINT = re.compile(r"-(?<=[^\W\d_]-)(?=[^\W\d_])")


def _left_word(text: str, end: int) -> str:
    """Letters that end at a place."""
    at = end
    while at and text[at - 1].isalpha():
        at -= 1
    return text[at:end]


@lru_cache(maxsize=10_000)
def _in_words(signs: str) -> str | None:
    """Signs outside Latin-1 with spaces for those that no word holds; None where only the whole text tells their lower case."""
    if not _OUTSIDE.search(signs):
        return " "
    return "".join(x if _OUTSIDE.match(x) else " " for x in signs) if max(signs) <= "\uffff" and signs == signs.lower() else None


def words_of(text: str) -> list[str]:
    """Words of a text, in lower case: letters and digits, with exclamation marks that a misreading may have put in."""
    wide, text = (), text.replace("\1", " ")
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        # signs outside Latin-1 are taken out, and put back once the rest is in lower case
        parts = _WIDE_SIGNS.split(text)
        wide = list(map(_in_words, parts[1::2]))
        if None in wide:
            return _TOKEN.findall(text.lower())
        raw = "\1".join(parts[::2]).encode("latin-1", "replace")
    flat = raw.translate(_LATIN if not wide and "!" not in text else _MARKED).decode("latin-1")
    if wide:
        parts[::2], parts[1::2] = flat.split("\1"), wide
        flat = "".join(parts)
    if "!" in flat:
        flat = _LONE.sub(" ", flat)
    return flat.split()


def compounds(text: str) -> list[str]:
    """Marked pairs of words that a hyphen joins inside a line."""
    return [f"\1{_left_word(text, m.start())}-{_RIGHT.match(text, m.end()).group()}".lower() for m in _JOINT.finditer(text)] if "-" in text else []


def han_windows(text: str) -> list[str]:
    """A marked triple for each glyph that has a twin; what is not Chinese counts as ^."""
    t = "^" + _NOT_HAN.sub("^", (_HAN_GAP if "\r" in text else _HAN_END).sub("", text)) + "^"
    return ["\0" + t[i - 1 : i + 2] for i in [m.start() for m in _TWIN.finditer(t)]]


def forms(text: str) -> tuple[str, list[str]]:
    """(the plain text, its windows of Chinese glyphs)"""
    if text.isascii() or not _WIDE.search(text):
        return text, []
    text = plain(text)
    return text, han_windows(text) if _TWIN.search(text) else []


@lru_cache(maxsize=100_000)
def _signature(word: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(xxhash.xxh32_digest(word.encode()), np.uint8))
    return bits.astype(np.float32) * 2 - 1


def learn_words(pages: DataFrame, text: str = "text") -> DataFrame:
    """word, n, traced (occurrences on pages with traces of print) and vector (ARRAY<DOUBLE>) over all distinct texts.

    Words broken at a line end are left out. Null and empty texts add nothing, and a text that is delivered again is no new evidence.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        han: Counter = Counter()
        han_traced: Counter = Counter()

        def fresh() -> None:
            nonlocal ids, n, traced, vectors, signs, known, total
            ids = defaultdict(count(1).__next__, {"": 0})
            n, traced = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
            vectors, signs, known = np.zeros((1 << 12, DIMS), np.float32), np.zeros((1 << 12, DIMS), np.float32), 0
            total = 0

        def held() -> Iterator[pd.DataFrame]:
            words = [(x, i) for x, i in ids.items() if i and not x.isdigit()]
            for a in range(0, len(words), 20_000):
                z = [i for _, i in words[a : a + 20_000]]
                yield pd.DataFrame({"word": [x for x, _ in words[a : a + 20_000]], "n": n[z], "traced": traced[z], "v": list(vectors[z])})
            if han:
                keys = list(han)
                yield pd.DataFrame({"word": keys, "n": [han[x] for x in keys], "traced": [han_traced[x] for x in keys], "v": [np.zeros(DIMS, np.float32)] * len(keys)})
                han.clear(), han_traced.clear()

        ids = n = traced = vectors = signs = None
        known = total = 0
        fresh()

        def add(tokens: list[str], marks: list[int], sizes: list[int]) -> None:
            """Only the words of this part are touched, so its cost does not grow with the words held."""
            nonlocal n, traced, vectors, signs, known, total
            w = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
            while len(ids) > len(n):
                n, traced = np.concatenate((n, n * 0)), np.concatenate((traced, traced * 0))
                vectors, signs = np.concatenate((vectors, vectors * 0)), np.concatenate((signs, signs * 0))
            for word, i in islice(reversed(ids.items()), len(ids) - known):
                if i:
                    signs[i] = _signature(word)
            known = len(ids)
            keys = np.sort(w << 32 | np.arange(len(w)))
            order, sorted_w = keys & 0xFFFFFFFF, keys >> 32
            first = np.flatnonzero(np.r_[True, sorted_w[1:] != sorted_w[:-1]])
            here = sorted_w[first]
            n[here] += np.diff(np.r_[first, len(w)])
            traced[here] += np.add.reduceat(np.repeat(np.array(marks, np.int64), sizes)[order], first)
            total += len(w)
            weight = np.minimum(1.0, np.sqrt(FREQUENT * total / n[here])).astype(np.float32)
            weight[here == 0] = 0
            place = np.empty(len(w), np.int64)
            place[order] = np.repeat(np.arange(len(here)), np.diff(np.r_[first, len(w)]))
            s = (signs[here] * weight[:, None])[place]
            around = np.zeros_like(s)
            around[1:] = s[:-1]
            around[:-1] += s[1:]
            around[2:] += s[:-2]
            around[:-2] += s[2:]
            vectors[here] += np.add.reduceat(around[order], first, axis=0)

        tokens: list[str] = []
        marks: list[int] = []
        sizes: list[int] = []
        for b in batches:
            for t in b["text"]:
                broken = line_breaks(t)
                trace = int(bool(broken) or _TRACE.search(t) is not None)
                if broken:
                    at, kept = 0, []
                    for a, _, b_, _, _, right in broken:
                        kept.append(t[at:a])
                        at = b_ + len(right)
                    t = "\n".join((*kept, t[at:]))
                t, windows = forms(t)
                here = words_of(t)
                windows = windows + compounds(t)
                han.update(windows)
                if trace:
                    han_traced.update(windows)
                tokens += here
                tokens += "", ""
                marks.append(trace)
                sizes.append(len(here) + 2)
                if len(tokens) > PART_WORDS:
                    add(tokens, marks, sizes)
                    tokens, marks, sizes = [], [], []
                    if len(ids) > HELD_WORDS:  # sums add up, so a full table is handed on
                        yield from held()
                        fresh()
        if tokens:
            add(tokens, marks, sizes)
        yield from held()

    rows = pages.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().mapInPandas(partial, "word string, n long, traced long, v array<float>")
    added = rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("traced").alias("traced"), *[F.sum(F.col("v")[i]).alias(f"_{i}") for i in range(DIMS)])
    return added.select("word", "n", "traced", F.array(*[f"_{i}" for i in range(DIMS)]).alias("vector"))


def link_misreadings(words: DataFrame) -> DataFrame:
    """wrong, choices, n_wrong: each rare word with the frequent words it may be a misreading of, the most frequent first.

    choices is ARRAY<STRUCT<order, right, vector>>. Joined on the word itself, so the vocabulary may be of any size.
    A pair of letters only is refused where neither the pages nor the vectors speak for a misreading, so a word does not lose its link
    because it is met more often.
    """

    def sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(w, s) for w in b["word"] for s in glyph_sources(w)]
            yield pd.DataFrame(out, columns=["wrong", "right"]).astype(object)

    edits = words.select("word").mapInPandas(sources, "wrong string, right string")
    w = words.select(F.col("word").alias("wrong"), F.col("n").alias("n_wrong"), "traced", F.col("vector").alias("a"))
    r = words.select(F.col("word").alias("right"), F.col("n").alias("n_right"), F.col("vector").alias("b"))
    pair = edits.join(r, "right").join(w, "wrong")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = F.col("a"), F.col("b")
    cosine = dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-9))
    han = F.col("wrong").startswith("\0")
    mixed = F.col("wrong").rlike("[0-9!]")
    ratio = F.when(han, RATIO_HAN).when(mixed, RATIO_MIXED).otherwise(RATIO)
    likely = F.col("n_right") >= ratio * F.col("n_wrong")
    traced = lambda n, share: F.col("traced") + GRANTED >= share * (F.col(n) + GRANTED)
    agrees = han | traced("n_wrong", F.when(mixed, TRACES_MIXED).otherwise(TRACES)) | (~mixed & (cosine >= AGREE))
    enough = F.col("n_right") >= 3
    sized = han | (F.length("wrong") > 1) & (F.length("right") > 1)
    fit = pair.filter(likely & agrees & enough & sized)
    best = fit.groupBy("wrong").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_right")).alias("order"), "right", F.when(~han, F.col("b")).alias("vector")))).alias("choices"), F.max("n_wrong").alias("n_wrong"))
    # figures with a letter inside: what they stand for is a number, which is always frequent
    figures = words.filter(F.col("word").rlike(_NUMBERISH.pattern) & traced("n", TRACES_MIXED))
    number = F.struct((-F.col("n")).alias("order"), F.translate("word", "lios", "1105").alias("right"), F.lit(None).cast("array<double>").alias("vector"))
    figures = figures.select(F.col("word").alias("wrong"), F.array(number).alias("choices"), F.col("n").alias("n_wrong"))
    return best.join(figures, "wrong", "left_anti").unionByName(figures)


def _places(word: str, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(5)]


def word_filter(links: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of the linked words, built in parts and put together; bounded by MOST_BITS."""
    bits = 1 << 16
    n = links.count()
    while bits < min(BITS * n, MOST_BITS):
        bits *= 2
    part = 1 << 16

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = np.array([x for w in b["wrong"] for x in _places(w, bits)], np.int64)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(held), part):
            if held[k : k + part].any():
                yield pd.DataFrame({"k": [k], "bits": [held[k : k + part].tobytes()]})

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        every = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]], axis=0)
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "bits": [every.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    marked = links.select("wrong").mapInPandas(mark, "k long, bits binary").groupBy("k").applyInPandas(together, "k long, bits binary")
    for r in marked.toLocalIterator():
        out[r["k"] : r["k"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


class Suspects:
    """Tells which words may be linked, and remembers those that may not."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.n, self.clean, self.known = bits, len(bits) * 8, set(), set()

    def __getitem__(self, word: str) -> bool:
        return all(self.bits[x >> 3] >> (x & 7) & 1 for x in _places(word, self.n)) or _figure(word)

    def among(self, words: list[str]) -> list[str]:
        """Those of the words that may be linked, each as often as it stands there."""
        odd = list(filterfalse(self.clean.__contains__, words))
        if odd and not self.known.issuperset(odd):
            for w in set(odd) - self.known:
                (self.known if self[w] else self.clean).add(w)
            odd = list(filter(self.known.__contains__, odd))
            if len(self.clean) + len(self.known) > REMEMBERED:
                self.clean, self.known = set(), set()
        return odd


def _form(letters: str) -> str:
    return letters.lower() if letters.isascii() else canonical(letters).lower()


def _figure(word: str) -> bool:
    return word[-1] in "lios0123456789" and not word.isdigit() and _NUMBERISH.match(word) is not None


class Scan:
    """What the links have to be asked about one text."""

    def __init__(self, bits: np.ndarray, weights: dict[str, float], contexts: bool = True):
        self.suspects, self.weights, self.contexts = Suspects(bits), weights, contexts

    def words(self, text: str) -> tuple[list[str], list[str], list[str]]:
        """(words, the suspects among them, suspect windows of Chinese glyphs) of a text without broken words."""
        flat, windows = forms(text)
        low = words_of(flat)
        return low, self.suspects.among(low), self.suspects.among(windows) if windows else windows

    def context(self, low: list[str], at: int) -> np.ndarray:
        near = low[max(0, at - 2) : at] + low[at + 1 : at + 3]
        return sum((_signature(x) * self.weights.get(x, 1.0) for x in near), np.zeros(DIMS, np.float32))

    def read(self, text: str, ends: tuple[str, str]) -> tuple[list[dict], list[dict], bool]:
        """(suspects, words broken by a hyphen, was a word broken by a sign that only a break has?)"""
        breaks = line_breaks(text)
        pairs: dict[tuple[str, str], int] = {}
        sure, at, kept = False, 0, []
        found: dict[tuple, dict] = {}

        def suspect(word: str, pair: tuple[str, str] | None = None, joined: bool | None = None) -> dict:
            key = (word, pair, joined)
            if key not in found:
                found[key] = {"word": word, "n": 0, "n_first": 0, "n_last": 0, "left": pair and pair[0], "right": pair and pair[1], "joined": joined, "context": None}
            found[key]["n"] += 1
            return found[key]

        for a, _, b, left, sign, right in breaks:
            kept.append(text[at:a])
            at = b + len(right)
            pair = (_form(left), _form(right))
            whole = pair[0] + pair[1]
            if sign in "¬\xad":
                sure = True
                if self.suspects[whole]:
                    suspect(whole)
                continue
            key = (pair, right[:1].isupper())
            pairs[key] = pairs.get(key, 0) + 1
            if self.suspects[whole]:
                suspect(whole, pair, True)
            for x in pair:
                if self.suspects[x]:
                    suspect(x, pair, False)
        low, odd, windows = self.words("\n".join((*kept, text[at:])) if breaks else text)
        for w in odd + windows:
            suspect(w)
        if self.contexts and odd:
            some = set(odd)
            for i, w in enumerate(low):
                if w in some:
                    s, c = found[w, None, None], self.context(low, i)
                    s["context"] = c if s["context"] is None else s["context"] + c
            for s in found.values():
                s["context"] = None if s["context"] is None else s["context"].tolist()
        words = {key[0] for key in found}
        for end, field in zip(ends, ("n_first", "n_last")):
            # words of an ASCII line stand in it as they are
            if end and found and (not end.isascii() or any(map(end.lower().__contains__, words))):
                for x in self.words(end)[1:]:
                    for w in x:
                        if (w, None, None) in found:
                            found[w, None, None][field] += 1
        return list(found.values()), [{"left": x, "right": y, "upper": u} for (x, y), u in pairs], sure


class Mender:
    """Makes words whole and corrects them with what was decided for one text."""

    def __init__(self, broken: dict[tuple[str, str], bool], links: dict[str, str]):
        self.is_broken, self.links = broken, links

    def whole(self, text: str) -> str:
        at, out = 0, []
        for _, end, start, left, sign, right in line_breaks(text):
            hyphen = sign in "¬\xad" or self.is_broken.get((_form(left), _form(right)), False)
            out += text[at:end], "" if hyphen else "-"
            at = start
        return "".join((*out, text[at:])) if out else text

    def mend(self, text: str) -> str:
        flat = plain(self.whole(text))

        def word(m: re.Match) -> str:
            w = m.group()
            right = self.links.get(w.lower())
            if right is None:
                return w
            return right.capitalize() if w[:1].isupper() else right

        out = _TOKEN.sub(word, flat)
        if _TWIN.search(out):
            t = "^" + out + "^"
            edge = lambda c: c if "一" <= c <= "鿿" else "^"
            out = "".join(
                self.links.get(f"\0{edge(t[i - 1])}{c}{edge(t[i + 1])}", "\0\0" + c)[2] if c in _TWINS else c for i, c in enumerate(t[1:-1], 1)
            )
        return out


def reflow(text: str) -> str:
    """Lines of a paragraph joined; blank lines keep paragraphs apart; headings and list items stay alone."""
    out = []
    for block in re.split(r"\n[ \t]*\n\s*", text.replace("\r\n", "\n").strip("\n")):
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        joined = ""
        for x in lines:
            if not joined:
                joined = x
            elif re.match(r"([-*•]|\(?\d{1,3}[.)]|\[\d+\])\s", x):
                joined += "\n" + x
            elif re.search(r"[一-鿿，。、；：（）]$", joined) and re.match(r"[一-鿿，。、；：（）\w]", x):
                joined += x
            else:
                joined += " " + x
        if joined:
            out.append(joined)
    return "\n\n".join(out)


# page numbers have as many digits as the pages of a paper need; nine fit an INT
_PAGE_WORD = r"(?:p|pp|page|seite|s|página|pág|pag|p\.|第)\.?\s*"
_NUMBER_LINE = rf"(?i)^[\[(·•\-–—~*\s]*(?:{_PAGE_WORD})?(\d{{1,9}})\s*(?:页|頁)?(?:\s*(?:of|/|von|de|sur|共)\s*\d{{1,9}}\s*(?:页|頁)?)?[\])·•\-–—~*\s]*$"
_ROMAN_LINE = r"^[\[(·\-–—\s]*[ivxl]{1,6}[\])·\-–—\s]*$"
_LEAD, _TRAIL = r"^\s*(\d{1,9})(?:\s{2,}|\s*[|·]\s*)(?=\S)", r"(?<=\S)(?:\s{2,}|\s*[|·]\s*)(\d{1,9})\s*$"
_NO_HEADER = r"^(\d+(\.\d+)+\.?\s|\d+\.?[ ][A-ZÀ-Þ][a-zß-ÿ]+\b(?!.*\s{2})|(?i:figure|fig|table|tab|tabelle|abbildung|abb|tableau|tabla|figura)\.?\s*\d|[表图]\s*\d)"


_NUMBERED, _ROMAN, _LED, _TRAILED, _NOT_HEAD = (re.compile(x, re.ASCII) for x in (_NUMBER_LINE, _ROMAN_LINE, _LEAD, _TRAIL, _NO_HEADER))
_FORMED = re.compile(r"(?i)^\W*(p\.|page|seite|第)|^[\[(·–—-]", re.ASCII)
_LETTERS_2, _LETTERS_3, _HAN_SIGN = re.compile(r"[^\W\d_]{2}"), re.compile(r"[^\W\d_]{3}"), re.compile("[一-鿿]")
_STOPPED, _AND_OTHERS, _SMALL = re.compile(r"[.,;:，。；：、！？!]$"), re.compile(r"(et al|u\.\s*a|y otros)\.$"), re.compile("^[a-zß-ÿ]")
_BY_CLASS = str.maketrans("ctbg0a1!i59", "efh9oollls9")
_BLANKS = re.compile(r"\s+", re.ASCII)


def _skeleton(core: str) -> str:
    """Form in which a line equals its misreadings: page number off the ends, glyphs by class."""
    x = core.lower()
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("in", "m"), ("li", "h")):
        x = x.replace(a, b)
    return _BLANKS.sub("", x.translate(_BY_CLASS))


def line_signs(line: str, apart: bool, width: int) -> tuple | None:
    """(number, form, roman, inside, core, key) of a first or last line that can be furniture; key only if it is shaped like a header."""
    m = _NUMBERED.match(line)
    number = int(m.group(1)) if m else None
    led, trailed = _LED.match(line), _TRAILED.search(line) if line[-1:].isdigit() else None
    inside = int(led.group(1)) if led else int(trailed.group(1)) if trailed else None
    roman = _ROMAN.match(line) is not None
    core = line[led.end() :] if led else line
    core = _TRAILED.sub("", core).strip(" ") if trailed else core.strip(" ")
    shaped = (
        2 <= len(core) <= 90 and number is None and _LETTERS_2.search(core) and not _NOT_HEAD.match(line)
        and (not _STOPPED.search(core) or _AND_OTHERS.search(core)) and (not _SMALL.match(core) or core.endswith("et al.")) and not any(x in core for x in "，。；")
        and (apart or len(line) < 0.75 * width or inside is not None or core == core.upper() and _LETTERS_3.search(core) and not _HAN_SIGN.search(core))
    )
    if not shaped and not roman and number is None and inside is None:
        return None
    return number, bool(m and _FORMED.search(line)), roman, inside, core, _skeleton(core) if shaped else None


_SUSPECT = (
    T.StructType().add("word", "string").add("n", "integer").add("n_first", "integer").add("n_last", "integer").add("left", "string").add("right", "string")
    .add("joined", "boolean").add("context", T.ArrayType(T.FloatType()))
)
_BREAK = T.StructType().add("left", "string").add("right", "string").add("upper", "boolean")


def read_texts(df: DataFrame, text: str, words: DataFrame, links: DataFrame, bits=None, contexts: bool = True) -> DataFrame:
    """Rows without their text: first and last lines, the line beside them, widths, suspects and breaks of the words.

    `contexts` are needed to choose among the words a suspect may stand for, not to find it.
    """
    sc = df.sparkSession.sparkContext
    if bits is None:
        bits = reader_parts(words, links)
    held = sc.broadcast(bits)
    schema = T.StructType()
    for f in df.schema:
        if f.name != text:
            schema.add(f)
    names = list(schema.names)
    at_text = df.columns.index(text)
    for name in ("first", "last"):
        schema.add(name, "string")
    schema.add("lines", "integer").add("width", "integer").add("first_apart", "boolean").add("last_apart", "boolean").add("repeats_first", "boolean")
    schema.add("suspects", T.ArrayType(_SUSPECT)).add("breaks", T.ArrayType(_BREAK)).add("sure", "boolean")

    def rows(kind: pa.DataType, lists: list[list[dict]]) -> pa.Array:
        """A list of structs for each row, from columns of their fields."""
        flat = list(chain.from_iterable(lists))
        structs = pa.StructArray.from_arrays([pa.array([x[f.name] for x in flat], f.type) for f in kind.value_type], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), structs, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(*held.value, contexts)
        told = list(to_arrow_schema(T.StructType(schema.fields[len(names) :])))
        for b in batches:
            out = []
            for t in b.column(at_text).to_pylist():
                if not t or not t.strip():
                    out.append((None, None, 0, 0, False, False, False, [], [], False))
                    continue
                raw = list(map(str.strip, (t.replace("\r\n", "\n") if "\r" in t else t).split("\n")))
                at = [i for i, x in enumerate(raw) if x] if "" in raw else range(len(raw))
                first, last = raw[at[0]], raw[at[-1]]
                apart = len(at) > 1 and at[1] > at[0] + 1
                apart_last = len(at) > 1 and at[-2] < at[-1] - 1
                # a first or last line that turns out to be furniture is not read for misreadings
                suspects, breaks, sure = scan.read(t, (first, last if len(at) > 1 else ""))
                out.append((
                    first, last, len(at), max(map(len, raw)), apart, apart_last, len(at) > 1 and raw[at[1]].lower() == first.lower(),
                    suspects, breaks, sure,
                ))
            fields = [rows(f.type, x) if pa.types.is_list(f.type) else pa.array(x, f.type) for f, x in zip(told, zip(*out) if out else [()] * len(told))]
            yield pa.RecordBatch.from_arrays([*(x for i, x in enumerate(b.columns) if i != at_text), *fields], names=schema.names)

    return df.mapInArrow(run, schema)


def reader_parts(words: DataFrame, links: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
    """(filter of the linked words, weights of the frequent words, of which there are at most 1 / FREQUENT)."""
    total = words.filter(~F.col("word").rlike("^[\\x00\\x01]")).agg(F.sum("n")).first()[0] or 0
    often = words.filter((F.col("n") > FREQUENT * total) & ~F.col("word").rlike("^[\\x00\\x01]")).select("word", "n").collect()
    return word_filter(links), {r["word"]: float((FREQUENT * total / r["n"]) ** 0.5) for r in often}


def decide_breaks(breaks: DataFrame, words: DataFrame, links: DataFrame) -> DataFrame:
    """left, right, upper, hyphen of distinct `breaks` (left, right, upper): was the sign put in at the line end?

    It was if the whole word is met more often than the compound inside lines; else not if the compound is met or the right part has a
    capital; else if the whole is a misreading of a word that is met, or one of the parts is no word. Only presence and
    comparisons count, so the same corpus many times over decides the same.
    """
    pairs = breaks.select("left", "right", "upper").distinct()

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y, u in zip(b["left"], b["right"], b["upper"]):
                whole = x + y
                out += [(x, y, u, "whole", whole), (x, y, u, "compound", f"\1{x}-{y}"), (x, y, u, "left", x), (x, y, u, "right", y)]
                out += [(x, y, u, "source", w) for w in glyph_sources(whole)]
            yield pd.DataFrame(out, columns=["left", "right", "upper", "role", "word"])

    each = pairs.mapInPandas(asked, "left string, right string, upper boolean, role string, word string")
    met = each.join(words.select("word", "n"), "word").join(links.select(F.col("wrong").alias("word"), F.lit(True).alias("linked")), "word", "left")
    clean = F.col("linked").isNull()
    top = lambda role, sound=True: F.coalesce(F.max(F.when((F.col("role") == role) & (clean if sound else F.lit(True)), F.col("n"))), F.lit(0))
    seen = met.groupBy("left", "right", "upper").agg(
        top("whole", False).alias("whole"), top("compound", False).alias("compound"), top("left").alias("l"), top("right").alias("r"), top("source").alias("source")
    )
    hyphen = (
        F.when(F.col("whole") > F.col("compound"), True).when(F.col("upper") | (F.col("compound") > 0), False).when(F.col("source") > 0, True)
        .otherwise((F.col("l") == 0) | (F.col("r") == 0))
    )
    found = seen.select("left", "right", "upper", hyphen.alias("hyphen"))
    return pairs.join(found, ["left", "right", "upper"], "left").select("left", "right", "upper", F.coalesce("hyphen", ~F.col("upper")).alias("hyphen"))


def judge_suspects(read: DataFrame, keys: list[str], broken: DataFrame, words: DataFrame, links: DataFrame, choose: bool = True) -> DataFrame:
    """keys, word, n, n_first, n_last and, if one is to be chosen, right: the suspects that are misreadings, with the word that fits their places best."""
    each = read.select(*keys, F.explode("suspects").alias("x")).select(*keys, "x.*")
    plain_ = each.filter("joined IS NULL")
    # the parts of a broken word are read together or apart, as was decided
    cut_words = each.filter("joined IS NOT NULL").join(broken.groupBy("left", "right").agg(F.max("hyphen").alias("hyphen")), ["left", "right"]).filter("joined = hyphen").drop("hyphen")
    every = plain_.unionByName(cut_words.select(*plain_.columns)).select(*keys, "word", "n", "n_first", "n_last", "context")
    numberish = F.col("word").rlike(_NUMBERISH.pattern)
    if not choose:
        # one look-up: linked words, and figures that are words of their own
        wrong = links.select(F.col("wrong").alias("word"), F.lit(True).alias("linked"))
        told = wrong.unionByName(words.filter(numberish).select("word").join(wrong, "word", "left_anti").withColumn("linked", F.lit(False)))
        return every.drop("context").join(told, "word", "left").filter(F.coalesce("linked", numberish)).drop("linked")
    linked = every.join(links.select(F.col("wrong").alias("word"), "choices"), "word", "left")
    figure = linked.filter("choices IS NULL").join(words.select("word"), "word", "left_anti").filter(numberish)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    near = lambda c: F.coalesce(dot(F.col("context"), c["vector"]) / F.sqrt(F.greatest(dot(c["vector"], c["vector"]), F.lit(1e-9))), F.lit(0.0))
    ranked = F.array_sort(F.transform("choices", lambda c: F.struct((-near(c)).alias("d"), c["order"].alias("order"), c["right"].alias("right"))))
    right = F.when(F.size("choices") == 1, F.col("choices")[0]["right"]).otherwise(ranked[0]["right"])
    found = linked.filter("choices IS NOT NULL").select(*keys, "word", "n", "n_first", "n_last", right.alias("right"))
    return found.unionByName(figure.select(*keys, "word", "n", "n_first", "n_last", F.translate("word", "lios", "1105").alias("right")))


def page_furniture(read: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """id and, where found, top_header, bottom_header, top_number, bottom_number (the lines as printed).

    `read` has id, paper_id, page_number and the columns of _read. A header returns as first or last line
    on at least two and a fifth of the paper's pages, set apart in length, case or by space; section
    headings, captions, titles and running sentences are none. A number line counts where its
    distance to the page number is that of other pages of the paper, or zero, or its form says so.
    """
    lines = read.filter("lines > 0").select(
        "id", "paper_id", "page_number", "width",
        F.explode(
            F.array(
                F.struct(F.lit("top").alias("place"), F.col("first").alias("line"), F.col("first_apart").alias("apart"), F.col("repeats_first").alias("doubled")),
                F.struct(F.lit("bottom").alias("place"), F.when(F.col("lines") > 1, F.col("last")).alias("line"), F.col("last_apart").alias("apart"), F.lit(False).alias("doubled")),
            )
        ).alias("x"),
    ).select("id", "paper_id", "page_number", "width", "x.*").filter("line IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    kept = ["id", "paper_id", "page_number", "place", "line", "doubled"]
    told = {"number": "int", "form": "boolean", "roman": "boolean", "inside": "int", "core": "string", "_key": "string"}

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [line_signs(x, a, w) for x, a, w in zip(b["line"], b["apart"], b["width"])]
            some = [x is not None for x in found]
            rest = pd.DataFrame([x for x in found if x is not None], columns=list(told), index=b.index[some])
            for c in ("number", "inside"):
                rest[c] = rest[c].astype("Int32")
            yield pd.concat([b.loc[some, kept], rest], axis=1)

    # what can be furniture at all is kept, so the patterns run once a line
    lines = cut(lines.mapInPandas(signs, ", ".join([*(f"{c} {kinds[c]}" for c in kept), *(f"{c} {t}" for c, t in told.items())])))
    pages = read.filter("lines > 0").groupBy("paper_id").agg(F.count("*").alias("_pages"))
    keyed = lines.filter("_key IS NOT NULL")
    many = keyed.groupBy("paper_id", "_key").agg(F.countDistinct("id").alias("_n")).join(pages, "paper_id")
    many = many.filter((F.col("_n") >= 2) & (F.col("_n") >= 0.2 * F.col("_pages"))).select("paper_id", "_key")
    heads = keyed.join(many, ["paper_id", "_key"])
    if titles is not None:
        named = titles.select("paper_id", F.trim("title").alias("_title")).filter("_title IS NOT NULL").groupBy("paper_id").agg(F.max("_title").alias("_title"))
        heads = heads.join(named, "paper_id", "left").filter(~((F.col("page_number") == 1) & (F.col("place") == "top") & F.coalesce(F.lower("core") == F.lower("_title"), F.lit(False)) & F.col("inside").isNull() & ~F.col("doubled")))
    heads = cut(heads.select("id", "place", "line", "inside"))
    # page numbers: the same distance to the page number on other pages of the paper
    value = F.coalesce("number", "inside")
    votes = lines.filter(value.isNotNull()).withColumn("_d", value - F.col("page_number"))
    agreed = votes.groupBy("paper_id", "_d").agg(F.countDistinct("id").alias("_v"))
    lone = votes.filter(F.col("number").isNotNull()).join(agreed, ["paper_id", "_d"])
    lone = lone.filter(F.col("form") | (F.col("_d") == 0) | (F.col("_v") >= 2)).select("id", "place", "line")
    roman = lines.filter(F.col("roman")).select("id", "place", "line")
    inside = heads.filter(F.col("inside").isNotNull()).select("id", "place", "line")
    every = heads.select("id", F.concat("place", F.lit("_header")).alias("what"), "line").unionByName(
        lone.unionByName(roman).unionByName(inside).select("id", F.concat("place", F.lit("_number")).alias("what"), "line")
    )
    return every.groupBy("id").pivot("what", ["top_header", "bottom_header", "top_number", "bottom_number"]).agg(F.max("line"))


def _pages_and_blocks(pages: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both as src, id, page_id, paper_id, page_number, block_index, text."""
    kinds = pages.schema
    whole = pages.select(F.lit("page").alias("src"), "id", F.col("id").alias("page_id"), "paper_id", "page_number", F.lit(0).alias("block_index"), "text")
    cuts = blocks.select(F.lit("block").alias("src"), "id", "page_id", F.lit(None).cast(kinds["paper_id"].dataType).alias("paper_id"), F.lit(None).cast(kinds["page_number"].dataType).alias("page_number"), "block_index", "text")
    return whole, cuts


def _blocks_on_pages(cuts: DataFrame, found: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(read blocks with the furniture of their page, is a block the first of it?, the last?); blocks without text have no place."""
    ends, at = Window.partitionBy("page_id"), F.when(F.col("lines") > 0, F.col("block_index"))
    placed = cuts.withColumns({"_low": F.min(at).over(ends), "_high": F.max(at).over(ends)})
    return placed.join(found.withColumnRenamed("id", "page_id"), "page_id", "left"), F.col("block_index") == F.col("_low"), F.col("block_index") == F.col("_high")


def _furniture_lines(first_ok: Column, last_ok: Column) -> tuple[Column, Column, Column, Column]:
    """Is the first line a header, the last one, the first a page number, the last?"""
    one = F.col("lines") == 1
    top = first_ok & F.coalesce(F.col("first") == F.col("top_header"), F.lit(False)) | one & F.coalesce(F.col("first") == F.col("bottom_header"), F.lit(False))
    bottom = last_ok & F.coalesce(F.col("last") == F.col("bottom_header"), F.lit(False))
    top_no = first_ok & F.coalesce(F.col("first") == F.col("top_number"), F.lit(False))
    bottom_no = last_ok & F.coalesce(F.col("last") == F.col("bottom_number"), F.lit(False))
    return top, bottom, top_no, bottom_no


def scan_defects(pages: DataFrame, blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """src (page, block), row_id, defect (hyphen, misread, header, page_no), one row per defect.

    Null, empty and blank texts have none. Copies give one row. Blocks take furniture from their page:
    a header or number line at their start or end counts where it is that of the page.
    """
    words = cut(learn_words(pages))
    links = cut(link_misreadings(words))
    parts = reader_parts(words, links)
    whole, cuts = _pages_and_blocks(pages, blocks)
    both = cut(read_texts(whole, "text", words, links, parts, contexts=False).unionByName(read_texts(cuts, "text", words, links, parts, contexts=False)))
    each = both.select("src", "id", F.explode("breaks").alias("b")).select("src", "id", "b.*")
    broken = cut(decide_breaks(each, words, links))
    put_in = each.join(broken.filter("hyphen"), ["left", "right", "upper"]).select("src", "id", F.lit(True).alias("hyphen"))
    keys = ["src", "id"]
    told = {"n": "wrong", "n_first": "wrong_first", "n_last": "wrong_last"}
    signs = judge_suspects(both, keys, broken, words, links, choose=False).select(*keys, *told, F.lit(False).alias("hyphen"))
    signs = signs.unionByName(put_in.select(*keys, *[F.lit(0).alias(c) for c in told], "hyphen"))
    signs = cut(signs.groupBy(*keys).agg(*[F.sum(c).alias(to) for c, to in told.items()], F.max("hyphen").alias("hyphen")))
    ends = both.drop("suspects", "breaks")
    found = cut(page_furniture(ends.filter("src = 'page'"), titles))
    lean = ends.join(signs, keys, "left").fillna(0, list(told.values())).withColumn("hyphen", F.coalesce("hyphen", F.lit(False)) | F.col("sure"))
    read, cuts = lean.filter("src = 'page'").drop("src"), lean.filter("src = 'block'").drop("src", "paper_id", "page_number")

    def rows(df: DataFrame, src: str, first_ok: Column, last_ok: Column) -> DataFrame:
        one = F.col("lines") == 1
        top, bottom, top_no, bottom_no = _furniture_lines(first_ok, last_ok)
        aside = F.when(top | top_no | one & (bottom | bottom_no), F.col("wrong_first")).otherwise(0) + F.when((bottom | bottom_no) & ~one, F.col("wrong_last")).otherwise(0)
        wrong = F.col("wrong") > aside
        flags = F.array_compact(
            F.array(
                F.when(F.col("hyphen"), F.lit("hyphen")), F.when(wrong, F.lit("misread")), F.when(top | bottom, F.lit("header")), F.when(top_no | bottom_no, F.lit("page_no"))
            )
        )
        return df.filter("lines > 0").select(F.lit(src).alias("src"), F.col("id").alias("row_id"), F.explode(flags).alias("defect"))

    # a bare number inside a page is a cell, so blocks count at the ends of their page only
    by_block = rows((placed := _blocks_on_pages(cuts, found))[0], "block", *placed[1:])
    by_page = rows(read.drop("page_id", "block_index").join(found, "id", "left"), "page", F.lit(True), F.lit(True))
    return by_page.unionByName(by_block).distinct()


def repair_pages(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """id, repaired (STRING) of the pages, see repair_texts."""
    return repair_texts(pages, None, titles).select("id", "repaired")


def repair_texts(pages: DataFrame, blocks: DataFrame | None, titles: DataFrame | None = None) -> DataFrame:
    """src (page, block), id, repaired (STRING): furniture off, words whole and corrected, lines reflowed into paragraphs.

    Null stays null, blank texts become empty, and so do blocks that hold nothing but furniture of their page. Copies stay copies.
    """
    words = cut(learn_words(pages))
    links = cut(link_misreadings(words))
    base, cuts = _pages_and_blocks(pages, pages.limit(0).select("id", F.col("id").alias("page_id"), F.lit(0).alias("block_index"), "text") if blocks is None else blocks)
    base = base.unionByName(cuts)
    read = cut(read_texts(base, "text", words, links))
    ends = read.drop("suspects", "breaks", "sure")
    found = cut(page_furniture(ends.filter("src = 'page'"), titles))
    keys = ["src", "id"]
    each = read.select(*keys, F.explode("breaks").alias("b")).select(*keys, "b.*")
    broken = cut(decide_breaks(each, words, links))
    signs = each.join(broken.filter("hyphen"), ["left", "right", "upper"]).groupBy(*keys).agg(F.collect_set(F.struct("left", "right")).alias("broken"))
    chosen = judge_suspects(read, keys, broken, words, links).groupBy(*keys).agg(F.collect_set(F.struct("word", "right")).alias("links"))

    def aside(df: DataFrame, first_ok: Column, last_ok: Column) -> DataFrame:
        top, bottom, top_no, bottom_no = _furniture_lines(first_ok, last_ok)
        return df.select(*keys, (top | top_no).alias("top"), (bottom | bottom_no).alias("bottom")).filter("top OR bottom")

    off = aside(ends.filter("src = 'page'").join(found, "id"), F.lit(True), F.lit(True))
    off = off.unionByName(aside(*_blocks_on_pages(ends.filter("src = 'block'"), found))).distinct()

    @F.pandas_udf(T.StringType())
    def body(text: pd.Series, top: pd.Series, bottom: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, top, bottom):
            if t is not None:
                lines = t.replace("\r\n", "\n").split("\n")
                at = [i for i, x in enumerate(lines) if x.strip()]
                drop = {at[0]} if at and a else set()
                drop |= {at[-1]} if at and b else set()
                t = "\n".join(x for i, x in enumerate(lines) if i not in drop)
            out.append(t)
        return pd.Series(out, dtype=object)

    @F.pandas_udf(T.StringType())
    def mend(text: pd.Series, broken: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for t, b, l in zip(text, broken, links):
            if t is not None:
                pairs = {(x["left"], x["right"]): True for x in b} if b is not None else {}
                t = Mender(pairs, {x["word"]: x["right"] for x in l} if l is not None else {}).mend(t)
            out.append(t)
        return pd.Series(out, dtype=object)

    @F.pandas_udf(T.StringType())
    def paragraphs(text: pd.Series) -> pd.Series:
        return text.map(reflow, na_action="ignore").astype(object)

    joined = base.select(*keys, "text").join(off, keys, "left").join(signs, keys, "left").join(chosen, keys, "left").fillna(False, ["top", "bottom"])
    return joined.select(*keys, paragraphs(mend(body("text", "top", "bottom"), "broken", "links")).alias("repaired"))
