"""Visually identical text with different characters, brought to one form.

Only segments that can change are touched. A character class built from the Unicode
quick-check properties (NFKC quick check NO and MAYBE, plus invisible signs, odd spaces and
look-alike letters) finds unstable runs; each run is normalised together with the base character
before it and the combining marks after it, and spliced back into the untouched text. MAYBE are
the signs that may compose with the one before them: combining marks, vowel signs of Indic scripts,
vowels and final consonants of decomposed Hangul.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts drawn like a Latin letter, as pairs.
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ӏl ѵv "  # Cyrillic, small
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԌG ԚQ ԜW ҮY "  # Cyrillic, capital
    "οo ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC "  # Greek
    "օo հh ոn սu ցg "  # Armenian
    "ɡg ɑa"  # Latin
)
HYPHENS = "‐‑"
_PAIRS = {p[0]: p[1] for p in LOOKALIKES.split()}
_FOLD = {ord(a): b for a, b in _PAIRS.items()} | {ord(h): "-" for h in HYPHENS}
# Decompositions whose result looks different from the character (raised, circled, boxed figures).
_VISIBLE = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
# Code points that show nothing, as ranges.
INVISIBLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
)
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE) + "]+")


@lru_cache(maxsize=1)
def _maybe() -> frozenset:
    """Characters whose quick check is MAYBE: second halves of canonical pairs, vowels and finals of Hangul."""
    pairs = (unicodedata.decomposition(chr(cp)).split() for cp in range(0xC0, sys.maxunicode + 1) if not 0xAC00 <= cp <= 0xD7A3)
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(seconds | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))))


@lru_cache(maxsize=1)
def _tables() -> tuple[re.Pattern, frozenset, re.Pattern]:
    """(pattern of an unstable run, characters that stay as they are, pattern of a run in texts of the first plane, which is one look-up a sign)."""
    kept, unstable = set(), []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0x20000 <= cp <= 0x2F7FF or cp >= 0x30000 and not 0xE0000 <= cp < 0xE1000:
            continue  # stable blocks
        ch = chr(cp)
        if unicodedata.decomposition(ch).startswith(_VISIBLE) and ch not in "℃℉":
            kept.add(ch)
        elif not unicodedata.is_normalized("NFKC", ch) or unicodedata.combining(ch) or ch in _maybe() or cp in _FOLD or _INVISIBLE.match(ch) or (ch.isspace()):
            unstable.append(cp)
    runs, start = [], None
    for a, b in zip(unstable, unstable[1:] + [-1]):
        start = a if start is None else start
        if b != a + 1 or a == 0xFFFF:
            runs.append((start, a))
            start = None
    every, plane = ("".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs if b <= most) + r"\t\x0b\x0c" for most in (sys.maxunicode, 0xFFFF))
    every, plane = re.compile(f"[{every}]+"), re.compile(f"[{plane}][{plane}]*")  # a class in front lets the search leap to the next
    return every, frozenset(kept), plane


@lru_cache(maxsize=200_000)
def _segment(s: str) -> str:
    kept = _tables()[1]
    s = _INVISIBLE.sub("", s)
    s = "".join(c if c in kept else unicodedata.normalize("NFKC", c) for c in s)
    s = re.sub(r"[^\S\n]", " ", s.translate({0x2028: "\n", 0x2029: "\n", 0x85: "\n"}))
    return unicodedata.normalize("NFC", s)


_WORD = re.compile(r"[^\W\d_]+")
_FOREIGN, _BEYOND = re.compile("[\u0370-\u058f\u0251\u0261]"), re.compile("[\U00010000-\U0010ffff]")


def canonical(text: str) -> str:
    """The one form of a text: stable under repetition, equal for texts that look equal.

    Look-alike letters become Latin in every word that can be read as Latin as a whole; a word
    with a letter that has no Latin twin keeps its script. Line ends become \\n.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return re.sub(r"[\t\x0b\x0c]", " ", text)
    parts, done = [], 0
    for m in _tables()[0 if _BEYOND.search(text) else 2].finditer(text):
        start, end = m.span()
        first = text[start]
        if start > done and (unicodedata.combining(first) or first in _maybe() or _INVISIBLE.match(first)):
            start -= 1  # the base character belongs to the segment
        parts += text[done:start], _segment(text[start:end])
        done = end
    out = "".join((*parts, text[done:]))
    parts, done = [], 0
    for m in _FOREIGN.finditer(out):
        if m.start() >= done:  # only the words that hold such a letter are looked at
            start = m.start()
            while start > done and _WORD.match(out[start - 1]):
                start -= 1
            end = word.end() if (word := _WORD.match(out, start)) else start
            parts += out[done:start], _word(out[start:end])
            done = end
    out = "".join((*parts, out[done:]))
    for h in HYPHENS:
        out = out.replace(h, "-")
    return out


def _word(w: str) -> str:
    if w.isascii():
        return w
    folded = w.translate(_FOLD)
    return folded if folded != w and not _FOREIGN.search(folded) else w


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def fullwidth_ascii_count(text: Column) -> Column:
    """Full-width forms of ASCII signs (U+FF01 to U+FF5E) in a text as read; null for null."""
    return F.regexp_count(text, F.lit("[！-～]"))


def normalize_glyphs(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `canonical` (STRING) and `fullwidth_found` (INT, counted in the text as read).

    Null gives null and null, an empty text an empty text and 0. Copies stay copies, other
    columns pass through, columns already so named are replaced.
    """
    return df.withColumns({"canonical": canonical_text(F.col(text)), "fullwidth_found": fullwidth_ascii_count(F.col(text))})


def equal_looking(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_id: str, right_id: str, text: str = "text") -> DataFrame:
    """Pairs of rows with equal keys whose texts look the same everywhere and differ in code points.

    Blank and null texts never match. Only keys, ids and two digests per row are shuffled, so
    long texts and a key that holds a third of the rows cost little; every text is brought to its form once.
    Columns left_id, right_id.
    """

    def digest(df: DataFrame, key: str, row_id: str, side: str) -> DataFrame:
        kept = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(row_id).alias(f"_{side}"), F.col(text).alias("_t"))
        kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                forms = [_LINE_END.sub("", canonical(t)) for t in b["_t"]]
                some = [bool(f) and not f.isspace() for f in forms]
                out = b.drop(columns="_t")
                out[f"_raw_{side}"] = [_digest(t) for t in b["_t"]]
                out["_form"] = [_digest(f) for f in forms]
                yield out[some]

        return kept.mapInPandas(run, f"_k {kinds['_k']}, _{side} {kinds[f'_{side}']}, _raw_{side} binary, _form binary").distinct()

    a, b = digest(left, left_key, left_id, "a"), digest(right, right_key, right_id, "b")
    both = a.join(b, ["_k", "_form"]).filter("_raw_a <> _raw_b")
    return both.select(F.col("_a").alias("left_id"), F.col("_b").alias("right_id")).distinct()


_LINE_END = re.compile(r" +(?=\n|$)")


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
