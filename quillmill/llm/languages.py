"""Languages of documents and of the stretches of mixed ones, by error-correcting output codes.

Every language has a codeword; each bit is decided by a binary classifier on letter trigrams
(log-odds of the trigram under the bit's two sides, counted over all labelled rows, wrong labels
included). The mean log-odds of a sentence are compared with each codeword by logistic loss,
so weak bits count little; the nearest codeword wins and a small lead flags ambiguity.
Trigrams are looked up for whole blocks of text at once, in arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.quality import text_kind

LANGUAGES = ("en", "zh", "de", "fr", "es")
# Bits are all splits of the five languages into two and three: any two codewords differ in six of ten bits.
CODES = np.array([[1.0 if k in pair else -1.0 for pair in combinations(range(len(LANGUAGES)), 2)] for k in range(len(LANGUAGES))], dtype=np.float32)
# Names of the languages in labels; codes with a region or script are cut first.
NAMES = {
    "en": "en eng english anglais englisch inglés 英文 英语 英語",
    "zh": "zh zho chi cmn chinese mandarin chinois chinesisch 中文 汉语 漢語 简体中文 繁體中文 cn",
    "de": "de deu ger german deutsch allemand alemán 德文 德语",
    "fr": "fr fra fre french français francais französisch francés 法文 法语",
    "es": "es spa spanish español espanol castellano espagnol spanisch 西班牙文 西班牙语",
}
MISSING = ("", "und", "unknown", "none", "null", "n/a", "na", "nan", "?", "-", "mul", "zxx", "mis", "undefined", "other")
#: A mean log-odds of one trigram beyond this says no more.
CLIP = 3.0
#: Steepness of the loss in mean log-odds.
SCALE = 4.0
#: A lead in loss under this is ambiguous.
LEAD = 1.0
_LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáçéèêëíîïñóôöúùûüßœ"
_HAN, _OTHER = len(_LETTERS) + 1, len(_LETTERS) + 2
BASE = len(_LETTERS) + 3
SIZE = BASE**3
#: Signs counted at once; signs scored at once, so that their rows of ten weights (1.3 MB) stay in the processor's cache.
BLOCK, SCORED = 1 << 19, 1 << 15


def _symbol_table() -> np.ndarray:
    lut = np.zeros(0x10000, np.int32)
    for cp in range(0x80, 0x10000):
        if chr(cp).isalpha():
            lut[cp] = _OTHER
    lut[0x3400:0x4DC0] = lut[0x4E00:0xA000] = lut[0xF900:0xFB00] = lut[0x2E80:0x2FE0] = _HAN
    for i, c in enumerate(_LETTERS, 1):
        lut[ord(c)] = i
        if len(c.upper()) == 1:
            lut[ord(c.upper())] = i
    for i in range(26):  # full width
        lut[0xFF21 + i] = lut[0xFF41 + i] = i + 1
    for foreign, latin in zip("аеорсухіјѕοАЕОРСТВНКМΑΟΕΡΤ", "aeopcyxijsoaeopctbhkmaoept"):
        lut[ord(foreign)] = _LETTERS.index(latin) + 1
    return lut


_LUT = _symbol_table()
_MIDDLE_HAN = np.arange(SIZE) // BASE % BASE == _HAN


def trigrams(text: str) -> np.ndarray:
    """Number of the trigram that starts at each sign; 0 where it holds no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _LUT[np.minimum(points, 0xFFFF)]
    s = np.concatenate((s, np.zeros(2, np.int32)))
    grams = s[:-2] * (BASE * BASE) + s[1:-1] * BASE + s[2:]
    grams[s[1:-1] == 0] = 0
    return grams


def normalize_label(label: str | None) -> str | None:
    """Code of a label in any spelling; None if it names no language; other languages as spelled."""
    if label is None:
        return None
    x = label.strip().lower()
    if x in MISSING:
        return None
    x = _ALIASES.get(x) or re.split(r"[-_ ]", x)[0]
    return _ALIASES.get(x, x)


_ALIASES = {a: k for k, v in NAMES.items() for a in v.split()}


def count_trigrams(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """gram INT and one LONG column per language: trigrams of all rows with a known label.

    Partitions add up before the shuffle; the result has at most SIZE rows whatever the input.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SIZE * len(LANGUAGES), np.int64)
        for b in batches:
            for k, rows in b.groupby("label"):
                if k in LANGUAGES:
                    at, held = LANGUAGES.index(k) * SIZE, []
                    for t in rows["text"]:
                        held.append(t)
                        if sum(map(len, held)) > BLOCK:
                            counts[at : at + SIZE] += np.bincount(trigrams("\n".join(held)), minlength=SIZE)
                            held = []
                    if held:
                        counts[at : at + SIZE] += np.bincount(trigrams("\n".join(held)), minlength=SIZE)
        table = counts.reshape(len(LANGUAGES), SIZE)
        some = np.flatnonzero(table.any(axis=0))
        yield pd.DataFrame({"gram": some.astype(np.int32)} | {k: table[i, some] for i, k in enumerate(LANGUAGES)})

    code = label_code(F.col(label))
    rows = labelled.select(F.col(text).alias("text"), code.alias("label")).filter(F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull())
    schema = "gram int, " + ", ".join(f"{k} long" for k in LANGUAGES)
    return rows.mapInPandas(partial, schema).groupBy("gram").agg(*[F.sum(k).alias(k) for k in LANGUAGES])


def fit(counts: pd.DataFrame, smoothing: float = 0.5) -> np.ndarray:
    """Weights SIZE x bits (about 6 MB): clipped log-odds of each trigram for each bit."""
    table = np.zeros((SIZE, len(LANGUAGES)))
    table[counts["gram"].to_numpy()] = counts[list(LANGUAGES)].to_numpy()
    table[0] = 0
    share = (table + smoothing) / (table.sum(axis=0) + smoothing * max(int((table.sum(axis=1) > 0).sum()), 1))
    weights = np.zeros((SIZE, CODES.shape[1]), np.float32)
    for bit in range(CODES.shape[1]):
        on = CODES[:, bit] > 0
        weights[:, bit] = np.clip(np.log(share[:, on].mean(axis=1)) - np.log(share[:, ~on].mean(axis=1)), -CLIP, CLIP)
    weights[table.sum(axis=1) == 0] = 0
    return weights


# starts with one character class, so that the search can leap to it
_SENTENCE_END = re.compile(
    r"[.!?。！？\n](?:(?<=[。！？])[”’」』）]*\s*|(?<=[.!?])(?:[\"”’)\]]*\s+(?=[\"“(\[¿¡]*(?:[A-ZÀ-ÞА-ЯΑ-Ω一-鿿]|\d+[^\d\s.,;|]))|(?=[一-鿿]))|(?<=\n)[ \t]*\n\s*)"
)
_FULL = re.compile(r"[.!?。！？][\"”’)\]」』）]*\s*$")


def sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of the sentences, which cover the whole text."""
    cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


class Decoder:
    """Languages of many stretches at once."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def scores(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(summed log-odds per stretch and bit, letters and Chinese signs per stretch); starts rise, each stretch goes to the next start."""
        grams = trigrams(text)
        sums = np.zeros((len(starts), self.weights.shape[1]), np.float32)
        for a in range(int(starts[0]), len(grams), SCORED):
            i, j = np.searchsorted(starts, a, "right"), np.searchsorted(starts, a + SCORED)
            sums[i - 1 : j] += np.add.reduceat(self.weights.take(grams[a : a + SCORED], axis=0), np.r_[0, starts[i:j] - a], axis=0)
        return sums, np.add.reduceat(grams > 0, starts, dtype=np.int64), np.add.reduceat(_MIDDLE_HAN.take(grams), starts, dtype=np.int64)

    def decode(self, sums: np.ndarray, letters: np.ndarray, han: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, confidence, ambiguous) by loss-weighted decoding; no Chinese without its signs."""
        margin = sums / np.maximum(letters, 1)[:, None] * SCALE
        loss = np.logaddexp(0, -margin[:, None, :] * CODES[None]).sum(axis=2)
        loss[han == 0, 1] += 1e3
        order = np.sort(loss, axis=1)
        odds = np.exp(order[:, :1] - loss)
        return loss.argmin(axis=1), 1 / odds.sum(axis=1), (order[:, 1] - order[:, 0] < LEAD) | (letters < 3)


#: A full sentence has so many letters (Latin) or signs (Chinese) and this confidence.
FULL_LETTERS, FULL_HAN, FULL_CONFIDENCE = 25, 8, 0.8


def _stretches(bounds: list, langs: np.ndarray, conf: np.ndarray, letters: np.ndarray, full: list[bool]) -> list[tuple[int, int, str, float]]:
    """Longest runs of one language; what is no full sentence of its own joins its neighbours."""
    runs: list[list] = []
    lead = 0
    for (a, b), lang, c, n, ok in zip(bounds, langs, conf, letters, full):
        if not ok:
            if runs:
                runs[-1][1] = b
            continue
        if runs and runs[-1][2] == lang:
            runs[-1][1], runs[-1][3], runs[-1][4] = b, runs[-1][3] + c * n, runs[-1][4] + n
        else:
            runs.append([a if runs else lead, b, lang, c * n, n])
    return [(r[0], r[1], LANGUAGES[r[2]], float(r[3] / max(r[4], 1))) for r in runs]


_SEGMENT = T.StructType().add("start", "integer").add("end", "integer").add("lang", "string").add("confidence", "double")
_FOUND = (
    T.StructType().add("lang", "string").add("confidence", "double").add("ambiguous", "boolean").add("full_sentences", "integer").add("signs", T.ArrayType(T.LongType()))
    .add("segments", T.ArrayType(_SEGMENT))
)


def detect(texts: list[str], decoder: Decoder) -> list[tuple]:
    """One tuple per text in the order of _FOUND."""
    out: list[tuple] = []
    held: list[tuple[str, list]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        starts, at, parts = [], 0, []
        for text, bounds in held:
            starts += [at + a for a, _ in bounds]
            parts += text, "\n"
            at += len(text) + 1
        if starts:
            sums, letters, han = decoder.scores("".join(parts), np.array(starts))
            langs, conf, unsure = decoder.decode(sums, letters, han)
        sizes = np.array([len(b) for _, b in held])
        some = np.flatnonzero(sizes)
        if len(some):
            doc = np.repeat(np.arange(len(held)), sizes)
            first = np.cumsum(sizes)[some] - sizes[some]
            dl, dh = np.add.reduceat(letters, first), np.add.reduceat(han, first)
            whole, sure, open_ = (x.tolist() for x in decoder.decode(np.add.reduceat(sums, first, axis=0), dl, dh))
            signs = np.bincount(doc * len(LANGUAGES) + langs, weights=letters, minlength=len(held) * len(LANGUAGES)).astype(np.int64)
            signs = signs.reshape(-1, len(LANGUAGES)).tolist()
            enough = ((letters >= np.where(langs == 1, FULL_HAN, FULL_LETTERS)) & (conf >= FULL_CONFIDENCE) & ~unsure).tolist()
            langs, conf, letters = langs.tolist(), conf.tolist(), letters.tolist()
        i = k = 0
        for d, (text, bounds) in enumerate(held):
            n = len(bounds)
            if not n:
                out.append((None, 0.0, True, 0, [0] * len(LANGUAGES), []))
                continue
            ls = langs[i : i + n]
            full = [enough[i + j] and _FULL.search(text, max(a, b - 12), b) is not None for j, (a, b) in enumerate(bounds)]
            if not dl[k]:
                out.append((None, 0.0, True, 0, signs[d], []))
            else:
                kinds = {x for x, f in zip(ls, full) if f}
                if len(kinds) > 1:
                    segments = _stretches(bounds, ls, conf[i : i + n], letters[i : i + n], full)
                else:
                    segments = [(0, len(text), LANGUAGES[kinds.pop() if kinds else whole[k]], sure[k])]
                out.append((LANGUAGES[whole[k]], sure[k], open_[k], sum(full), signs[d], segments))
            i += n
            k += 1
        held, size = [], 0

    for text in texts:
        held.append((text, sentences(text)))
        size += len(text)
        if size > SCORED:
            flush()
    flush()
    return out


def detect_languages(df: DataFrame, text: str, counts: DataFrame, out: str = "found") -> DataFrame:
    """Adds `out`: lang, confidence, ambiguous, full_sentences, signs (letters per language of
    LANGUAGES, by sentence) and segments (start, end, lang, confidence; one for a text in one language).

    Null, empty and letterless texts have lang null, confidence 0 and no segments. A text of
    several languages has the one that fits it best as a whole. Other columns pass through.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(counts.toPandas()))  # SIZE x 10 numbers at most

    @F.pandas_udf(_FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(model.value)
        for texts in batches:
            yield pd.DataFrame(detect(list(texts), decoder), columns=_FOUND.names)

    return df.withColumn(out, run(F.coalesce(F.col(text), F.lit(""))))


def label_code(label: Column) -> Column:
    """Column: code of a label in any spelling, null where it names none."""
    aliases = F.create_map(*[F.lit(x) for kv in _ALIASES.items() for x in kv])
    low = F.lower(F.trim(label))
    head = F.split(low, r"[-_ ]")[0]
    return F.when(~low.isin(*MISSING), F.coalesce(F.try_element_at(aliases, low), F.try_element_at(aliases, head), head))


def check_labels(df: DataFrame, row_id: str, text: str, label: str, counts: DataFrame) -> DataFrame:
    """row_id, label_code, found (see detect_languages) and kind of the text where it matters.

    kind is looked up for texts whose label is missing or differs and for texts with several
    segments, null for the rest; only kind prose makes a case. Copies stay copies.
    """
    seen = detect_languages(df.select(F.col(row_id), F.col(text).alias("_t"), label_code(F.col(label)).alias("label_code")), "_t", counts)
    lang = F.col("found.lang")
    doubt = (F.size("found.segments") > 1) | (lang.isNotNull() & (F.col("label_code").isNull() | (F.col("label_code") != lang)))
    return seen.withColumn("kind", text_kind(F.when(doubt, F.col("_t")))).drop("_t")
