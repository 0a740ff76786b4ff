"""Per-document text quality statistics and the kind of text they point to.

A long text is cut into pieces at spaces or between two Chinese signs, so no word is cut. Each piece
gives counts of its complete lines and the state of its two open lines (counts, first and last signs) and
of its first and last units (for repetition), which together form a monoid: the pieces of a text
give the figures of the whole text exactly, wherever they are cut. Pieces are merged in two
levels, so one huge document is no long task, and ratios come last.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a piece; a run that cannot be cut makes it longer.
PIECE = 32_768
#: A unit is repeated if it stood among so many units before it.
BACK = 99
#: A text of at most so many different pairs of neighbouring signs is monotonous.
PAIRS = 6
#: Pieces merged in the first level.
FAN = 64
# Frequent words of English, German, French and Spanish, and frequent signs of Chinese.
COMMON = frozenset(
    (
        "the of and in to a was were that with for is are by from this which not at on be as it an or than had has been after we their "
        "der die das und ist war wurde wurden nicht mit von zu den dem des ein eine einer auf für im sich nach bei aus auch wie werden wir "
        "le la les du et est était une dans pour pas avec sur par qui que ont été aux au ce cette nous sont après ne "
        "el los las del y es era fue en para no con por se al su sus han sido este esta como tras sin lo"
    ).split()
)
COMMON_HAN = "的了在是和与为由均后中将被对而及于所有我们可能本"
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
# starts with the signs, so that the search leaps from one to the next
_END = re.compile(r"[.!?。！？](?:(?<=[。！？])|(?<=[^\W\d_][.!?])[.!?]*(?=[\"”’)\]]*(?:\s|$))|(?<=[)%\]\d][.!?])(?=\s|$))")
_COMMON_HAN = re.compile(f"[{COMMON_HAN}]")
_NUMBER = re.compile(r"(?<![^\W_])\d+(?:[.,]\d+)*(?![^\W_])")
_ODD = re.compile("[\x80-\x9f-ÿ�]")
_PRINTED_ENDS = tuple(".!?。！？…:：;；")
_MARKER = re.compile(r"\s*(?:[-*•‣◦▪+–—·]\s+\S|\(?\d{1,3}(?:\.\d{1,3})*[.)、](?!\d)\s*\S|\(?[a-zA-Z][.)]\s*\S|\([ivxlc]+\)\s|\[\d{1,4}\]\s*\S|第\s*\d+\s*[项条点步]|[①-⓿❶-➓]|[（(][一二三四五六七八九十\d]{1,3}[)）]|[一二三四五六七八九十]{1,3}、)")
_GLOSS = re.compile(r"\s*\S[^:：.。!?\t|]{0,40}[:：]\s*\S[^.。!?！？]{0,60}$")
_HEX = frozenset(a + b for a in "0123456789abcdefABCDEF" for b in "0123456789abcdefABCDEF")
_VOWELS = "aeiouyáàâäãéèêëíìîïóòôöõúùûü".encode("latin-1")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)*")
_NOT_HAN = re.compile(r"[^㐀-䶿一-鿿]+")
_RULE = re.compile(r"[|+:=\s-]*\|[|+:=\s-]*")
_DIGIT = re.compile(r"\d")
_SEMI, _COMMA, _GAP = re.compile(r";(?=\S)"), re.compile(r",(?=\S)"), re.compile(r"(?<=\S)[ \u3000]{2,}(?=\S)")
_LONG = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_UNIT = re.compile(r"[㐀-䶿一-鿿]|[^\s㐀-䶿一-鿿]+")
_CUT = re.compile(r"(?<=\S)\s(?=\S)|[㐀-䶿一-鿿](?=[㐀-䶿一-鿿])")
_SPACES = re.compile(r"\s{2,}|[^\S ]")

#: Names of the additive counts of a stretch of text, in order.
COUNTS = (
    "chars", "spaces", "letters", "han", "digits", "words", "word_letters", "common", "common_han", "numbers", "ends", "vowels", "odd", "hex", "long_runs", "covered",
    "pipes", "tabs", "semis", "commas", "gaps",
)
#: Names of the counts of complete lines, in order.
LINES = (
    "lines", "ended", "marked", "marked_chars", "gloss", "gloss_chars", "short", "short_chars", "rows_pipe", "rows_tab", "rows_semi", "rows_comma", "rows_gap", "row_chars",
    "framed", "wordy", "line_chars",
)
_N, _L = len(COUNTS), len(LINES)
_I = {n: i for i, n in enumerate(COUNTS)}
_J = {n: i for i, n in enumerate(LINES)}
HEAD, TAIL = 160, 80


def _measure(s: str) -> list[int]:
    """Additive counts of a stretch without line ends."""
    plain = s.isascii()
    latin = (_ASCII_WORD if plain else _WORD).findall(s)
    han = common_han = odd = 0
    if not plain:
        han, odd = len(_HAN.findall(s)), len(_ODD.findall(s))
        if han:
            latin = [x for w in latin for x in _NOT_HAN.findall(w)]
            common_han = len(_COMMON_HAN.findall(s))
    tokens = s.split()
    sizes = list(map(len, tokens))
    word_sizes = list(map(len, latin))
    letters = sum(word_sizes)
    digits = len(_DIGIT.findall(s))
    numbers = _NUMBER.findall(s) if digits else ()
    low = s.lower()
    western = low.encode("latin-1", "replace")
    return [
        len(s), len(s) - sum(sizes), letters, han, digits, len(latin), letters, sum(map(COMMON.__contains__, map(str.lower, latin))),
        common_han, len(numbers), len(_END.findall(s)), len(western) - len(western.translate(None, _VOWELS)) + (0 if plain else low.count("œ") + low.count("æ")), odd,
        sum(map(_HEX.__contains__, tokens)) if 2 in sizes else 0, sum(map(len, _LONG.findall(s))) if sizes and max(sizes) >= 40 else 0,
        letters - word_sizes.count(1) - 2 * word_sizes.count(2) + sum(map(len, numbers)) + han,
        s.count("|"), s.count("\t"), len(_SEMI.findall(s)) if ";" in s else 0, len(_COMMA.findall(s)) if "," in s else 0,
        len(_GAP.findall(s)) if "  " in s or "\u3000" in s else 0,
    ]


def _open(s: str) -> tuple:
    """State of an open line: counts, first signs, last signs with every run of spaces as one."""
    tail = s[-TAIL:]
    return _measure(s), s[:HEAD], _SPACES.sub(" ", s)[-TAIL:] if _SPACES.search(tail) else tail


def _join(a: tuple, b: tuple) -> tuple:
    """Two neighbouring stretches of one line."""
    return [x + y for x, y in zip(a[0], b[0])], (a[1] + b[1])[:HEAD], (a[2] + (b[2][1:] if a[2][-1:] == " " == b[2][:1] else b[2]))[-TAIL:]


def _close(line: tuple, total: list[int], lines: list[int]) -> None:
    """A complete line goes into the totals."""
    c, head, tail = line
    for i, v in enumerate(c):
        total[i] += v
    tail, chars = tail.rstrip(), c[0] - c[1]
    if chars <= 0:
        return
    lines[_J["lines"]] += 1
    lines[_J["line_chars"]] += chars
    ended = tail.rstrip("\"'”’)]）】」』").endswith(_PRINTED_ENDS)
    lines[_J["ended"]] += ended
    size = c[_I["words"]] + c[_I["han"]] / 2
    prose = ended and (c[_I["common"]] >= 3 or c[_I["common_han"]] >= 2) and size >= 6
    lines[_J["wordy"]] += prose
    row = False
    rule = _RULE.fullmatch(head) is not None
    framed = head.lstrip()[:1] == "|" == tail[-1:]
    for name, hit in (
        ("rows_pipe", c[_I["pipes"]] >= 2 and (rule or framed or c[_I["covered"]] > 0.3 * chars)),
        ("rows_tab", c[_I["tabs"]] >= 1),
        ("rows_gap", c[_I["gaps"]] >= 1),
        ("rows_semi", c[_I["semis"]] >= 1),
        ("rows_comma", c[_I["commas"]] >= 1 and c[_I["common"]] < 3),
    ):
        if hit and not prose:
            lines[_J[name]] += 1
            row = True
    lines[_J["framed"]] += (framed or rule) and c[_I["pipes"]] >= 2
    lines[_J["row_chars"]] += row * chars
    if _MARKER.match(head):
        lines[_J["marked"]] += 1
        lines[_J["marked_chars"]] += chars
    elif not ended and chars <= 100 and _GLOSS.match(head):
        lines[_J["gloss"]] += 1
        lines[_J["gloss_chars"]] += chars
    elif not ended and size <= 9 and not c[_I["ends"]]:
        lines[_J["short"]] += 1
        lines[_J["short_chars"]] += chars


def _repetition(piece: str, joins: bool) -> dict:
    """units, repeated ones, tokens between spaces, and what joining needs: units at both ends, kinds of sign pairs, outer signs.

    A unit is a Chinese sign or a run of other signs between spaces, in lower case.
    """
    low = piece.lower()
    units = tokens = low.split()
    if not low.isascii():
        units = _UNIT.findall(low)
    n = len(units)
    if n <= BACK + 1 and not joins:
        again = [1] * (n - len(set(units)))
    elif n <= BACK + 1:
        seen: set[str] = set()
        again = [u in seen or seen.add(u) is not None for u in units]
    else:
        last: dict[str, int] = {}
        again = []
        for i, u in enumerate(units):
            again.append(i - last.get(u, -BACK - 1) <= BACK)
            last[u] = i
    mark = lambda u: xxhash.xxh3_64_intdigest(u.encode("utf-8", "surrogatepass")) >> 1
    pairs: set[str] = set()
    for x, y in pairwise(piece):
        pairs.add(x + y)
        if len(pairs) > PAIRS:
            break
    return {
        "units": n, "repeats": sum(again), "tokens": len(tokens), "pairs": sorted(pairs), "ends": piece[:1] + piece[-1:],
        "head": [-1 if r else mark(u) for u, r in zip(units[:BACK], again)] if joins else [], "tail": [mark(u) for u in units[-BACK:]] if joins else [],
    }


def _rejoin(a: dict, b: dict) -> dict:
    """Repetition over two neighbouring pieces: the first units of the right one look back into the left one."""
    if not a["ends"] or not b["ends"]:
        return a if a["ends"] else b
    tail, head, found = a["tail"], list(b["head"]), 0
    for j, u in enumerate(head):
        if u >= 0 and u in tail[max(len(tail) - (BACK - j), 0) :]:
            head[j], found = -1, found + 1
    pairs = sorted({*a["pairs"], *b["pairs"], a["ends"][-1] + b["ends"][0]})[: PAIRS + 1]
    cut_through = not a["ends"][-1].isspace() and not b["ends"][0].isspace()
    return {
        "units": a["units"] + b["units"], "repeats": a["repeats"] + b["repeats"] + found, "tokens": a["tokens"] + b["tokens"] - cut_through, "pairs": pairs,
        "ends": a["ends"][0] + b["ends"][-1], "head": (a["head"] + head)[:BACK] if a["units"] < BACK else a["head"], "tail": (tail + b["tail"])[-BACK:],
    }


def summarize(piece: str, joins: bool = True) -> dict:
    """Partial state of one piece; what only joining needs is left out on demand."""
    total, lines = [0] * _N, [0] * _L
    parts = re.split("\r\n|[\n\r\x85\u2028\u2029]", piece)
    state = {"total": total, "lines": lines, "one": len(parts) == 1, "first": _open(parts[0]), "again": _repetition(piece, joins)}
    if len(parts) == 1:
        return state | {"last": ([0] * _N, "", "")}
    for p in parts[1:-1]:
        _close(_open(p), total, lines)
    return state | {"last": _open(parts[-1])}


def merge(a: dict, b: dict) -> dict:
    """State of two neighbouring pieces; associative."""
    total, lines = [x + y for x, y in zip(a["total"], b["total"])], [x + y for x, y in zip(a["lines"], b["lines"])]
    both = {"total": total, "lines": lines, "one": a["one"] and b["one"], "again": _rejoin(a["again"], b["again"])}
    if a["one"]:
        return both | {"first": _join(a["first"], b["first"]), "last": b["last"]}
    if b["one"]:
        return both | {"first": a["first"], "last": _join(a["last"], b["first"])}
    _close(_join(a["last"], b["first"]), total, lines)
    return both | {"first": a["first"], "last": b["last"]}


def cut_text(text: str, piece: int = PIECE) -> Iterator[str]:
    """Pieces of about `piece` signs that make up the text, cut behind a space or between two Chinese signs only."""
    at = 0
    while len(text) - at > piece:
        m = _CUT.search(text, at + piece - 1)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def finish(s: dict) -> dict:
    """Ratios, rule outcomes and kind of a whole text."""
    total, lines = list(s["total"]), list(s["lines"])
    _close(s["first"], total, lines)
    if not s["one"]:
        _close(s["last"], total, lines)
    c, n, again = dict(zip(COUNTS, total)), dict(zip(LINES, lines)), s["again"]
    ink = max(c["chars"] - c["spaces"], 1)
    units = c["words"] + c["han"] / 2
    out = {
        "n_words": c["words"],
        "n_han": c["han"],
        "mean_word_length": c["word_letters"] / c["words"] if c["words"] else 0.0,
        "symbol_ratio": (ink - c["letters"] - c["han"] - c["digits"]) / ink if n["lines"] else 0.0,
        "digit_ratio": c["digits"] / ink,
        "n_lines": n["lines"],
        "end_punct_share": n["ended"] / n["lines"] if n["lines"] else 0.0,
        "common_word_share": (c["common"] + c["common_han"] * 0.5) / units if units else 0.0,
        "sentences": c["ends"],
        "item_share": (n["marked_chars"] + n["gloss_chars"]) / max(n["line_chars"], 1),
        "row_share": n["row_chars"] / max(n["line_chars"], 1),
        "repeat_share": again["repeats"] / max(again["units"], 1),
    }
    out["kind"] = _kind(c, n, again, ink, units, out) if n["lines"] else None
    return out


def _kind(c: dict, n: dict, again: dict, ink: int, units: float, r: dict) -> str:
    k = n["lines"]
    caption = 1 if k >= 3 else 0
    latin_vowels = c["vowels"] / c["letters"] if c["letters"] else 0.4
    readable = c["ends"] >= 1 and r["common_word_share"] >= 0.12
    rows = max(n["rows_pipe"], n["rows_tab"], n["rows_semi"], n["rows_comma"], n["rows_gap"])
    if c["odd"] > 0.15 * ink and c["han"] < 0.2 * ink and c["common"] < 0.15 * max(c["words"], 1):
        return "junk"
    grid = n["framed"] >= 2 and n["framed"] >= 0.7 * (k - caption)
    if c["covered"] < 0.3 * ink and ink >= 12 and not grid:
        return "junk"
    if c["long_runs"] > 0.5 * ink or c["hex"] >= 12 and c["hex"] > 0.7 * again["tokens"]:
        return "junk"
    if n["marked"] >= 2 and n["marked"] >= 0.6 * k and n["marked_chars"] >= 0.5 * n["line_chars"]:
        return "list"
    if rows >= 2 and rows >= 0.7 * (k - caption) and n["wordy"] <= 0.2 * k:
        return "table"
    if again["repeats"] > 0.85 * again["units"] and again["units"] >= 8 or again["tokens"] == 1 and c["chars"] > 40 and len(again["pairs"]) <= PAIRS:
        return "junk"
    if c["letters"] >= 30 and c["letters"] > 3 * c["han"] and latin_vowels < 0.22:
        return "junk"
    marked = n["marked"] + n["gloss"]
    if marked >= 2 and r["item_share"] >= 0.5:
        return "list"
    terms = marked + n["short"]
    if terms >= 3 and terms >= 0.8 * k and not n["wordy"] and c["ends"] <= 0.1 * k:
        return "list"
    if units >= 12 and not readable and r["common_word_share"] < 0.04 and c["ends"] <= units / 40:
        return "junk"
    return "prose"


_OPEN = T.StructType().add("counts", T.ArrayType(T.LongType())).add("head", "string").add("tail", "string")
_AGAIN = (
    T.StructType().add("units", "long").add("repeats", "long").add("tokens", "long").add("pairs", T.ArrayType(T.StringType())).add("ends", "string")
    .add("head", T.ArrayType(T.LongType())).add("tail", T.ArrayType(T.LongType()))
)
_STATE = (
    T.StructType().add("total", T.ArrayType(T.LongType())).add("lines", T.ArrayType(T.LongType())).add("one", "boolean").add("first", _OPEN).add("last", _OPEN)
    .add("again", _AGAIN)
)
_RESULT = T.StructType()
for _name, _kind_of in (
    ("n_words", "long"), ("n_han", "long"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("digit_ratio", "double"), ("n_lines", "long"),
    ("end_punct_share", "double"), ("common_word_share", "double"), ("sentences", "long"), ("item_share", "double"), ("row_share", "double"),
    ("repeat_share", "double"), ("kind", "string"),
):
    _RESULT.add(_name, _kind_of)


def _pack(s: dict) -> dict:
    return s | {k: {"counts": s[k][0], "head": s[k][1], "tail": s[k][2]} for k in ("first", "last")}


def _unpack(s: dict) -> dict:
    o = {k: ([int(x) for x in s[k]["counts"]], s[k]["head"], s[k]["tail"]) for k in ("first", "last")}
    g = s["again"]
    again = {k: int(g[k]) for k in ("units", "repeats", "tokens")} | {k: [int(x) for x in g[k]] for k in ("head", "tail")} | {"pairs": list(g["pairs"]), "ends": g["ends"]}
    return {"total": [int(x) for x in s["total"]], "lines": [int(x) for x in s["lines"]], "one": bool(s["one"]), "again": again} | o


def _fold(states) -> dict:
    whole = None
    for s in states:
        whole = _unpack(s) if whole is None else merge(whole, _unpack(s))
    return whole


def text_quality(df: DataFrame, row_id: str, text: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per row of `df`: `row_id`, n_chars and the statistics (see _RESULT).

    kind is prose, list, table or junk; null for null, empty and blank texts, whose counts are 0
    (n_chars is null with the text). Row ids need not be unique: texts over one piece are merged by id
    and digest of the text, and rows equal in both come back as often as they came. Every text is measured once.
    """
    base = df.select(F.col(row_id).alias("_row"), F.col(text).alias("_t"))
    kind = base.schema["_row"].dataType
    short = F.col("_t").isNull() | (F.length("_t") <= piece)
    result = T.StructType().add("_row", kind).add("n_chars", "long")
    for f in _RESULT:
        result.add(f)

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([finish(summarize(t or "", joins=False)) for t in b["_t"]], columns=_RESULT.names)
            out.insert(0, "_row", b["_row"])
            out.insert(1, "n_chars", pd.array([None if t is None else len(t) for t in b["_t"]], "Int64"))
            yield out

    piece_schema = T.StructType().add("_row", kind).add("_digest", "binary").add("_len", "long").add("_at", "long").add("piece", "string")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, t in zip(b["_row"], b["_t"]):
                digest, held, size = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(), [], 0
                for i, p in enumerate(cut_text(t, piece)):
                    held.append((r, digest, len(t), i, p))
                    size += len(p)
                    if size > 64 * PIECE:
                        yield pd.DataFrame(held, columns=piece_schema.names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=piece_schema.names)

    state_schema = T.StructType([*piece_schema.fields[:4], T.StructField("copies", T.LongType()), T.StructField("state", _STATE)])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["_row", "_digest", "_len", "_at"]].assign(copies=(b["_at"] == 0).astype("int64"), state=[_pack(summarize(t)) for t in b["piece"]])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="x").assign(state=[_pack(_fold(y["state"] for y in x)) for x in b["x"]])

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([finish(_fold(y["state"] for y in x)) for x in b["x"]], columns=_RESULT.names)
            out.insert(0, "_row", b["_row"])
            out.insert(1, "n_chars", b["_len"])
            yield out.loc[out.index.repeat(b["copies"])]

    small = base.filter(short).mapInPandas(direct, result)
    # pieces of one huge text go to many tasks before they are measured
    pieces = base.filter(~short).mapInPandas(cut_up, piece_schema).repartition("_row", "_digest", "_at")
    keys = ["_row", "_digest", "_len"]
    gather = lambda g, at: g.agg(F.sum("copies").alias("copies"), F.array_sort(F.collect_set(F.struct(F.col(at).alias("at"), "state"))).alias("x"))
    first = gather(pieces.mapInPandas(measured, state_schema).groupBy(*keys, F.floor(F.col("_at") / FAN).alias("_g")), "_at")
    merged_schema = T.StructType([*piece_schema.fields[:3], T.StructField("_g", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("state", _STATE)])
    second = gather(first.select(*keys, "_g", "copies", "x").mapInPandas(merged, merged_schema).groupBy(*keys), "_g")
    big = second.mapInPandas(finished, result)
    return small.unionByName(big).withColumnRenamed("_row", row_id)


@F.pandas_udf(T.StringType())
def text_kind(texts: pd.Series) -> pd.Series:
    """Kind of a text at once, without pieces; null for null, empty and blank texts."""
    return texts.map(lambda t: finish(summarize(t, joins=False))["kind"] if t else None, na_action="ignore").astype(object)
