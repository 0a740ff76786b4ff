"""Several values packed in one field: one row per value, with its position.

Unmistakable separators cut a field into segments. Inside a segment commas and conjunctions may
separate values or belong to one ("Family, Given"; "Institute of A and B, Branch"). Expectation-
maximisation learns how frequent values and value shapes are in the whole column, first from
spans that leave no choice (quoted spans, segments of one piece), then from all, until the frequencies stand
still; a Viterbi lattice over the pieces of each segment picks the likeliest split. Quoted spans are atoms.
Left to itself, the likeliest model takes names that often stand together for one; so each separator inside a
value has a price, the share of separators that certain spans hold, and the frequency of a value with
separators inside is learned from certain spans alone.

A span of more than SPAN pieces is an edge of the lattice only if its shape stands among the certain spans: the model
gives an unknown longer span no more than its parts, so leaving it out changes no split.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut

#: Pieces up to which a span of any shape may be one value.
SPAN = 4
#: Expectation-maximisation stops when less than this share of the shape frequencies moves, or after so many rounds.
STILL, ROUNDS = 1e-3, 12
#: Shape frequencies are held in so many cells (hashed; 8 MB whatever the column holds).
CELLS = 1 << 20
#: Parts into which the lattices of one value are split where they meet its frequency.
SALT = 8
_MARK = re.compile(r'[";；|\n\r\t•、，　·/,&]|[au]nd(?<=\s[au]nd)(?=\s)')
_HARD = frozenset(";；|\n\r\t•、，　")
_SPACE, _CAPITAL, _COMMA = re.compile(r"\s*"), re.compile(r"\s*[A-Z一-鿿]"), re.compile(r",\s*(?:and\s+|und\s+|&\s*)?")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.|"")*)"(?=\s*(?:[;；|\n\r\t•、，　,&/·]|and\s|et\s+al|$))')
_NOBODY = re.compile(r"(?i)^[\s.]*(?:et\s+al\.?|and\s+others|others|u\.\s?a\.|y\s+otros|等|等人)?[\s.]*$")
_TAIL = re.compile(r"(?i)[\s,]*\bet\s+al\.?\s*$")
_WORD = re.compile(r"[^\s,&]+|,|&")


def pieces(field: str) -> list[list[tuple[str, bool, str]]]:
    """Segments of a field, each a list of (text, quoted, separator before it)."""
    s = field.strip()
    if len(s) > 1 and s[0] == "[" and s[-1] == "]":
        s = s[1:-1]
    segments: list[list[tuple[str, bool, str]]] = [[]]
    start, before = 0, ""

    def take(text: str, quoted: bool) -> None:
        text = text.strip()
        if not quoted:
            text = _TAIL.sub("", text).strip()
        if text and (quoted or not _NOBODY.match(text)):
            segments[-1].append((text, quoted, before if segments[-1] else ""))

    m = _MARK.search(s)
    while m:
        at, sign, end = m.start(), m.group(), m.end()
        if sign == '"':
            q = _QUOTED.match(s, at) if not s[start:at].strip() else None
            if q:
                take(re.sub(r"\\(.)", r"\1", q.group(1).replace('""', '"')), True)
                start = end = q.end()
        elif (
            sign in _HARD
            or sign == "·" and at > start and s[at - 1].isspace() and s[end : end + 1].isspace()
            or sign == "/" and (not "a" <= s[at - 1 : at] <= "z" or _CAPITAL.match(s, end))
        ):
            take(s[start:at], False)
            segments.append([])
            start = end = _SPACE.match(s, end).end()
            before = ""
        elif sign in ",&" or sign in ("and", "und") and at > start:
            take(s[start:at], False)
            left = at
            while left > start and s[left - 1].isspace():
                left -= 1
            start = end = (_COMMA.match(s, at) if sign == "," else _SPACE.match(s, end)).end()
            before = s[left:start]
        m = _MARK.search(s, end)
    take(s[start:], False)
    return [x for x in segments if x]


def shape(value: str) -> str:
    """Form of a value: W word, I initials, p small word, Z Chinese run, signs as they are."""
    out = []
    for w in _WORD.findall(value):
        bare = w.strip("\"'.")
        if w in ",&":
            out.append(w)
        elif re.fullmatch(r"[A-ZÀ-Þ](?:\.?-?[A-ZÀ-Þ]){0,2}\.?", w):
            out.append("I")
        elif re.fullmatch(r"[㐀-鿿]+", w):
            out.append("Z")
        elif bare[:1].islower() and not re.match(r"[a-z]+['’][A-ZÀ-Þ]", bare):
            out.append("&" if bare in ("and", "und") else "p")
        else:
            out.append("W")
    return "".join(out)


def _key(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def _cell(form: str) -> int:
    return xxhash.xxh32_intdigest(form.encode()) % CELLS


class Lattice:
    """Spans of the pieces of one segment that may be one value."""

    def __init__(self, segment: list[tuple[str, bool, str]], certain: np.ndarray, longest: int):
        self.segment, n = segment, len(segment)
        forms = [shape(t) for t, _, _ in segment]
        seps = [shape(d) for _, _, d in segment]
        self.edges: list[tuple[int, int]] = []
        self.cells: list[int] = []
        self.words: list[int] = []
        for i, (_, quoted, _) in enumerate(segment):
            form = forms[i]
            self._add(i, i + 1, form)
            for j in range(i + 1, min(n, i + max(SPAN, longest))):
                if quoted or segment[j][1]:
                    break
                form += seps[j] + forms[j]
                if j - i < SPAN or certain[_cell(form)]:
                    self._add(i, j + 1, form)

    def _add(self, i: int, j: int, form: str) -> None:
        self.edges.append((i, j))
        self.cells.append(_cell(form))
        self.words.append(max(1, sum(map(form.count, "WIpZ"))))

    def value(self, i: int, j: int) -> str:
        return _joined(self.segment, i, j)


def _logs(i, j, cells, words, shapes: np.ndarray, total: float, kinds: int, inner_cost: float, known) -> np.ndarray:
    """Log-probability of each edge: half by the value's own frequency, half by its shape and words, times the price of its separators."""
    inner = np.asarray(j) - i - 1
    p = math.log(0.5 / (total + 0.01 * (kinds + 1))) + np.log(shapes[cells] + 0.01) - np.asarray(words) * _WORD_COST
    if known is not None:
        for x in known:
            p[x["at"]] = np.logaddexp(p[x["at"]], math.log(0.5 * x["c"] / total))
    return p - inner * inner_cost


def _joined(segment: list[tuple[str, bool, str]], i: int, j: int) -> str:
    return "".join((segment[i][0], *(d + t for t, _, d in segment[i + 1 : j])))


_INNER = re.compile(",&|,|&")
_WORD_COST = math.log(1e3)


def _expect(n: int, i: list[int], j: list[int], p: list[float]) -> list[float]:
    """Posterior of each edge (from i to j, log-probability p, in order of i) in the lattice over n pieces."""
    ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = back[n] = 0.0
    for a, b, x in zip(i, j, p):
        x += ahead[a]
        m, y = (x, ahead[b]) if x > ahead[b] else (ahead[b], x)
        ahead[b] = m + math.log1p(math.exp(y - m)) if m > -math.inf else m
    for a, b, x in zip(reversed(i), reversed(j), reversed(p)):
        x += back[b]
        m, y = (x, back[a]) if x > back[a] else (back[a], x)
        back[a] = m + math.log1p(math.exp(y - m)) if m > -math.inf else m
    return [math.exp(ahead[a] + x + back[b] - ahead[n]) for a, b, x in zip(i, j, p)]


def _best(n: int, i: list[int], j: list[int], p: list[float]) -> list[tuple[int, int]]:
    """Spans of the likeliest path; ties go to the shorter first value."""
    score: list[int] = [0] * (n + 1)
    at = [0.0] + [-math.inf] * n
    for a, b, x in zip(i, j, p):
        if at[a] + x > at[b]:
            at[b], score[b] = at[a] + x, a
    out, b = [], n
    while b:
        out.append((score[b], b))
        b = score[b]
    return out[::-1]


def split_values(df: DataFrame, row_id: str, field: str) -> DataFrame:
    """row_id, pos (INT, from 1), value: every value of each field.

    Null, blank and empty fields give no row; empty places and "et al." take no position; a value
    named twice counts twice. Rows with equal id and field count once; different fields under
    one id are numbered one after the other. Values come as written, without outer spaces and quotes.
    Equal segments are counted before anything else, so a field that most rows share is one row here. Values and
    segments meet by 64 and 128 bit digests, so only narrow rows are shuffled.
    """
    kind = df.schema[row_id].dataType.simpleString()
    sc = df.sparkSession.sparkContext

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, f in zip(b["_r"], b["_f"]):
                field = xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass"))
                for k, seg in enumerate(pieces(f)):
                    packed = "\x1e".join(f"{int(q)}\x1f{d}\x1f{t}" for t, q, d in seg)
                    out.append((r, field, k, xxhash.xxh3_128_digest(packed.encode("utf-8", "surrogatepass")), packed, len(seg)))
            yield pd.DataFrame(out, columns=["_r", "_f", "_k", "_d", "_seg", "_n"]).astype({"_k": "int32", "_n": "int32"})

    rows = df.filter(F.col(field).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).alias("_r"), F.col(field).alias("_f")).distinct()
    parts = cut(rows.mapInPandas(cut_up, f"_r {kind}, _f binary, _k int, _d binary, _seg string, _n int"))
    segments = cut(parts.groupBy("_d", "_n").agg(F.count("*").alias("_m"), F.min("_seg").alias("_seg")))

    def read(seg: str) -> list[tuple[str, bool, str]]:
        return [(t, q == "1", d) for q, d, t in (x.split("\x1f", 2) for x in seg.split("\x1e"))]

    def certain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values, cells, longest, inner, between = [], {}, 0, 0, 0
            for seg, m in zip(b["_seg"], b["_m"]):
                s = read(seg)
                between += m * (len(s) - 1)
                for t, q, _ in s:
                    if q or len(s) == 1:
                        form = shape(t)
                        inner += m * len(_INNER.findall(form))
                        values.append(_key(t))
                        cells[_cell(form)] = cells.get(_cell(form), 0.0) + m
                        longest = max(longest, 1 + form.count(",") + form.count("&"))
            yield pd.DataFrame({"what": 0, "key": values, "n": 1.0, "most": 1.0})
            yield pd.DataFrame({"what": 1, "key": list(cells), "n": list(cells.values()), "most": float(longest)})
            yield pd.DataFrame({"what": 2, "key": [0, 1], "n": [float(inner), float(between)], "most": 0.0})

    found_schema = "what int, key long, n double, most double"

    def added(found: DataFrame) -> DataFrame:
        return cut(found.groupBy("what", "key").agg(F.sum("n").alias("n"), F.max("most").alias("most")))

    def table(found: DataFrame) -> np.ndarray:
        got = found.filter("what = 1").select("key", "n").toPandas()  # at most CELLS rows
        cells = np.zeros(CELLS)
        cells[got["key"].to_numpy(np.int64)] = got["n"]
        return cells

    sure = added(segments.mapInPandas(certain, found_schema))
    longest = int(sure.filter("what = 1").agg(F.max("most")).first()[0] or 1)
    counted = {r["key"]: r["n"] for r in sure.filter("what = 2").collect()}  # two numbers
    inner, between = counted.get(0, 0.0), counted.get(1, 0.0)
    inner_cost = -math.log((inner + 1) / (inner + between + 2))
    shapes = table(sure)
    held = sc.broadcast(shapes > 0)

    def lattice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, seg in zip(b["_d"], b["_seg"]):
                x = Lattice(read(seg), held.value, longest)
                out.append((d[0] % SALT, [i for i, _ in x.edges], [j for _, j in x.edges], [_key(x.value(i, j)) for i, j in x.edges], x.cells, x.words))
            yield pd.concat((b, pd.DataFrame(out, columns=["_z", "i", "j", "keys", "cells", "words"], index=b.index).astype({"_z": "int32"})), axis=1)

    # the lattice of a segment is laid once, later rounds read its numbers
    several = cut(segments.filter("_n > 1").mapInPandas(
        lattice, "_d binary, _n int, _m long, _seg string, _z int, i array<int>, j array<int>, keys array<long>, cells array<int>, words array<int>"
    ))
    edges = several.select("_d", "_z", "i", "j", F.posexplode("keys").alias("at", "key"))
    edges = edges.select("_d", "_z", "at", "key", (F.get("j", "at") == F.get("i", "at") + 1).alias("one"))

    def salted(values: DataFrame) -> DataFrame:
        return values.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))

    # a value of one piece can be frequent where it stands in two segments, one of several where it is certain in another
    stands = edges.filter("one").select("key", F.lit(1).alias("_c")).unionByName(sure.filter("what = 0").select("key", F.lit(2).alias("_c")))
    often = stands.groupBy("key").agg(F.sum("_c").alias("_c")).filter("_c > 1").select("key")
    edges = cut(edges.drop("one").join(salted(often), ["key", "_z"]))

    def weighed(seen: DataFrame) -> DataFrame:
        """Segments with the frequency of each of their spans that other segments hold."""
        # the largest share of one segment does not count
        values = seen.filter("what = 0").select("key", (F.col("n") - F.col("most")).alias("c")).filter("c > 0.01")
        met = edges.join(salted(values), ["key", "_z"]).groupBy("_d").agg(F.collect_list(F.struct("at", "c")).alias("e"))
        return several.join(met, "_d", "left")

    def rounds(seen: DataFrame, shapes: np.ndarray):
        some = np.flatnonzero(shapes)
        model = sc.broadcast((some.astype(np.int32), shapes[some]))
        total, kinds = max(float(shapes.sum()), 1.0), int(np.count_nonzero(shapes))

        def dense() -> np.ndarray:
            cells = np.zeros(CELLS)
            cells[model.value[0]] = model.value[1]
            return cells

        def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shapes = dense()
            for b in batches:
                values, cells = [], {}
                for n, m, i, j, keys, at, words, e in zip(b["_n"], b["_m"], b["i"], b["j"], b["keys"], b["cells"], b["words"], b["e"]):
                    logs = _logs(i, j, at, words, shapes, total, kinds, inner_cost, e).tolist()
                    i, j, own = i.tolist(), j.tolist(), {}
                    for x, y, key, cell, p in zip(i, j, keys.tolist(), at.tolist(), _expect(n, i, j, logs)):
                        if p > 1e-4:
                            if y == x + 1:
                                own[key] = own.get(key, 0.0) + p
                            cells[cell] = cells.get(cell, 0.0) + p * m
                    values += own.items()
                yield pd.DataFrame({"what": 0, "key": [k for k, _ in values], "n": [p for _, p in values], "most": [p for _, p in values]})
                yield pd.DataFrame({"what": 1, "key": list(cells), "n": list(cells.values()), "most": 0.0})

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shapes = dense()
            for b in batches:
                best = []
                for seg, n, i, j, at, words, e in zip(b["_seg"], b["_n"], b["i"], b["j"], b["cells"], b["words"], b["e"]):
                    logs = _logs(i, j, at, words, shapes, total, kinds, inner_cost, e).tolist()
                    segment = read(seg)
                    best.append([_joined(segment, x, y) for x, y in _best(n, i.tolist(), j.tolist(), logs)])
                yield pd.DataFrame({"_d": b["_d"], "values": best})

        return weighed(seen), expected, decide

    seen = sure
    for _ in range(ROUNDS):
        lattices, expected, _ = rounds(seen, shapes)
        seen = added(sure.unionByName(lattices.mapInPandas(expected, found_schema)))
        before, shapes = shapes, table(seen)
        if np.abs(shapes - before).sum() <= STILL * max(shapes.sum(), 1.0):
            break
    lattices, _, decide = rounds(seen, shapes)
    chosen = lattices.mapInPandas(decide, "_d binary, values array<string>")
    single = parts.filter("_n = 1").select("_r", "_f", "_k", F.lit(0).alias("_p"), F.substring_index("_seg", "\x1f", -1).alias("value"))
    split = parts.filter("_n > 1").select("_r", "_f", "_k", "_d").join(chosen, "_d").select("_r", "_f", "_k", F.posexplode("values").alias("_p", "value"))
    order = Window.partitionBy("_r").orderBy("_f", "_k", "_p")
    return single.unionByName(split).select(F.col("_r").alias(row_id), F.row_number().over(order).alias("pos"), F.col("value"))
