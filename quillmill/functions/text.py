"""Text functions as Column expressions: tokens, scripts, query terms, clips, table text.

Null counts as an empty text unless said otherwise. Word characters are Unicode letters, digits
and the underscore; white space is Unicode white space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = r"\p{L}\p{N}_"
_ON, _OFF = rf"(?<![{_W}])", rf"(?![{_W}])"  # word boundaries that do not depend on the Java version

# Patterns of terms that are matched exactly, in their order.
TERM_PATTERNS = (
    rf"(?i){_ON}(?:table|tab\.?|figure|fig\.?)\s*[0-9]+[a-z]?{_OFF}",
    rf"{_ON}[A-Z]{{2,}}(?:[-/][A-Z0-9]+)*(?:[0-9]+[A-Z0-9/-]*)?{_OFF}",
    rf"{_ON}[A-Za-z]+(?:-[A-Za-z0-9]+)+{_OFF}",
    rf"{_ON}[A-Za-z0-9]+(?:/[A-Za-z0-9]+)+{_OFF}",
    rf"{_ON}[A-Za-z]*[0-9]+[A-Za-z0-9-]*{_OFF}",
)
LATIN_TOKEN = rf"{_ON}[A-Za-z][A-Za-z0-9-]{{2,}}{_OFF}"
# Words that point at a table's body.
TABLE_FOCUS = (
    "(?iu)(研究组|对照组|实验组|干预前|干预后|治疗前|治疗后|组别|stimulation|sham|baseline|post[- ]?(?:treatment|intervention)|pre[- ]?(?:treatment|intervention)"
    "|theta|beta|smr|frequency|score|p-?value|频率|评分|显著性)"
)
TABLE_VALUE = "(?iu)(?:[αβγθδμσχ]|SMR|P值|p-?value|频率|评分|均数|标准差|mean|sd|x±s|χ2|t检验)"
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"
# What Chinese wording of a question adds to its English form.
QUESTION_RULES = (
    ("研究设计|试验设计|研究方法", ("study design",)),
    ("主要结局|主要终点|主要结局指标", ("primary outcome measure",)),
    ("年龄范围|年龄段|纳入.*年龄", ("age range",)),
    ("样本量|受试者|参与者", ("sample size", "participants")),
    ("完成研究|最终完成", ("completed participants",)),
    ("干预|刺激|治疗", ("intervention",)),
    ("对照组|对照条件|安慰剂|假刺激", ("control group",)),
    ("量表", ("scale",)),
    ("副作用|不良反应|安全性", ("adverse events", "side effects")),
    ("显著性|p值|p-value|P值", ("p-value", "statistical significance")),
    ("基线", ("baseline",)),
)
STRUCTURE_RULES = (("显著性|p值|P值", "p-value"), ("基线", "baseline"), ("量表", "scale"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(rf"([{_W}]+)"), 1)


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(text), r"(?U)\s+", " "))


def clip(text: Column, size: int) -> Column:
    """Squeezed text of at most `size` signs, cut ones with three dots."""
    s = squeeze(text)
    return F.when(F.length(s) <= size, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, size)), F.lit("...")))


def preview(text: Column, size: int = 80) -> Column:
    """Like clip, but the dots count."""
    s = squeeze(text)
    return F.when(F.length(s) <= size, s).otherwise(F.concat(F.substring(s, 1, size - 3), F.lit("...")))


def excerpt(text: Column, default: str, size: int = 24) -> Column:
    """Clip for titles; an empty text gives the default."""
    s = squeeze(text)
    return F.when(F.length(s) == 0, F.lit(default)).otherwise(clip(text, size))


def han_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit("[一-鿿]"))


def latin_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit("[A-Za-z]"))


def han_dominant(text: Column) -> Column:
    h = han_count(text)
    return (h > 0) & (h >= F.greatest(latin_count(text) * 2, F.lit(8)))


def question_language(text: Column) -> Column:
    """unknown (blank), zh, mixed or en."""
    h, a = han_count(text), latin_count(text)
    return (
        F.when(F.length(squeeze(text)) == 0, "unknown").when(h > a, "zh").when((h > 0) & (a > 0), "mixed").when(h > 0, "zh").otherwise("en")
    )


def distinct_strings(values: Column) -> Column:
    """Squeezed strings without blanks, the first spelling of each (letter case apart), in order."""
    clean = F.filter(F.transform(values, squeeze), lambda x: F.length(x) > 0)
    return F.aggregate(
        clean, no_strings(), lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.array_append(seen, x))
    )


def longest_first(terms: Column) -> Column:
    """By length, longest first; equal lengths keep their order."""
    keyed = F.transform(terms, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _terms_in_order(query: Column) -> Column:
    raw = [F.regexp_extract_all(text_or_empty(query), F.lit(f"({p.replace('(?i)', '')})" if not p.startswith("(?i)") else f"(?i)({p[4:]})"), 1) for p in TERM_PATTERNS]
    trimmed = F.transform(F.concat(*raw), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[ \t\r\n.,;:()\[\]{}]+|[ \t\r\n.,;:()\[\]{}]+$", ""), r"\s+", " "))
    kept = F.filter(trimmed, lambda x: F.length(x) >= 2)
    latin = F.when(text_or_empty(query).rlike(r"[^\x00-\x7F]"), F.regexp_extract_all(text_or_empty(query), F.lit(f"({LATIN_TOKEN})"), 1)).otherwise(no_strings())
    return distinct_strings(F.concat(kept, latin))


def exact_terms(query: Column) -> Column:
    """Terms to be matched as written: tables, figures, acronyms, compounds, codes; longest first."""
    return longest_first(_terms_in_order(query))


def focus_terms(query: Column) -> Column:
    """Exact terms and words that point at a table's body; longest first."""
    found = F.transform(F.regexp_extract_all(text_or_empty(query), F.lit(TABLE_FOCUS), 1), strip)
    return longest_first(distinct_strings(F.concat(exact_terms(query), found)))


def asks_for_table(query: Column) -> Column:
    q = text_or_empty(query)
    return q.rlike(rf"(?i){_ON}(?:table|tab\.?|figure|fig\.?)\s*[0-9]+") | q.rlike(r"[表图]\s*[0-9]+")


def exact_heavy(query: Column, terms: Column | None = None) -> Column:
    terms = exact_terms(query) if terms is None else terms
    return F.when(asks_for_table(query), True).when(han_dominant(query), False).otherwise(F.size(terms) >= 2)


def structure_terms(query: Column) -> Column:
    q = text_or_empty(query)
    fixed = F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(t)) for p, t in STRUCTURE_RULES]))
    found = lambda sign, word: F.transform(F.regexp_extract_all(q, F.lit(rf"{sign}\s*([0-9]+)"), 1), lambda n: F.concat(F.lit(word), n))
    numbered = [found("表", "Table "), found("图", "Figure ")]
    return distinct_strings(F.concat(fixed, *numbered))


def template_terms(query: Column) -> Column:
    q = text_or_empty(query)
    return distinct_strings(F.flatten(F.array(*[F.when(q.rlike(p), F.lit(list(t))).otherwise(no_strings()) for p, t in QUESTION_RULES])))


def english_query(query: Column, terms: Column) -> Column:
    """First eight of the English-looking exact terms, the template terms and the structural terms, joined."""
    english = F.filter(terms, lambda x: x.rlike("[A-Za-z]"))
    return F.array_join(F.slice(distinct_strings(F.concat(english, template_terms(query), structure_terms(query))), 1, 8), " ")


def lexical_overlap(query_tokens: Column, content_tokens: Column) -> Column:
    """Share of the distinct query tokens that the content has; 0 without any."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, content_tokens)) / F.size(q).cast("double"))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(f"({NUMBER})"), 1)


def number_overlap(left: Column, right: Column) -> Column:
    """Share of the distinct numbers of `left` that `right` has; 0 without any."""
    a = F.array_distinct(numbers(left))
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, numbers(right))) / F.size(a).cast("double"))


def looks_like_table_body(text: Column) -> Column:
    t = strip(text_or_empty(text))
    n, digits = F.regexp_count(t, F.lit(NUMBER)), F.regexp_count(t, F.lit(r"\p{Nd}"))
    return (
        ((n >= 3) & t.rlike(TABLE_FOCUS)) | ((n >= 4) & t.rlike(TABLE_VALUE) & (digits >= 8)) | ((digits >= 10) & t.contains("±"))
    )


def has_table_body(block_types: Column, body: Column) -> Column:
    low = F.transform(F.coalesce(block_types, no_strings()), F.lower)
    return F.array_contains(low, "table_like") | looks_like_table_body(body)


def caption_only(block_types: Column, body: Column) -> Column:
    low = F.transform(F.coalesce(block_types, no_strings()), F.lower)
    return (F.size(low) > 0) & (F.size(F.array_except(low, F.array(F.lit("table_caption")))) == 0) & ~looks_like_table_body(body)


# Labels of the lines of a chunk's header and payload.
TITLE_LABEL, SECTION_LABEL, PAGE_LABEL, CONTEXT_LABEL, PARENT_LABEL = "论文标题: ", "章节: ", "页码: ", "上下文补充: ", "章节上下文: "


def context_header(title: Column, section: Column, page_from: Column, page_to: Column) -> Column:
    """Title, section and page lines of a chunk; missing ones are left out."""
    t, s = strip(text_or_empty(title)), strip(text_or_empty(section))
    pages = F.when(page_to.isNotNull() & (page_to != page_from), F.concat_ws("-", page_from, page_to)).otherwise(page_from.cast("string"))
    return F.concat_ws(
        "\n",
        F.when(F.length(t) > 0, F.concat(F.lit(TITLE_LABEL), t)),
        F.when(F.length(s) > 0, F.concat(F.lit(SECTION_LABEL), s)),
        F.when(page_from.isNotNull(), F.concat(F.lit(PAGE_LABEL), pages)),
    )


def chunk_payload(header: Column, body: Column, content: Column, context: Column | None = None, parent: Column | None = None) -> Column:
    """Header and body, with the context and section texts where given; the content where both are blank."""
    h = F.nullif(strip(text_or_empty(header)), F.lit(""))
    b = F.nullif(strip(F.coalesce(F.nullif(body, F.lit("")), content, F.lit(""))), F.lit(""))
    parts = [h, b]
    if context is not None:
        c = F.nullif(strip(text_or_empty(context)), F.lit(""))
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(CONTEXT_LABEL), c)))
    if parent is not None:
        p = F.nullif(strip(text_or_empty(parent)), F.lit(""))
        parts.append(F.when(p.isNotNull(), F.concat(F.lit(PARENT_LABEL), p)))
    joined = F.concat_ws("\n\n", *parts)
    return F.when(F.length(joined) > 0, joined).otherwise(text_or_empty(content))


def table_rows(rows: Column, limit: int = 8) -> Column:
    """First rows of ARRAY<MAP<STRING,STRING>> as lines of "key: value", blank values left out."""
    cells = lambda m: F.filter(F.map_entries(m), lambda e: F.length(strip(text_or_empty(e["value"]))) > 0)
    lines = F.transform(F.slice(F.coalesce(rows, F.array().cast("array<map<string,string>>")), 1, limit), lambda m: F.array_join(F.transform(cells(m), lambda e: F.concat(strip(e["key"]), F.lit(": "), strip(e["value"]))), "; "))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 0), "\n")


def table_text(caption: Column, markdown: Column, rows: Column, limit: int = 8) -> Column:
    """Caption and rows, or the markdown where there are no rows."""
    c, r, m = strip(text_or_empty(caption)), table_rows(rows, limit), strip(text_or_empty(markdown))
    body = F.when(F.length(r) > 0, r).otherwise(m)
    return F.concat_ws("\n", F.nullif(c, F.lit("")), F.nullif(body, F.lit("")))


def compact_lines(text: Column) -> Column:
    """Trimmed lines, runs of blank lines as one, none at the end."""
    lines = F.transform(F.split(text_or_empty(text), "\n"), strip)
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "\n+$", "")


def heading_line(text: Column, level: Column) -> Column:
    n = F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6))
    return F.concat(F.repeat(F.lit("#"), n), F.lit(" "), text)


def normalize_doi(value: Column) -> Column:
    """10.x/y without prefix or resolver address; null for everything else."""
    v = strip(text_or_empty(value))
    v = F.regexp_replace(F.regexp_replace(v, r"(?i)^doi:\s*", ""), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.when(v.rlike(r"^10\.\S+/\S+$"), v)


def valid_url(value: Column) -> Column:
    """The address if it is http or https with a host, else null."""
    v = strip(text_or_empty(value))
    ok = F.lower(F.coalesce(F.try_parse_url(v, F.lit("PROTOCOL")), F.lit(""))).isin("http", "https") & F.try_parse_url(v, F.lit("HOST")).isNotNull()
    return F.when(ok, v)


def fold_fullwidth(text: Column) -> Column:
    """Full-width ASCII and the ideographic space at half width."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.translate(text, wide, "".join(chr(0x21 + i) for i in range(94)) + " ")


def fullwidth_counts(text: Column) -> Column:
    """struct of the five counters of full-width signs."""
    n = lambda p: F.regexp_count(text_or_empty(text), F.lit(p))
    return F.struct(
        n("[！-～]").alias("fullwidth_ascii_count"), n("[Ａ-Ｚａ-ｚ]").alias("fullwidth_latin_count"), n("[０-９]").alias("fullwidth_digit_count"),
        (n("[！-～]") - n("[Ａ-Ｚａ-ｚ]") - n("[０-９]")).alias("fullwidth_ascii_punctuation_count"), n("　").alias("fullwidth_space_count"),
    )


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: inside a code fence, or from the first brace to the last; null without one."""
    t = strip(text_or_empty(text))
    fenced = F.nullif(F.regexp_extract(t, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1), F.lit(""))
    body = F.coalesce(fenced, F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")))
    return F.when(body.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(body).isNotNull(), body)


def png_data_url(image: Column) -> Column:
    """Data address of an image, on one line."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(image), r"\s+", ""))


@F.pandas_udf(T.StringType())
def match_form(texts: pd.Series) -> pd.Series:
    """Text for comparing snippets: compatibility forms, no accents, lower case, one dash, word characters only."""

    def one(t: str) -> str:
        if not t.isascii():
            t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t))
        return "".join(c for c in t.lower() if (c.isalnum() or c == "_") and not unicodedata.combining(c))

    return texts.map(lambda t: one(t) if t else "")
