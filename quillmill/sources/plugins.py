"""Plug-ins: functions a caller may bring for extraction, embedding, reranking and answers, with offline defaults.

A plug-in is a plain function over a batch; the wrappers run it per Arrow batch, in order, and check its answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RERANK_BATCH = 128


def hashed_vectors(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Offline embedding: words hashed to signed places, unit length; a text without words gives zeros."""
    out = np.zeros((len(texts), dims))
    for row, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[row, h % dims] += 1.0 if h >> 63 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0).tolist()


def retrying(call: Callable, retries: int = 2, wait: float = 1.0) -> Callable:
    """`call` again after a timeout, waiting longer each time."""

    def run(*args):
        for n in range(retries + 1):
            try:
                return call(*args)
            except TimeoutError:
                if n == retries:
                    raise
                time.sleep(wait * (n + 1))

    return run


def embed_with(call: Callable[[list[str]], list[list[float]]] = hashed_vectors, batch: int = 64) -> Callable[[DataFrame, str, str], DataFrame]:
    """embed(df, text, out): adds vectors. Blank texts get null and are not sent; another number of answers than texts is an error."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            for a in range(0, len(full), batch):
                part = full[a : a + batch]
                got = call([texts.iloc[i] for i in part])
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
                for i, v in zip(part, got):
                    out[i] = list(map(float, v))
            yield pd.Series(out, dtype=object)

    return lambda df, text, out: df.withColumn(out, run(F.col(text)))


def rerank_with(call: Callable[[str, list[str]], list[tuple[int, float]]], documents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """rerank(candidates): q_id, position, relevance from `call(query, texts)`; at most RERANK_BATCH candidates per question, which ranking cuts before.

    `documents` has q_id, query, chunk_id, text for the candidates. Blank texts keep their place. A failing call gives no rows, which leaves the fused order.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").head(RERANK_BATCH)
        try:
            got = call(rows["query"].iloc[0], rows["text"].fillna("").tolist())
        except Exception:  # noqa: BLE001
            got = []
        out = [(rows["q_id"].iloc[0], int(p), float(s)) for p, s in got if 0 <= int(p) < len(rows)]
        return pd.DataFrame(out, columns=["q_id", "position", "relevance"])

    def rerank(candidates: DataFrame) -> DataFrame:
        kind = candidates.schema["q_id"].dataType.simpleString()
        joined = candidates.select("q_id", "chunk_id", "rank").filter(F.col("rank") <= RERANK_BATCH).join(documents, ["q_id", "chunk_id"], "left")
        return joined.groupBy("q_id").applyInPandas(one, f"q_id {kind}, position int, relevance double")

    return rerank


def split_text_extractor(content: bytes) -> list[tuple[int, int, str]]:
    """Offline extractor of plain text: (page_number, block_index, text) of form-feed pages and blank-line blocks."""
    out, n = [], 0
    for page, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for block in text.split("\n\n"):
            if block.strip():
                out.append((page, n, block.strip()))
                n += 1
    return out


def extract_with(documents: DataFrame, call: Callable[[bytes], list[tuple[int, int, str]]] = split_text_extractor) -> DataFrame:
    """content_hash, page_number, block_index, text of every document; a failing document gives one row with its error and null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, c in zip(b["content_hash"], b["content"]):
                try:
                    out += [(h, p, i, t, None) for p, i, t in call(bytes(c))]
                except Exception as e:  # noqa: BLE001
                    out.append((h, None, None, None, f"{type(e).__name__}: {e}"[:160]))
            yield pd.DataFrame(out, columns=["content_hash", "page_number", "block_index", "text", "error"]).astype({"page_number": "Int32", "block_index": "Int32"})

    return documents.select("content_hash", "content").mapInPandas(run, "content_hash string, page_number int, block_index int, text string, error string")
