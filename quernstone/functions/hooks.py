"""Where models plug in: tokenizers, embedders and rerankers, with stand-ins that need none."""

import base64
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.metadata import chunk_header

DIMENSION = 64
#: A word, or one sign that is no blank.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f]"
#: Fixed value: how byte-pair vocabularies of this kind part words before merging.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer(Protocol):
    def count(self, text: Column) -> Column:
        """The number of tokens of a text column; null where the tokenizer is not at hand."""


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of ``dimension`` finite float32 numbers per text."""


class Reranker(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        """One number per pair, higher for a better answer."""


class PatternTokenizer:
    """Counts words and signs in the JVM."""

    def __init__(self, pattern: str = TOKEN):
        self.pattern = pattern

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.pattern))


class BytePairTokenizer:
    """Counts and cuts by a byte-pair vocabulary file, whose path is given; ``None`` for no file, and then nothing is counted."""

    def __init__(self, path: str | None):
        self.path = path

    def count(self, text: Column) -> Column:
        if self.path is None:
            return F.lit(None).cast("int")
        path = self.path

        @F.pandas_udf("int")
        def counted(texts: pd.Series) -> pd.Series:
            encoding = byte_pairs(path)
            return texts.map(lambda t: None if t is None else len(encoding.encode_ordinary(t))).astype("Int32")

        return counted(text)


@lru_cache(4)
def byte_pairs(path: str):
    """The encoding of a vocabulary file of base64 tokens and ranks, one pair a line."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte pairs", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_windows(units: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """``(unit_id, window, contents)``: windows of ``size`` byte-pair tokens that step by size - overlap, stripped.

    An overlap of the size or more falls back to a quarter of it.  Null and blank texts give no window, nor
    do windows that are blank or lie wholly within the one before.  A sign cut by a window's edge is left out.
    """
    step = size - (size // 4 if overlap >= size else overlap)
    schema = pa.schema([("unit_id", pa.string()), ("window", pa.int32()), ("contents", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_pairs(path)
        for b in batches:
            out = []
            for unit, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = encoding.encode_ordinary(text.strip())
                starts = range(0, max(1, len(tokens) - (size - step)), step)
                pieces = [encoding.decode(tokens[i : i + size], errors="ignore").strip() for i in starts]
                out += [(unit, k, p) for k, p in enumerate(pieces) if p]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return units.where("contents IS NOT NULL").select("unit_id", "contents").mapInArrow(run, "unit_id string, window int, contents string")


class _Cells(dict):
    """A word's cell, doubled, and 1 more where it counts up."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        self[word] = cell = h % self.dimension * 2 + (h >> 16 & 1)
        return cell


class HashingEmbedder:
    """Words hashed into signed cells and scaled to length 1: deterministic, and near for texts that share words."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        cells = _Cells(self.dimension)  # each word is hashed once a call
        found, ends = array("q"), np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found.extend(map(cells.__getitem__, re.findall(r"[^\W_]+", text.lower())))
            ends[i] = len(found)
        cell = np.array(found)
        at = np.repeat(np.arange(len(texts)) * self.dimension, np.diff(ends, prepend=0)) + (cell >> 1)
        out = np.bincount(at, np.where(cell & 1, 1.0, -1.0), len(texts) * self.dimension).reshape(len(texts), self.dimension)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1.0)).astype(np.float32)


class OverlapReranker:
    """The share of a query's words that a text holds."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
        return [len(words(q) & words(t)) / len(words(q)) if words(q) else 0.0 for q, t in zip(queries, texts, strict=True)]


def embedded(rows: DataFrame, embedder: Embedder, key: str, text: str) -> DataFrame:
    """``(<key>, vector)`` of each text; rows of the wrong shape or with numbers that are not finite are an error, null texts have no row."""
    name = rows.schema[key].dataType
    schema = pa.schema([(key, pa.string() if isinstance(name, T.StringType) else pa.int64()), ("vector", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(embedder.embed(b.column(1).to_pylist()))
            if x.shape != (b.num_rows, embedder.dimension) or x.dtype != np.float32 or not np.isfinite(x).all():
                raise ValueError(f"the embedder gave {x.shape} of {x.dtype}, not {b.num_rows} rows of {embedder.dimension} finite float32")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * embedder.dimension, x.ravel())], schema=schema)

    return rows.where(F.col(text).isNotNull()).select(F.col(key).cast("string" if isinstance(name, T.StringType) else "long").alias(key), text).mapInArrow(run, f"{key} {'string' if isinstance(name, T.StringType) else 'long'}, vector array<float>")


def reranked(rows: DataFrame, reranker: Reranker) -> DataFrame:
    """``(query_id, chunk_id, rerank_score, rerank_fallback)`` of rows ``(query_id, chunk_id, query, text)``.

    Where the reranker fails, a batch keeps null scores and says so, so that the order before it stands.
    """
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.string()), ("rerank_score", pa.float64()), ("rerank_fallback", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                scores = [float(s) for s in reranker.score(b.column(2).to_pylist(), b.column(3).to_pylist())]
                failed = len(scores) != b.num_rows or not all(map(math.isfinite, scores))
            except Exception:  # a model may fail in any way; the search answers without it
                failed = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None] * b.num_rows if failed else scores, pa.float64()), pa.array([failed] * b.num_rows)], schema=schema)

    whole = rows.select(F.col("query_id").cast("long").alias("query_id"), "chunk_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(run, "query_id long, chunk_id string, rerank_score double, rerank_fallback boolean")


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    """What a chunk is embedded from: its header line and its text; never what a search shows."""
    header = F.nullif(chunk_header(title, section), F.lit(""))
    return F.when(header.isNull(), text).otherwise(F.concat(header, F.lit("\n\n"), text))


def minimum_tokens(fraction: float, size: int) -> int:
    """The least tokens of a passage, as a share of the size chunks were cut to; 0 for no such rule."""
    if fraction <= 0:
        return 0
    if size <= 0:
        raise ValueError("a share of the chunk size needs a recorded chunk size")
    return max(1, int(fraction * size))
