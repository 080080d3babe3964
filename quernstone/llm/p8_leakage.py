"""Problem 8: evaluation texts leaking into training text, by winnowing.

Of every window of consecutive k-gram hashes the least is kept, so that any shared run of at least
``minimum_words`` words shares a kept fingerprint.  Shared fingerprints are extended word by word.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.wordstream import WORD, folded, gram_hashes, stream, whole_grams
from quernstone.sources import read_table

MINIMUM_WORDS = 10
GRAM = 5
#: Test sets of up to so many bytes of text travel to every task; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_HIT = "doc_id long, item_id long, matched_words int, doc_word int, item_word int"
_HIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_words", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())])


def winnowed(grams: np.ndarray, inside: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least gram (the last of equals) of every window that lies in one text."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    whole = np.lib.stride_tricks.sliding_window_view(inside, window).all(axis=1)
    at = np.arange(n) + window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(at[whole])


def fingerprints(texts: list[str], minimum: int = MINIMUM_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, text offsets, and the positions and values of the winnowed fingerprints."""
    hashes, offsets = stream([WORD.findall(folded(t)) if t else [] for t in texts])
    grams = gram_hashes(hashes, gram)
    inside = whole_grams(offsets, gram, len(grams))
    # a window must not reach over the end of a text; windows of a text have minimum - gram + 1 grams
    at = winnowed(grams, inside, minimum - gram + 1)
    return hashes, offsets, at, grams[at] if len(at) else np.empty(0, dtype=np.uint64)


class Items:
    """The fingerprints of a test set, sorted for look-up."""

    def __init__(self, ids: list[int], texts: list[str], minimum: int, gram: int):
        self.minimum, self.gram, self.ids = minimum, gram, np.array(ids, dtype=np.int64)
        self.hashes, self.offsets, at, values = fingerprints(texts, minimum, gram)
        order = np.argsort(values, kind="stable")
        self.values, self.at = values[order], at[order]
        self.of = np.searchsorted(self.offsets, self.at, side="right") - 1

    def hits(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """The longest shared run of each (text, item): words, start in the text, start in the item."""
        hashes, offsets, at, values = fingerprints(texts, self.minimum, self.gram)
        first, last = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        covered: dict[tuple[int, int, int], int] = {}
        for f in np.nonzero(last > first)[0].tolist():
            p = int(at[f])
            text = int(np.searchsorted(offsets, p, side="right")) - 1
            low, high = int(offsets[text]), int(offsets[text + 1])
            for s in range(int(first[f]), int(last[f])):
                q, item = int(self.at[s]), int(self.of[s])
                if covered.get((text, item, p - q), -1) >= p:
                    continue
                item_low, item_high = int(self.offsets[item]), int(self.offsets[item + 1])
                back = _run(hashes, p - 1, low - 1, self.hashes, q - 1, item_low - 1, -1)
                forth = _run(hashes, p, high, self.hashes, q, item_high, 1)
                covered[text, item, p - q] = p + forth - 1
                if back + forth >= self.minimum and back + forth > best.get((text, item), (0,))[0]:
                    best[text, item] = (back + forth, p - back - low, q - back - item_low)
        return best


def _run(a: np.ndarray, i: int, i_end: int, b: np.ndarray, j: int, j_end: int, step: int) -> int:
    """How many words agree from i and j on, going by ``step``."""
    n = max(0, min((i_end - i) * step, (j_end - j) * step))
    if not n:
        return 0
    x, y = (a[i : i + n], b[j : j + n]) if step > 0 else (a[i - n + 1 : i + 1][::-1], b[j - n + 1 : j + 1][::-1])
    differ = np.nonzero(x != y)[0]
    return int(differ[0]) if len(differ) else n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_HIT_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HIT_SCHEMA, strict=True)], schema=_HIT_SCHEMA)


def leaks(documents: DataFrame, items: DataFrame, minimum: int = MINIMUM_WORDS, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, item_id, matched_words, doc_word, item_word)``: the longest shared run of each leaking pair.

    - Words are runs of letters and digits of the folded text (case, accents, compatibility forms, line-end and soft hyphens removed).
    - Null texts and ids, and texts of fewer than ``minimum`` words, match nothing; repeated rows count once; extra columns are ignored.
    - A test set whose text is at most ``broadcast_bytes`` is sent to the tasks, and documents are not shuffled at all;
      a larger one is joined by fingerprint and the candidates verified on their texts.
    """
    items = items.select(F.col("item_id").cast("long"), "item_text").where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    documents = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 16), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        rows = items.orderBy("item_id", "item_text").collect()  # bounded by broadcast_bytes
        known = documents.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], minimum, gram))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                found = known.value.hits(b.column(1).to_pylist())
                yield _batch([(ids[t], int(known.value.ids[i]), *hit) for (t, i), hit in found.items()])

        hits = documents.mapInArrow(search, _HIT)
    else:
        hits = _joined(documents, items, minimum, gram)
    best = F.max_by(F.struct("doc_word", "item_word"), F.struct("matched_words", -F.col("doc_word"), -F.col("item_word")))
    return hits.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), best.alias("_at")).select("doc_id", "item_id", "matched_words", "_at.doc_word", "_at.item_word")


def _joined(documents: DataFrame, items: DataFrame, minimum: int, gram: int) -> DataFrame:
    """For test sets of any size: fingerprints are joined, then each candidate pair is verified on its two texts."""
    schema = pa.schema([("id", pa.int64()), ("fingerprint", pa.int64())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets, at, values = fingerprints(b.column(1).to_pylist(), minimum, gram)
            ids = np.array(b.column(0).to_pylist(), dtype=np.int64)
            own = ids[np.searchsorted(offsets, at, side="right") - 1] if len(at) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(values.view(np.int64))], schema=schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, item, passage in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(doc, item, *hit) for hit in Items([item], [passage], minimum, gram).hits([text]).values()]
            yield _batch(rows)

    of_items = items.mapInArrow(prints, "id long, fingerprint long").distinct().withColumnRenamed("id", "item_id")
    of_docs = documents.mapInArrow(prints, "id long, fingerprint long").distinct().withColumnRenamed("id", "doc_id")
    pairs = of_docs.join(of_items, "fingerprint").select("doc_id", "item_id").distinct()
    return pairs.join(documents.distinct(), "doc_id").join(items, "item_id").select("doc_id", "text", "item_id", "item_text").mapInArrow(verify, _HIT)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The longest shared span of each leaking pair."""
    return leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans}


def _words_sql(text: str) -> str:
    """The words of a text as DuckDB has them: line-end hyphenation, invisible signs, ligatures, accents and case undone."""
    joined = f"regexp_replace({text}, '(\\p{{L}})[-‐‑⁃¬\\x{{AD}}][ \\t\\r\\f\\x{{A0}}]*\\n\\s*(\\p{{L}})', '\\1\\2', 'g')"
    visible = f"regexp_replace({joined}, '[\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ß", "ss")):
        visible = f"replace({visible}, '{sign}', '{letters}')"
    return f"regexp_extract_all(lower(regexp_replace(strip_accents({visible}), '[\\x{{300}}-\\x{{36F}}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"


def _runs_sql(key: str, words: str) -> str:
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i : i + 9], ' '))) AS run FROM {words} WHERE len(w) >= 10"


ORACLES = {
    "p8_found": f"""
WITH d AS (SELECT DISTINCT doc_id, {_words_sql("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_words_sql("item_text")} AS w FROM eval_items WHERE item_id IS NOT NULL AND item_text IS NOT NULL),
x AS ({_runs_sql("doc_id", "d")}), y AS ({_runs_sql("item_id", "i")})
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (run)""",
}
