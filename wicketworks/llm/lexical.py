"""Ranked lexical search turned round: the items' inverted index is broadcast and the documents stream through it."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicketworks.llm.common import ceil_div

#: Bytes of item texts whose index is built and broadcast at once.
BLOCK_BYTES = 16 << 20
#: Bytes of a text that are cut into words at once, and cells and postings that are scored at once.
CHUNK, CELLS = 1 << 20, 1 << 20
#: Parts that the heaps of an item are merged in first.
PARTS = 32
#: A-Z lower-cased; what is no letter, digit or byte of a character beyond ASCII is a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z lower-cased, in runs of about CHUNK bytes. Null has none."""
    clean, at = (text or b"").translate(_WORDS), 0
    while at < len(clean):
        end = at + CHUNK
        if end < len(clean):
            blank = clean.rfind(b" ", at, end)
            end = blank if blank > at else clean.find(b" ", end)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


class Index:
    """Terms of a block of items, and for each the items that hold it and how often."""

    def __init__(self, texts: Iterable[bytes | None]):
        self.numbers: dict[bytes, int] = {}
        terms, items, times = [], [], []
        for item, text in enumerate(texts):
            counted: Counter[bytes] = Counter()
            for run in words(text):
                counted.update(run)
            for term, n in counted.items():
                terms.append(self.numbers.setdefault(term, len(self.numbers)))
                items.append(item)
                times.append(n)
        order = np.argsort(np.array(terms, np.int64), kind="stable")
        self.items, self.times = np.array(items, np.int64)[order], np.array(times, np.int64)[order]
        self.ends = np.cumsum(np.bincount(np.array(terms, np.int64), minlength=len(self.numbers)))

    def held(self, text: bytes | None) -> tuple[int, Counter[bytes]]:
        """Number of terms of a document, and how often those of the index occur."""
        n, found, known = 0, Counter(), self.numbers.keys()
        for run in words(text):
            n += len(run)
            counted = Counter(run)
            for term in counted.keys() & known:
                found[term] += counted[term]
        return n, found


def _counts(shared):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen, documents, terms = shared.value, Counter(), 0, 0
        for batch in batches:
            for value in batch.column("text"):
                n, found = index.held(value.as_py())
                documents, terms = documents + (n > 0), terms + n
                seen.update(found.keys())
        numbers = [-1, -2, *(index.numbers[t] for t in seen)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([documents, terms, *seen.values()], pa.int64())], ["term", "n"])

    return counts


class _Heaps:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def update(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` has a row for each document of ``ids`` and a column for each item."""
        for doc, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.least))):
            heap, i = self.heaps[item], ids[doc]
            entry = (int(scores[doc, item]), i is not None, -(i or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def _best(shared, weights, total_documents: int, total_terms: int, k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, items = shared.value, weights.value, None
        items = int(index.items.max()) + 1 if len(index.items) else 0
        heaps, begins = _Heaps(items, k), np.concatenate([[0], index.ends[:-1]])
        most = max(1, CELLS // max(1, items))
        ids, doc, term, times, length = [], [], [], [], []
        held = 0

        def score() -> None:
            if not term:
                return
            tf, t, at = np.array(times, np.int64), np.array(term, np.int64), np.array(doc, np.int64)
            gain = weight[t] * (1_000_000_000 * tf // (1000 * tf + 12 * np.array(length, np.int64)[at]))
            n = index.ends[t] - begins[t]
            hit = np.repeat(np.arange(len(t)), n)
            posting = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + begins[t][hit]
            scores = np.zeros(len(ids) * items, np.int64)
            np.add.at(scores, at[hit] * items + index.items[posting], gain[hit] * index.times[posting])
            heaps.update(scores.reshape(len(ids), items), ids)

        for batch in batches:
            for i, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                n, found = index.held(value.as_py())
                if not found:
                    continue
                for word, tf in found.items():
                    t = index.numbers[word]
                    doc.append(len(ids))
                    term.append(t)
                    times.append(tf)
                    held += int(index.ends[t] - begins[t])
                ids.append(i)
                length.append(75 + 25 * n * total_documents // total_terms)
                if len(ids) >= most or held >= CELLS:
                    score()
                    ids, doc, term, times, length, held = [], [], [], [], [], 0
        score()
        found = [(item, -i if known else None, s) for item, heap in enumerate(heaps.heaps) for s, known, i in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["item", "doc_id", "score"])

    return best


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, *, block_bytes: int = BLOCK_BYTES,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A term's weight is
    ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, its gain in a document
    ``weight * (1e9 * tf div (1000 * tf + 12 * m))`` with ``m = 75 + 25 * n * N div L``, over ``N`` documents that hold a term and
    their ``L`` terms; a score adds up the gains of the item's terms, repeats included, in whole numbers.

    The items, not the documents, are indexed, since they are the few. They are read in blocks of about
    ``block_bytes`` of text, by a hash, so that what is broadcast has a bound however many there are (an item
    is not split). The documents stream through the index of a block twice: once to count them, their terms and the documents
    of each term, once to be scored. No posting of a document is stored or moved; a task sends one number for each
    term of the index and ``k`` rows for each item. Each task keeps one heap of ``k`` for each item, and heaps are merged in
    PARTS parts and then whole, so no item's rows meet in one task but ``k * PARTS``. Long texts are cut into
    words piece by piece.

    Each row of ``docs`` is a document and each row of ``items`` an item, repeated rows too; items of one id have
    ranks of their own. Equal scores go by ascending ``doc_id``, null last. Null texts and texts without terms score nothing,
    and items without any give no rows. ``doc_id`` is a whole number. Other columns, whatever their names, are not read. An empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    blocks = ceil_div(asked.agg(F.sum(F.length("text"))).first()[0] or 0, block_bytes)
    empty = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    result, totals = None, {}
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = Index(r.text for r in rows)
        if not index.numbers:
            continue
        shared = spark.sparkContext.broadcast(index)
        counted = base.select("text").mapInArrow(_counts(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        totals = {r.term: r.n for r in counted.collect()}
        n, length = totals.get(-1) or 0, totals.get(-2) or 0
        if not n:
            break
        df = [totals.get(t, 0) for t in range(len(index.numbers))]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df], np.int64)
        weights = spark.sparkContext.broadcast(weight)
        found = base.mapInArrow(_best(shared, weights, n, length, k), "item long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
        some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
        whole = some.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {id_type}")
        ranked = whole.where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.union(ranked)
    return empty if result is None else result
