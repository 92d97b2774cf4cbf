"""Passage dedup: repeated lines and runs of sentences stay where they come first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = r"\n"
PARAGRAPHS = r"\n\s*\n"
SENTENCES = r"\n|(?<=[.!?])\s"
_words = re.compile(r"\w+")


def units(text: str, ends: str, min_words: int) -> list[tuple[int, int, str]]:
    """(start, end, normalised words) of the units of a text.

    A text is cut after each match of ``ends``. Pieces of ``min_words`` words or more are units; runs of
    shorter pieces of one line between them are units together, if they have that many words. So where
    units begin and end depends on nearby text alone, and a passage has the same ones in any document.
    """
    out: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, list[str]]] = []

    def close() -> None:
        if run and sum(len(w) for *_, w in run) >= min_words:
            out.append((run[0][0], run[-1][1], " ".join(w for *_, words in run for w in words)))
        run.clear()

    at = 0
    for end in [m.end() for m in re.finditer(ends, text)] + [len(text)]:
        words = _words.findall(text[at:end].lower())
        if len(words) >= min_words:
            close()
            out.append((at, end, " ".join(words)))
        else:
            run.append((at, end, words))
        if text[at:end].endswith("\n"):
            close()
        at = end
    close()
    return out


def _long_runs(own: list[tuple[int, int, str]], gone: set[int], min_words: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the units that start in ``gone`` and have ``min_words`` words with their neighbours there."""
    for repeated, neighbours in groupby(own, lambda unit: unit[0] in gone):
        run = list(neighbours)
        if repeated and sum(words.count(" ") + 1 for *_, words in run) >= min_words:
            yield from ((start, end) for start, end, _ in run)


def _digests(ends: str, min_words: int):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, found = [], [], []
            for i, text in enumerate(batch.column("text")):
                for start, _, words in units(text.as_py() or "", ends, min_words):
                    rows.append(i)
                    starts.append(start)
                    found.append(hashlib.blake2b(words.encode(), digest_size=12).digest())
            own = batch.select(["id", "text_id"]).take(pa.array(rows, pa.int64()))
            columns = [*own.columns, pa.array(starts, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_id", "start", "digest"])

    return digests


def dedup_passages(
    docs: DataFrame,
    ends: str = SENTENCES,
    min_words: int = 8,
    min_span_words: int = 25,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(row, kept, n_units, spans): texts without units that came earlier, and the places of what was removed.

    Units are normalised (words in lower case, without marks), their 96-bit digests grouped over all texts,
    and the occurrence with the least (id, place) stays; ``spans`` are the (start, end) of the others in code
    points of the original, neighbours joined. ``ends`` says how texts are cut: LINES, PARAGRAPHS or, as
    passages may begin and end inside a line, SENTENCES. Units of less than ``min_words`` words stay.

    One repeated sentence is no passage: repeated units go where neighbours, no other unit between them, have
    ``min_span_words`` words together. At 25, a passage of 50 words goes wherever it begins and ends, unless the sentences that it
    shares with the text around it take more than half of it.

    Digests are counted with their least occurrence before they are moved, and the join back may be split, so
    a line of every third text is no burden. Only the places removed from a text meet it.

    ``row`` holds all columns of the input, whatever their names. Null or empty texts stay as they are. Rows
    with one id and one text are one document: they keep and lose the same. Null ids come first. An empty
    table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text")
    )
    found = base.select("id", "text_id", "text").mapInArrow(
        _digests(ends, min_words), f"id {kind}, text_id long, start long, digest binary"
    )
    place = F.struct("id", "text_id", "start")
    repeated = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    later = (
        found.join(repeated.select("digest", "first"), "digest")
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias("of"), F.col("text_id").alias("of_text"))
        .agg(F.collect_set("start").alias("starts"))
    )

    @F.pandas_udf("kept string, n_units long, spans array<struct<start:long,end:long>>")
    def without(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for value, gone in zip(texts, starts):
            own = units(value or "", ends, min_words)
            spans: list[dict[str, int]] = []
            gone = set() if gone is None else set(gone)
            for start, end in _long_runs(own, gone, min_span_words):
                if spans and spans[-1]["end"] == start:
                    spans[-1]["end"] = end
                else:
                    spans.append({"start": start, "end": end})
            kept = value
            if spans:
                edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(value)]
                kept = "".join(value[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((kept, len(own), spans))
        return pd.DataFrame(out, columns=["kept", "n_units", "spans"])

    on = F.col("id").eqNullSafe(F.col("of")) & (F.col("text_id") == F.col("of_text"))
    return base.join(later, on, "left").select("row", without("text", "starts").alias("x")).select("row", "x.*")
