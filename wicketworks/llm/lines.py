"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.llm.common import SPACES


def line_key(line: str, min_chars: int) -> bytes | None:
    """16-byte digest of a normalised line, or nothing if it is short."""
    line = line.strip(SPACES)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest()  # bytes lower A-Z alone


def _keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    own = {k for line in text.split("\n") if (k := line_key(line, min_chars))}
                    at += [i] * len(own)
                    found += own
            rows = batch.select(["id", "text_id"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.binary())], ["id", "text_id", "key"])

    return keys


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(row, kept, n_lines, n_dropped): each text without the lines that ``min_docs`` documents or more share.

    Lines are exploded, stripped, lower-cased (A-Z) and hashed; the documents of each hash are counted, and
    those over the threshold lose the line everywhere but in the document with the largest id. Lines of
    less than ``min_chars`` code points always stay. The rest is put together again by position.

    Counts are added up before they are moved, so a line of every third document is a few rows; the join
    back may be split. A document's dropped digests, never more than its lines, meet its text once.

    ``row`` holds all columns of the input, whatever their names. Each row counts as a document. A null or
    empty text is one empty line and stays as it is (null stays null). Rows with the largest id all keep the
    line; a row without id keeps it only if no row that has it has an id. An empty table gives no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_id")
    )
    keys = base.select("id", "text_id", "text").mapInArrow(_keys(min_chars), f"id {id_type}, text_id long, key binary")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    dropped = (
        keys.join(shared, "key")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("of"), F.col("text_id").alias("of_text"))
        .agg(F.collect_set("key").alias("dropped"))
    )

    @F.pandas_udf("kept string, n_lines long, n_dropped long")
    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for value, drop in zip(texts, drops):
            lines = (value or "").split("\n")
            if drop is None or not len(drop):
                out.append((value, len(lines), 0))
                continue
            gone = {bytes(k) for k in drop}
            kept = [line for line in lines if line_key(line, min_chars) not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    joined = base.join(dropped, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_id") == F.col("of_text")), "left")
    return joined.select("row", without("text", "dropped").alias("x")).select("row", "x.*")
