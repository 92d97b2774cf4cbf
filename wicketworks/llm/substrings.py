"""Removal of byte strings that occur more than once, by column-wise sorting of a collection."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.llm.anchors import Ranges, anchors, mix
from wicketworks.llm.common import dropped, grouped, stored

RUN = 1 << 20
COLLECTION = 8192
STEPS = 8


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, in runs of about RUN bytes, with the row number of the first."""
    run: list[bytes] = []
    size = first = 0
    for i, value in enumerate(batch.column(column)):
        data = (value.as_py() or "").encode()
        if run and size + len(data) > RUN:
            yield first, run
            run, size, first = [], 0, i
        run.append(data)
        size += len(data)
    if run:
        yield first, run


def _anchored(length: int, gram: int):
    """A row for each anchor: hash of its gram, hash of all that strings through it can cover, and place."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _runs(batch, "text"):
                sizes = np.array([len(t) for t in texts])
                ends = np.cumsum(sizes)
                data = np.frombuffer(b"".join(texts), np.uint8)
                ranges = Ranges(data)
                at = anchors(ranges, len(data), gram, length)
                doc = np.searchsorted(ends, at, "right")
                inside = (at + gram <= ends[np.minimum(doc, len(ends) - 1)]) & (sizes[np.minimum(doc, len(ends) - 1)] >= length)
                at, doc = at[inside], doc[inside]
                lo = np.maximum(at - (length - gram), (ends - sizes)[doc])
                hi = np.minimum(at + length, ends[doc])
                with np.errstate(over="ignore"):
                    context = mix(ranges(lo, hi) + (at - lo).astype(np.uint64) * np.uint64(1315423911))
                rows = batch.select(["id", "text_id"]).take(pa.array(doc + first))
                found = [ranges(at, at + gram).view(np.int64), context.view(np.int64), at - (ends - sizes)[doc]]
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, found)], ["id", "text_id", "gram", "context", "at"])

    return anchored


def _packed_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts deflated for the exchange."""
    for batch in batches:
        packed = [zlib.compress((t.as_py() or "").encode(), 6) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.select(["id", "text_id"]).columns, pa.array(packed, pa.binary())], ["id", "text_id", "packed"])


def _contexts(length: int, gram: int):
    """What lies around each wanted anchor: the bytes, or hashes of its strings for an anchor that is hot."""
    names = ["id", "text_id", "at", "weight", "group", "left", "bytes", "lo", "hi", "part", "whole", "strings"]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = length - gram
        step = -(-(back + 1) // STEPS)
        for batch in batches:
            at_row, out = [], []
            for i in range(batch.num_rows):
                data = zlib.decompress(batch.column("packed")[i].as_py())
                ranges = None
                for x in batch.column("wanted")[i].as_py():
                    at = x["at"]
                    if not x["hot"]:
                        lo = max(0, at - back)
                        out.append((at, x["n"], x["gram"], at - lo, data[lo : at + length], None, None, None, None, None))
                        at_row.append(i)
                        continue
                    ranges = ranges or Ranges(data)
                    for j in range(0, back + 1, step):
                        far = min(j + step - 1, back)
                        lo, hi = max(0, at - far), min(at - j, len(data) - length)
                        if lo > hi:
                            continue
                        starts = np.arange(lo, hi + 1)
                        edges = np.array([at - j, lo]), np.array([at - far + length, hi + length])
                        with np.errstate(over="ignore"):
                            keys = mix(ranges(*edges) + np.array([j, j + 997 * (at - lo)]).astype(np.uint64)).view(np.int64)
                        strings = ranges(starts, starts + length).view(np.int64)
                        out.append((at, x["n"], hash((x["gram"], at, i)), at - lo, None, lo, hi, int(keys[0]), int(keys[1]), strings.tolist()))
                        at_row.append(i)
            rows = batch.select(["id", "text_id"]).take(pa.array(at_row, pa.int64()))
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 4 + [pa.list_(pa.int64())]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return contexts


def repeated_columns(strings: list[bytes], left: np.ndarray, back: int, length: int) -> np.ndarray:
    """Column-wise construction: [back + 1, strings] says where ``length`` bytes occur in another string too.

    The strings are laid side by side, each with ``left`` bytes before a common column. From the last
    column to the first, each round puts one more symbol before every string's suffix: a stable sort of the
    order so far by the new symbol is the order of the longer suffixes (the symbols in this order are the
    collection's Burrows-Wheeler transform), and the common prefix of neighbours with one symbol is one
    more than the least between their former places. Row ``d`` is for the suffixes that start ``d`` bytes
    before the common column. Where a string has no byte its suffix is like no other.
    """
    m = len(strings)
    total = back + length
    table = np.full((total, m), 256, np.uint16)
    for i, s in enumerate(strings):
        a = back - left[i]
        table[a : a + len(s), i] = np.frombuffer(s, np.uint8)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int32)
    out = np.zeros((back + 1, m), bool)
    for column in range(total - 1, -1, -1):
        symbols = table[column][order]
        place = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[place]
        same = np.flatnonzero((sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] < 256)) + 1
        longer = np.zeros(m + 1, np.int32)
        if len(same):
            p, q = place[same - 1], place[same]
            near = q == p + 1
            longer[same[near]] = common[q[near]] + 1
            p, q, at = p[~near], q[~near], same[~near]
            if len(p):
                spans = np.stack([p + 1, q + 1], 1).ravel()
                longer[at] = np.minimum.reduceat(common, spans)[::2] + 1
        order, common = order[place], longer
        if column <= back:
            full = common >= length
            out[back - column, order] = full[:-1] | full[1:]
    return out


def _sorted_groups(length: int, gram: int):
    """Spans of repeated strings in the contexts of one anchor; rows of hot anchors pass."""
    back = length - gram
    names = ["id", "text_id", "lo", "hi", "weight", "left", "part", "whole", "strings"]

    def spans(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        found = repeated_columns(table["bytes"].to_pylist(), table["left"].to_numpy(), back, length)
        found[:, table["weight"].to_numpy() > 1] = False
        # Runs of neighbouring starts: place - d, for d from first to last.
        edges = np.diff(np.pad(found.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edges == 1)
        last = np.nonzero(edges == -1)[1] - 1
        at = table["at"].to_numpy()[row]
        columns = table.select(["id", "text_id"]).take(pa.array(row)).combine_chunks().to_batches()
        rest = [pa.array(at - last), pa.array(at - first), pa.nulls(len(row), pa.int64())]
        rest += [pa.nulls(len(row), pa.int64())] * 3 + [pa.nulls(len(row), pa.list_(pa.int64()))]
        own = columns[0].columns if columns else [pa.array([], f.type) for f in list(table.schema)[:2]]
        return pa.RecordBatch.from_arrays([*own, *rest], names)

    def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            hot = table.filter(pa.compute.is_valid(table["part"]))
            yield from hot.select(names).to_batches()
            table = table.filter(pa.compute.is_null(table["part"]))
            if not table.num_rows:
                continue
            held.append(table)
            rows += table.num_rows
            if rows >= COLLECTION:  # up to the last group that is complete
                table = pa.concat_tables(held)
                groups = table["group"].to_numpy()
                starts = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
                done = 0
                for end in starts[1:]:
                    if end - done >= COLLECTION or end == starts[-1]:
                        yield spans(table.slice(done, end - done))
                        done = end
                held, rows = [table.slice(done)], table.num_rows - done
        if rows:
            yield spans(pa.concat_tables(held))

    return sorted_groups


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "spans", "kept"]
    for batch in batches:
        sizes, removed, all_spans, kept = [], [], [], []
        for packed, found in zip(batch.column("packed"), batch.column("found")):
            data = zlib.decompress(packed.as_py())
            spans: list[list[int]] = []
            for x in sorted((x["lo"], x["hi"]) for x in found.as_py() or []):
                end = min(x[1], len(data))
                if spans and x[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([x[0], end])
            edges = [0, *(e for s in spans for e in s), len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            sizes.append(len(data))
            removed.append(len(data) - len(rest))
            all_spans.append([{"start": a, "end": b} for a, b in spans])
            kept.append(rest)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        rest = [pa.array(c, k) for c, k in zip((sizes, removed, all_spans, kept), kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *rest], names)


def dedup_substrings(
    docs: DataFrame, length: int = 400, gram: int = 160, hot: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): texts without bytes of ``length``-byte strings met elsewhere.

    Texts are UTF-8 bytes. A byte goes if any string of ``length`` bytes over it starts anywhere else, in
    this text or another; all is judged on the input. ``spans`` are the maximal runs removed, ``kept`` the
    other bytes.

    1. Every string of ``length`` bytes chooses its least gram of ``gram`` bytes by hash: its anchor. Equal
       strings have equal anchors at equal distance, so only anchors that occur twice matter, under 1 % of
       the places are anchors, and most occur once.
    2. Anchors with all that strings through them can cover alike (at most ``2 * length - gram`` bytes) settle
       by counting: all these strings are repeated.
    3. The other contexts of repeated anchors are sorted column by column, as a collection of short
       documents: one symbol of each is inserted each round, and order and common prefixes are updated. A
       string is repeated where it shares ``length`` bytes with a neighbour. Collections are small, as
       anchors with more than ``hot`` contexts do not come here:
    4. Their strings are taken in STEPS intervals of neighbouring starts. Hashes of all that the strings of
       an interval cover, and of what they have in common, are counted; where neither settles it, the hash
       of each string and its distance is. Counting needs no group in one place.

    Hashes have 64 bits. Every row is a text of its own, so repeated rows repeat each other; a null text is
    empty; null ids are fine, as ids are only carried. Other columns, whatever their names, are not read.
    An empty table gives no rows. Results may contain broken UTF-8, hence bytes.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    place = ["id", "text_id"]
    every = base.mapInArrow(_anchored(length, gram), f"id {kind}, text_id long, gram long, context long, at long")
    # Stored first, so that the join is one of two plain exchanges, in which Spark splits a hot gram.
    often = stored(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    occurrences = stored(every.join(often, "gram"))
    dropped(often)
    alike = stored(
        occurrences.groupBy("gram", "context")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place, "at")).alias("one"))
        .select("gram", "context", "n", "one.*")
    )
    whole = occurrences.join(alike.where("n > 1").select("gram", "context"), ["gram", "context"])
    spans = whole.select(*place, F.greatest(F.lit(0), F.col("at") - (length - gram)).alias("lo"), (F.col("at") + length).alias("hi"))
    open_grams = alike.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
    open_grams = open_grams.where("kinds > 1 and single > 0").select("gram", (F.col("kinds") > hot).alias("hot"))
    wanted = alike.join(open_grams, "gram").groupBy(*place).agg(F.collect_list(F.struct("gram", "at", "n", "hot")).alias("wanted"))
    packed = base.mapInArrow(_packed_text, f"id {kind}, text_id long, packed binary")
    around = _joined(packed, wanted, "inner").mapInArrow(
        _contexts(length, gram),
        f"id {kind}, text_id long, at long, weight long, group long, left long, bytes binary, lo long, hi long, "
        "part long, whole long, strings array<long>",
    )
    settled = stored(
        grouped(around, ["group"]).mapInArrow(
            _sorted_groups(length, gram),
            f"id {kind}, text_id long, lo long, hi long, weight long, left long, part long, whole long, strings array<long>",
        )
    )
    run = F.col("hi") + length
    spans = spans.union(settled.where("part is null").select(*place, "lo", run.alias("hi")))
    counted = settled.where("part is not null")
    covers = counted.groupBy("part", "whole").agg(F.sum("weight").alias("n"))
    parts = covers.groupBy("part").agg(F.count(F.lit(1)).alias("covers"), F.count_if(F.col("n") == 1).alias("single"))
    known = counted.join(covers, ["part", "whole"])
    spans = spans.union(known.where("n > 1 and weight = 1").select(*place, "lo", run.alias("hi")))
    parts = parts.where("covers > 1 and single > 0").select("part")
    strings = known.join(parts, "part").select(*place, "part", "lo", "left", "weight", "n", F.posexplode("strings").alias("i", "string"))
    # With the distance to the gram: where a text repeats its gram, an interval may hold one place twice.
    strings = strings.withColumn("string", F.xxhash64("string", F.col("left") - F.col("i"))).drop("left")
    again = strings.groupBy("part", "string").agg(F.sum("weight").alias("m")).where("m > 1").select("part", "string")
    start = F.col("lo") + F.col("i")
    each = strings.where("n = 1").join(again, ["part", "string"]).select(*place, start.alias("lo"), (start + length).alias("hi"))
    found = spans.union(each).groupBy(*place).agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    struct = "array<struct<start:long,end:long>>"
    result = _joined(packed, found, "left").mapInArrow(_without, f"id {kind}, n_bytes long, n_removed long, spans {struct}, kept binary")
    return result.withColumnRenamed("id", "doc_id")


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"id": "of", "text_id": "of_text"})
    on = F.col("id").eqNullSafe(F.col("of")) & F.col("text_id").eqNullSafe(F.col("of_text"))
    return left.join(right, on, how).drop("of", "of_text")
