"""Embedding near-dedup by Euclidean p-stable hashing."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.llm.common import block_pairs, components, cut, grouped, groups, sides

BLOCK = 1024


def share_a_cell(cosine: float, width: float) -> float:
    """Probability that one projection puts two unit vectors into one cell (p-stable hashing, Gaussian directions)."""
    far = math.sqrt(max(0.0, 2 - 2 * cosine))
    if not far:
        return 1.0
    ratio = width / far
    return math.erf(ratio / math.sqrt(2)) - math.sqrt(2 / math.pi) / ratio * (1 - math.exp(-ratio * ratio / 2))


def tables_for(rows: int, threshold: float, recall: float, strangers: int, width: float) -> tuple[int, int]:
    """(tables, projections) that let a vector meet about ``strangers`` others at right angles in a bucket, whatever the number
    of rows, and a pair at the threshold in one of the tables with probability ``recall``."""
    near, far = share_a_cell(threshold, width), share_a_cell(0.0, width)
    projections = max(1, math.ceil(math.log(max(1.0, rows / strangers)) / -math.log(far)))
    one = near**projections
    tables = 1 if one >= recall else math.ceil(math.log(1 - recall) / math.log1p(-one))
    return tables, projections


@lru_cache(4)
def _directions(size: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.standard_normal((size, tables * projections)), random.uniform(0, width, tables * projections)


def quantised(vectors: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """For unit vectors, ``projections`` whole numbers in each of ``tables``: floor((a . v + b) / width)."""
    a, b = _directions(vectors.shape[1], tables, projections, width, seed)
    cells = np.floor((vectors @ a + b) / width)
    return cells.clip(-127, 127).astype(np.int8).reshape(len(vectors), tables, projections)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _encoded(kind: str):
    """Vectors as bytes; null where a vector has no direction."""
    wide = np.dtype(kind).itemsize

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            values = vectors.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            at = vectors.offsets.to_numpy()
            # How many components before each place are not finite, and how many are not zero.
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            filled = np.concatenate([[0], np.cumsum(values != 0)])
            good = (wrong[at[1:]] == wrong[at[:-1]]) & (filled[at[1:]] > filled[at[:-1]])
            good &= vectors.is_valid().to_numpy(zero_copy_only=False)
            raw = values.tobytes()
            out = [raw[a * wide : b * wide] if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), good)]
            nodes = [hashlib.blake2b(v, digest_size=16).digest() if v else None for v in out]
            columns = [batch.column("id"), pa.array(nodes, pa.binary()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "raw"])

    return encoded


def _bucketed(kind: str, options: tuple):
    """A row per table: the table's number, the length of the vector and its cells."""

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            raws = batch.column("raw").to_pylist()
            for size in sorted(set(map(len, raws))):
                at = [i for i, raw in enumerate(raws) if len(raw) == size]
                values = np.frombuffer(b"".join(raws[i] for i in at), kind).reshape(len(at), -1)
                cells = quantised(unit(values), *options)
                for t in range(options[0]):
                    head = t.to_bytes(4, "little") + size.to_bytes(4, "little")
                    keys += [head + c.tobytes() for c in cells[:, t]]
                    nodes += at
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(nodes, pa.int64())), pa.array(keys, pa.binary())], ["node", "bucket"]
            )

    return bucketed


def _linked(kind: str, threshold: float, options: tuple):
    """Of each group: how many links each vector has, and the smallest vector it is connected to.

    A pair belongs to the first table in which it shares a bucket, and counts there only.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, bytes]] = []
        for table in groups(batches, ["bucket", "left_block", "right_block"]):
            own = int.from_bytes(table["bucket"][0].as_py()[:4], "little")
            values = unit(np.frombuffer(b"".join(table["raw"].to_pylist()), kind).reshape(table.num_rows, -1))
            left, right, same = sides(table)
            i, j = np.nonzero(values[left] @ values[right].T >= threshold)
            if same:
                i, j = i[i < j], j[i < j]
            i, j = left[i], right[j]
            if own and len(i):
                some, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                cells = quantised(values[some], *options)
                first = np.ones(len(i), bool)
                a, b = back[: len(i)], back[len(i) :]
                for before in range(own):
                    whole = np.ascontiguousarray(cells[:, before]).view(f"S{options[1]}").ravel()
                    _, bucket = np.unique(whole, return_inverse=True)
                    first &= bucket[a] != bucket[b]
                i, j = i[first], j[first]
            if not len(i):
                continue
            copies = table["copies"].to_numpy()
            nodes = table["node"].to_pylist()
            links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
            order = np.array(sorted(range(len(nodes)), key=nodes.__getitem__))
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            least = _least(rank, i, j)
            out += [(nodes[n], int(links[n]), nodes[order[least[n]]]) for n in np.flatnonzero(links)]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return linked


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["node", "links", "least"])


def _least(rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest rank reachable inside a group, by spreading minima until nothing changes."""
    least = rank.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        if (least == before).all():
            return least


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    recall: float = 0.98,
    strangers: int = 32,
    width: float = 2.0,
    seed: int = 6,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors whose cosine is ``threshold`` or more.

    Unit vectors are projected on random Gaussian directions, shifted and cut into cells of ``width``; the
    cells of some directions together are one bucket of a table. ``tables_for`` takes their numbers from the number of different
    vectors: with more rows, buckets are cut by more projections, so that a vector still meets about ``strangers`` vectors
    at right angles in a bucket, and there are more tables, so that a pair at the threshold still shares one of them with
    probability ``recall``, closer pairs with more. At cosine 0.9 tables grow with the power 0.27 of the rows: 7 for 500
    vectors, 26 for 25,000, 73 for a million; comparisons grow with the rows times the tables, not with the square of the rows.

    Equal vectors are one class, with a count, before anything is paired. Buckets are dealt in blocks, so
    no task holds a bucket. Inside a group all pairs are compared exactly, in double precision, and only
    counts and one connection per vector leave it; a pair that meets in several tables counts in the first.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing. Vectors
    are compared with those of the same length only. One row per row of the input: repeated vectors link
    with each other; rows that share a vec_id each count. A row without vec_id gets the smallest id of its
    component, and is kept if that has none. Labels and other columns are not read. An empty table gives
    no rows.
    """
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    id_type = vectors.schema[vec_id].dataType.simpleString()
    values = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    base = vectors.select(F.col(vec_id).alias("id"), values.alias("vector"))
    rows = cut(base.mapInArrow(_encoded(kind), f"id {id_type}, node binary, raw binary"))
    classes = rows.where("node is not null").groupBy("node")
    classes = cut(classes.agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.min("raw").alias("raw")))
    options = (*tables_for(classes.count(), threshold, recall, strangers, width), width, seed)
    buckets = classes.select("node", "raw").mapInArrow(_bucketed(kind, options), "node binary, bucket binary")
    dealt = block_pairs(buckets, "bucket", "node", BLOCK).join(classes.select("node", "raw", "copies"), "node")
    dealt = grouped(dealt, ["bucket", "left_block", "right_block"])
    found = cut(dealt.mapInArrow(_linked(kind, threshold, options), "node binary, links long, least binary"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    named = (
        classes.select("node", "id", "copies")
        .join(components(edges), "node", "left")
        .join(links, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = named.join(smallest, "component").select(F.col("node").alias("of"), n_links.alias("n_links"), "component_id")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        rows.select("id", "node")
        .join(named, F.col("node") == F.col("of"), "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"),
        )
    )
