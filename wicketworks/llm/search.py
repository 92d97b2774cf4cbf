"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketworks.llm.common import ceil_div, cut, partitions

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS


def sign_code(vector: str, bits: int = BITS) -> Column:
    """A 64-bit code of a vector: bit i is set where component i is above zero. Null without a vector.

    A vector of more components is an error: its code would leave some out, so it has to be projected first.
    """
    bit = lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))
    flags = F.transform(F.slice(F.col(vector), 1, bits), bit)
    code = F.aggregate(flags, F.expr("0L"), lambda code, flag: F.shiftleft(code, 1).bitwiseOR(flag))
    longer = F.raise_error(F.concat(F.lit(f"a code has {bits} bits; the vector's length is "), F.size(vector).cast("string")))
    return F.when(F.size(vector) > bits, longer).otherwise(code)


@lru_cache(WIDTH + 1)
def _masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], np.int64)


class SegmentIndex:
    """Codes of one shard, listed by the value of each of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.lists = []
        for s in range(SEGMENTS):
            values = (codes >> np.uint64(s * WIDTH)).astype(np.int64) & ((1 << WIDTH) - 1)
            order = np.argsort(values, kind="stable")
            self.lists.append((order, np.searchsorted(values[order], np.arange((1 << WIDTH) + 1))))

    def nearest(self, code: np.uint64, k: int, ids: np.ndarray, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest codes, by (distance, id), but for the rows in ``without``.

        Once all segments are searched to radius r, every code within SEGMENTS * (r + 1) - 1 bits has been
        seen, since one of its segments is within r. The radius grows until the k-th verified distance is
        covered by that.
        """
        seen = np.zeros(len(self.codes), bool)
        seen[without] = True
        rows, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(WIDTH + 1):
            masks = _masks(radius)
            for s, (order, starts) in enumerate(self.lists):
                values = masks ^ (int(code) >> s * WIDTH & (1 << WIDTH) - 1)
                a, n = starts[values], starts[values + 1] - starts[values]
                values = a.repeat(n) + np.arange(n.sum()) - (n.cumsum() - n).repeat(n)
                new = order[values]
                new = new[~seen[new]]
                seen[new] = True
                rows = np.concatenate([rows, new])
                distances = np.concatenate([distances, np.bitwise_count(self.codes[new] ^ code).astype(np.int64)])
            best = np.lexsort((ids[rows], distances))[:k]
            rows, distances = rows[best], distances[best]
            if len(best) == k and distances[-1] <= SEGMENTS * (radius + 1) - 1:
                break
        return rows, distances


def top_k(
    codes: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 8192, query_rows: int = 65536
) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` codes nearest to each query in Hamming distance, exactly.

    Both tables hold ``id`` and ``code`` (64 bits as a long). Codes are dealt by a hash to shards of about
    ``shard_rows``; queries, in blocks of about ``query_rows``, visit every shard. A shard lists its codes by
    the values of four 16-bit segments and searches these lists with a growing radius, until the k-th
    distance is provably covered; the nearest of all shards are then merged. Work and memory of a task
    are bounded; what leaves a shard is k rows for each query.

    Ties go to the smaller id. A query never finds itself: rows with its own id are left out. Rows without
    id or code take no part; repeated rows are found each time, repeated queries are asked once, queries with
    one id and other codes each; fewer than k codes give fewer rows. Other columns, whatever their names, are not read. Empty tables give no rows.
    """
    columns = ["query_id", "query_code", "id", "distance"]
    known = F.col("id").isNotNull() & F.col("code").isNotNull()
    index = cut(codes.where(known).select("id", "code"))
    asked = cut(queries.where(known).select("id", "code").distinct())
    shards, blocks = ceil_div(index.count(), shard_rows), ceil_div(asked.count(), query_rows)
    dealt = index.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(shard: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or query.empty:
            return pd.DataFrame(np.zeros((0, 4), np.int64), columns=columns)
        ids = shard["id"].to_numpy()
        lists = SegmentIndex(shard["code"].to_numpy().view(np.uint64))
        out = []
        for own, code in zip(query["id"].to_numpy(), query["code"].to_numpy()):
            rows, distances = lists.nearest(code.view(np.uint64), k, ids, np.flatnonzero(ids == own))
            out.append(np.stack([np.full(len(rows), own), np.full(len(rows), code), ids[rows], distances], 1))
        return pd.DataFrame(np.concatenate(out), columns=columns)

    # Few bytes, much work: partitions of a stated number are not merged by their size.
    dealt, asked = (x.repartition(partitions(x), "shard", "block") for x in (dealt, asked.withColumn("block", F.col("block").cast("int"))))
    pairs = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    near = pairs.applyInPandas(search, ", ".join(f"{c} long" for c in columns))
    order = Window.partitionBy("query_id", "query_code").orderBy("distance", "id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "distance")
