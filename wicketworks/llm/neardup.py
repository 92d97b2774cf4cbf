"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.llm.common import components, dropped, grouped, groups, sides, stored

ROWS, BANDS = 5, 36
BINS = ROWS * BANDS
BLOCK, SHINGLES = 1024, 1 << 20
CHUNK = 1 << 20
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_random = np.random.default_rng(20240229)
_byte_hash = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_base = np.uint64(0x9E3779B97F4A7C15)
#: For each bin, the order in which an empty one asks the others for a value.
_donors = np.argsort(_random.random((BINS, BINS)), axis=1)
_ask = np.argsort(_donors, axis=1).astype(np.int32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _base)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, words lower-cased (A-Z).

    A text of fewer words is one shingle; without words it has none. Works on runs of texts of about
    CHUNK bytes at a time; a longer text is a run of its own.
    """
    out: list[np.ndarray] = []
    run: list[bytes] = []
    size = 0
    for text in texts:
        if run and size + len(text) > CHUNK:
            out += _run_sets(run, k)
            run, size = [], 0
        run.append(text)
        size += len(text) + 1
    return out + (_run_sets(run, k) if run else [])


def _run_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    buffer = _lower[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    blank = _space[buffer]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    with np.errstate(over="ignore"):
        # A word's hash is the sum of byte hash times base ** distance to its end, from running sums.
        n = len(buffer)
        powers = _powers(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_hash[buffer] * powers[:n])])
        inverse = np.uint64(pow(int(_base), -1, 1 << 64))
        back = np.full(n + 1, inverse)
        back[0] = 1
        back = np.multiply.accumulate(back)
        words = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        limits = np.cumsum([1] + [len(t) + 1 for t in texts])
        at = np.searchsorted(starts, limits)
        out = []
        full = np.zeros(0, np.uint64)
        if len(words) >= k:
            full = words[: len(words) - k + 1].copy()
            for i in range(1, k):
                full = _mix(full * np.uint64(0x100000001B3) + words[i : len(words) - k + 1 + i])
        for a, b in zip(at, at[1:]):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                one = words[a]
                for w in words[a + 1 : b]:
                    one = _mix(np.array([one * np.uint64(0x100000001B3) + w]))[0]
                out.append(np.array([one ^ np.uint64(b - a)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """One permutation into BINS bins, the least of each kept in 16 bits; empty bins densified.

    ``hashes`` are sorted, so the leading bits are the bin and the first of a bin is its least. An empty
    bin takes the value of the first bin that has one, in the empty bin's own random order.
    """
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled = bins[first]
    sig = np.zeros(BINS, np.uint16)
    sig[filled] = (_mix(hashes[first]) & np.uint64(0xFFFF)).astype(np.uint16)
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        need = np.flatnonzero(empty)
        donor = filled[_ask[np.ix_(need, filled)].argmin(1)]
        sig[need] = sig[donor]
    return sig


def _features(k: int, with_set: bool):
    names = ["id", "text_id", "n_shingles", "digest", "found"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()], k)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                cols = [part.column("id"), part.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())]
                if with_set:
                    cols.append(pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))
                else:
                    cols.append(pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return features


_GROUP = ["bucket", "left_block", "right_block"]
_OTHERS = [*_GROUP, "own_block", "node", "component"]


def _dealt(rows: DataFrame) -> DataFrame:
    """Deals the buckets that hold more than one component to groups of two blocks, so that all their pairs meet once.

    A block has about BLOCK rows and SHINGLES shingles at most, so a group has a bound in memory, and a large bucket is
    dealt to many tasks.
    """
    size = rows.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / SHINGLES)).cast("int").alias("blocks"),
    )
    mixed = size.where("least < most").select("bucket", "blocks")
    return (
        rows.join(mixed, "bucket")
        .withColumn("own_block", F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int"))
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left_block", F.least("own_block", "other_block"))
        .withColumn("right_block", F.greatest("own_block", "other_block"))
        .select(*_OTHERS)
    )


def _roots(table: pa.Table) -> np.ndarray:
    return table["component"].combine_chunks().dictionary_encode().indices.to_numpy().copy()


def _likely(threshold: float, slack: float):
    """The rows of a group that another of it may be linked with: of another component, in no earlier band, alike in size and signature."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, _GROUP):
            band = table["bucket"][0].as_py()[0]
            sig = np.frombuffer(b"".join(table["found"].to_pylist()), np.uint16).reshape(-1, BINS)
            n, component = table["n_shingles"].to_numpy(), _roots(table)
            left, right, same = sides(table)
            marked = np.zeros(len(n), bool)
            for i in left:
                js = right[right > i] if same else right
                js = js[component[js] != component[i]]
                js = js[np.minimum(n[js], n[i]) >= threshold * np.maximum(n[js], n[i])]
                if not len(js):
                    continue
                js = js[(sig[js] == sig[i]).sum(1) >= (threshold - slack) * BINS]
                if band and len(js):
                    earlier = (sig[js, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(js), band, ROWS).all(2).any(1)
                    js = js[~earlier]
                if len(js):
                    marked[i] = marked[js] = True
            if marked.any():
                yield from table.select(_OTHERS).filter(pa.array(marked)).combine_chunks().to_batches()

    return likely


def _links(percent: int):
    """Links of a group, confirmed on the full sets: as many as it takes to join what belongs together, fewer than it has rows."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, _GROUP):
            found = table["found"].combine_chunks()
            ends = found.offsets.to_numpy().astype(np.int64)
            values = found.values.to_numpy()[ends[0] : ends[-1]]
            ends = ends - ends[0]
            n, root = np.diff(ends), _roots(table)
            left, right, same = sides(table)
            shingles, numbers = np.unique(values, return_inverse=True)
            mine = np.zeros(len(shingles), np.int32)
            ia, ib = [], []
            for i in left:
                js = right[right > i] if same else right
                js = js[root[js] != root[i]]
                if not len(js):
                    continue
                own = numbers[ends[i] : ends[i + 1]]
                mine[own] = 1
                shared = np.add.reduceat(mine[numbers], ends[:-1])[js]
                mine[own] = 0
                for j in js[shared * 100 >= percent * (n[i] + n[js] - shared)]:
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        ia.append(int(i))
                        ib.append(int(j))
            if ia:
                node = table["node"]
                yield pa.RecordBatch.from_arrays([node.take(pa.array(x)).combine_chunks() for x in (ia, ib)], ["a", "b"])

    return links


def _agreement(threshold: float, slack: float):
    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, BINS) for x in (a, b))
        return pd.Series((one == two).sum(1) >= (threshold - slack) * BINS)

    return agree


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose full sets are alike: 100 * intersection >= percent * union."""
    one = sets.select(F.col("node").alias("a"), F.col("found").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("found").alias("set_b"))
    both = edges.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared * 100 >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, slack: float = 0.14, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text_id, n_shingles, component_id, kept): groups of texts with alike k-word shingle sets.

    1. Each text becomes a one-permutation signature of 180 bins, densified, and a digest of its set. Texts
       with equal sets are one class from here on, however many copies there are.
    2. Signatures are cut into 36 bands of 5 rows; classes with an equal band share a bucket. Two sets of
       similarity 0.8 miss each other in all bands once in a million.
    3. Star edges: in each bucket, one class chosen by a hash is compared with the others, so a bucket gives
       fewer edges than it has rows. Edges whose signatures agree are confirmed on the full sets.
    4. What a star cannot see, two classes alike that are both unlike the centre, is looked for among the
       pairs of a bucket that are in different components so far. They are compared inside the tasks, in blocks of
       a bounded size: first by signature, alike but for ``slack`` (over four standard deviations), each pair in
       the first of its common buckets. This leaves rows, not pairs. Then the full sets of these rows meet in the same
       blocks, and each task returns links that join what it has confirmed, fewer than it has rows.
    5. Components of the confirmed links.

    Full sets are built a second time for the classes that have candidates only. No pair that is not
    a link leaves a task in step 4, so what is stored grows with the rows of a group, not with their square. No cap on
    buckets, partners or candidates.

    One row per row of the input, with ``text_id``, the text's 64-bit hash. Null or empty texts, and texts
    without words, have no shingles and link with nothing. Repeated rows are in one group. A null doc_id
    gives a row its group's smallest id; it is kept only if its group has no id at all. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    features = f"id {id_type}, text_id long, n_shingles long, digest binary, found "
    signed = stored(base.mapInArrow(_features(k, False), features + "binary"))
    one = F.min(F.struct("n_shingles", "found"))
    classes = stored(
        signed.where("digest is not null")
        .groupBy(F.col("digest").alias("node"))
        .agg(F.min("id").alias("id"), one.alias("one"))
        .select("node", "id", "one.*")
    )
    band = [F.concat(F.unhex(F.lit(f"{b:02x}")), F.substring("found", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)]
    buckets = classes.select("node", F.explode(F.array(*band)).alias("bucket"))
    order = F.struct(F.xxhash64("bucket", "node").alias("h"), F.col("node"))
    centres = buckets.groupBy("bucket").agg(F.min(order).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stored(buckets.join(centres, "bucket").select("bucket", "node", F.col("c.node").alias("centre")))
    stars = (
        crowded.where("node != centre")
        .select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"))
        .distinct()
    )
    light = lambda x: classes.select(F.col("node").alias(x), F.col("found").alias(f"found_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    first = stored(
        stars.join(light("a"), "a")
        .join(light("b"), "b")
        .where(F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b"))
        .where(_agreement(percent / 100, slack)("found_a", "found_b"))
        .select("a", "b")
    )

    def sets(rows: DataFrame, *columns: str) -> DataFrame:
        """Full sets of the nodes in ``columns``."""
        nodes = rows.select(F.explode(F.array(*columns)).alias("node")).distinct()
        wanted = classes.join(nodes, "node", "left_semi").select(F.col("id").alias("of"))
        texts = base.join(wanted, F.col("id").eqNullSafe(F.col("of")), "left_semi")
        found = texts.mapInArrow(_features(k, True), features + "array<long>").select(F.col("digest").alias("node"), "found")
        return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    linked = stored(_verified(first, sets(first, "a", "b"), percent))
    placed = crowded.select("bucket", "node").join(components(linked, stored), "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    dealt = _dealt(placed.join(classes.select("node", "n_shingles"), "node")).join(classes.drop("id"), "node")
    kinds = "bucket binary, left_block int, right_block int, own_block int, node binary, component binary"
    likely = stored(grouped(dealt, _GROUP).mapInArrow(_likely(percent / 100, slack), kinds))
    more = grouped(likely.join(sets(likely, "node"), "node"), _GROUP).mapInArrow(_links(percent), "a binary, b binary")

    links = linked.union(stored(more))
    dropped(crowded, first, likely)
    named = classes.select("node", "id").join(components(links, stored), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component_id")
    return (
        signed.join(named, signed["digest"] == named["node"], "left")
        .withColumn("component_id", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")))
        .select(
            F.col("id").alias("doc_id"), "text_id", "n_shingles", "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group that ``found``, a result of near_duplicates, names."""
    base = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_id"))
    kept = found.where("kept").select(F.col("doc_id").alias("of"), F.col("text_id").alias("of_text"))
    joined = base.join(kept, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_id") == F.col("of_text")), "left_semi")
    return joined.dropDuplicates(["id", "text_id"]).select("row.*")
