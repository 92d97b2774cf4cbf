"""Best-fit packing of token sequences."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from sys import getsizeof

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.llm.common import ceil_div, cut

#: Bytes that a worker keeps of words that the tokenizer itself codes.
WORD_BYTES = 96 << 20
#: Characters, about, that are coded at once.
STRETCH = 1 << 16
#: What a dictionary takes for an entry besides the key and the value, about.
ENTRY = 100
SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    from public_tokenizers import path

    return str(path(name))


#: Words of these characters alone take the short way: lower case, cut into pieces, merged by rank.
_plain = re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
#: Runs of other words, with the blanks between them: from where a word starts, none of its characters is tried twice.
_odd_word = r"(?:[!-;=-~À-ÖØ-öø-ÿ]|<(?!\|))*+[^ ]+"
_odd = re.compile(rf"((?<![^ ]){_odd_word}(?: {_odd_word})*)")
#: A piece that is no run of letters: a digit, an ending after its mark, or a run of other characters.
_other = re.compile(r"[^ a-zß-öø-ÿ](?:(?<=[0-9])|(?<=')(?:s|t|re|ve|m|ll|d)|(?<![0-9])[^ a-zß-öø-ÿ0-9]*)")


def _merges(vocabulary: dict[str, int]):
    """The vocabulary as ranks of byte strings, with a blank in place of the mark at the end of a word.

    Ids are in the order of the merges, so the pair of the least id is the next to merge. A blank is never in
    a word, and an end with its mark comes before all merges, as in the vocabulary.
    """
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    end = "</w>"
    ranks = {}
    for token, rank in vocabulary.items():
        body, mark = (token[: -len(end)], b" ") if token.endswith(end) else (token, b"")
        if body and all(c in byte for c in body) and (key := bytes(byte[c] for c in body) + mark) != b" ":
            ranks[key] = rank
    ranks[b" "] = max(vocabulary.values()) + 1
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


class Remembered(dict):
    """Values by key, made where they are missing, in two generations of half of ``most`` bytes each.

    A full generation becomes the old one, and what is asked for again moves on to the new one; the rest goes.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.half, self.held, self.old = make, most // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.held >= self.half:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += getsizeof(key) + getsizeof(value) + ENTRY
        return value


#: How a vocabulary file must cut texts for words to be coded one by one. Fixed values.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _codes_words(path: str) -> bool:
    """Whether a vocabulary lower-cases texts, parts them at blanks and line ends, and marks the ends of words."""
    with open(path, encoding="utf-8") as file:
        form = json.load(file)
    steps = (form.get("normalizer") or {}).get("normalizers") or []
    cuts = (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        [s.get("type") for s in steps] == _NORMALIZERS
        and (cuts[0].get("pattern") or {}).get("Regex") == _SPLIT
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and form["model"].get("type") == "BPE"
        and form["model"].get("end_of_word_suffix") == "</w>"
        and not form["model"].get("dropout")
    )


class WordEncoder:
    """Token ids of texts as little-endian 32-bit words.

    The lower-case vocabulary with word ends never joins what blanks and line ends part, so words may be coded apart.
    Common words take a fast merge of the same vocabulary, a stretch of them at once: to merge is cheaper than to keep
    and look up millions of words. Words with other characters, or with marks of special tokens, go through the
    tokenizer itself and are remembered, up to a bounded number of bytes. Under any other vocabulary every whole text
    goes through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = _merges(self.tokenizer.get_vocab()) if _codes_words(path) else None
        self.known = Remembered(self.exact, WORD_BYTES)

    def exact(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> bytes:
        """Ids of words that take the short way, parted by blanks: each piece is coded with a blank as its end."""
        return _bytes(self.merges.encode_ordinary(_other.sub(r" \g<0> ", text.lower()) + " "))

    def words(self, text: str) -> Iterator[bytes]:
        for part in _stretches(text.replace("\n", " ")):
            if "<|" not in part and _plain.fullmatch(part):
                yield self.plain(part)
                continue
            for i, words in enumerate(_odd.split(part)):
                yield b"".join([self.known[w] for w in words.split(" ")]) if i % 2 else self.plain(words)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(self.words(text)) if self.merges else self.exact(text)


def _stretches(text: str) -> Iterator[str]:
    """The text in parts of STRETCH characters or some more, cut at blanks."""
    start = 0
    while (end := text.find(" ", start + STRETCH)) >= 0:
        yield text[start:end]
        start = end + 1
    yield text[start:]


def _bytes(ids: list[int]) -> bytes:
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that what it remembers serves all its tasks."""
    return WordEncoder(path)


def _pieces(path: str, end: int, capacity: int, schema: pa.Schema):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail, step = encoder(path), end.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            texts = (v.as_py() or "" for v in batch.column("text"))
            at, cols = [], ([], [], [], [])
            for i, ids in enumerate(encode(texts)):
                ids += tail
                for piece, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    at.append(i)
                    for col, value in zip(cols, (piece, a // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(value)
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)
        pa.default_memory_pool().release_unused()

    return pieces


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length in the given order, and the space used in each bin.

    A segment tree over the remaining capacities 0..capacity says whether a range has an open bin; the
    tightest bin that still fits is found by one climb and one descent.
    """
    leaves = 1 << capacity.bit_length()
    tree = bytearray(2 * leaves)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = [], []
    for length in lengths:
        node = leaves + length
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            free = node - leaves
            own = open_bins[free].pop()
            if not open_bins[free]:
                _mark(tree, node, 0)
        else:
            own = len(used)
            used.append(0)
        bins.append(own)
        offsets.append(used[own])
        used[own] += length
        if left := capacity - used[own]:
            open_bins[left].append(own)
            if len(open_bins[left]) == 1:
                _mark(tree, leaves + left, 1)
    return bins, offsets, used


def _mark(tree: bytearray, node: int, value: int) -> None:
    tree[node] = value
    while node > 1:
        node >>= 1
        tree[node] = tree[2 * node] | tree[2 * node + 1]


def _packed(capacity: int, level: int, schema: pa.Schema):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        table = table.sort_by(order)
        bins, offsets, used = best_fit(table["length"].to_pylist(), capacity)
        base = level << 56 | TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64()))
        table = table.append_column("offset", pa.array(offsets, pa.int64()))
        table = table.append_column("used", pa.array([used[b] for b in bins], pa.int64()))
        yield from table.cast(schema).combine_chunks().to_batches(max_chunksize=50_000)

    return packed


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end: int = 1,
    shard_rows: int = 20_000,
    full: float = 0.995,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Best-fit decreasing: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Texts are tokenized in place (null as empty), ``end`` is added, and only what is longer than
    ``capacity`` is cut. The pieces, small rows without ids, are dealt by a hash to shards of about
    ``shard_rows``; each is sorted by length and packed with a segment tree over remaining capacities.
    Sequences less than ``full`` are opened again and their pieces packed together in fewer shards, as long
    as fewer shards can hold them: the number of sequences is then near that of a single pass, and no task
    holds more than about a shard.

    Every row is a document of its own: repeated rows are packed each time, and a null doc_id is kept.
    Ties go by doc_id and piece, so reruns agree. Other columns, whatever their names, are not read.
    An empty table gives no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    columns = SCHEMA.format(id=id_type)
    arrow = _arrow(docs, doc_id, ["piece", "start", "length", "ids_crc32"])
    rest = cut(base.mapInArrow(_pieces(tokenizer_path, end, capacity, arrow), columns))
    out_columns = columns + ", sequence_id long, offset long, used long"
    out_arrow = _arrow(docs, doc_id, ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "used"])
    done, level = [], 0
    n = ceil_div(rest.count(), shard_rows)
    while True:
        shards = rest.repartition(n, "doc_id", "piece", "start", "length", "ids_crc32")
        packed = cut(shards.mapInArrow(_packed(capacity, level, out_arrow), out_columns))
        loose = packed.where(F.col("used") < full * capacity)
        fewer = ceil_div(loose.count(), shard_rows)
        if fewer >= n:  # one shard, or pieces that leave gaps wherever they are put
            done.append(packed)
            break
        done.append(packed.where(F.col("used") >= full * capacity))
        rest = loose.select("doc_id", "piece", "start", "length", "ids_crc32")
        level, n = level + 1, fewer
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    return result.drop("used")


def _arrow(docs: DataFrame, doc_id: str, names: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {"piece": pa.int32()}
    return pa.schema([("doc_id", to_arrow_type(docs.schema[doc_id].dataType)), *((n, kinds.get(n, pa.int64())) for n in names)])
