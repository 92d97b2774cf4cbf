"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
ORDER = 3
PAD = b"\n" * ORDER
CHUNK = 1 << 20


@dataclass
class ByteModel:
    """Frozen statistics of all languages: one row of code lengths per context and symbol.

    ``symbol`` maps bytes to symbols (0: bytes never seen), ``context`` the last three symbols to the
    deepest context that any language has, ``bits`` holds context x symbol x language.
    """

    languages: list[str]
    symbol: np.ndarray
    context: np.ndarray
    bits: np.ndarray


def fit(samples: dict[str, list[bytes]]) -> ByteModel:
    """Context trees of orders 0 to 3 per language, with escape probabilities, turned into code lengths.

    In a context that saw ``n`` symbols, ``d`` of them different, a symbol seen ``c`` times has c / (n + d).
    The escape has d / (n + d) and hands over to the next shorter context, among the symbols not seen in
    this one (exclusion). Below order 0 all symbols are alike, but for bytes seen in no sample, which are one
    symbol together, of a 256th of the others' weight. A language without a context uses its longest shorter one.
    """
    languages = sorted(samples)
    streams = {k: PAD + PAD.join(v) for k, v in samples.items()}
    seen = np.unique(np.concatenate([np.frombuffer(s, np.uint8) for s in streams.values()]))
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1

    grams = {k: _counts(symbol[np.frombuffer(s, np.uint8)].astype(np.int64), size) for k, s in streams.items()}
    contexts = [np.zeros(1, np.int64)]
    contexts += [np.unique(np.concatenate([g[o][0] // size for g in grams.values()])) for o in range(1, ORDER + 1)]

    uniform = np.full((1, size), 1 / (size - 1 + 1 / 256))
    uniform[0, 0] /= 256
    bits = []
    for k in languages:
        lower, lower_ids, own = uniform, None, []
        for order in range(ORDER + 1):
            ids = contexts[order]
            count = np.zeros((len(ids), size))
            codes, n = grams[k][order]
            count[np.searchsorted(ids, codes // size), codes % size] = n
            up = np.zeros(len(ids), int) if lower_ids is None else np.searchsorted(lower_ids, ids % size ** (order - 1) if order > 1 else ids * 0)
            base = lower[up]
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            left = np.where(count > 0, 0, base)
            share = left.sum(1, keepdims=True)
            escape = np.where(share > 0, kinds / np.maximum(total + kinds, 1), 0)
            scale = np.where(share > 0, total + kinds, total)
            p = np.where(count > 0, count / np.maximum(scale, 1), escape * left / np.maximum(share, 1e-300))
            p = np.where(total > 0, p, base)
            own.append(-np.log2(p).astype(np.float32))
            lower, lower_ids = p, ids
        bits.append(np.concatenate(own))
    table = np.stack(bits, axis=2)

    starts = np.cumsum([0] + [len(c) for c in contexts])
    context = np.zeros(1, np.int32)
    for order in range(1, ORDER + 1):
        # Deepest context for each longer one: inherit from the suffix, then set those that exist.
        context = np.tile(context, size) if order > 1 else np.zeros(size, np.int32)
        context[contexts[order]] = starts[order] + np.arange(len(contexts[order]), dtype=np.int32)
    return ByteModel(languages, symbol, context, np.ascontiguousarray(table))


def _counts(symbols: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of the grams of length 1 to ORDER + 1; the last symbol is the lowest digit."""
    out = []
    code = symbols[ORDER:]
    for order in range(ORDER + 1):
        if order:
            code = code + symbols[ORDER - order : len(symbols) - order] * size**order
        out.append(np.unique(code, return_counts=True))
    return out


def code_lengths(model: ByteModel, texts: list[bytes]) -> np.ndarray:
    """Bits that each language needs for each text, in whole texts; work space is bounded by CHUNK bytes."""
    size = int(model.symbol.max()) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(PAD + PAD.join(texts), np.uint8)
    starts = np.cumsum(np.concatenate([[0], sizes[:-1] + ORDER])) + ORDER
    ends = starts + sizes
    total = np.zeros((len(texts), len(model.languages)))
    for a in range(ORDER, len(buffer), CHUNK):
        b = min(len(buffer), a + CHUNK)
        s = model.symbol[buffer[a - ORDER : b]]
        code = (s[: b - a] * size + s[1 : b - a + 1]) * size + s[2 : b - a + 2]
        bits = model.bits[model.context[code], s[ORDER:]]
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if first < last:
            lo = np.maximum(starts[first:last], a) - a
            hi = np.minimum(ends[first:last], b) - a
            some = hi > lo
            if some.any():
                cuts = np.stack([lo[some], np.minimum(hi[some], b - a)], 1).ravel()
                padded = np.concatenate([bits, np.zeros((1, bits.shape[1]), np.float32)])
                total[np.arange(first, last)[some]] += np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
    return total


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(labelled: DataFrame, per_language: int, max_bytes: int) -> dict[str, list[bytes]]:
    """Texts to learn from: about ``per_language`` of each label, by a hash of text, none over ``max_bytes``.

    ``labelled`` holds text and lang. The labels are counted over all rows; the share of rows that
    brings ``per_language`` is then taken in one scan, without moving a text that isn't taken.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    steps = 1 << 30
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(steps, int(steps * per_language / n) + 1)))])
    taken = usable.where(F.pmod(F.xxhash64("text", F.lit(5)), steps) < share[F.col("lang")])
    texts: dict[str, list[bytes]] = {}
    # A text that repeats a million times is taken once.
    for row in sorted(taken.select("lang", "text").dropDuplicates().collect()):
        texts.setdefault(row["lang"], []).append(row["text"].encode())
    return texts


def identify_language(
    docs: DataFrame,
    labelled: DataFrame,
    per_language: int = 300,
    max_bytes: int = 1 << 14,
    text: str = "text",
) -> DataFrame:
    """(row, lang_pred, score): the language whose frozen byte statistics code the text in the fewest bits.

    ``labelled`` (text, lang) is what is learned from, by a bounded sample: about ``per_language`` texts of
    at most ``max_bytes`` bytes for each language, so the driver holds some MB for each label. Every
    byte of every text is then scored under every language. ``score`` is the language's share of the
    probability of the text, all languages alike likely beforehand.

    ``row`` holds all columns of the input, whatever their names; none but the text is read. Null texts and
    texts without a letter are ``und`` with score 0, and so are all texts if there is nothing to learn from.
    Ties go to the first language by code point. Repeated rows get equal results; an empty table no rows.
    """
    samples = sample(labelled, per_language, max_bytes)
    lettered = F.col("text").rlike(r"\p{L}")
    base = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    if not samples:
        return base.select("row", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(fit(samples))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            lengths = code_lengths(model.value, [t.encode() for t in batch])
            best = lengths.argmin(1)
            least = lengths.min(1, keepdims=True)
            score = 1 / np.exp2(np.maximum(least - lengths, -1000)).sum(1)
            yield pd.DataFrame({"lang_pred": [model.value.languages[i] for i in best], "score": score})

    found = predict(F.when(lettered, F.col("text")).otherwise(F.lit("")))
    known = F.coalesce(lettered, F.lit(False))
    return base.select("row", known.alias("known"), found.alias("found")).select(
        "row",
        F.when(F.col("known"), F.col("found.lang_pred")).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(F.col("known"), F.col("found.score")).otherwise(F.lit(0.0)).alias("score"),
    )
