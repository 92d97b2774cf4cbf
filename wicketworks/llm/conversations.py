"""Conversation structure repair: turns are aligned to the alternating grammar (s?(ua)+)? at the least cost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wicketworks.llm.common import cut, partitions

BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", "sound"
#: Costs of the edits, and what a truncated turn costs that stays.
REROLE, DELETE, INSERT, STAYS = 3, 4, 3, 3
FAR = 1 << 60
#: Turns that are aligned at once. A longer conversation is aligned piece by piece and put together exactly.
PIECE = 512
ROLES = {"u": "user", "a": "assistant"}
#: What has been emitted so far: nothing, a first system turn, up to a user turn, up to an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = "0sua"
ENTRIES = (NOTHING, SYSTEM, USER, ASSISTANT)


# Damage and faults -----------------------------------------------------------


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32 of ``conv_id:turn`` modulo 20, nulls written as one space.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 makes it the user's.
    """
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown(conv_id), F.lit(":"), shown(turn)).cast("binary")) % 20
    base = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("kind"))
    text_now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_now = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return base.select("conv_id", "turn", role_now.alias("role"), text_now.alias("text"), F.explode(F.array_repeat(F.lit(1), times))).drop("col")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``, the first that holds: blank, duplicate (role and text were seen earlier), truncated, or sound."""
    said = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    seen = Window.partitionBy("conv_id", "same").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(said == "", BLANK)
        .when(F.row_number().over(seen) > 1, DUPLICATE)
        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    return rows.withColumn("same", same).withColumn("fault", fault).drop("same")


# Alignment --------------------------------------------------------------------


def symbols(roles: list[str], faults: list[str]) -> str:
    """One character for each turn: the role's initial, in capitals if truncated; x for other roles, - for what must go."""
    out = []
    for role, fault in zip(roles, faults):
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        out.append("-" if fault in (BLANK, DUPLICATE) else initial.upper() if fault == TRUNCATED else initial)
    return "".join(out)


def _table(turns: str, last: str, slack: int):
    """Cost of aligning ``turns[i:]`` to the last ``k`` letters of ``...uaua`` or ``...auau`` (``last``), banded.

    ``slack`` is what may be spent beyond the cost that every alignment has. From it follows Ukkonen's band: a cell that
    needs more insertions or deletions than ``slack`` pays for is not filled in. Rows are dicts of ``k``.
    """
    other = "u" if last == "a" else "a"
    free = [0] * (len(turns) + 1)  # turns that need not go, from here on
    loose = [0] * (len(turns) + 1)  # those whose deletion costs DELETE - STAYS more than keeping them, not DELETE
    for i in range(len(turns) - 1, -1, -1):
        free[i] = free[i + 1] + (turns[i] != "-")
        loose[i] = loose[i + 1] + turns[i].isupper()
    more, gone = slack // INSERT, slack // (DELETE - STAYS)

    def band(i: int) -> range:
        fewest = free[i] - min(gone, loose[i] + slack // DELETE)
        return range(max(0, fewest), free[i] + more + 1)

    rows: list[dict[int, int]] = [{}] * (len(turns) + 1)
    rows[-1] = {k: INSERT * k for k in band(len(turns))}
    for i in range(len(turns) - 1, -1, -1):
        turn, below, row, left = turns[i], rows[i + 1], {}, FAR
        stays = STAYS if turn.isupper() else 0
        kept = turn.lower()
        for k in band(i):
            least = below.get(k, FAR) + DELETE
            if left + INSERT < least:
                least = left + INSERT
            if k and turn != "-":
                wanted = last if k % 2 else other
                cost = below.get(k - 1, FAR) + stays + (0 if kept == wanted else REROLE)
                if cost < least:
                    least = cost
            row[k] = left = least
        rows[i] = row
    return rows, other


def _backtrace(turns: str, rows: list[dict[int, int]], last: str, other: str, i: int, k: int) -> str:
    """The ASCII-least of the cheapest edits from cell (i, k) on: of the moves that cost no more, D, I, K, R in this order."""
    out = []
    while i < len(turns) or k:
        now = rows[i][k]
        below = rows[i + 1] if i < len(turns) else {}
        if below.get(k, FAR) + DELETE == now:
            out.append("D")
            i += 1
        elif k and rows[i].get(k - 1, FAR) + INSERT == now:
            out.append("I")
            k -= 1
        else:
            out.append("K" if turns[i].lower() == (last if k % 2 else other) else "R")
            i, k = i + 1, k - 1
    return "".join(out)


def _starts_system(turns: str, rows: list[dict[int, int]], k: int) -> tuple[int, int]:
    """Cost of a first ``s`` followed by the last ``k`` letters, and the last turn of those that can be the ``s`` at that cost."""
    least, at, spent = FAR, -1, 0
    for i, turn in enumerate(turns):
        if turn in "sS":
            cost = spent + (STAYS if turn == "S" else 0) + rows[i + 1].get(k, FAR)
            if cost <= least:  # a later one means more deletions first, and D comes before K
                least, at = cost, i
        spent += DELETE
    return least, at


@lru_cache(20_000)
def align(turns: str, entry: str = NOTHING, leave: str = ASSISTANT) -> tuple[int, str]:
    """The cheapest edits (cost, audit) that lead from what was emitted before to what is emitted then.

    Wagner-Fischer alignment to each feasible length of the target: ``leave`` and ``entry`` say how the string ends and
    begins, so all targets share their tail and one table holds the costs of each length. The table is filled
    within Ukkonen's band, from the incumbent cost: that of a first, narrow band, which is widened to it until the
    cheapest cost found lies inside the band that pays for it. The audits of all lengths of that cost are traced back and
    the ASCII-least is taken. From NOTHING, both the targets with a first ``s`` and those without are tried.
    """
    if leave == NOTHING or leave == SYSTEM and entry == SYSTEM:
        return (DELETE * len(turns), "D" * len(turns)) if entry == leave else (FAR, "")
    if leave == SYSTEM:
        cost, at = _starts_system(turns, [{0: DELETE * (len(turns) - i)} for i in range(len(turns) + 1)], 0) if entry == NOTHING else (FAR, -1)
        return (cost, "D" * at + "K" + "D" * (len(turns) - at - 1)) if cost < FAR else (FAR, "")
    base = DELETE * turns.count("-") + STAYS * sum(t.isupper() for t in turns)
    first = "a" if entry == USER else "u"
    odd = first == leave  # an odd number of letters begins and ends with the same one
    fewest = 1 if odd else 0 if entry == leave else 2
    slack = 2 * INSERT
    while True:
        rows, other = _table(turns, leave, slack)
        lengths = [k for k in rows[0] if k % 2 == odd and k >= fewest]
        costs = {(False, k): rows[0][k] for k in lengths}
        if entry == NOTHING and ("s" in turns or "S" in turns):
            width = {k for row in rows for k in row if k % 2 == odd and k >= fewest}
            costs |= {(True, k): _starts_system(turns, rows, k)[0] for k in width}
        least = min(costs.values(), default=FAR)
        if least - base <= slack:
            break
        slack = min(least - base, 4 * slack) if least < FAR else 4 * slack
    audits = []
    for (system, k), cost in costs.items():
        if cost == least:
            at = _starts_system(turns, rows, k)[1] if system else -1
            audits.append(("D" * at + "K" if system else "") + _backtrace(turns, rows, leave, other, at + 1, k))
    return least, min(audits)


def cheapest(turns: str) -> tuple[int, str]:
    """Edits of a whole conversation: all rows deleted, or a target of two letters or more."""
    return min(align(turns, NOTHING, NOTHING), align(turns, NOTHING, ASSISTANT))


def repaired(audit: str, entry: str, roles: list[str], texts: list[str]) -> list[str]:
    """The ``role:text`` lines that an audit leaves, where ``entry`` was emitted before."""
    out, i, emitted = [], 0, entry
    for edit in audit:
        wanted = "a" if emitted == USER else "u"
        if edit == "D":
            i += 1
            continue
        if edit == "I":
            out.append(f"{ROLES[wanted]}:")
        elif edit == "R":
            out.append(f"{ROLES[wanted]}:{texts[i]}")
        else:
            out.append(f"{roles[i]}:{texts[i]}")
            wanted = roles[i][0]
        emitted = wanted
        i += edit != "I"
    return out


# Conversations ---------------------------------------------------------------

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PAIRS = ("su", "ua", "au")


class _Piece:
    """A run of turns of one conversation, in order."""

    def __init__(self, turns: list, roles: list[str], texts: list[str], faults: list[str]):
        self.turns, self.roles, self.texts, self.faults = turns, roles, texts, faults

    def row(self, conv, order: int, alone: bool) -> tuple:
        """What is sent on. ``alone``: it is known to be its whole conversation, so that its repair is known too."""
        known = [t for t in self.turns if t is not None]
        counts = [self.faults.count(f) for f in _COUNTS[:3]]
        illegal = sum(a[:1] + b[:1] not in _PAIRS for a, b in zip(self.roles, self.roles[1:]))
        ends = (self.roles[0][:1], self.roles[-1][:1])
        head = (conv, order, known[0] if known else None, known[-1] if known else None, len(set(known)), *counts, illegal, *ends)
        code = symbols(self.roles, self.faults)
        if alone:
            cost, audit = cheapest(code)
            lines = repaired(audit, NOTHING, self.roles, self.texts)
            return (*head, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), None, None, None)
        return (*head, None, None, None, code, self.roles, self.texts)


def _schema(conv: T.DataType, turn: T.DataType) -> T.StructType:
    out = T.StructType().add("conv_id", conv).add("place", T.LongType()).add("first", turn).add("last", turn).add("turns", T.LongType())
    for name in (*_COUNTS, ):
        out = out.add(name, T.LongType())
    for name in ("starts", "ends"):
        out = out.add(name, T.StringType())
    out = out.add("cost", T.LongType()).add("audit", T.StringType()).add("digest", T.StringType()).add("code", T.StringType())
    return out.add("roles", T.ArrayType(T.StringType())).add("texts", T.ArrayType(T.StringType()))


def _pieces(schema: pa.Schema, piece: int):
    """Pieces of the sorted turns of a partition. Those that may go on in another partition, or are full, are not alone."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        out, size = [], 0
        place, conv, begun, first = TaskContext.get().partitionId() << 40, None, False, True

        def ready():
            nonlocal out, size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0

        def close(alone: bool) -> None:
            nonlocal held, place, size
            row = _Piece(*held).row(conv, place, alone)
            out.append(row)
            size += 0 if alone else sum(map(len, held[2]))
            place += 1
            held = [[], [], [], []]

        split = True  # the first conversation of a partition may have begun in another
        for batch in batches:
            for now, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if begun and now != conv:
                    close(not split)
                    split = False
                elif begun and len(held[0]) >= piece:
                    close(False)
                    split = True
                conv, begun = now, True
                for column, value in zip(held, turn):
                    column.append(value)
                if len(out) >= 1024 or size > 4 << 20:
                    yield from ready()
        if begun:
            close(False)
        yield from ready()

    return pieces


def _joined(schema: pa.Schema):
    """Whole conversations from their pieces, which come in order: one piece is held at a time.

    For each of the four things that may have been emitted so far, the cheapest edits up to here are kept as a cost, the audits
    of the pieces and a running digest. The least of equal costs is the ASCII-least audit, piece by piece: audits of the
    same turns and cost are never beginnings of one another, as what is longer would have paid for an insertion.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, total, out, begun = None, {}, [], [], False

        def close() -> tuple:
            cost, audit, digest, _ = min((state[s] for s in (NOTHING, ASSISTANT) if s in state), key=lambda x: x[:2])
            return (conv, 0, *total, cost, audit, digest.hexdigest(), None, None, None)

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        out.append(close())
                    conv, begun, total = row["conv_id"], True, None
                    state = {NOTHING: (0, "", hashlib.sha256(), False)}
                if total is None:
                    total = [row["first"], row["last"], row["turns"], *(row[c] for c in _COUNTS), row["starts"], row["ends"]]
                else:
                    total = _added(total, row)
                state = _advance(state, row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if begun:
            out = [close()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return joined


def _added(total: list, row: dict) -> list:
    first, last, turns, *counts, starts, ends = total
    shared = last is not None and last == row["first"]
    counts = [a + row[c] for a, c in zip(counts, _COUNTS)]
    counts[-1] += ends + row["starts"] not in _PAIRS
    return [
        row["first"] if first is None else first, last if row["last"] is None else row["last"],
        turns + row["turns"] - shared, *counts, starts, row["ends"],
    ]


def _advance(state: dict, row: dict) -> dict:
    after = {}
    for leave in ENTRIES:
        ways = []
        for entry, (cost, audit, _, _) in state.items():
            more, edits = align(row["code"], entry, leave)
            if more < FAR:
                ways.append((cost + more, audit + edits, entry, edits))
        if ways:
            cost, audit, entry, edits = min(ways, key=lambda w: w[:2])
            lines = repaired(edits, entry, row["roles"], row["texts"])
            _, _, digest, any_line = state[entry]
            if lines:
                digest = digest.copy()
                digest.update((("\n" if any_line else "") + "\n".join(lines)).encode())
            after[leave] = (cost, audit, digest, any_line or bool(lines))
    return after


def repair(
    rows: DataFrame, piece: int = PIECE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of ``rows``.

    A conversation is repaired by the cheapest edits that make its role initials ``(s?(ua)+)?``. Keep costs 0, Rerole to user or
    assistant 3, Delete 4, Insert of an empty user or assistant turn 3. Blank turns and duplicates must go. Truncated turns that stay
    cost 3 more. ``audit`` has the initials of the edits in order, the ASCII-least of the cheapest; the hash is that of the
    ``role:text`` lines. ``gaps`` are the turn numbers missing between the least and the largest; ``illegal`` counts
    neighbours whose initials are not su, ua or au.

    1. Duplicates are numbered by (conversation, role and text).
    2. Turns are dealt to tasks by ranges of (conversation, turn), so a conversation that holds a third of all rows is
       spread over the tasks in order. There they are cut into pieces of at most ``piece`` turns.
    3. A conversation that is one piece is aligned at once (``align``). The pieces of the others, at most two conversations a
       task besides the long ones, are put together in order; one piece is held at a time. A hash of a whole
       conversation can only be taken in order, so its lines pass one task, as a stream.

    Turns are ordered by number, null first; those of equal numbers by a hash of role and text, so equal rows are neighbours. Null roles and texts are a space.
    A null conversation id is a conversation of its own. Other columns, whatever their names, are not read. An empty
    table gives no rows.
    """
    base = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    marked = with_faults(base)
    # Equal turn numbers are put in order by a hash, so that the ranges need no texts; the first of equal rows is no duplicate.
    ranges = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.xxhash64("role", "text")]
    dealt = marked.repartitionByRange(partitions(marked), *ranges)
    ordered = dealt.sortWithinPartitions(*ranges, F.asc("role"), F.asc("text"), F.col("fault") == DUPLICATE)
    schema = _schema(base.schema["conv_id"].dataType, base.schema["turn"].dataType)
    arrow = to_arrow_schema(schema)
    found = cut(ordered.mapInArrow(_pieces(arrow, piece), schema))
    several = found.where("audit is null").repartition(partitions(found), "conv_id").sortWithinPartitions("conv_id", "place")
    whole = found.where("audit is not null").union(several.mapInArrow(_joined(arrow), schema))
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return whole.select("conv_id", gaps.alias("gaps"), *_COUNTS, "cost", "audit", F.col("digest").alias("repaired_sha256"))


def with_unrepaired(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """``found``, a result of repair, with a row of zeros, no audit and no lines for every other id of ``conversations``."""
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
