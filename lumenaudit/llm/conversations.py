"""Repair of conversations whose turns are out of order, repeated, blank or cut off: A* on the edit lattice.

A repaired conversation's roles are `(s?(ua)+)?`: nothing, or an optional system turn and then pairs of user and
assistant. Edits: Keep a row (0), Rerole it to user or assistant (1), Delete it (2; blank and duplicate rows must go),
Insert an empty turn of user or assistant (5); a truncated row that stays costs 5 more. Of the cheapest edits those
whose initials, in order, are least in ASCII are taken.

Search. A node of the lattice is (rows consumed, state of the role pattern), and the queue's key is (cost so far plus
heuristic, audit). The heuristic is a suffix sum: 2 for every row ahead that must go, and 2 for every truncated one,
which costs 2 deleted and 5 kept. It never overestimates and falls by no more than an edit costs, so a node is final when
it is first taken; of equal keys the least audit is taken first, and so wins. (Two audits that reach a node at equal cost
consume the same rows and hold equally many insertions; neither begins the other, so whatever follows keeps their order.)

Long conversations. Rows are sorted by range, so a conversation of any size lies in several tasks, and is cut into
pieces of at most `PIECE` rows. A piece whose first state isn't known is searched from every state to every state; the
tables of two neighbouring pieces join into one, as costs add and audits concatenate, until the whole is one table. What
one task holds is 16 bytes a row of one conversation; its audit, a single string, is as long as that anyway. Texts stay
out of all this. They are read once more, by conversation and in order, row after row, to be edited (a SHA-256 of a
conversation can only be computed from its first byte on; nothing of it is kept).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

# Costs of the edits.
RETITLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a piece. The queue of a search holds audits of up to this length.
PIECE = 256
#: States of the role pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Kinds of rows: the role's class, four times, plus the fault.
CLASSES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
FINE, BLANK, DUPLICATE, CUT = range(4)
#: What a message needs to be more than blank, and how it should end.
VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def after(state: int) -> int:
    """The state after the next turn of user or assistant, which from every state is one of the two only."""
    return ASSISTANT if state == USER else USER


def search(codes: bytes, entry: int) -> dict[int, tuple[int, str]]:
    """For each state in which the rows can end, having begun in entry: the least cost and its least audit."""
    n = len(codes)
    ahead = np.zeros(n + 1, np.int64)
    ahead[:n] = np.cumsum([DELETE if c % 4 != FINE else 0 for c in reversed(codes)])[::-1]
    ahead = ahead.tolist()
    queue, done, found = [(ahead[0], "", 0, entry)], set(), {}
    while queue:
        total, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = total - ahead[i]
        if i == n:
            found[state] = (cost, audit)
            if len(found) == 4:
                break
        heapq.heappush(queue, (total + INSERT, audit + "I", i, after(state)))
        if i == n:
            continue
        kind, fault = divmod(codes[i], 4)
        rest = cost + ahead[i + 1]
        heapq.heappush(queue, (rest + DELETE, audit + "D", i + 1, state))
        if fault in (BLANK, DUPLICATE):
            continue
        rest += TRUNCATED if fault == CUT else 0
        heapq.heappush(queue, (rest + RETITLE, audit + "R", i + 1, after(state)))
        if kind == CLASSES["s"] and state == START:
            heapq.heappush(queue, (rest, audit + "K", i + 1, SYSTEM))
        elif kind == (CLASSES["a"] if state == USER else CLASSES["u"]):
            heapq.heappush(queue, (rest, audit + "K", i + 1, after(state)))
    return found


@lru_cache(100_000)
def _searched(codes: bytes, entries: tuple[int, ...]) -> tuple[tuple[int, int, int, str], ...]:
    """The table of a piece: (from, to, cost, audit). Short conversations repeat, so results are kept."""
    return tuple((e, x, cost, audit) for e in entries for x, (cost, audit) in sorted(search(codes, e).items()))


Table = dict[tuple[int, int], tuple[int, str]]


def joined(left: Table, right: Table) -> Table:
    """The table of two neighbouring pieces."""
    out: Table = {}
    for (a, b), (cost, audit) in left.items():
        for (c, d), (more, rest) in right.items():
            if b == c:
                at = out.get((a, d))
                if at is None or cost + more <= at[0]:
                    both = (cost + more, audit + rest)
                    out[a, d] = both if at is None else min(at, both)
    return out


def best(table: Table) -> tuple[int, str]:
    return min(table[START, x] for x in ENDS if (START, x) in table)


def illegal(codes: np.ndarray) -> int:
    """Neighbours whose roles aren't system and user, user and assistant, or assistant and user."""
    a, b = codes[:-1] // 4, codes[1:] // 4
    s, u, x = CLASSES["s"], CLASSES["u"], CLASSES["a"]
    return int(len(a) - (((a == s) & (b == u)) | ((a == u) & (b == x)) | ((a == x) & (b == u))).sum())


PIECES = "part int, seq int, turn long, role string, digest binary, id long, n int, first int, last int, blank long, duplicate long, truncated long, illegal long, whole boolean, moves array<struct<a:int,b:int,cost:long,audit:string>>"


def _solve(piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (conv, turn, role, digest, id, code) in order: a row per piece. Whole ones have only their cheapest edits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, number = TaskContext.get().partitionId(), 0, 0
        held: list | None = None  # conv, turn, role, digest, id, codes, how many pieces of it were before
        kind = None
        out: list[tuple] = []

        def made(ends: bool) -> tuple:
            conv, turn, role, digest, i, codes, before = held
            # The first conversation of a task may have begun in another one, the last may go on in the next.
            began = not before and (number > 1 or part == 0)
            raw = bytes(codes)
            each = np.frombuffer(raw, np.uint8)
            faults = np.bincount(each % 4, minlength=4)
            whole = began and ends
            moves = _searched(raw, (START,) if began else (START, SYSTEM, USER, ASSISTANT))
            if whole:
                cost, audit = best({(a, b): (c, x) for a, b, c, x in moves})
                moves = ((START, START, cost, audit),)
            return (conv, part, seq, turn, role, digest, i, len(raw), raw[0], raw[-1], int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[CUT]), illegal(each), whole, [dict(zip(("a", "b", "cost", "audit"), m, strict=True)) for m in moves])

        def batch() -> pa.RecordBatch:
            names = ["conv", *(c.split()[0] for c in PIECES.split(", "))]
            types = [kind, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.bool_(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
            done = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return done

        for b in parts:
            kind = b.schema.field(0).type
            for conv, turn, role, digest, i, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] != conv:
                    out.append(made(True))
                    held, seq = None, seq + 1
                elif held is not None and len(held[5]) == piece:
                    out.append(made(False))
                    held, seq = [conv, turn, role, digest, i, bytearray(), held[6] + 1], seq + 1
                if held is None:
                    held, number = [conv, turn, role, digest, i, bytearray(), 0], number + 1
                held[5].append(code)
                if len(out) >= 2000:
                    yield batch()
        if held is not None:
            out.append(made(False))
        if out:
            yield batch()

    return run


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pieces of a conversation: what stands in its summary (on the first piece) and each piece's share of the audit."""
    pdf = pdf.sort_values(["part", "seq"], ignore_index=True)
    tables = [{(m["a"], m["b"]): (m["cost"], m["audit"]) for m in moves} for moves in pdf["moves"]]
    while len(tables) > 1:
        tables = [joined(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    cost, audit = best(tables[0])
    shares, at = [], 0
    for n in pdf["n"]:
        end, left = at, int(n)
        while left:
            left -= audit[end] != "I"
            end += 1
        shares.append(audit[at:end])
        at = end
    shares[-1] += audit[at:]
    between = [illegal(np.array([a, b])) for a, b in zip(pdf["last"][:-1], pdf["first"][1:], strict=True)]
    out = pdf[["conv", "turn", "role", "digest", "id"]].copy()
    out["share"] = shares
    for c in ("blank", "duplicate", "truncated", "illegal"):
        out[c] = [int(pdf[c].sum()) + (sum(between) if c == "illegal" else 0)] + [0] * (len(pdf) - 1)
    out["cost"] = [cost] + [0] * (len(pdf) - 1)
    out["audit"] = [audit] + [None] * (len(pdf) - 1)
    return out


def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Over (conv, kind, role, text, share) in order, a share (kind 0) before the rows it is for: (conv, new, role, text) of what stays.

    `new` tells an inserted turn. After a conversation's last row comes (conv, None, None, None).
    """
    conv, began, state, pending, at = None, False, START, "", 0

    def inserts() -> Iterator[tuple]:
        nonlocal state, at
        while at < len(pending) and pending[at] == "I":
            state, at = after(state), at + 1
            yield conv, True, "user" if state == USER else "assistant", ""

    for key, kind, role, text, share in rows:
        if not began or key != conv:
            if began:
                yield from inserts()
                yield conv, None, None, None
            conv, began, state, pending, at = key, True, START, "", 0
        if not kind:
            pending, at = pending[at:] + share, 0
            continue
        yield from inserts()
        edit, at = pending[at], at + 1
        if edit == "D":
            continue
        if edit == "K" and state == START and role.startswith("s"):
            state = SYSTEM
        else:
            state = after(state)
            role = role if edit == "K" else "user" if state == USER else "assistant"
        yield conv, False, role, text
    if began:
        yield from inserts()
        yield conv, None, None, None


class Repair:
    """The repair of all conversations of rows(conv, turn, role, text).

    Rows without a conversation are one of their own; null roles and texts count as one space. Rows are ordered by turn
    (nulls first), then role, then a digest of role and text; rows that repeat all of these follow each other, and all
    but the first are duplicates. Empty texts are blank. Very long texts never meet in memory. No rows, no conversations;
    extra columns are not read.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE):
        filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
        digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
        # Ids must not change when a task runs again, so they are written.
        self.rows = written(plain.select("*", digest.alias("digest"), F.monotonically_increasing_id().alias("id")))
        kinds = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(OTHER)
        narrow = self.rows.select("conv", "turn", "role", "digest", "id", kinds.alias("class"), (~F.col("text").rlike(VISIBLE)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"))
        place = F.struct("turn", "id")
        again = narrow.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("own_conv"), F.col("digest").alias("own_digest"), F.col("first.id").alias("first_id"))
        known = narrow.join(again, F.col("conv").eqNullSafe(F.col("own_conv")) & (F.col("digest") == F.col("own_digest")), "left")
        fault = F.when(F.col("blank"), BLANK).when(F.col("first_id") != F.col("id"), DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
        order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("id")]
        coded = known.select("conv", "turn", "role", "digest", "id", (F.col("class") * 4 + fault).alias("code"))
        kind = rows.schema[conv_col].dataType.simpleString()
        self.pieces = written(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_solve(piece), f"conv {kind}, {PIECES}"))
        schema = f"conv {kind}, turn long, role string, digest binary, id long, share string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
        move = F.col("moves")[0]
        whole = self.pieces.where("whole").select("conv", "turn", "role", "digest", "id", move["audit"].alias("share"), "blank", "duplicate", "truncated", "illegal", move["cost"].alias("cost"), move["audit"].alias("audit"))
        self.edits = written(whole.unionByName(self.pieces.where("not whole").groupBy("conv").applyInPandas(_together, schema)))
        dropped(self.pieces)

    def summary(self) -> DataFrame:
        """(conv, blank, duplicate, truncated, illegal, cost, audit): a row per conversation that has rows."""
        return self.edits.where("audit is not null").select("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _stream(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        shares = self.edits.select("conv", "turn", "role", "digest", "id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "share")
        texts = self.rows.select("conv", "turn", "role", "digest", "id", F.lit(1).alias("kind"), "text", F.lit(None).cast("string").alias("share"))
        order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("id"), F.asc("kind")]
        kind = self.rows.schema["conv"].dataType.simpleString()
        return shares.union(texts).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "share").mapInArrow(run, f"conv {kind}, {schema}")

    def turns(self) -> DataFrame:
        """(conv, place, role, text, inserted): the repaired conversations, places from 0."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, out, size = 0, [], 0
            kind = None

            def rows() -> Iterator[tuple]:
                nonlocal kind
                for b in parts:
                    kind = b.schema.field(0).type
                    yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

            def batch() -> pa.RecordBatch:
                types = [kind, pa.int64(), pa.string(), pa.string(), pa.bool_()]
                return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv", "place", "role", "text", "inserted"])

            for conv, new, role, text in edited(rows()):
                if new is None:
                    place = 0
                    continue
                out.append((conv, place, role, text, new))
                place, size = place + 1, size + len(text)
                if len(out) >= 5000 or size > 4 << 20:
                    yield batch()
                    out, size = [], 0
            if out:
                yield batch()

        return self._stream(run, "place long, role string, text string, inserted boolean")

    def digests(self) -> DataFrame:
        """(conv, sha256): of the repaired `role:text`, joined by line ends."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashed, n, out = hashlib.sha256(), 0, []
            kind = None

            def rows() -> Iterator[tuple]:
                nonlocal kind
                for b in parts:
                    kind = b.schema.field(0).type
                    yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

            def batch() -> pa.RecordBatch:
                return pa.record_batch([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], names=["conv", "sha256"])

            for conv, new, role, text in edited(rows()):
                if new is None:
                    out.append((conv, hashed.hexdigest()))
                    hashed, n = hashlib.sha256(), 0
                    if len(out) >= 5000:
                        yield batch()
                        out = []
                    continue
                hashed.update((f"\n{role}:{text}" if n else f"{role}:{text}").encode("utf-8", "surrogatepass"))
                n += 1
            if out:
                yield batch()

        return self._stream(run, "sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to conversations(conv_id, turn, role, text), by a hash of conversation and turn; nulls of role, text and key count as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(filled("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    coded = rows.select("conv_id", "turn", "role", "text", code.alias("code")).where("code <> 0")
    return coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def gaps(rows: DataFrame) -> DataFrame:
    """(conv, gaps): turns missing between the first and the last; of null turns alone none."""
    found: Column = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return rows.groupBy(F.col("conv_id").alias("conv")).agg(F.coalesce(found, F.lit(0)).cast("long").alias("gaps"))


def op11(conversations: DataFrame) -> DataFrame:
    """The contract's damage and its repair, digested: a row per conversation, those that lost all rows too. Odd rows as in `Repair`."""
    rows = damaged(conversations)
    repair = Repair(rows)
    every = conversations.select(F.col("conv_id")).distinct()
    out = every
    for part in (gaps(repair.rows.withColumnRenamed("conv", "conv_id")), repair.summary(), repair.digests()):
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
