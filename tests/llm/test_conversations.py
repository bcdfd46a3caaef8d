"""Conversation repair against brute force, over pieces of any size."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, id int, code string, kind int, share string, digest string"


def frame(spark, rows):
    """conversations with columns that clash with names the operator uses."""
    return spark.createDataFrame([(*r, 7, "x", 3, "y", "z") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else x
        code = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def order(r):
    conv, turn, role, text = r
    return (turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By trying every edit of every row in every state, from the last row to the first."""
    kinds = faults(rows)

    @lru_cache(None)
    def rest(i, state, inserted):
        turn = "user" if state != "u" else "assistant"
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            c, a, o = rest(i, turn[0], inserted + 1)
            ways.append((c + 5, "I" + a, ((turn, ""), *o)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, o = rest(i + 1, state, 0)
            ways.append((c + 2, "D" + a, o))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] else 0
                c, a, o = rest(i + 1, turn[0], 0)
                ways.append((c + 1 + more, "R" + a, ((turn, text), *o)))
                if role[:1] == turn[0] or role[:1] == "s" and state == "":
                    c, a, o = rest(i + 1, role[0], 0)
                    ways.append((c + more, "K" + a, ((role, text), *o)))
        return min(ways) if ways else (10**9, "", ())

    return rest(0, "", 0)


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=order)
        kinds, turns, roles = faults(own), [r[1] for r in own if r[1] is not None], [r[2][:1] for r in own]
        cost, audit, kept = cheapest(own)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def corpus(n=120, seed=3):
    r = random.Random(seed)
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"])
    text = lambda: r.choice(["Yes.", "No!", "Why? \n", "cut", "", " \t", None, "Long " * r.randint(1, 40) + ".", "Ends here.\u0085", "x" * 5000])
    rows = [(c, t if r.random() < 0.95 else None, role(), text()) for c in range(n) for t in range(r.randint(1, 9))]
    rows += [(1000, t, r.choice(["user", "assistant"]), f"turn {t} {r.choice(['.', ''])}") for t in range(120)]
    rows += [(2000, 1, "user", "again.")] * 70 + [(2000, t, "user", "again.") for t in range(60)]
    rows += [(None, t, "user", "Mine.") for t in range(3)] + [(3000, None, "user", "A."), (3000, None, "assistant", "B.")]
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_is_brute_force(spark):
    rows = corpus()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.op11(frame(spark, rows).repartition(5)).collect()}
    assert got == want(rows)


@pytest.mark.parametrize("piece", [1, 7])
def test_pieces_make_the_same_whole(spark, piece):
    rows = [r for r in corpus(20, 5) if r[0] is None or r[0] != 2000]
    repair = conversations.Repair(conversations.damaged(frame(spark, rows)), piece=piece)
    full = want(rows)
    assert {r["conv"]: tuple(r[c] for c in COLUMNS[1:-1]) for r in repair.summary().collect()} == {k: v[1:-1] for k, v in full.items() if any(d[0] == k for d in damage(rows))}
    turns = {}
    for r in repair.turns().orderBy("place").collect():
        turns.setdefault(r["conv"], []).append((r["place"], r["role"], r["text"], r["inserted"]))
    for conv, kept in turns.items():
        assert [k[0] for k in kept] == list(range(len(kept)))
        assert hashlib.sha256("\n".join(f"{k[1]}:{k[2]}" for k in kept).encode()).hexdigest() == full[conv][-1]
        assert sum(k[3] for k in kept) == full[conv][-2].count("I")


def test_search_and_joins_agree():
    r = random.Random(2)
    for _ in range(300):
        codes = bytes(r.randrange(16) for _ in range(r.randint(1, 12)))
        cut = r.randint(0, len(codes))
        tables = [{(a, b): x for a in range(4) for b, x in conversations.search(c, a).items()} for c in (codes[:cut], codes[cut:], codes)]
        assert conversations.joined(*tables[:2]) == tables[2]


def test_nothing_to_repair(spark):
    assert conversations.op11(frame(spark, [])).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in conversations.op11(frame(spark, [(lost, 0, "user", "A.")])).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_long_conversation_is_split(spark):
    """Its rows are dealt to several tasks, and none of them holds the texts."""
    rows = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id"), F.lit(".")).alias("text"))
    repair = conversations.Repair(rows.repartition(8))
    (got,) = repair.summary().collect()
    assert (got["cost"], got["audit"]) == (0, "K" * 20_000)
    assert repair.edits.count() > 20_000 // conversations.PIECE
