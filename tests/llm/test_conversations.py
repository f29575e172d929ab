"""Conversation repair against plain searches."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import conversations as c
from loomgraph.llm.registry import op12_repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def searched(rows):
    """Cheapest (cost, audit) by trying all edits of a few rows: (initial, must go, truncated)."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        if any(e != "D" and must for e, (_, must, _) in zip(edits, rows)):
            continue
        for inserts in product(range(3), repeat=len(rows) + 1):
            outs, audit, cost = [""], "", 0
            for k in range(len(rows) + 1):
                outs = [o + "".join(x) for o in outs for x in product("ua", repeat=inserts[k])]
                audit += "I" * inserts[k]
                cost += 2 * inserts[k]
                if k < len(rows):
                    audit += edits[k]
                    initial, _, truncated = rows[k]
                    if edits[k] == "K":
                        outs = [o + initial for o in outs]
                    elif edits[k] == "R":
                        outs = [o + x for o in outs for x in "ua"]
                    cost += {"K": 0, "R": 2, "D": 3}[edits[k]] + (truncated and edits[k] != "D")
            if any(re.fullmatch("(s?(ua)+)?", o) for o in outs) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def code(row):
    initial, must, truncated = row
    return "d" if must else initial.upper() if truncated else initial


def test_chart_finds_the_cheapest_audit():
    kinds = [("s", False, False), ("u", False, False), ("a", False, False), ("x", False, False), ("u", True, False), ("u", False, True), ("a", False, True), ("s", False, True)]
    for n in range(3):
        for rows in product(kinds, repeat=n):
            assert c.completed(c.chart("".join(map(code, rows)), "")) == searched(rows), rows
    rng = random.Random(1)
    for _ in range(12):
        rows = rng.choices(kinds, k=4)
        assert c.completed(c.chart("".join(map(code, rows)), "")) == searched(rows), rows


@pytest.mark.parametrize("most", [1, 2, 5])
def test_stretches_compose(most):
    rng = random.Random(2)
    for _ in range(300):
        rows = "".join(rng.choices("suaxdUAS", k=rng.randrange(1, 40)))
        whole = c.completed(c.chart(rows, ""))
        at = sorted(rng.choices(range(1, len(rows) + 1), k=3))
        cut = [x for x in (rows[: at[0]], rows[at[0] : at[1]], rows[at[1] : at[2]], rows[at[2] :]) if x]
        assert c.completed(c.compose([c.stretch(x, tuple(c.BY_LEFT), most) for x in cut])) == whole


def plain(rows):
    """One conversation's columns from its rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    codes = "".join("d" if f in ("blank", "duplicate") else (i if i in ("s", "u", "a") else "x").upper() if f else i if i in ("s", "u", "a") else "x" for f, i in zip(faults, initials))
    cost, audit = c.completed(c.chart(codes, ""))
    out, left, at = [], "", 0
    for edit in audit:
        row = rows[at] if edit != "I" else (None, "", "")
        at += edit != "I"
        if edit == "D":
            continue
        role = row[1] if edit == "K" else "assistant" if left == "u" else "user"
        left = role[0]
        out.append(f"{role}:{row[2]}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def table(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for k in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None, "usr"], [8, 8, 2, 1, 1, 1, 1])[0]
            text = rng.choices([f"t{turn}. ", f"t{turn} é", "same!", "", " \t\x0b\r\n", None, "no end\x1f"], [9, 3, 3, 1, 1, 1, 1])[0]
            rows.append((None if k == 3 else k, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text))
    return rows + rng.choices(rows, k=len(rows) // 10)


def check(spark, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
        plans = c.plan_repairs(frame)
        got = {r.conv_id: tuple(r)[1:] for r in c.repair_digests(frame, plans).collect()}
        repaired = c.repair_conversations(frame, plans).orderBy("conv_id", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for conv_id, *row in rows:
        groups.setdefault(conv_id, []).append(tuple(row))
    assert got == {k: plain(v) for k, v in groups.items()}
    for conv_id in groups:
        mine = [r for r in repaired if r.conv_id == conv_id]
        assert [r.place for r in mine] == list(range(len(mine))) and re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert "".join(r.edit for r in mine) == got[conv_id][6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == got[conv_id][7]


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_conversations_equal_plain_repair(spark, partitions):
    """Nulls, blanks, repeats, ties and odd roles; with 40 ranges many conversations are cut."""
    check(spark, table(partitions, 60, 12), partitions)


def test_one_conversation_over_many_ranges(spark):
    check(spark, table(9, 1, 4000) + [(77, t, "user", "a.") for t in range(300)] + [(78, 1, "user", "same.")] * 50, 16)


def test_damage(spark):
    rows = [(k, t, "assistant", "One. Two? Three!") for k in range(40) for t in range(3)] + [(None, 0, None, None), (5, None, "user", "x.")]
    got = {}
    for r in c.damage(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    seen = set()
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got.get((conv_id, turn), []) == want
        seen.add(kind)
    assert seen >= set(range(5))


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    rows = [(k, t, "user", "x") for k in range(60) for t in range(1)]
    spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit(1)).withColumn("key", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op12_repair(spark, str(tmp_path)).collect()}
    gone = [k for k, *_ in rows if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    assert len(got) == 60 and gone
    for k in gone:
        assert tuple(got[k])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op12_repair(spark, f"{tmp_path}/none").count() == 0
