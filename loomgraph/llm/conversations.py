"""Conversation structure repair by error-correcting Earley parsing (operator 12).

A whole conversation has the role initials ``(s?(ua)+)?``. The grammar is left-linear: a nonterminal is a beginning that
ends in that role, and each production adds one edit to a shorter beginning. Besides Keep there are error productions:
Delete and Rerole read a row, Insert reads none. A chart item retains the least (cost, audit) of its beginning, the
audit being the initials of the edits so far; the completed chart gives the repair.

All items of a left-linear grammar begin where the chart begins, so the chart of a stretch of rows, made once for each
nonterminal that may stand before it, maps beginnings to beginnings, and such maps compose. Rows are sorted by range and
parsed in stretches wherever they lie, so a conversation of very many rows is parsed by many tasks; only the maps of
conversations that a range border cuts are brought together. Texts move once, to where their repair is applied row by
row; neither a conversation's rows nor its texts are ever held together.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits; a truncated row that is not deleted costs one more (fixed values).
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
EMPTY, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Nonterminal -> the beginnings that it may follow; those that may end a conversation.
FOLLOWS = {SYSTEM: (EMPTY,), USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
WHOLE = (EMPTY, ASSISTANT)
#: Productions (head, beginning, edit): head -> beginning edit. A system row is kept or deleted, never made.
PRODUCTIONS = [(head, left, edit) for head, lefts in FOLLOWS.items() for left in lefts for edit in ((KEEP,) if head == SYSTEM else (KEEP, REROLE, INSERT))]
PRODUCTIONS += [(head, head, DELETE) for head in (EMPTY, *FOLLOWS)]
BY_LEFT = {left: [p for p in PRODUCTIONS if p[1] == left] for left in (EMPTY, *FOLLOWS)}
ORDER = ["turn", "role", "key"]

Value = tuple[int, str]


def items(done: dict[str, Value]) -> dict[tuple, Value]:
    """The items of a set from its complete beginnings: (head, beginning, edit) with the dot before the edit. Insert reads no row, so it completes its head here."""
    agenda = [(*value, head) for head, value in done.items()]
    heapq.heapify(agenda)
    found: dict[tuple, Value] = {}
    complete = set()
    while agenda:  # the least value of a head comes first, since an insertion costs something
        cost, audit, left = heapq.heappop(agenda)
        if left in complete:
            continue
        complete.add(left)
        found[left, None, None] = cost, audit
        for item in BY_LEFT[left]:
            found[item] = cost, audit
            if item[2] == INSERT:
                heapq.heappush(agenda, (cost + COST[INSERT], audit + INSERT, item[0]))
    return found


def scan(row: str, found: dict[tuple, Value]) -> dict[str, Value]:
    """Complete beginnings of the next set: the dot moves over edits that read ``row``.

    row: its role's initial (x: any other), in upper case if truncated, or d if it must be deleted.
    """
    done: dict[str, Value] = {}
    for (head, _, edit), (cost, audit) in found.items():
        if edit is None or edit == INSERT or (edit == KEEP and row.lower() != head) or (row == "d" and edit != DELETE):
            continue
        value = cost + COST[edit] + (row.isupper() and edit != DELETE), audit + edit
        if head not in done or value < done[head]:
            done[head] = value
    return done


@lru_cache(maxsize=1 << 16)
def chart(rows: str, start: str) -> dict[str, Value]:
    """From a beginning ``start`` over ``rows`` to beginnings; insertions stand before the row that they precede, never at the end."""
    done: dict[str, Value] = {start: (0, "")}
    for row in rows:
        done = scan(row, items(done))
    return done


def stretch(rows: str, starts: tuple[str, ...], most: int = 64) -> dict[str, dict[str, Value]]:
    """start -> the chart over any number of rows, through charts of at most ``most`` rows each."""
    pieces = [rows[i : i + most] for i in range(0, len(rows), most)]
    return {start: compose([{q: chart(piece, q) for q in BY_LEFT} for piece in pieces], start) for start in starts}


def compose(maps: list[dict[str, dict[str, Value]]], start: str = EMPTY) -> dict[str, Value]:
    """The chart over neighbouring stretches.

    Audits over equal rows never open one another, since each row ends its run of insertions by one edit. So the order of
    beginnings (a rank) and the audit of the next stretch decide, and long audits are joined only at the end.
    """
    best: dict[str, tuple] = {start: (0, 0, None)}
    for one in maps:
        found: dict[str, tuple] = {}
        for left, (cost, rank, chain) in best.items():
            for head, (more, audit) in one.get(left, {}).items():
                value = (cost + more, rank, audit)
                if head not in found or value < found[head][0]:
                    found[head] = value, (chain, audit)
        ranks = {head: k for k, head in enumerate(sorted(found, key=lambda head: found[head][0][1:]))}
        best = {head: (value[0], ranks[head], chain) for head, (value, chain) in found.items()}

    def audit(chain) -> str:
        parts = []
        while chain is not None:
            chain, part = chain
            parts.append(part)
        return "".join(reversed(parts))

    return {head: (cost, audit(chain)) for head, (cost, _, chain) in best.items()}


def completed(done: dict[str, Value]) -> Value:
    """The cheapest whole conversation, after insertions at the end."""
    found = items(done)
    return min(found[head, None, None] for head in WHOLE if (head, None, None) in found)


def text_columns(rows: DataFrame) -> list[Column]:
    """conv_id, turn, role, text and the key of role and text; null roles and texts count as one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key")]


_COUNTS = ["rows", "least_turn", "most_turn", "turns", "blank", "duplicate", "truncated", "illegal"]
_MAP = pa.list_(pa.struct([("start", pa.string()), ("head", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("cut", pa.bool_()), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("maps", _MAP)])
SEGMENT = "conv_id long, part int, cut boolean, first string, last string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", maps array<struct<start:string,head:string,cost:long,audit:string>>"
PLAN_COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PLAN = "conv_id long, " + ", ".join(f"{c} long" for c in PLAN_COLUMNS) + ", audit string"


def legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def _segments(batches):
    """Sorted rows of one range -> one row for each conversation in it; ``cut`` where the conversation may go on beyond the range."""
    from pyspark import TaskContext

    part, first, held = TaskContext.get().partitionId(), True, None

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_SEGMENT)

    def close(cut: bool) -> dict:
        found = stretch("".join(held.pop("codes")), tuple(BY_LEFT) if held["cut"] else (EMPTY,))
        maps = [{"start": s, "head": h, "cost": c, "audit": a} for s, done in found.items() for h, (c, a) in done.items()]
        return {k: v for k, v in held.items() if k not in ("turn", "key")} | {"cut": held["cut"] or cut, "maps": maps}

    out: list[dict] = []
    for batch in batches:
        for conv_id, turn, key, initial, blank, truncated, later in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if held is None or held["conv_id"] != conv_id:
                if held is not None:
                    out.append(close(False))
                held = {"conv_id": conv_id, "part": part, "cut": first, "first": initial, "last": None, "codes": [], "turn": None, "key": None} | dict.fromkeys(_COUNTS, 0) | {"least_turn": turn, "most_turn": turn}
                first = False
            again = later or (held["key"] == key and held["turn"] == turn)  # equal rows of one turn stand side by side
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            if fault:
                held[fault] += 1
            held["illegal"] += held["last"] is not None and not legal(held["last"], initial)
            if turn is not None:
                held["turns"] += held["turn"] != turn
                held["most_turn"] = turn
                held["least_turn"] = turn if held["least_turn"] is None else held["least_turn"]
            held["rows"] += 1
            held |= {"turn": turn, "key": key, "last": initial}
            code = initial if initial in ("s", "u", "a") else "x"
            held["codes"].append("d" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        if len(out) >= 2000:
            yield batch_of(out)
            out = []
    if held is not None:
        out.append(close(True))
    yield batch_of(out)


def _plans(batches):
    """Segments sorted by conversation and range -> one row for each conversation."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in PLAN_COLUMNS), ("audit", pa.string())])

    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    out: list[dict] = []
    for conv_id, found in groupby(rows(), key=lambda r: r["conv_id"]):
        total, maps, last, turn = dict.fromkeys(_COUNTS, 0), [], None, None
        least = None
        for r in found:
            maps.append({s: {m["head"]: (m["cost"], m["audit"]) for m in r["maps"] if m["start"] == s} for s in BY_LEFT})
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                total[c] += r[c]
            if last is not None:
                total["illegal"] += not legal(last, r["first"])
            if r["least_turn"] is not None:
                total["turns"] -= turn == r["least_turn"]  # a turn on both sides of a border counts once
                least, turn = r["least_turn"] if least is None else least, r["most_turn"]
            last = r["last"]
        cost, audit = completed(compose(maps))
        gaps = 0 if least is None else turn - least + 1 - total["turns"]
        out.append({"conv_id": conv_id, "gaps": gaps, **{c: total[c] for c in PLAN_COLUMNS[1:5]}, "cost": cost, "audit": audit})
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def plan_repairs(conversations: DataFrame) -> DataFrame:
    """One row per conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    conversations: conv_id, turn, role, text; other columns are not read. Rows count by turn (nulls first), then role, then
    text digest. Rows without conv_id are one conversation. Null roles and texts count as one space, an empty role has no initial;
    an empty table gives no rows. The audit of a conversation is one string, a byte or more for each of its rows.
    """
    known = text_columns(conversations)
    stripped = F.expr("rtrim(' \\t\\n\\u000b\\f\\r', text)")
    small = conversations.select(*known).select("conv_id", "turn", "role", "key", F.substring("role", 1, 1).alias("initial"), (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    small = materialize(small, "rows")
    # rows whose role and text stand at an earlier turn; those of one turn are told apart where they lie
    several = small.groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "least")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key"))
    later = F.col("least").isNotNull() & ~F.col("turn").eqNullSafe(F.col("least.turn"))
    codes = small.join(several, same, "left").select("conv_id", *ORDER, "initial", "blank", "truncated", later.alias("later"))
    codes = materialize(codes, "codes")
    ranged = codes.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    segments = materialize(ranged.select("conv_id", "turn", "key", "initial", "blank", "truncated", "later").mapInArrow(_segments, SEGMENT), "segments")
    inner = segments.filter("not cut").mapInArrow(_plans, PLAN)
    edge = segments.filter("cut").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_plans, PLAN)
    return inner.unionByName(edge)


def _applied(batches):
    """(conversation's plan, its repaired rows) in order: rows are (turn, role, text, edit). Each iterator must be used up before the next."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def repaired(audit: str, found):
        at, head = 0, EMPTY

        def inserted():
            nonlocal at, head
            while at < len(audit) and audit[at] == INSERT:
                at, head = at + 1, ASSISTANT if head == USER else USER
                yield None, ROLE[head], "", INSERT

        for _, _, turn, role, text, *_ in found:
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == DELETE:
                continue
            if edit == REROLE:
                head = ASSISTANT if head == USER else USER
                role = ROLE[head]
            else:
                head = role[0]
            yield turn, role, text, edit
        yield from inserted()

    for conv_id, found in groupby(rows(), key=lambda r: r[0]):
        plan = next(found)
        yield (conv_id, *plan[5:]), repaired(plan[-1], found)


def _meet(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order."""
    rows = conversations.select(*text_columns(conversations)).select("conv_id", F.lit(1).alias("side"), "turn", "role", "text", "key")
    heads = plans.select("conv_id", F.lit(0).alias("side"), *PLAN_COLUMNS, "audit")
    both = rows.unionByName(heads, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "side", *ORDER)
    return both.select("conv_id", "side", "turn", "role", "text", *PLAN_COLUMNS, "audit")


def repair_conversations(conversations: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), turn (null: inserted), role, text, edit (K, R or I); of conversations as in ``plan_repairs``."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches):
        for (conv_id, *_), rows in _applied(batches):
            out, size = [], 0
            for place, (turn, role, text, edit) in enumerate(rows):
                out.append({"conv_id": conv_id, "place": place, "turn": turn, "role": role, "text": text, "edit": edit})
                size += len(text)
                if len(out) >= 1000 or size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    plans = plan_repairs(conversations) if plans is None else plans
    return _meet(conversations, plans).mapInArrow(run, "conv_id long, place long, turn long, role string, text string, edit string")


def repair_digests(conversations: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """What ``plan_repairs`` gives, with repaired_sha256: the digest of the repaired rows as ``role:text``, joined by newlines.

    A digest reads its conversation in order, so one task streams each conversation's texts, row by row.
    """
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in PLAN_COLUMNS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        out: list[tuple] = []
        for plan, rows in _applied(batches):
            digest = hashlib.sha256()
            for place, (_, role, text, _) in enumerate(rows):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            out.append((*plan, digest.hexdigest()))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    plans = plan_repairs(conversations) if plans is None else plans
    return _meet(conversations, plans).mapInArrow(run, PLAN + ", repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes the sentence
    ends out of it, 3 repeats it, 4 makes it the user's. Nulls count as one space."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    return conversations.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
