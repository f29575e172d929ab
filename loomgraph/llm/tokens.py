"""Token counts by a compiled finite-state transducer (operator 1).

The tokenizer is a BPE over characters with byte fallback. Its encoding of a
prefix ends in one token, and which one it is follows from a bounded past: the
tokens that may still grow over the next character, each with the last token
and the count where it would start. These tuples are the states of a
deterministic transducer; a transition is annotated with the tokens that it
adds to the count (fewer than none where tokens merge). States and transitions
are compiled as texts call for them and kept for the worker's life.

Long texts are cut into chunks that any worker maps: the map of a chunk takes each
state that may be alive at its start to the state at its end and the tokens in
between. Which states may be alive follows from the characters before the cut: no
piece holds a word mark behind another character, so a word boundary leaves one
state only, and without one the paths from all places before the cut soon meet.
Maps compose associatively, and the count of a text is the prefix scan of its
chunks' maps. A state that a map lacks is walked through that chunk in one more
round, so counts are exact whatever the text.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, temporary

MARK = "▁"
INFINITE = float("inf")
_COMPILED: dict[str, "Transducer"] = {}


class State(dict):
    """Transitions of one state: character -> (tokens added, next state). live: (text so far, the past that matters to it, count before)."""

    __slots__ = ("live",)


class Transducer:
    """Lazily determinised transducer of one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str, most_states: int = 100_000, most_maps: int = 300_000, few: int = 6):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}  # the lower, the earlier merged; equal ranks from the left
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("a piece holds a word mark behind another character")
        probe = "  A\tb\né ①"
        if "".join(model.encode(probe, out_type=str)).replace("<0x09>", "\t").replace("<0x0A>", "\n").replace("<0xE2><0x91><0xA0>", "①") != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises its input in a way that this transducer does not know")
        self.longer: dict[str, list[str]] = {}
        for piece in self.rank:
            for i in range(1, len(piece)):
                self.longer.setdefault(piece[:i], []).append(piece)
        self.characters = {piece for piece in self.rank if len(piece) == 1}
        self.most_states, self.most_maps, self.few = most_states, most_maps, few
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, tuple[bool, list[tuple[float, str, str]]]] = {}  # of vocabulary pieces only
        self.maps: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states (they are rebuilt as needed), so that memory stays bounded."""
        self.states: dict[tuple, State] = {}
        self.sets: dict[frozenset, frozenset] = {}
        self.start = self.state((("", "", 0),))

    def state(self, live: tuple) -> State:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State()
            found.live = live
        return found

    def history(self, token: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether the encoding of ``token`` alone is itself, and its merges in order: (rank, leftmost part, rightmost part after it)."""
        found = self.histories.get(token)
        if found is None:
            parts, merges = list(token), []
            while True:
                ranks = [self.rank.get(x + y, INFINITE) for x, y in zip(parts, parts[1:])]
                best = min(ranks, default=INFINITE)
                if best == INFINITE:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                merges.append((best, parts[0], parts[-1]))
            found = self.histories[token] = len(parts) == 1, merges
        return found

    def follows(self, last: str, token: str) -> bool:
        """Whether ``last`` and ``token`` side by side stay these two: no merge across their border comes first."""
        key = (last, token)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 4 * self.most_states:
                self.pairs.clear()
            found = self.pairs[key] = self.history(token)[0] and (not last or self.apart(last, token))
        return found

    def apart(self, last: str, token: str) -> bool:
        left, right, i, j = self.history(last)[1], self.history(token)[1], 0, 0
        a, b = last[-1], token[0]
        while True:  # the best merge of both sides and of their border, the leftmost of equals
            border = self.rank.get(a + b, INFINITE)
            one = left[i][0] if i < len(left) else INFINITE
            two = right[j][0] if j < len(right) else INFINITE
            if border < one and border <= two:
                return False
            if one == two == INFINITE:
                return True
            if one <= two:
                a, i = left[i][2], i + 1
            else:
                b, j = right[j][1], j + 1

    def past(self, last: str | frozenset, text: str) -> str | frozenset | None:
        """What of the past matters to a token that has begun with ``text``: where few pieces go on from there, which
        of them can follow; else the last token itself; None if nothing can."""
        longer = self.longer.get(text)
        if longer is None:
            return None
        if isinstance(last, frozenset):
            can = frozenset(x for x in last if x.startswith(text) and len(x) > len(text))
        elif len(longer) > self.few:
            return last
        else:
            can = frozenset(x for x in longer if self.follows(last, x))
        return self.sets.setdefault(can, can) if can else None

    def compile(self, state: State, c: str) -> tuple[int, State]:
        """The transition of ``state`` on ``c``: a character without a piece counts its bytes and leads to the start; a
        word mark behind another character leads where it leads from the start."""
        if c not in self.characters:
            return len(c.encode("utf-8", "replace")), self.start
        if c == MARK and not state.live[-1][1].endswith(MARK):
            state = self.start
        grown = [(text + c, last, count) for text, last, count in state.live]
        for text, last, count in grown:  # longest text first
            if text in last if isinstance(last, frozenset) else text in self.rank and self.follows(last, text):
                token, added = text, count + 1
                break
        else:
            raise AssertionError("no token ends here")
        live = tuple((text, kept, count - added) for text, last, count in grown if (kept := self.past(last, text)) is not None)
        return added, self.state((*live, ("", token, 0)))

    def key(self, state: State) -> str:
        """The name of a state, alike on all workers."""
        return json.dumps([[text, past if isinstance(past, str) else sorted(past), count] for text, past, count in state.live])

    def named(self, key: str) -> State:
        live = ((text, past if isinstance(past, str) else frozenset(past), count) for text, past, count in json.loads(key))
        return self.state(tuple((text, self.sets.setdefault(past, past) if isinstance(past, frozenset) else past, count) for text, past, count in live))

    def step(self, state: State, c: str) -> tuple[int, State]:
        found = state.get(c)
        if found is None:
            found = state[c] = self.compile(state, c)
        return found

    def alive(self, before: str) -> list[State]:
        """The states that may be alive behind ``before``, the end of what stands before a cut."""
        if not before:
            return [self.start]
        states = [self.start]
        for i, c in enumerate(before):
            known = c not in self.characters or (c == MARK and i > 0 and before[i - 1] != MARK)
            went = [self.step(s, c)[1] for s in (states[:1] if known else states)]
            if not known:  # a path may also begin here
                went.append(self.start)
            states = list({id(s): s for s in went}.values())
        return states

    def through(self, states: list[State], text: str) -> list[tuple[State, int]]:
        """For each state, the state behind ``text`` and the tokens that it adds. Paths that have met go on as one."""
        met, of, counts = list(states), list(range(len(states))), [0] * len(states)  # paths, the path of each state, its tokens
        for i, c in enumerate(text):
            if len(met) == 1:
                n, state = self.run(met[0], text[i:])
                return [(state, counts[k] + n) for k in range(len(states))]
            went = [self.step(s, c) for s in met]
            counts = [n + went[p][0] for n, p in zip(counts, of, strict=True)]
            place: dict[int, int] = {}
            new = []
            for _, s in went:
                if id(s) not in place:
                    place[id(s)] = len(new)
                    new.append(s)
            of = [place[id(went[p][1])] for p in of]
            met = new
        return [(met[p], n) for p, n in zip(of, counts, strict=True)]

    def run(self, state: State, text: str) -> tuple[int, State]:
        """Tokens that ``text`` adds from ``state``, and the state behind it: up to the first word boundary one by one, between
        boundaries by what is kept of words, from the last on one by one."""
        first = BOUNDARY.search(text)
        if not first:
            n = 0
            for c in text:
                added, state = self.step(state, c)
                n += added
            return n, state
        head, last = first.end(), len(text) - BOUNDARY_BACK.search(text[::-1]).end()
        n, _ = self.run(state, text[:head])
        tail, state = self.run(self.start, text[last:])
        return n + self.segments(text[head:last]) + tail, state

    def chunk_map(self, before: str, text: str) -> list[tuple[str, str, int]]:
        """(entry, exit, tokens) of a chunk for each state that may be alive behind ``before``."""
        if len(self.states) > self.most_states:
            self.reset()
        states = self.alive(before)
        return [(self.key(a), self.key(b), n) for a, (b, n) in zip(states, self.through(states, text), strict=True)]

    def walk(self, text: str) -> int:
        """Tokens of a text that starts at a boundary, one transition a character."""
        if len(self.states) > self.most_states:
            self.reset()
        state, n = self.start, 0
        for c in text:
            found = state.get(c)
            if found is None:
                found = state[c] = self.compile(state, c)
            n += found[0]
            state = found[1]
        return n

    def segments(self, text: str) -> int:
        """Tokens of a text that starts at a boundary. The maps of short stretches between boundaries are kept composed."""
        if not text or text[0] != MARK or MARK + MARK in text:
            return self.walk(text)
        n, maps = 0, self.maps
        for x in text[1:].split(MARK):
            found = maps.get(x)
            if found is None:
                found = self.walk(MARK + x)
                if len(x) < 40:
                    if len(maps) >= self.most_maps:
                        maps.clear()
                    maps[x] = found
            n += found
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text, without begin or end tokens; none for an empty one."""
        return self.segments(MARK + text.replace(" ", MARK)) if text else 0


BOUNDARY = re.compile(f"[^{MARK}](?={MARK})", re.S)
BOUNDARY_BACK = re.compile(f"{MARK}(?=[^{MARK}])", re.S)


def transducer(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def compose(maps: list[dict[str, tuple[str, int]]]) -> dict[str, tuple[str, int]]:
    """The maps of neighbouring chunks as one, by pairs; an entry whose path a map lacks is left out."""
    while len(maps) > 1:
        pairs = [(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
        joined = [{e: (y[x][0], n + y[x][1]) for e, (x, n) in a.items() if x in y} for a, y in pairs]
        maps = joined + maps[2 * len(pairs) :]
    return maps[0]


def scan(maps: list[dict[str, tuple[str, int]]], start: str) -> tuple[int, str, int | None]:
    """(chunk, state, None) where the path from ``start`` meets a map that lacks its state; (chunks, state, tokens) at the end."""
    found = compose(maps).get(start)
    if found is not None:
        return len(maps), *found
    state = start
    for k, x in enumerate(maps):
        if state not in x:
            return k, state, None
        state = x[state][0]
    raise AssertionError("a path through all maps is part of their composition")


def token_counts(docs: DataFrame, model: str, *, limit: int = 4096, chunk: int = 65_536, look_back: int = 64) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    docs: doc_id and text; other columns are not read. A null or empty text has no bytes and no tokens. Texts of over
    ``chunk`` characters are cut into chunks, in one pass over the text; any workers map them, and their maps are composed in
    order. ``look_back`` characters before a cut tell which states may be alive there; what they miss costs another
    round, not the result. Rows are told apart by number, so repeated or null doc_ids each give their row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def whole(batches):
        compiled = transducer(model)
        for batch in batches:
            counts = [compiled.count(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    short = rows.filter(F.length("text") <= chunk).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    short = short.mapInArrow(whole, COUNTED)
    over = rows.filter(F.length("text") > chunk)
    with temporary(docs.sparkSession):
        long_ = long_counts(over, model, chunk, look_back)
    found = short if long_ is None else short.unionByName(long_)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


COUNTED = "doc_id long, n_bytes long, n_tokens long"


def long_counts(over: DataFrame, model: str, chunk: int, look_back: int) -> DataFrame | None:
    """(doc_id, n_bytes, n_tokens) of long texts, chunk by chunk; None if there are none."""

    def cut(batches):
        for batch in batches:
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                n_bytes, marked = len(text.encode()), MARK + text.replace(" ", MARK)
                for k, at in enumerate(range(0, len(marked), chunk)):
                    values = [doc_id], [n_bytes], [row], [k], [marked[max(0, at - look_back) : at]], [marked[at : at + chunk]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "row", "k", "before", "piece"])

    numbered = over.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    pieces = materialize(numbered.mapInArrow(cut, "doc_id long, n_bytes long, row long, k int, before string, piece string"), "pieces")
    if pieces.isEmpty():
        return None

    def maps(batches):
        compiled = transducer(model)
        for batch in batches:
            out: list[tuple] = []
            for row, k, before, piece, entry in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if entry is None:
                    found = compiled.chunk_map(before, piece)
                else:
                    found = [(entry, compiled.key(b), n) for b, n in compiled.through([compiled.named(entry)], piece)]
                out += [(row, k, *x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["row", "k", "entry", "exit", "n"])

    def scans(batches):
        start = transducer(model)
        start = start.key(start.start)
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                by_chunk: dict[int, dict] = {}
                for x in found:
                    by_chunk.setdefault(x["k"], {})[x["entry"]] = (x["exit"], x["n"])
                out.append(scan([by_chunk[k] for k in sorted(by_chunk)], start))
            k, entry, n = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k, pa.int32()), pa.array(entry, pa.string()), pa.array(n, pa.int64())], names=["row", "k", "entry", "n"])

    mapped = "row long, k int, entry string, exit string, n long"
    asked = pieces.select("row", "k", "before", "piece", F.lit(None).cast("string").alias("entry")).repartition("row", "k")
    known = None
    while True:
        found = materialize(asked.mapInArrow(maps, mapped), "maps")
        known = found if known is None else known.unionByName(found)
        lists = known.groupBy("row").agg(F.collect_list(F.struct("k", "entry", "exit", "n")).alias("maps"))
        scanned = materialize(lists.mapInArrow(scans, "row long, k int, entry string, n long"), "scanned", keep=True)
        missing = scanned.filter("n is null")
        if missing.isEmpty():
            break
        asked = pieces.join(missing.select("row", "k", "entry"), ["row", "k"]).select("row", "k", "before", "piece", "entry")
    named = materialize(pieces.filter("k = 0").select("row", "doc_id", "n_bytes"), "rows", keep=True)
    return named.join(scanned.select("row", F.col("n").alias("n_tokens")), "row").select("doc_id", "n_bytes", "n_tokens")
