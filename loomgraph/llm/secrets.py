"""Secret scans with guess-cost estimates of credential values (operator 8).

Three fixed patterns give the base spans. Beyond them, values that stand in a
credential context (a key such as ``pwd`` or ``auth``, then ``:`` or ``=``, then perhaps
a quote and a scheme such as Bearer) are taken apart at minimum guess cost: a dynamic program over all splits into
dictionary words, dates, repeats, keyboard walks and brute-force spans, in bits.
Values that stay dear to guess are secrets; ``changeme`` and the like are not.

The dictionary is a short list of common passwords and the words of the corpus
itself: a word costs the bits of its share of all words. Words count that make
up ``least_share`` of all words at least, so there are at most 1 / least_share of
them however large the corpus is; what stands as a value in a credential context
is left out of the count, so a secret does not make itself a word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, materialize

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: A text without any of these words has no credential context.
HINTS = ("pass", "pwd", "secret", "token", "api", "auth", "cred", "login", "key")
#: A credential's key up to where its value begins: behind an opening quote, and behind the name of a scheme (fixed values).
KEY = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|auth(?:orization)?|cred(?:ential)?s?|login|key)["']?[\x20\t]*[:=][\x20\t]*(["']?)(?:(?:bearer|basic|digest|negotiate|token|apikey|bot)[\x20\t]+)?""", re.IGNORECASE | re.ASCII)
#: What ends a value that is not quoted.
STOP = re.compile(r"""[\s"'<>,;(){}\[\]]""", re.ASCII)
LEAST_LENGTH = 6
LONGEST_WORD = 24
WORD = re.compile(rf"(?<![a-z])[a-z]{{3,{LONGEST_WORD}}}(?![a-z])")
WORDS = """123456 password qwerty dragon monkey letmein football baseball master shadow michael sunshine princess welcome admin login
hello freedom whatever secret root user test guest default changeme example sample demo temp public private access server database
system manager oracle mysql backup summer winter spring autumn love money star power iloveyou trustno1 superman batman pass
word key token value string null none true false your here insert enter the and for not you all any""".split()
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
_BITS = {w: math.log2(i + 2) + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
#: Of repeats and walks longer than this, guess_bits offers the last ends only.
_NEAR = 200
_LEET = str.maketrans("013457@$!", "oieastasi")


def _reach(same: list[bool]) -> tuple[list[int], list[int]]:
    """For each place, how many true entries follow from it on, and how many stand right before it."""
    after, before = [0] * (len(same) + 1), [0] * (len(same) + 1)
    for i in range(len(same) - 1, -1, -1):
        after[i] = after[i + 1] + 1 if same[i] else 0
    for i, x in enumerate(same):
        before[i + 1] = before[i] + 1 if x else 0
    return after, before


def _ends(i: int, first: int, step: int, last: int, deep: int):
    """Ends from ``first`` to ``last``: all up to _NEAR characters on, then those next to ``last``; deep inside a run, the latter only."""
    if deep < _NEAR:
        yield from range(first, min(last, i + _NEAR) + 1, step)
    far = max(first, last - 12 if deep < _NEAR else last - step + 1, i + _NEAR + 1 if deep < _NEAR else 0)
    yield from range(far + (first - far) % step, last + 1, step)


def contexts(text: str):
    """(start of the key, start, end) of the values in credential contexts, in order of their starts, in linear time.

    A quoted value runs to its quote on the same line, any other to the next blank, quote, bracket, comma or semicolon. A
    value that begins or holds a key is looked into, but what ends with a value around it and is part of it costs no more
    than that, so it is left out. A quoted value with blanks counts only if it holds no key and is unlike prose.
    """
    stop = reach = newline = -1
    for m in KEY.finditer(text):
        start, end = m.end(), -1
        if m[1]:
            if newline < start:
                newline = text.find("\n", start)
                newline = len(text) if newline < 0 else newline
            end = text.find(m[1], start, newline)
            while end > start and text[end - 1] == "\\":
                end = text.find(m[1], end + 1, newline)
        if end < 0:
            if start > stop:
                found = STOP.search(text, start)
                stop = found.start() if found else len(text)
            end = stop
        if end - start < LEAST_LENGTH or end <= reach:
            continue
        if text.find(" ", start, end) < 0 and text.find("\t", start, end) < 0:
            reach = end
            yield m.start(), start, end
        elif not KEY.search(text, start, end) and unlike_prose(text[start:end]):
            yield m.start(), start, end


def unlike_prose(value: str) -> bool:
    """Whether words that hold a digit, a symbol or a capital behind their first character make up half of a quoted value or more."""
    words = value.split()
    odd = sum(len(w) for w in words if any(not c.isalpha() or c.isupper() for c in w[1:-1]) and not w.isupper())
    return 2 * odd >= sum(map(len, words))


def vocabulary(docs: DataFrame, *, least_share: float = 2.0**-17) -> dict[str, float]:
    """word -> guess cost in bits, of the corpus words of 3 to 24 letters (a-z, in lower case) that make up ``least_share``
    or more of all such words. All texts count, but not the values in credential contexts. At most 1 / least_share words.
    """

    def count(batches):
        found: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py() or ""
                low = text.lower()
                if any(hint in low for hint in HINTS):
                    rest, at = [], 0
                    for a, _, b in contexts(text):
                        rest.append(text[at:a])
                        at = max(at, b)
                    low = " ".join([*rest, text[at:]]).lower()
                found.update(WORD.findall(low) if len(low) < 1_000_000 else (m[0] for m in WORD.finditer(low)))
            if len(found) > 200_000:
                yield table(found)
                found = Counter()
        yield table(found)

    def table(found: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(count), "word string, n long")
    counts = materialize(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r.word: math.log2(total / r.n) + 1 for r in counts.filter(F.col("n") >= total * least_share).collect()}


def guess_bits(value: str, words: Mapping[str, float] = MappingProxyType({})) -> float:
    """Bits of the cheapest guess of ``value``: the least sum over its splits into guessable spans, in linear time.

    ``words``: bits of dictionary words, beside the built-in list of common passwords.

    All splits count for values of up to 200 characters; a longer repeat or walk is left at its first 200 or last 12 ends.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    sizes = ((26, str.islower), (26, str.isupper), (10, str.isdigit))
    alphabet = sum(k for k, is_ in sizes if any(is_(c) for c in value)) + (33 if any(not c.isalnum() for c in value) else 0) or 100
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        alphabet = min(alphabet, 16)
    each, cost = math.log2(alphabet), [0.0] + [math.inf] * n
    repeats = [(size, _reach([x == y for x, y in zip(value, value[size:])])) for size in (1, 2, 3, 4)]
    walks = _reach([(x, y) in _NEXT for x, y in zip(low, low[1:n])])
    for i in range(n):
        here = cost[i]

        def offer(j: int, bits: float, here: float = here) -> None:
            if here + bits < cost[j]:
                cost[j] = here + bits

        offer(i + 1, each)
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for text, extra in ((low[i:j], 0.0), (plain[i:j], 1.0)):
                bits = min(_BITS.get(text, math.inf), words.get(text, math.inf))
                if bits < math.inf:
                    offer(j, bits + extra + (value[i:j] != low[i:j]))
        found = _DATE.match(value, i)
        if found:
            offer(found.end(), math.log2(365 * 120) if found.end() - i > 4 else math.log2(120))
        for size, (after, before) in repeats:
            if i < len(after) and after[i] >= max(size, 2):
                last = i + size + after[i] // size * size
                for j in _ends(i, i + max(2 * size, 3), size, last, before[i]):
                    offer(j, size * each + math.log2((j - i) / size) + 1)
        if walks[0][i] >= 2:
            for j in _ends(i, i + 3, 1, i + 1 + walks[0][i], walks[1][i]):
                offer(j, math.log2(47) + 2 * math.log2(j - i) + 1)
    return cost[n]


def reaches_beyond(start: int, end: int, base: list[tuple[int, int, str]]) -> bool:
    """Whether some character of the span is in none of the base spans, which are sorted."""
    for a, b, _ in base:
        if a > start or start >= end:
            break
        start = max(start, b)
    return start < end


def scan(text: str, least_bits: float, words: Mapping[str, float] = MappingProxyType({})) -> list[tuple[int, int, str, bool, str, float]]:
    """(start, end, kind, base, value, bits) of the base spans, and of those that the guess cost adds (kind "guess"), in order.

    An added span may overlap base spans, but is not inside them. ``value`` is the secret itself, without the key of an
    assignment, and ``bits`` is its guess cost.
    """
    base, added = [], []
    low = text.lower()
    if any(x in low for x in HINTS):
        base += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        added = [span for _, *span in contexts(text)]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    found = [(a, b, kind, True, value, guess_bits(value, words)) for a, b, kind, value in base]
    covered = [(a, b, kind) for a, b, kind, _ in base]
    end = -1
    for a, b in added:
        if b > end and reaches_beyond(a, b, covered):
            bits = guess_bits(text[a:b], words)
            if bits >= least_bits:
                found.append((a, b, "guess", False, text[a:b], bits))
                end = b
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def find_secrets(docs: DataFrame, *, least_bits: float = 40.0) -> DataFrame:
    """One row per document: doc_id, secrets array<struct<kind, start, end, base, value, bits>>, in text order.

    docs: doc_id and text; other columns are not read. Starts and ends count code points, the end is exclusive. A null
    or empty text has no secrets. Rows that repeat a doc_id, or have none, each give their row. A text, and the list of its
    words while words are counted, are held whole, however long they are.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string()), ("bits", pa.float64())])
    words = vocabulary(docs)

    def run(batches):
        for batch in batches:
            found = []
            for x in batch.column(1):
                rows = scan(x.as_py() or "", least_bits, words)
                found.append([{"kind": k, "start": a, "end": b, "base": own, "value": value, "bits": bits} for a, b, k, own, value, bits in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], names=["doc_id", "secrets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, secrets array<struct<kind string, start long, end long, base boolean, value string, bits double>>")


def redact(text: str | None, secrets: list[tuple[int, int]], mask: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by ``mask``."""
    if not text or not secrets:
        return text
    parts, at, spans = [], 0, sorted(secrets)
    i = 0
    while i < len(spans):
        start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        parts += [text[at:start], mask]
        at, i = end, i + 1
    return "".join(parts) + text[at:]


def redact_secrets(docs: DataFrame, *, least_bits: float = 40.0, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` masked; all columns and rows stay as they are otherwise."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names, at, words = docs.columns, docs.columns.index("text"), vocabulary(docs)

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            new = [redact(text, [(a, b) for a, b, *_ in scan(text or "", least_bits, words)], mask) for text in texts]
            columns = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(run), docs.schema)
