import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomgraph.llm.registry import op1_token_counts
from loomgraph.llm.tokens import MARK, compose, scan, token_counts, transducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab the▁ \n<>0x'\"éñß①漢🙂.,;THE  ") for _ in range(rng.randrange(120))) for _ in range(300)]
    return [None, "", " ", "   ", " a", "a ", "a  b", "\n", "<s> </s> <unk> <0x41>", "▁▁x", "\x00", "a" * 300, *made, *made[:9]]


def test_query_equals_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 4096)


@pytest.mark.parametrize("chunk", [13, 65_536])
def test_odd_texts_whole_and_in_chunks(spark, library, chunk):
    rows = [(i % 290, x) for i, x in enumerate(texts())] + [(None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("a")).withColumn("n_bytes", F.lit(None).cast("int"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs, MODEL, chunk=chunk).collect())
    assert got == sorted((str(d), len((x or "").encode()), len(library.encode(x or ""))) for d, x in rows)


def maps_of(compiled, text, chunk, look_back):
    marked = MARK + text.replace(" ", MARK)
    return [{e: (x, n) for e, x, n in compiled.chunk_map(marked[max(0, at - look_back) : at], marked[at : at + chunk])} for at in range(0, len(marked), chunk)]


def test_chunk_maps_compose_associatively(library):
    compiled, rng = transducer(MODEL), random.Random(1)
    start = compiled.key(compiled.start)
    for x in [*filter(None, texts()[12:100]), "a" * 4000, "aab" * 900, "".join(rng.choice("abcdefgh") for _ in range(4000))]:
        maps = maps_of(compiled, x, 37, 64)
        assert scan(maps, start)[2] == len(library.encode(x))
        assert all(len(m) <= 20 for m in maps)
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [compose(maps[i : i + 2])]
        assert maps[0][start][1] == len(library.encode(x))


def test_states_that_maps_lack_take_another_round(spark, library):
    """With nothing known of what stands before a cut, most maps lack the state that is alive there."""
    rows = list(enumerate(texts()[8:60])) + [(99, "abcdefghij" * 40), (100, "a" * 170)]
    compiled = transducer(MODEL)
    assert scan(maps_of(compiled, rows[-2][1], 41, 0), compiled.key(compiled.start))[2] is None
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, chunk=41, look_back=0).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(d, len(library.encode(x))) for d, x in rows]


@pytest.mark.parametrize("unit", ["the words of a text ", "abcdefghijklmnopqrst"])
def test_time_follows_the_length(unit, library):
    """Transitions per character do not grow with the text, with blanks or without."""
    compiled = transducer(MODEL)
    steps = []
    for n in (500, 4000):
        calls, plain = [0], compiled.step
        compiled.step = lambda s, c: (calls.__setitem__(0, calls[0] + 1), plain(s, c))[1]
        try:
            maps = maps_of(compiled, unit * n, 4096, 64)
        finally:
            del compiled.step
        assert scan(maps, compiled.key(compiled.start))[2] == len(library.encode(unit * n))
        steps.append(calls[0] / (len(unit) * n))
    assert steps[1] <= max(1.1 * steps[0], 0.1) and steps[0] <= 3


def test_long_texts_in_spark(spark, library):
    rng = random.Random(2)
    rows = [(1, "".join(rng.choice("abcdefghij") for _ in range(400_000))), (1, "word and words " * 30_000), (2, "é" * 200_000), (None, "x" * 70_000)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((str(d), len(x.encode()), len(library.encode(x))) for d, x in rows)


def test_states_can_be_forgotten(library):
    from loomgraph.llm.tokens import Transducer

    small = Transducer(MODEL, most_states=50, most_maps=20)
    assert all(small.count(x) == len(library.encode(x or "")) for x in texts()[:150])


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
