import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm.packing import cut, encoder, pack
from loomgraph.llm.registry import op3_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity=2048):
    """Every id in one piece, pieces gapless in their sequences, digests right; gives (tokens, padding)."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence, tokens = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        tokens += at
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return tokens, padding


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    tokens, padding = check(op3_packing(spark, sf_dir).collect(), docs)
    assert padding < 0.02 * tokens


def test_many_workers_and_odd_texts(spark):
    texts = [None, "", "a", "<|endoftext|> a<|endoftext|>", "é漢🙂\n\n  x", "word " * 5000, " ", "it's 12 we'll\t\tx"] * 5
    docs = list(enumerate(texts))
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), PATH).collect()
    check(rows, docs)


@pytest.mark.parametrize("text", [" " * 5_000_000, " " * 1_000_000 + "a", "x" + "\n" * 3_000_000 + "\ty", "\t" * 2_000_000, "b" * 5_000_000, ("a " + "\u3000\r" * 400_000) * 3, "\x1c" * 1_000_000 + "<|endoftext|> "])
def test_long_runs_equal_the_library(text):
    assert list(encoder(PATH).ids(text)) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_very_long_text_and_clashing_columns(spark):
    docs = [(1, "word " * 300_000 + " " * 800_000 + "end"), (2, "short")]
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, length long, worker long, bin string")
    check(pack(frame, PATH).collect(), docs)


def test_repeated_and_null_ids(spark):
    rows = pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows) == [(0, 2), (1, 3), (1, 3)]


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 31, 32, 33, 2047, 2048, 2049, 9999])
def test_cut(n):
    pieces = cut(n, 2048, 32)
    assert [a for a, _ in pieces] == [sum(x for _, x in pieces[:i]) for i in range(len(pieces))] and sum(x for _, x in pieces) == n
    assert all(x >= 32 and x & (x - 1) == 0 for _, x in pieces[:-1])


def test_encoder_is_kept():
    assert encoder(PATH) is encoder(PATH)
