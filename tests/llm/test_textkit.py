"""Long texts read part by part give what they give as a whole."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm.minhash import shingle_sets
from loomgraph.llm.passages import pieces, runs
from loomgraph.llm.quality import passages
from loomgraph.llm.textkit import BLANK, column_bytes, count_words, parts
from loomgraph.llm.toxicity import terms


def texts():
    rng = random.Random(3)
    words = ["a", "Bc", "d,e", "é", "f" * 9, "Group-x", "!!", "漢字"]
    made = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 300, 2000)]
    return [*made, "x" * 3000, "  " + "y" * 2500 + "\n z" * 200 + "   ", "\t" * 1500, "b " * 64 + " " * 2000, None]


@pytest.mark.parametrize("most", [7, 100, 999])
def test_parts_cut_between_words(most):
    for text in texts():
        data = np.frombuffer((text or "").encode(), np.uint8)
        found = list(parts(data, most))
        assert [a for a, _ in found] == [0, *(b for _, b in found)][: len(found)] and sum(b - a for a, b in found) == len(data)
        assert [w for a, b in found for w in bytes(data[a:b]).split()] == bytes(data).split()
        assert all(b == len(data) or BLANK[data[b]] for _, b in found)


def test_counted_words():
    column = pa.array([*texts(), "a", "b", " c", "d "])
    got = count_words(*column_bytes(column))
    assert got.tolist() == [len((x or "").encode().split()) for x in column.to_pylist()]


@pytest.mark.parametrize("most", [50, 400])
def test_readers_do_not_depend_on_parts(most):
    for text in texts():
        column = pa.array([text], pa.string())
        (_, _, whole), (_, _, cut) = next(terms(column)), next(terms(column, most))
        assert (whole == cut).all()
        for size in (3, 5):
            ((_, whole),), ((_, cut),) = shingle_sets(column, size), shingle_sets(column, size, most)
            assert (whole == cut).all()
        (_, bag, whole), (_, again, cut) = next(passages(column, 16)), next(passages(column, 16, most))
        assert whole.shape == cut.shape and (bag == again).all() and np.allclose(whole, cut, atol=1e-5)


@pytest.mark.parametrize("most", [60, 500])
def test_windows_do_not_depend_on_pieces(most):
    data, offsets = column_bytes(pa.array(texts()))
    ids = np.arange(len(offsets) - 1)

    def windows(bound):
        found = set()
        for first, part, at, within in pieces(ids, data, offsets, 50, bound):
            for text, start, end, value in zip(*runs(part, at, 50, 24), strict=True):
                found |= {(first + text, start - at[text] + within + k, value) for k in range(end - start - 49)}
        return found

    assert windows(most) == windows(1 << 30) and len(windows(most)) == sum(max(0, b - a - 49) for a, b in zip(offsets, offsets[1:]))
