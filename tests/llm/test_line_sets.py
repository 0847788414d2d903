"""Line sets outside Spark: pieces of long texts, order of words, sketches."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tramline.llm import line_join


def line_sets(texts: list[bytes], levels: np.ndarray) -> pa.Table:
    numbers = pa.array(np.arange(len(texts)))
    batch = pa.record_batch([numbers, numbers, pa.array(texts, pa.binary())], ["doc", "row", "text"])
    run = line_join._line_sets(SimpleNamespace(value=levels), line_join.SIMILAR)
    return pa.Table.from_batches(run([batch])).sort_by([("row", "ascending"), ("line", "ascending")])


def texts(rng: np.random.Generator, words: int = 300) -> list[bytes]:
    def line():
        return b" ".join(b"w%d" % x for x in rng.integers(0, words, rng.choice([0, 1, 5, 30, 45, 90, 130])))

    return [b"\n".join(line() for _ in range(rng.integers(0, 40))) for _ in range(12)] + [b"", b"\n\n", b"one\n"]


@pytest.mark.parametrize("group", [1, 50, 1000])
def test_cutting_long_texts_changes_nothing(monkeypatch, group):
    rng = np.random.default_rng(3)
    given, levels = texts(rng), rng.integers(0, 4, 1 << 10).astype(np.uint16)
    whole = line_sets(given, levels)
    monkeypatch.setattr(line_join, "GROUP_BYTES", group)
    assert [b"\n".join(line_join._pieces(t)) for t in given] == given
    assert line_sets(given, levels).equals(whole)


def test_sizes_and_lines_are_those_of_the_text():
    given = texts(np.random.default_rng(4))
    found = line_sets(given, np.zeros(1 << 10, np.uint16))
    expected = [(d, n, len(set(line.split()))) for d, t in enumerate(given) for n, line in enumerate(t.split(b"\n")) if line.split()]
    assert list(zip(*(found[c].to_pylist() for c in ("row", "line", "size")))) == expected


def test_rare_words_come_first_and_in_one_order():
    rng = np.random.default_rng(5)
    levels = rng.integers(0, line_join.LEVELS, 1 << 10).astype(np.uint16)
    line = [b"w%d" % x for x in rng.permutation(60)]
    one, two = (line_sets([b" ".join(x)], levels)["prefix"].to_pylist()[0] for x in (line, line[::-1] + line[:9]))
    assert one == two
    hashes = {int(np.int64(h >> np.uint64(32)).astype(np.int32)): int(levels[int(h) & 1023]) for h in line_join.words(b" ".join(line))[0]}
    told = [hashes[w] for w in one]
    assert told == sorted(hashes.values())[: len(told)]


def test_sketches_never_say_more_than_differs():
    rng = np.random.default_rng(6)
    levels = np.zeros(1 << 10, np.uint16)
    for size in (4, 20, 39, 41, 60, 99, 101, 150):
        base = rng.permutation(400)[:size]
        lines = [set(base[: size - cut]) | set(range(1000, 1000 + more)) for cut in range(3) for more in range(4)]
        found = line_sets([b" ".join(b"w%d" % x for x in sorted(s)) for s in lines], levels)
        sketch = [found[c].to_numpy().view(np.uint64) for c in line_join.SKETCH]
        sizes = found["size"].to_numpy()
        one, two = np.triu_indices(len(lines), 1)
        bits = line_join._differing([x[one] ^ x[two] for x in sketch], np.minimum(sizes[one], sizes[two]))
        assert all(b <= len(lines[i] ^ lines[j]) for b, i, j in zip(bits, one, two))
