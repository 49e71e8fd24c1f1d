"""Scattered short matches cost little, and contexts are read as bit by bit."""

import random
import sys

import numpy as np

from tidemark.llm import chaining


def _array_calls(f) -> int:
    """How often f calls numpy's reductions, sums and concatenations."""
    seen = []
    sys.setprofile(lambda _, event, arg: seen.append(arg) if event == "c_call" and getattr(arg, "__name__", "") in ("reduce", "cumsum", "concatenate", "astype") else None)
    try:
        f()
    finally:
        sys.setprofile(None)
    return len(seen)


def _scattered(n: int) -> np.ndarray:
    """n runs of 5 words, each before the one before it in the other text, so that none chains with another."""
    at = np.arange(n) * 40
    return np.stack([at, at + 5, at[::-1]], axis=1)


def test_short_chains_cost_no_array_work():
    runs = _scattered(300)
    words = np.arange(300 * 40 + 10).astype(np.uint64)
    pairs = chaining.Pairs(words, np.array([0, len(words)]), words, np.array([0, len(words)]), 5)
    found = []
    assert _array_calls(lambda: found.extend(pairs.passages(0, runs, 50, 80))) < 30
    assert not found


def test_regions_of_single_anchors_cost_no_array_work():
    runs = _scattered(300)
    own = [runs[i : i + 1] for i in range(300)]
    out = []
    assert _array_calls(lambda: out.extend(chaining.regions(own, near=8))) <= 300 + 30  # one for each region
    assert len(out) == 300 and sorted(x[0].tolist() for x in out) == runs.tolist()


def _plain_reach(a: int, b: int, drop: int = 6) -> int:
    size, shifted = chaining.CONTEXT, chaining.SHIFTED
    n = min(a >> size, b >> size)
    x, y = ([(v >> i) & 1 for i in range(size)] for v in (a, b))
    score = best = at = 0
    for i in range(n):
        if score < best - drop:
            break
        score += 1 if x[i] == y[i] else -2
        if score > best:
            best, at = score, i + 1
    else:
        if n == size and score >= best - drop:
            return size
    run = next((i for i in range(n) if x[i] != y[i]), n)
    for i in range(4):
        for j in range(4):
            if (i or j) and run + max(i, j) + shifted <= n and x[run + i : run + i + shifted] == y[run + j : run + j + shifted]:
                return size
    return at


def test_reach_is_that_of_each_bit_alone():
    draw = random.Random(5)
    a, b = [], []
    for _ in range(4000):
        x = draw.getrandbits(chaining.CONTEXT)
        y = x if draw.random() < 0.2 else x ^ sum(1 << draw.randrange(chaining.CONTEXT) for _ in range(draw.randrange(1, 9))) % (1 << chaining.CONTEXT)
        if draw.random() < 0.3:
            y = (x << draw.randrange(4) ^ draw.getrandbits(3)) % (1 << chaining.CONTEXT)
        a.append(x | draw.choice([0, 1, 7, 20, 47, 48]) << chaining.CONTEXT)
        b.append(y | draw.choice([0, 13, 30, 48, 48, 48]) << chaining.CONTEXT)
    got = chaining._reach(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
    assert got.tolist() == [_plain_reach(x, y) for x, y in zip(a, b, strict=True)]
