"""Configurations of few sizes, and that they stay in the plan."""

import random
from collections import Counter, defaultdict

import pytest

from trellis.llm import packing


def best_fit(histogram, capacity=1024):
    return packing.placed(histogram, capacity, [], [], [])[1]


def test_configurations_save_sequences_where_lengths_are_few(monkeypatch):
    few = {461: 508, 378: 1590, 267: 2921, 202: 1800, 165: 591, 163: 2717, 154: 2061, 260: 2228}
    bound = -(-sum(x * n for x, n in few.items()) // 1024)
    _, n = packing.plan(few)
    assert n < 0.99 * best_fit(few) and n < 1.02 * bound
    monkeypatch.setattr(packing, "configurations", lambda *a, **k: [])
    assert packing.plan(few)[1] == best_fit(few)  # without them best fit is all that is left


@pytest.mark.parametrize("share", packing.LARGE)
def test_every_configured_sequence_is_kept(share):
    r = random.Random(3)
    h = dict(Counter(r.choice([r.randint(1, 1024), r.randint(300, 700)]) for _ in range(5000)))
    sizes, members, patterns = packing.grouped(h, 1024, 40, share)
    assert len(sizes) <= 40 and sum(c for m in members for _, c in m) == sum(c for x, c in h.items() if share * 1024 < x < 1024)
    for s, m in zip(sizes, members):
        assert all(x <= s for x, _ in m)
    counts = [sum(c for _, c in m) for m in members]
    for k in range(len(sizes)):
        assert sum(p[k] * t for p, t in patterns) <= counts[k]
    assert all(sum(s * n for s, n in zip(sizes, p)) <= 1024 for p, _ in patterns)
    rows, n = packing.placed(h, 1024, sizes, members, patterns)
    held = defaultdict(int)
    for length, first, last, each, sequence, offset in rows:
        for k in range((last - first) // each):
            held[sequence + k] += sum(1 for _ in range(each) if length > share * 1024)
    # the configured sequences come first after the full ones and hold as many large documents as their patterns say
    at = h.get(1024, 0)
    for pattern, times in patterns:
        assert all(held[at + i] >= sum(pattern) for i in range(times))
        at += times
    assert n >= at


def test_near_the_bound_where_lengths_are_diverse():
    r = random.Random(5)
    h = dict(Counter(min(1024, int(r.lognormvariate(5.5, 1))) + 0 or 1 for _ in range(20000)))
    bound = -(-sum(x * n for x, n in h.items()) // 1024)
    assert packing.plan(h)[1] <= 1.002 * bound + 2
