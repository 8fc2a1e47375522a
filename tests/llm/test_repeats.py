"""Contexts that share no string leave before a transform is built; those left give the same runs."""

import numpy as np

from millrace.llm import repeats


def plain(parts, twice, length):
    seen = {}
    for x in parts:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    out = []
    for x, double in zip(parts, twice, strict=True):
        flags = [False, *(double or seen[x[i : i + length]] > 1 for i in range(len(x) - length + 1)), False]
        edges = [i for i in range(len(flags) - 1) if flags[i] != flags[i + 1]]
        out.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return out


def test_only_contexts_that_share_are_transformed(monkeypatch):
    rng, sizes, real = np.random.default_rng(5), [], repeats.repeated_suffixes
    monkeypatch.setattr(repeats, "repeated_suffixes", lambda text, length: (sizes.append(len(text)), real(text, length))[1])
    made = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    passage = made(230)
    parts = [made(300), made(50) + passage, made(260), passage + made(40), b"ab" * 130, made(200)]
    twice = [False, False, True, True, False, False]
    assert repeats.repeated_in(parts, twice, 200) == plain(parts, twice, 200)
    assert sizes == [sum(len(parts[i]) + 1 for i in (1, 3, 4))]
    alone = [parts[0], parts[2], parts[5]]
    assert repeats.repeated_in(alone, [False, True, False], 200) == [[], [(0, 61)], []]
    assert len(sizes) == 1
