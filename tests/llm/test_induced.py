"""Induced sorting against plain sorting."""

import random

import pytest

from skyquarry.llm import induced


@pytest.mark.parametrize("memory", [3, 50, 1 << 16])
def test_suffixes(memory):
    rng = random.Random(memory)
    texts = [b"", b"a", b"aa", b"ab", b"ba", b"banana", b"mississippi", b"abababab" * 9, b"\0" * 30, bytes(range(255, -1, -1)), bytes(range(256))]
    texts += [bytes(rng.choice(b"ab") for _ in range(rng.randrange(200))) for _ in range(40)] + [rng.randbytes(300) for _ in range(5)]
    for t in texts:
        order = list(induced.suffixes(t, memory))
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = list(induced.common_prefixes(t, order, 50))
        for (a, _), (b, n) in zip(lcp, lcp[1:]):
            assert t[a : a + n] == t[b : b + n] and (n == 50 or t[a + n : a + n + 1] != t[b + n : b + n + 1])
