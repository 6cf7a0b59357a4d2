"""op8: the sum of an n-gram's values is looked up at once, whichever n-grams are there."""

import random

import numpy as np
import pytest

from newsloom.llm import suffix_tree_lm as lm


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_sums_of_values(monkeypatch, chunk):
    """Against a plain dictionary: values of any n-grams, as in a part of them, with the least and highest bytes and empty texts."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    rng = random.Random(8)
    texts = [[bytes(rng.choice(b"\x00\x01a\xfe\xff") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 5))] for _ in range(60)]
    whole = [b"\n" + b" ".join(t) + b"\n" for t in texts]
    every = {t[i - k : i] for t in whole for k in range(1, lm.LONGEST + 1) for i in range(k, len(t) + 1)}
    value = {g: rng.uniform(-3, 3) for g in sorted(every) if rng.random() < 0.5} | {b"\n": 0.7}
    plain = np.array([rng.uniform(-6, -1) for _ in range(256)])

    def level(k):
        found = [(int.from_bytes(g), v) for g, v in value.items() if len(g) == k]
        return np.array([g for g, _ in found], np.int64), np.array([v for _, v in found], np.float32)

    want = [value[b"\n"] + sum(plain[t[i]] + sum(value.get(t[i - k + 1 : i + 1], 0) for k in range(1 if t[i] != lm.BORDER else 2, min(i + 1, lm.LONGEST) + 1)) for i in range(1, len(t))) for t in whole]
    assert np.allclose(lm.Values(plain, level).scores(texts), want, atol=1e-3)
    assert len({len(g) for g in value}) == lm.LONGEST
