"""Elias-Fano lists against plain arrays."""

import numpy as np
import pytest

from orrery.llm.eliasfano import EliasFano, encode


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1000, 70_000])
@pytest.mark.parametrize("universe", [0, 1, 9, 1 << 20, 1 << 40, 1 << 62])
def test_select_and_slice(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe + 1, n, dtype=np.uint64))
    data = encode(values, universe)
    found = EliasFano(data)
    assert len(found) == n and (found.slice(0, n) == values).all()
    for k in rng.integers(0, n, 30).tolist() if n else []:
        assert found.select(k) == int(values[k])
        assert (found.slice(k, k + 300) == values[k : k + 300]).all()
    with pytest.raises(IndexError):
        found.select(n)


def test_size():
    n, step = 100_000, 1000
    data = encode(np.arange(n, dtype=np.uint64) * step)
    assert len(data) * 8 / n < 2 + np.log2(step) + 0.2
