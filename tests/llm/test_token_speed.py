"""The encoder's short ways against plain ones."""

import numpy as np

from sparkfolio.llm import token_store as t
from sparkfolio.llm.text import mix


def plain_cuts(ids):
    n, ends, last = len(ids), [], 0
    sums = [0]
    for x in mix(ids.astype(np.uint64) + np.uint64(977)).tolist():
        sums.append((sums[-1] + x) % 2**64)
    for at in range(t.WINDOW, n + 1 if n > t.LEAST else 0):
        rolling = mix(np.array([(sums[at] - sums[at - t.WINDOW]) % 2**64], dtype=np.uint64))[0]
        if int(rolling) % t.MEAN == 0:
            while at - last > t.MOST:
                last += t.MOST
                ends.append(last)
            if at - last >= t.LEAST:
                ends.append(at)
                last = at
    while n - last > t.MOST:
        last += t.MOST
        ends.append(last)
    return [*ends, n] if last < n else ends


def test_cuts_stand_where_the_plain_formula_puts_them():
    rng = np.random.default_rng(3)
    for n in (0, 1, 128, 129, 3000, 9000):
        ids = rng.integers(0, 65536 if n % 2 else 900, n)
        for width in ("<u2", "<u4"):
            assert t.cuts(ids.astype(width)) == plain_cuts(ids)
    assert t.cuts(np.zeros(9000, dtype="<u2")) == plain_cuts(np.zeros(9000, dtype="<u2"))


def test_different_keys_as_numpy_finds_them():
    rng = np.random.default_rng(5)
    for keys in (np.zeros(0, dtype=np.uint64), rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(0, 2**64, 500, dtype=np.uint64)):
        for a, b in zip(t.different(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
            assert np.array_equal(a, b)
