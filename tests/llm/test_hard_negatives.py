import math
import random

import numpy as np
import pytest

from ampersift.llm import negatives
from ampersift.llm.negatives import Pack

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, row string"


def brute(rows):
    held = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if sum(x * x for x in whole) < 2**62:
            held.add((i, (label + 1) % 10 if i % 7 == 0 else label, whole))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in held:
        if i % 100:
            continue
        others = sorted((-dot(v, w), j, k) for j, k, w in held if j != i and len(w) == len(v))
        for p, j, _ in [x for x in others if x[2] == label][:5]:
            inside = [x for x in others if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(i, j, n, k, -p, -s) for n, (s, k, _) in enumerate(inside, 1)]
    return sorted(out)


def found(llm, rows):
    table = llm.createDataFrame([(*r, 0.5, 3, "mine") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(table).collect())


def vectors(rng, n, size, spread=0.4):
    centre = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centre)], rng.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("size", [1, 3, 16, 33])
def test_equals_brute_force(llm, size, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 2)
    rows = vectors(random.Random(size), 450, size)
    assert found(llm, rows) == brute(rows)


def test_cases(llm):
    rng = random.Random(9)
    rows = vectors(rng, 120, 6)
    rows += [(100, None, 1), (None, [1.0] * 6, 1), (7, [1.0] * 6, None), (200, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1)]
    rows += [(300, [float("nan")] * 6, 2), (300, [float("inf")] * 6, 2), (400, [1e30] * 6, 2)]
    rows += [(500, [], 3), (501, [], 3), (502, [], 4), (600, [1.0, 2.0], 3), (601, [1.0, 2.0], 3)]
    rows += rows[:30]  # repeated rows
    rows += [(-700, [0.5] * 6, 5), (-701, [0.5] * 6, 5), (-702, [0.4] * 6, 6)]
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(80)]  # ties everywhere
    # sums beyond 2^53: whole numbers all the way
    rows += [(900, [4.0e6, 1.0, 3.0e6], 1), (901, [4.0e6, 1.0, 3.0e6], 1), (902, [4.0e6, 0.5, 3.0e6], 2), (903, [4.0e6, 1.0, 2.9e6], 2)]
    assert found(llm, rows) == brute(rows)


def test_rows_that_share_an_id(llm):
    rows = [(100, [1.0, 1.0], 1), (5, [1.0, 0.9], 1), (5, [0.9, 0.9], 2), (5, [0.95, 0.9], 3), (100, [1.0, 1.0], 2)]
    got = found(llm, rows)
    assert got == brute(rows) and got


def test_empty_table(llm):
    assert found(llm, []) == []


def packs(rows):
    batch = _batch(rows)
    (out,) = negatives._pack(iter([batch]), "shard")
    cell = {f"s_{n}": out.column(n)[0].as_py() for n in out.schema.names}
    return Pack(cell, "s")


def _batch(v):
    import pyarrow as pa

    n = len(v)
    return pa.RecordBatch.from_pydict(
        {"id": list(range(n)), "label": [0] * n, "tie": [0] * n, "row": list(range(n)), "v": v, "shard": [0] * n, "size": [len(v[0])] * n}
    )


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (60, 21)).tolist()
    pack = packs(v)
    score = pack.v @ pack.v.T
    reach = []
    for mean, dev in pack.levels:
        middle, width = mean @ mean.T, dev @ dev.T
        assert (middle - width <= score + 1e-6).all() and (middle + width >= score - 1e-6).all()
        reach.append(width.mean())
    assert reach[0] > reach[1] > reach[2] >= 0


def test_ranges_lose_no_row():
    rng = np.random.default_rng(4)
    pack = packs(rng.integers(-90, 90, (80, 16)).tolist())
    score = pack.v @ pack.v.T
    low, high = np.quantile(score, 0.9, axis=1), np.quantile(score, 0.97, axis=1)
    got = dict(negatives.ranges(pack, pack, low, high))
    for i in range(len(score)):
        inside = set(np.flatnonzero((score[i] >= low[i]) & (score[i] <= high[i])).tolist())
        assert inside <= set(got.get(i, np.zeros(0, int)).tolist())
    assert sum(map(len, got.values())) < score.size  # something is left out
