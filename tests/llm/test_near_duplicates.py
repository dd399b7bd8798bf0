"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from ampersift.llm import neardup


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    size = min(width, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, ""), (4, " \n\t"), (5, "One two"), (6, "ONE  TWO"), (7, "one")]
    for i in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(len(own))] = word()
        rows.append((10 + i, " ".join(own)))
    drift = list(base)
    for i in range(30):  # a chain whose ends are not alike
        drift[3 * i % 120] = word()
        rows.append((100 + i, " ".join(drift)))
    rows += [(200 + i, " ".join(word() for _ in range(60))) for i in range(20)]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(docs, width, percent):
    rows = corpus(width)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(rows), width, percent).collect()}
    want = brute(rows, width, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_outsiders_meet_the_whole_bucket_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = corpus(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(rows), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_null_ids_and_repeated_rows(docs):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, text)]
    got = sorted(map(tuple, neardup.near_duplicates(docs(rows), 3, 85).collect()), key=repr)
    assert got == sorted([(1, 6, 1, True)] * 2 + [(2, 6, 1, False), (None, 6, None, True), (None, 0, None, True)], key=repr)
    kept = neardup.deduplicate(docs(rows))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1]
    assert kept.columns == docs(rows).columns


def test_empty_table(docs):
    assert neardup.near_duplicates(docs([]).limit(0)).count() == 0


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    found = rng.integers(0, 1 << 32, neardup.SAMPLES, dtype=np.uint64).astype(np.uint32)
    other = found.copy()
    other[: neardup.SAMPLES // 10] += 1
    bits = np.unpackbits(np.frombuffer(neardup.odd_sketch(found), np.uint8) ^ np.frombuffer(neardup.odd_sketch(other), np.uint8)).sum()
    assert 0.6 * neardup.SAMPLES / 5 <= bits <= neardup.SAMPLES / 5
