"""Repeated strings against a search of all positions."""

import hashlib
import random
from collections import Counter

from ampersift.llm import repeats


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[p : p + 200] for _, raw in texts for p in range(len(raw) - 199))
    out = []
    for i, raw in texts:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 199):
            if seen[raw[p : p + 200]] > 1:
                gone[p : p + 200] = b"\x01" * 200
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[n] for n in names) for r in repeats.remove_repeats(df).collect()), key=repr)


def corpus():
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choices("abcdé ", k=n))
    one, two = draw(400), draw(260)
    rows = [
        (1, one),
        (2, draw(90) + one[100:330] + draw(50)),
        (3, two + draw(10) + two),
        (4, draw(500) + one[:180] + two[3:230]),
        (5, None),
        (6, ""),
        (7, "short"),
        (8, "a" * 250),
        (9, "ab" * 700),
        (10, "x" * 199),
        (11, "y" * 200),
        (12, one),
        (12, one),
        (None, draw(300)),
        (13, one[:250] + "Z" + one[251:]),
    ]
    noisy = list(draw(900))
    for i in range(12):
        own = list(noisy)
        for _ in range(4):
            own[rng.randrange(900)] = "#"
        rows.append((100 + i, "".join(own)))
    return rows


def test_equals_brute_force(docs):
    rows = corpus()
    assert found(docs(rows)) == brute(rows)


def test_segments_and_full_bitmaps(docs, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    monkeypatch.setattr(repeats, "MAP_BITS", 6)
    rows = corpus()
    assert found(docs(rows)) == brute(rows)


def test_empty_table(docs):
    assert found(docs([]).limit(0)) == []
