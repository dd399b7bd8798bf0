"""Personal data against Python's regular expressions."""

import hashlib
import re

import numpy as np

from ampersift.llm import pii


def base(text):
    digits = pii.digits_of
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and pii.luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, rule, good in rules for m in re.finditer(rule, text or "") if good(m[0])]


TEXTS = [
    None,
    "",
    "é😀 a.b+c@mail.example.com, a@b, @x.y, q@a.b@c.d.e, z@a..b",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9999999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111 1111 1111 1111 1111 1",
    "+1 (555) 010-9999 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49.30.1234567-",
    "9" * 40000,
    "a" * 40000 + "@" * 50,
    "١٢٣.4.5.6 １.2.3.4",
]


def test_base_spans(docs):
    for r in pii.find_personal(docs(list(enumerate(TEXTS)))).collect():
        want = base(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert set(want) <= set(r["spans"].split(",")) | ({""} if not want else set())
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(w.startswith(f"{kind}:") for w in want)


def test_expectation_maximisation_finds_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    n = len(pii.LABELERS)
    rates = np.where(np.arange(n) % 4 == 3, 0.5, 0.9)
    votes = np.where(rng.random((4000, n)) < rates, truth[:, None], ~truth[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, found = pii.reliabilities(patterns.astype(float), counts.astype(float))
    assert found[1][0] > 0.85 and abs(found[1][3] - found[0][3]) < 0.1
    weights = pii.train(patterns.astype(float), counts.astype(float), post)
    assert weights[0] > 1 and abs(weights[2]) < 0.5


def test_redaction(docs):
    rows = [(1, "é mail a@b.co or 1.2.3.4 now"), (2, None), (3, "clean"), (1, "x +1 555 010 9999")]
    out = pii.redact(docs(rows))
    got = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"])
    assert got == [(1, "x [PHONE]"), (1, "é mail [EMAIL] or [IP] now"), (3, "clean")]
    assert out.columns == docs(rows).columns and out.count() == 4


def test_empty_table(docs):
    assert pii.find_personal(docs([]).limit(0)).count() == 0
