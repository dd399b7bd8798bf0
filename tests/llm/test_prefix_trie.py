import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ampersift.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, kept string, depth int"


def brute(rows, every=4, period=20):
    """Nodes of the trie with every prefix written out."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, tie), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % every
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, period)), [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    words = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", t[-1][1].encode())) if t else 0
    out = []
    for top, inside in members.items():
        below = [k for k in members if k[: len(top)] == top]
        children = [k for k in below if len(k) == len(top) + 1]
        ends = ",".join(str(c) for c in sorted(inside) if len(rebuilt[c]) == len(top))
        leaves = [k for k in below if not any(len(x) > len(k) and x[: len(k)] == k for x in below)]
        out.append(
            (
                min(inside),
                len(top),
                min(members[top[:-1]]) if top else None,
                len(inside),
                len(children),
                len(leaves),
                sum((len(members[k]) - 1) * words(k) for k in below),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def found(llm, rows):
    table = llm.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(table).collect()), key=str)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(2)
    texts = ["hello there", "", None, "a  b\tc d", "same words again", "x" * 50_000]
    rows = []
    for c in [*range(45), 1000, 1001, 1019, -3, -20]:
        for turn in range(rng.randint(1, 5)):
            rows.append((c, turn if rng.random() < 0.8 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(7, 3, "user", "tied"), (7, 3, "user", "other"), (7, 3, "user", "other")]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (44, None, "system", None)]
    rows += [(61, i // 2, "user", f"turn {i}") for i in range(300)]  # one long conversation
    rows += [(62, i // 2, "user", f"turn {i}") for i in range(250)]
    return rows


def test_equals_brute_force(llm, mixed):
    assert found(llm, mixed) == brute(mixed)


def test_empty_table(llm):
    assert found(llm, []) == []


def test_turnless_conversations_stay_at_the_root(llm):
    c = next(i for i in range(21, 40) if zlib.crc32(str(i).encode()) % 4 > 1)
    rows = [(c, 0, "user", "gone")]
    assert found(llm, rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_other_bases_after_a_failed_node(llm, monkeypatch):
    """With base 0 a fingerprint is that of the first turn: nodes mix, and the
    next bases are taken."""
    rows = [(c, t, "user", f"{'same' if t == 0 else c} {t}") for c in (0, 20, 40, 60) for t in range(4)]
    monkeypatch.setattr(prefixtrie, "BASES", ((0, 0), *prefixtrie.BASES))
    monkeypatch.setattr(prefixtrie, "pow", lambda b, e, p: pow(b or 1, e, p) if e < 0 else pow(b, e, p), raising=False)
    assert found(llm, rows) == brute(rows)


def test_ends_over_slices_and_chunks(llm, monkeypatch):
    monkeypatch.setattr(prefixtrie._Run, "KEEP", 40)
    keys = [(1, 5, 6)] * 4000 + [(2, 5, 6)] * 30 + [(2, 5, 7), (3, 0, 0)]
    rows = [(*k, i * 3 - 50) for i, k in enumerate(keys)]
    table = llm.createDataFrame(rows, "depth long, f0 long, f1 long, c long").orderBy(F.rand(1))
    want = {k: hashlib.sha256(",".join(str(r[3]) for r in rows if r[:3] == k).encode()).hexdigest() for k in set(keys)}
    got = [((r["depth"], r["f0"], r["f1"]), r["digest"]) for r in prefixtrie.ends_digest(table).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_products_compose_over_slices(llm, mixed):
    """Running products equal a plain left-to-right product, whatever the slices."""
    table = llm.createDataFrame([(*r, "x", 1) for r in mixed], SCHEMA)
    turns = prefixtrie.stored_turns(table)
    bases = prefixtrie.BASES[0]
    rows = prefixtrie.running_products(turns, bases).collect()
    by = {}
    for r in rows:
        by.setdefault(r["c"], {})[r["k"]] = r
    assert sum(len(v) for v in by.values()) == sum(r[0] is not None for r in mixed)
    for places in by.values():
        words, hashes = 0, [0, 0]
        for k in range(1, len(places) + 1):
            r = places[k]
            words += r["words"]
            hashes = [(x + r[f"t{i}"] * pow(bases[i], k - 1, p)) % p for i, (x, p) in enumerate(zip(hashes, prefixtrie.PRIMES, strict=True))]
            assert (r["w"], [r["h0"], r["h1"]]) == (words, hashes)
