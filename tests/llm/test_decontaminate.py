"""Contamination against a plain window search."""

import hashlib

from ampersift.llm import decontaminate as dc

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def brute(text, items):
    words = dc.words((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        own = dc.words((body or "").encode())
        size = min(13, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


ITEMS = [(1, ITEM), (10, ITEM.lower()), (2, "one-item"), (3, None), (4, "!!"), (2, "one item"), (None, "null item here"), (5, "é ü")]
TEXTS = [
    None,
    "",
    "??",
    ITEM,
    "x " * 500 + ITEM.upper().replace(" ", ", ") + " y" * 10,
    "nothing of it",
    "one item; One\nitem",
    "a null item here",
    "É ü é ü",
    " ".join(ITEM.split()[:12]),
    ("filler " * 400 + "one item"),
]


def figures(rows):
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows}


def test_equals_brute_force(llm, docs):
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    want = {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}
    assert figures(dc.judged(docs(list(enumerate(TEXTS))), items).collect()) == want


def test_blocks_of_a_large_benchmark(llm, docs, monkeypatch):
    monkeypatch.setattr(dc, "INDEX_BYTES", 40)
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    want = {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}
    assert figures(dc.judged(docs(list(enumerate(TEXTS))), items).collect()) == want


def test_removal(llm, docs):
    items = llm.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(1, f"before, {ITEM}! after"), (2, "clean"), (3, None)]
    whole = dc.decontaminate(docs(rows), items)
    assert sorted(r["doc_id"] for r in whole.collect()) == [2, 3] and whole.columns == docs(rows).columns
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs(rows), items, unit="span").collect()}
    assert cut == {1: "before, ! after", 2: "clean", 3: None}


def test_empty_tables(llm, docs):
    none = llm.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in dc.judged(docs([(1, ITEM)]), none).collect()] == [0]
    assert dc.judged(docs([]).limit(0), none).count() == 0
