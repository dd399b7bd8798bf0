"""Base figures and the line field against brute force."""

import itertools

import numpy as np
import pytest

from ampersift.llm import quality, queries


def brute(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(hit),
    )


TEXTS = [
    None,
    "",
    " \n\t\n",
    "é# one\none\n one\none",
    "a b c d e f g h\n" * 4,
    " ".join("xyz"[i % 3] for i in range(40)),
    "word " * 300,
    "\x1ca\xa0b\x85 c" * 9,
]


def test_base_figures(docs):
    rows = quality.judge(docs(list(enumerate(TEXTS))), quality.ChainField()).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == {i: brute(t) for i, t in enumerate(TEXTS)}
    for r in rows:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_viterbi_equals_all_paths(size):
    rng = np.random.default_rng(size)
    field = quality.ChainField(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)))
    chain = rng.integers(0, quality.N_FEATURES, (size, len(quality.BUCKETS)))
    emit = field.weights[chain].sum(axis=1)

    def value(path):
        return sum(e for e, y in zip(emit, path, strict=True) if y) + sum(field.switch[a, b] for a, b in itertools.pairwise(path))

    best = max(itertools.product((0, 1), repeat=size), key=value)
    assert tuple(field.decode(chain)) == best


def test_field_learns_labels(llm):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op3_quality_rules"](llm, folder).collect() if r["doc_id"] in truth and not r["base_failed"]]
    right = sum(r["kept"] == (truth[r["doc_id"]] == 1) for r in rows)
    assert right >= 0.95 * len(rows)


def test_without_labels_and_empty(llm, docs):
    labels = llm.createDataFrame([], "doc_id long, quality int")
    field = quality.fit(docs([(1, "a b")]), labels)
    assert not field.weights.any()
    assert quality.judge(docs([]).limit(0), field).count() == 0


@pytest.mark.parametrize("n", [65, 66, 100, 1000])
def test_sampled_runs_reach_all_parts(n):
    lines = np.arange(n).reshape(-1, 1)
    starts = set()
    for k in range(40):
        runs = [r.ravel() for r in quality.sampled_runs(lines, b"text %d" % k)]
        assert sum(map(len, runs)) == quality.SAMPLE_LINES and len(set(np.concatenate(runs).tolist())) == quality.SAMPLE_LINES
        assert all((np.diff(r) == 1).all() for r in runs)
        assert runs[0][0] == 0 and runs[-1][-1] == n - 1
        starts |= {int(r[0]) for r in runs[1:-1]}
    assert n < 100 or len(starts) > 10
    assert len(quality.sampled_runs(lines[:64], b"x")) == 1
