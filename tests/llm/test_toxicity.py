import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ampersift.llm import queries, toxicity


def plain_windows(raw):
    """Windows of a text word by word."""
    words, at = [], 0
    while at < len(raw):
        if raw[at] > 32:
            words.append(at)
            while at < len(raw) and raw[at] > 32:
                at += 1
        else:
            at += 1
    units, starts = words[:: toxicity.STEP], []
    for i, a in enumerate(units):
        end = units[i + 1] if i + 1 < len(units) else len(raw)
        starts += range(a, end, toxicity.LONGEST)
    wide = toxicity.WINDOW // toxicity.STEP
    return [raw[a : starts[i + wide] if i + wide < len(starts) else len(raw)] for i, a in enumerate(starts)]


def prose(rng, n, extra=()):
    parts = ["an", "on", "ther", "ing", "ed", "ly", "st", "ou", "ea", "tion"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled():
    """(label, text) rows: toxic texts hold some of four words."""
    rng = random.Random(5)
    bad = ["wretch", "vermin", "blockhead", "cur!"]
    return [(i % 2, prose(rng, rng.randint(40, 120), rng.choices(bad, k=4) if i % 2 else ())) for i in range(400)]


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.Model([(y, t.encode()) for y, t in labelled], 0.5)


@pytest.mark.parametrize("text", ["", "   ", "one", " a b\nc  d e f g h i j k l m", "x" * 700, "ab " + "y" * 300 + " cd " * 9, "é à\tü " * 30])
def test_windows_equal_plain_loop(text):
    raw = text.encode()
    starts, lengths = toxicity.windows(raw)
    assert [raw[a : a + n] for a, n in zip(starts, lengths, strict=True)] == plain_windows(raw)


def test_gains_equal_single_frames(model, labelled):
    pair = toxicity.Compressors(model.ordinary, model.toxic)
    for _, text in labelled[:10]:
        raw = text.encode()
        sizes = []
        for content in (model.ordinary, model.toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=toxicity.LEVEL)
            settings = zstandard.ZstdCompressionParameters.from_level(
                toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
            )
            one = zstandard.ZstdCompressor(compression_params=settings, dict_data=held)
            sizes.append([len(one.compress(pair.lead + w + pair.end)) for w in plain_windows(raw)])
        assert pair.gains(raw).tolist() == (np.array(sizes[0]) - np.array(sizes[1])).tolist()


def test_slices_do_not_change_gains(model, labelled, monkeypatch):
    pair = toxicity.Compressors(model.ordinary, model.toxic)
    raw = " ".join(t for _, t in labelled[:20]).encode()
    whole = pair.gains(raw)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    assert pair.gains(raw).tolist() == whole.tolist()


def test_marks_are_the_toxic_words(labelled):
    marks = toxicity.marking([t.encode() for y, t in labelled if y], [t.encode() for y, t in labelled if not y])
    assert {m[:4] for m in marks} == {b"wret", b"verm", b"bloc", b"cur!"}


def test_held_out_texts(model):
    rng = random.Random(6)
    score = model.scorer()
    clean = [score(prose(rng, 80).encode())[0] for _ in range(60)]
    toxic = [score(prose(rng, 80, rng.choices(["Wretch", "vermin", "blockhead"], k=3)).encode())[0] for _ in range(60)]
    assert np.mean([s >= 0.3 for s in toxic]) >= 0.9
    assert np.mean([s >= 0.3 for s in clean]) <= 0.1


def test_cases(llm, docs, labelled, model):
    long = "vermin " * 40_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, labelled[1][1]), (4, labelled[1][1]), (None, "x"), (5, long), (6, "z" * 100_000)]
    found = toxicity.score(docs(rows), model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "score", "predicted", "n_windows"]
    out = [(r["doc_id"], r["score"], r["predicted"], r["n_windows"]) for r in found.collect()]
    assert len(out) == len(rows)
    by_id = {r[0]: r for r in out}
    assert by_id[1][1] == by_id[2][1] == by_id[3][1] < 0.3 and by_id[1][3] == 0
    assert by_id[5][3] == 10_000 and by_id[6][3] == -(-100_000 // toxicity.LONGEST)
    assert len({r for r in out if r[0] == 4}) == 1
    assert all(0 <= r[1] <= 1 and r[2] == (r[1] >= 0.3) for r in out)
    assert toxicity.score(docs([]), model).count() == 0


def test_fit_without_both_classes(llm, docs):
    table = docs([(i, f"some words {i}") for i in range(8)])
    labels = llm.createDataFrame([(i, 0) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    assert {r["score"] for r in toxicity.score(table, model).collect()} == {0.5 / 9}
    empty = toxicity.fit(table, labels.limit(0))
    assert {r["score"] for r in toxicity.score(table, empty).collect()} == {0.0}


def test_fit_takes_a_bounded_piece_of_repeated_ids(llm, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 5)
    seen = []
    monkeypatch.setattr(toxicity, "Model", lambda sample, share: seen.append((sample, share)))
    rows = [(i % 3, "y" * 20_000 + f" {i}") for i in range(60)]
    labels = llm.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 1)], "doc_id long, toxic int")
    toxicity.fit(docs(rows), labels)
    (sample, share), = seen
    assert share == 2.5 / 4 and sorted(y for y, _ in sample) == [0] * 5 + [1] * 5
    assert {len(t) for _, t in sample} == {toxicity.SAMPLE_BYTES}


def test_query_catches_held_out_toxic_words(llm, small_dir):
    docs = llm.read.parquet(f"{small_dir}/documents.parquet")
    words = "(?i)(idiot|worthless|trash|scum|moron|stupid|loser|disgusting|clown|pathetic)"
    hits = docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(words), F.lit(1))).alias("hits"))
    found = queries.QUERIES["op11_toxicity"](llm, small_dir).join(hits, "doc_id").collect()
    assert len(found) == docs.count()
    toxic = [r["predicted"] for r in found if r["hits"] >= 4]
    clean = [r["predicted"] for r in found if r["hits"] == 0]
    assert np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.15
