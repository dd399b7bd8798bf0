"""Packing: exact round trip, little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ampersift.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def placed_once(rows, texts):
    """Every id lies in one piece, every sequence is gapless; returns (tokens, padding)."""
    full = Tokenizer.from_file(PATH)
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    tokens = 0
    for doc, own_texts in texts.items():
        ids = [*full.encode(own_texts[0] or "", add_special_tokens=False).ids, 0]
        tokens += len(ids) * len(own_texts)
        got = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc])
        covered = Counter()
        for (start, length, crc, total), n in got.items():
            assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            covered.update({k: n for k in range(start, start + length)})
        assert covered == dict.fromkeys(range(len(ids)), len(own_texts))
    lost = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
        lost += 0 if at & (at - 1) == 0 else packing.SEQUENCE - at
    return tokens, lost


def test_round_trip(docs):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("aeinrst", k=5)) for _ in range(rng.randint(0, 700)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|> x <|endoftext|>"), (503, "naïve 😀\n\n  tab\t's"), (504, "z" * 9000)]
    rows += [(600, "same text " * 50)] * 40 + [(None, "no id")]
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    tokens, lost = placed_once(packing.pack(docs(rows), PATH).collect(), texts)
    assert lost <= 0.02 * tokens + packing.SEQUENCE


def test_whole_table(llm):
    df = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: [r["text"]] for r in df.collect()}
    tokens, lost = placed_once(packing.pack(df, PATH).collect(), texts)
    assert lost <= 0.02 * tokens + packing.SEQUENCE


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {1023: 3}, {600: 1000}, {513: 7, 511: 9, 2: 1}, {k: 3 for k in range(1, 1024)}])
def test_plan_places_every_piece(histogram):
    slots, cut = packing.plan(histogram)
    want = Counter({(length, False): n - cut.get(length, 0) for length, n in histogram.items()})
    for length, n in cut.items():
        want.update({(x, True): n for x in packing.powers(length)})
    got = Counter()
    for length, from_cut, low, high, *_ in slots:
        got[length, from_cut] += high - low
    assert got == +want


def test_empty_table(docs):
    assert packing.pack(docs([]).limit(0), PATH).count() == 0
