"""Language ID: cross-parsing against a plain parse, held-out accuracy."""

import numpy as np
import pytest

from ampersift.llm import language, queries


def plain_phrases(text, known):
    """Greedy longest phrases found in ``known``, blocks as the model cuts them."""
    total = 0
    for at in range(0, len(text), language.BLOCK):
        block, i = text[at : at + language.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i : j + 1] in known:
                j += 1
            total, i = total + 1, j
    return total


def test_phrases_equal_a_plain_parse():
    rng = np.random.default_rng(5)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    samples = [("x", draw("abc ", 400)), ("y", draw("bcd ", 400))]
    model = language.Model(samples)
    texts = [draw("abcd ", n) for n in (1, 7, 300, 1500)]
    want = [[plain_phrases(t, known) for _, known in samples] for t in texts]
    assert model.phrases(texts).tolist() == want


def test_held_out_accuracy(llm):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in llm.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.QUERIES["op2_language_id"](llm, folder).collect() if r["held_out"]]
    assert len(rows) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_texts_without_letters_and_clashing_columns(llm, docs):
    taught = llm.createDataFrame([("der die das und", "de"), ("the and of", "en"), (None, "fr"), ("x", None)], "text string, lang string")
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "THE AND"), (4, "THE AND"), (None, "und das"), (5, "the of " * 3000)]
    got = language.identify(docs(rows), taught)
    found = sorted(((r["doc_id"] or 0), r["lang_pred"]) for r in got.collect())
    assert found == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en")]
    assert dict(got.dtypes)["score"] == "double" and "kept" in got.columns


def test_nothing_to_learn_and_empty_table(docs):
    assert {r["lang_pred"] for r in language.identify(docs([(1, "a b")]), docs([]).limit(0)).collect()} == {"und"}
    assert language.identify(docs([]).limit(0), docs([(1, "a b")])).count() == 0


def test_phrases_equal_a_plain_parse_beyond_the_common_letters():
    rng = np.random.default_rng(6)
    han = "".join(chr(0x4E00 + i) for i in range(150))
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    samples = [("en", draw("abc ", 900)), ("ru", draw("абв ", 900)), ("zh", draw(han, 900))]
    model = language.Model(samples)
    texts = [samples[2][1][100:400], draw(han, 600), draw(han + "abc абвž", 700), samples[1][1][5:90], "ž"]
    want = [[plain_phrases(t, known) for _, known in samples] for t in texts]
    assert model.phrases(texts).tolist() == want
    assert model.judge(texts)[0][:2] == ["zh", "zh"]


def test_one_long_text_is_not_the_whole_sample(llm):
    short = [(f"der die das wort{chr(97 + i)} und", "de") for i in range(20)]
    rows = [("the of and " * 9000, "de"), *short]
    taught = llm.createDataFrame(rows, "text string, lang string")
    ((_, sample),) = language.labelled_sample(taught)
    assert all(t in sample for t, _ in short) and len(sample) <= language.SAMPLE_CHARS
    assert language.shared_out(["a" * 100, "b" * 3, "c" * 100], 25) == "a" * 10 + " bbb " + "c" * 10


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ", "① ٣ _ 7", "", None, "\u0301"])
def test_texts_without_letters_have_no_language(llm, docs, text):
    labelled = docs([(i, "hello world of words") for i in range(4)])
    (row,) = language.identify(docs([(1, text)]), labelled.select("text", "lang")).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_numbers_part_words():
    assert language.letters("aⅧb ½ Ümlaut") == "a b ümlaut"
