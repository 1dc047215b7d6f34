"""Cross parsing against a plain parse, and accuracy on rows that were held out."""

from __future__ import annotations

import random

from panelreg.llm.language import BLANK, SEGMENT, Parser, labelled_texts, letters_only, predict_language
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_phrases(text: str, known: str) -> int:
    """Greedy longest phrases that occur in the known text; a phrase has at least one character."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        count, at = count + 1, at + size
    return count


def test_phrases_are_those_of_a_plain_parse():
    rng = random.Random(3)

    def words(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))

    texts = {"a": [words("abcd", 200), words("abce", 100)], "b": [words("cdefg", 300)]}
    rules = Parser(texts)
    asked = [words("abcdefgh", 40), "", "1 2 3", words("abc", SEGMENT), "É" + words("abcd", 5)]
    totals, sizes = rules.phrases(asked)
    for i, text in enumerate(asked):
        letters = "".join(map(chr, letters_only([text])[0].tolist()))
        assert sizes[i] == len(letters)
        for j, lang in enumerate("ab"):
            known = "".join(map(chr, letters_only(["\n".join(texts[lang])])[0].tolist()))
            parts = [letters[k : k + SEGMENT] for k in range(0, len(letters), SEGMENT)]
            assert totals[j, i] == sum(plain_phrases(p, known) for p in parts)
    assert BLANK == 0


def test_letters_beyond_the_table():
    rng = random.Random(5)
    latin, one, two = ([chr(c) for c in span] for span in (range(0x430, 0x430 + 32), range(0x4E00, 0x4E50), range(0x4E30, 0x4E80)))
    latin += list("abcdefghijklmnopqrstuvwxyz")

    def words(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))

    texts = {"a": [words(one, 300)], "b": [words(two, 300)], "c": [words(latin, 3_000)]}
    rules = Parser(texts)
    asked = [words(one, 60), words(two, 60), words(latin, 60), words(one + two + latin, 90) + " \u9fa5\u9fa5"]
    totals, _ = rules.phrases(asked)
    for i, text in enumerate(asked):
        letters = "".join(map(chr, letters_only([text])[0].tolist()))
        for j, lang in enumerate("abc"):
            known = "".join(map(chr, letters_only(["\n".join(texts[lang])])[0].tolist()))
            assert totals[j, i] == sum(plain_phrases(letters[k : k + SEGMENT], known) for k in range(0, len(letters), SEGMENT))
    assert rules.predict(asked)[0][:3] == ["a", "b", "c"]


def test_held_out_accuracy(spark):
    rows = QUERIES["op7_cross_parsing"](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").toPandas().set_index("doc_id")
    assert len(rows) == len(docs) and rows["score"].between(0, 1).all()
    held = rows[rows["held_out"]]
    assert 150 < len(held) < 350
    assert (held["lang_pred"] == docs.loc[held.index, "lang"]).mean() > 0.95


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "der die das " * 20_000, "x"), (4, "der die das", "x"), (5, "the of", None)],
        "doc_id long, text string, score string",
    )
    texts = {"de": ["der die das ist"], "en": ["the of and is"]}
    found = predict_language(rows, texts).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in found) == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en")]
    assert all(r["score"] == 0 for r in found if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in predict_language(rows, {}).collect()} == {"und"}
    assert predict_language(rows.limit(0), texts).count() == 0


def test_sample_is_bounded_and_whole(spark):
    rows = [(f"text {i} " * (i % 9 + 1), "aa") for i in range(800)] + [("x" * 90_000, "bb"), (None, "aa"), ("y", None)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    found = labelled_texts(frame, 8_000)
    assert set(found) == {"aa", "bb"} and sum(map(len, found["aa"])) <= 4_000
    assert set(found["aa"]) <= {t for t, _ in rows} and found["bb"] == ["x" * 90_000]
    assert labelled_texts(frame.limit(0)) == {}
