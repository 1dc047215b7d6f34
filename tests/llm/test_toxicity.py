"""The recurrent network: derivatives, held-out accuracy, odd rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.types import LongType, StringType, StructField, StructType

from panelreg.llm import batches, toxicity
from panelreg.llm.language import predict_language
from panelreg.llm.queries import QUERIES
from panelreg.llm.toxicity import STRIDE, WINDOW, first_params, fit, gradient, labelled_sample, learn, logits, read_words, score_texts, score_toxicity

SF = "/root/testdata/sf0.1"


def test_gradient_against_differences():
    words = read_words(["a few words of text here", "other words", "a " * 45])
    known = np.sort(words.word_hash[:4]), np.unique(words.gram_hash[::2])
    params = {k: v.astype(np.float64) if k in ("word", "gram") or v.dtype.kind == "f" else v for k, v in first_params(*known).items()}
    dropped = np.where(np.random.default_rng(2).random((len(words.word_hash), 24)) > 0.3, 1.4, 0.0)
    asked = np.array([0.3, -1.2, 0.7, 0.1])
    tape = {}
    assert len(logits(params, words, words.windows, tape, dropped)) == len(asked)
    grads = gradient(params, words, words.windows, tape, asked)
    rng = np.random.default_rng(5)
    for name, value in params.items():
        if name in ("words", "grams"):
            continue
        places = np.argsort(-abs(grads[name].ravel()))[:3].tolist() + rng.integers(0, value.size, 2).tolist()
        for place in places:
            flat, old = value.reshape(-1), value.reshape(-1)[place]
            ends = []
            for change in (1e-5, -1e-5):
                flat[place] = old + change
                ends.append(logits(params, words, words.windows, None, dropped) @ asked)
            flat[place] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - grads[name].reshape(-1)[place]) < 1e-5


def test_windows_cover_every_word():
    for n in (1, WINDOW - 1, WINDOW, WINDOW + 1, WINDOW + STRIDE, 500):
        words = read_words([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)), ""])
        assert set(words.windows[words.windows >= 0].tolist()) == set(range(n))
        assert len(words.owner) == 1 + max(0, -(-(n - WINDOW) // STRIDE))


def test_long_texts_show_their_worst_window():
    rng = np.random.default_rng(1)
    plain = [["".join(rng.choice(list("abcde"), 4)) for _ in range(30)] for _ in range(400)]
    texts = []
    for i, words in enumerate(plain):
        at = int(rng.integers(30))
        texts.append(" ".join(words[:at] + ["zonkish"] * (i % 4 == 0) + words[at:]))
    plain = [" ".join(words) for words in plain]
    params = learn(texts, [int(i % 4 == 0) for i in range(400)])
    scores = score_texts(params, [" ".join(plain[:6]), " ".join(plain[:3]) + " zonkish " + " ".join(plain[3:6]), "", "1 2"])
    assert scores[0] < scores[1] > 0.6 and scores[2] == scores[3] == 0
    assert learn(["a", "b"], [1, 1]) is None and learn([], []) is None


def test_held_out_accuracy(spark):
    rows = QUERIES["op8_bigru_toxicity"](spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    assert len(rows) == 10_000 and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    held = rows[rows["held_out"] & rows.index.isin(labels.index)]
    truth = labels.loc[held.index]
    assert (held["predicted"] == truth).mean() > 0.95
    assert held.loc[truth == 1, "predicted"].mean() > 0.75


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "word " * 50_000, 9), (3, "word", 9)], "doc_id long, text string, score int")
    assert score_toxicity(rows, None).where("score = 0 and predicted = 0").count() == 4
    found = {r["doc_id"]: r for r in score_toxicity(rows, first_params(np.zeros(0, np.uint64), np.zeros(0, np.uint64))).collect()}
    assert found[1]["score"] == found[2]["score"] == 0 and found[3]["score"] > 0
    assert score_toxicity(rows.limit(0), None).count() == 0
    labelled = spark.createDataFrame([("a", 1), ("b", 1), (None, 0), ("c", None), ("d", 7)], "text string, toxic int")
    assert fit(labelled) is None and toxicity.THRESHOLD == 0.3


def test_label_on_long_texts_only(spark):
    rows = [(f"fine text {i}", 0) for i in range(5)] + [("bad " * 2_000, 1), ("bad " * 3_000, 1)]
    texts, labels = labelled_sample(spark.createDataFrame(rows, "text string, toxic int"))
    assert sorted(labels) == [0] * 5 + [1] * 2 and "bad " * 2_000 in texts
    assert labelled_sample(spark.createDataFrame(rows[:5], "text string, toxic int")) == ([], [])


def test_learning_keeps_little_of_each_text():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(w) for w in letters[rng.integers(0, 26, (2_000, 9))]]
    texts = [" ".join(words[i] for i in rng.integers(0, 2_000, 250)) for _ in range(600)]
    tracemalloc.start()
    try:
        assert learn(texts, [i % 2 for i in range(600)], 1) is not None
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # some 3 million grams of all texts, of 16 bytes each, would be 50 MB and more
    assert peak < 45e6


def test_packed_words_give_the_same_logits():
    words = read_words(["a few words of text here", "other words", ""])
    params = first_params(np.sort(words.word_hash[:4]), np.unique(words.gram_hash[::2]))
    again = toxicity.unpacked(params["grams"], toxicity.packed(params["grams"], words))
    tapes = {}, {}
    found = [logits(params, w, w.windows, tape) for w, tape in zip((words, again), tapes, strict=True)]
    assert np.array_equal(*found)
    grads = [gradient(params, w, w.windows, tape, np.ones(2, np.float32)) for w, tape in zip((words, again), tapes, strict=True)]
    assert all(np.array_equal(grads[0][k], grads[1][k]) for k in grads[0])


class Rows:
    """Documents whose tasks run here, batch after batch."""

    def __init__(self):
        self.columns = ["doc_id", "text"]
        self.schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

    def drop(self, *names):
        return self

    def withColumn(self, name, column):
        return self

    def mapInArrow(self, run, schema):
        self.made = list(run(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b", None, ""])], self.columns)])))
        return self


def test_tasks_give_back_what_earlier_stages_left(spark, monkeypatch):
    for score in (lambda: score_toxicity(Rows(), None), lambda: predict_language(Rows(), {})):
        batches.worker_store("words")["path"] = np.zeros(9)
        given = []
        monkeypatch.setattr(batches, "give_back", lambda: given.append(1))
        (made,) = score().made
        assert made["score"].to_pylist() == [0.0] * 3
        assert not batches.worker_store("words") and len(given) == 2
