"""Toxicity by a bidirectional gated recurrent network with attention pooling, written in numpy.

Words are runs of lower-case letters. A word enters the network as its own vector beside the
scaled sum of vectors of its character 3- to 5-grams, so unseen forms of a known stem still say something.
A window of ``WINDOW`` words is read in both directions by gated recurrent units; attention weighs their
states, and a linear layer gives the window's logit. All overlapping windows (every ``STRIDE`` words) of
a text are scored, and the largest logit is that of the text.

Learning: whole texts of labelled rows, drawn by a hash of the text, at most ``LEARN_ROWS`` per label and
``LEARN_CHARS`` characters long (bounds of the learning sample; scoring has none); a label that has only longer
texts gives its shortest ones. A text is labelled,
not its windows: after a first pass over windows at random, each step takes the window of each text that
the network itself finds most toxic. Adam, fixed seeds, so equal samples give equal networks.

The network has some hundred thousand parameters and travels with the tasks; a task holds one batch of
texts. Nothing is shuffled but the counts and the learning sample.

Defined results: texts without words, null ones included, score 0; without rows of both labels everything
scores 0; rows with a null label or text are not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelreg.llm.batches import LETTER, char_classes, codepoints, forget_others, give_back, mixed, ragged, run_hashes, text_parts, tidied, word_runs
from panelreg.llm.language import held_out
from panelreg.llm.registry import register, table

WINDOW, STRIDE = 40, 30
WORD_SIZE, GRAM_SIZE = 12, 12
#: Words and grams have vectors if at least so many texts of the learning sample hold them, the commonest first.
SEEN_IN, MOST_WORDS, MOST_GRAMS = 4, 20_000, 40_000
GRAMS = (3, 4, 5)
HIDDEN, ATTENTION = 12, 8
LEARN_ROWS, LEARN_CHARS = 1_500, 4_000
EPOCHS, BATCH, RATE, DROPPED = 4, 64, 0.01, 0.3
THRESHOLD = 0.3
#: Texts after which the words that were seen are counted, and words whose grams are summed at once.
COUNTED, SUMMED = 64, 2_000

Params = dict[str, np.ndarray]


@dataclass
class Words:
    """Distinct words of some texts, and the windows over them as indices (-1: no word)."""

    word_hash: np.ndarray
    gram_hash: np.ndarray
    gram_word: np.ndarray
    gram_count: np.ndarray
    windows: np.ndarray
    owner: np.ndarray


def read_words(texts: list[str]) -> Words:
    cps, ends = codepoints([t.lower() for t in texts])
    starts, stops = word_runs(cps, ends, char_classes()[cps] == LETTER)
    hashes, first, place = np.unique(run_hashes(cps, starts, stops), return_index=True, return_inverse=True)
    a, b = starts[first], stops[first]
    # every distinct word between two marks, and all its grams
    sizes = b - a + 2
    begins = np.cumsum(sizes) - sizes
    chars = np.zeros(int(sizes.sum()), np.uint64)
    inside = np.ones(len(chars), bool)
    inside[begins] = inside[begins + sizes - 1] = False
    chars[inside] = cps[ragged(a, b - a)] + np.uint64(1)
    word = np.repeat(np.arange(len(a)), sizes)
    left = np.repeat(begins + sizes, sizes) - np.arange(len(chars))
    rows, owners, code = [], [], np.zeros(len(chars), np.uint64)
    for i in range(max(GRAMS)):
        shifted = np.zeros_like(chars)
        shifted[: len(chars) - i] = chars[i:]
        code = mixed(code * np.uint64(0x100000001B3) + shifted + np.uint64(1))
        if i + 1 in GRAMS:
            whole = np.flatnonzero(left > i)
            rows.append(code[whole])
            owners.append(word[whole])
    gram_word = np.concatenate(owners)
    by_word = np.argsort(gram_word, kind="stable")
    gram_word = gram_word[by_word]
    cuts = np.searchsorted(starts, ends)
    counts = np.diff(cuts)
    windows_of = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(texts)), windows_of)
    at = ragged(np.zeros(len(texts), np.int64), windows_of) * STRIDE
    places = at[:, None] + np.arange(WINDOW)
    there = places < counts[owner][:, None]
    windows = np.full(places.shape, -1, np.int32)
    windows[there] = place[(cuts[:-1][owner][:, None] + places)[there]]
    return Words(
        hashes,
        np.concatenate(rows)[by_word],
        gram_word,
        np.bincount(gram_word, minlength=len(a)),
        windows,
        owner,
    )


class Seen:
    """Hashes, and in how many texts each one was."""

    def __init__(self):
        self.found, self.times, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, hashes: np.ndarray) -> None:
        """The hashes of one text."""
        self.new.append(np.unique(hashes))
        if len(self.new) >= COUNTED:
            self.count()

    def count(self) -> None:
        new, times = np.unique(np.concatenate([self.found[:0], *self.new]), return_counts=True)
        self.found, place = np.unique(np.concatenate([self.found, new]), return_inverse=True)
        total = np.zeros(len(self.found), np.int64)
        np.add.at(total, place, np.concatenate([self.times, times]))
        self.times, self.new = total, []

    def common(self, most: int) -> np.ndarray:
        """The sorted hashes that were in at least SEEN_IN texts."""
        self.count()
        order = np.lexsort((self.found, -self.times))[:most]
        return np.sort(self.found[order[self.times[order] >= SEEN_IN]])


def vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the words and grams that get vectors."""
    seen_words, seen_grams = Seen(), Seen()
    for text in texts:
        words = read_words([text])
        seen_words.add(words.word_hash)
        seen_grams.add(words.gram_hash)
    return seen_words.common(MOST_WORDS), seen_grams.common(MOST_GRAMS)


def packed(grams: np.ndarray, words: Words) -> Words:
    """For keeping: the places of grams that have vectors, the others add nothing, and how many of them each word has."""
    place = rows_of(grams, words.gram_hash)
    known = np.bincount(words.gram_word[place > 0], minlength=len(words.word_hash))
    return replace(words, gram_hash=(place[place > 0] - 1).astype(np.min_scalar_type(len(grams))), gram_word=known.astype(np.int32))


def unpacked(grams: np.ndarray, kept: Words) -> Words:
    return replace(kept, gram_hash=grams[kept.gram_hash], gram_word=np.repeat(np.arange(len(kept.word_hash)), kept.gram_word))


def rows_of(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the known ones, from 1 on; 0 is for all others."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[place] == hashes, place + 1, 0)


def first_params(words: np.ndarray, grams: np.ndarray, seed: int = 7) -> Params:
    """Random parameters; ``words`` and ``grams`` are the sorted hashes that get vectors."""
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    size = WORD_SIZE + GRAM_SIZE
    params = {"words": words, "grams": grams}
    params["word"] = normal(len(words) + 1, WORD_SIZE, scale=0.1)
    params["gram"] = normal(len(grams) + 1, GRAM_SIZE, scale=0.1)
    for way in ("f", "b"):
        params[f"x{way}"] = normal(size, 3 * HIDDEN, scale=size**-0.5)
        params[f"u{way}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        params[f"c{way}"] = np.zeros(3 * HIDDEN, np.float32)
    params["a"] = normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5)
    params["v"] = normal(ATTENTION, scale=ATTENTION**-0.5)
    params["o"] = normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5)
    params["bias"] = np.array([-1.0], np.float32)
    return params


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def word_inputs(params: Params, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The input of each distinct word, the row of its word vector and those of its grams."""
    word_row, gram_row = rows_of(params["words"], words.word_hash), rows_of(params["grams"], words.gram_hash)
    sums = np.zeros((len(word_row), GRAM_SIZE), params["gram"].dtype)
    known = np.flatnonzero(gram_row)
    if len(known):
        owner = words.gram_word[known]
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        # the vectors of some words' grams at a time
        for first in range(0, len(begins), SUMMED):
            some = begins[first : first + SUMMED]
            last = begins[first + SUMMED] if first + SUMMED < len(begins) else len(known)
            sums[owner[some]] = np.add.reduceat(params["gram"][gram_row[known[some[0] : last]]], some - some[0], 0)
    vectors = params["word"][word_row] * (word_row > 0)[:, None]
    return np.concatenate([vectors, sums * gram_scale(words)], 1), word_row, gram_row


def gram_scale(words: Words) -> np.ndarray:
    return (np.maximum(words.gram_count, 1) ** -0.5)[:, None].astype(np.float32)


def run_units(
    inputs: np.ndarray, u: np.ndarray, windows: np.ndarray, back: bool, tape: list | None, states: np.ndarray
) -> None:
    """Fill in the states of gated recurrent units after every word: (window place, window, unit)."""
    n, steps = windows.shape
    h = np.zeros((n, HIDDEN), inputs.dtype)
    for t in reversed(range(steps)) if back else range(steps):
        here = windows[:, t] >= 0
        p, a = inputs[windows[:, t]], h @ u
        gates = sigmoid(p[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(p[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        new = np.where(here[:, None], c + z * (h - c), h)
        if tape is not None:
            tape.append((t, here, h, z, r, c, a[:, 2 * HIDDEN :]))
        states[t] = h = new


def logits(
    params: Params, words: Words, windows: np.ndarray, tape: dict | None = None, dropped: np.ndarray | None = None
) -> np.ndarray:
    """The logit of each window. A tape keeps what the gradient needs; ``dropped`` scales the inputs."""
    x, word_row, gram_row = word_inputs(params, words)
    if dropped is not None:
        x = x * dropped
    # both ways side by side
    states = np.empty((windows.shape[1], len(windows), 2 * HIDDEN), np.result_type(x, params["xf"]))
    for i, way in enumerate(("f", "b")):
        steps = None if tape is None else tape.setdefault(way, [])
        inputs = x @ params[f"x{way}"] + params[f"c{way}"]
        run_units(inputs, params[f"u{way}"], windows, way == "b", steps, states[:, :, i * HIDDEN : (i + 1) * HIDDEN])
    key = np.tanh(states @ params["a"])
    weight = np.where(windows.T >= 0, key @ params["v"], -np.inf)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    if tape is not None:
        tape |= {"x": x, "dropped": dropped, "word": word_row, "gram": gram_row, "states": states, "key": key, "weight": weight, "pooled": pooled}
    return pooled @ params["o"] + params["bias"][0]


def gradient(params: Params, words: Words, windows: np.ndarray, tape: dict, d_logit: np.ndarray) -> Params:
    """Derivatives of sum(logit * d_logit) by all parameters."""
    states, key, weight = tape["states"], tape["key"], tape["weight"]
    grads = {"o": tape["pooled"].T @ d_logit, "bias": np.array([d_logit.sum()])}
    d_pooled = d_logit[:, None] * params["o"]
    d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
    d_states = weight[:, :, None] * d_pooled
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    grads["v"] = np.einsum("tna,tn->a", key, d_score)
    d_key = d_score[:, :, None] * params["v"] * (1 - key**2)
    grads["a"] = np.einsum("tnh,tna->ha", states, d_key)
    d_states = d_states + d_key @ params["a"].T
    d_x = np.zeros_like(tape["x"])
    for i, way in enumerate(("f", "b")):
        u = params[f"u{way}"]
        d_u, carry = np.zeros_like(u), 0.0
        d_in = np.zeros((len(d_x), 3 * HIDDEN), u.dtype)
        for t, here, h, z, r, c, a in reversed(tape[way]):
            d = d_states[t, :, i * HIDDEN : (i + 1) * HIDDEN] + carry
            live = d * here[:, None]
            d_c = live * (1 - z) * (1 - c**2)
            d_z = live * (h - c) * z * (1 - z)
            d_r = d_c * a * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_c * r], 1)
            d_u += h.T @ d_a
            carry = d - live + live * z + d_a @ u.T
            np.add.at(d_in, windows[here, t], np.concatenate([d_z, d_r, d_c], 1)[here])
        grads[f"u{way}"], grads[f"c{way}"] = d_u, d_in.sum(0)
        grads[f"x{way}"] = tape["x"].T @ d_in
        d_x += d_in @ params[f"x{way}"].T
    if tape["dropped"] is not None:
        d_x = d_x * tape["dropped"]
    d_gram = (d_x[:, WORD_SIZE:] * gram_scale(words))[words.gram_word]
    for name, rows, values in (("word", tape["word"], d_x[:, :WORD_SIZE]), ("gram", tape["gram"], d_gram)):
        shape, known = params[name].shape, rows > 0
        flat = (rows[known, None] * shape[1] + np.arange(shape[1])).ravel()
        grads[name] = np.bincount(flat, values[known].ravel(), shape[0] * shape[1]).reshape(shape)
    return grads


def learn(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Params | None:
    """The network for labelled texts, None without both labels."""
    y = np.array(labels, np.float32)
    keep = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t)]
    texts, y = [texts[i] for i in keep], y[keep]
    if len(set(y.tolist())) < 2:
        return None
    params = first_params(*vocabulary(texts))
    give_back()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items() if k not in ("words", "grams")}
    rng = np.random.default_rng(11)
    # few texts get more passes, so that there are enough steps
    epochs = max(epochs, min(60, -(-epochs * 250 * BATCH // (8 * len(texts)))))
    cached = {}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts)) if epoch == 0 else rng.permutation(-(-len(texts) // BATCH))
        if epoch == 0:
            groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            order = range(len(groups))
        for g in order:
            group = groups[g]
            if g not in cached:
                cached[g] = packed(params["grams"], read_words([texts[i] for i in group]))
                give_back()
            words = unpacked(params["grams"], cached[g])
            rank = rng.random(len(words.owner)) if epoch == 0 else logits(params, words, words.windows)
            best = np.lexsort((rank, words.owner))
            best = best[np.append(words.owner[best][1:] != words.owner[best][:-1], True)]
            windows = words.windows[best]
            tape: dict = {}
            dropped = np.repeat(rng.random((len(words.word_hash), 2)) > DROPPED, (WORD_SIZE, GRAM_SIZE), 1)
            dropped = (dropped / (1 - DROPPED)).astype(np.float32)
            wrong = (sigmoid(logits(params, words, windows, tape, dropped)) - y[group][words.owner[best]]) / len(best)
            grads = gradient(params, words, windows, tape, wrong.astype(np.float32))
            step += 1
            rate = RATE * min(1.0, 2 * (1 - (epoch + 0.5) / epochs))
            for k, grad in grads.items():
                m, s = moments[k]
                m += 0.1 * (grad - m)
                s += 0.01 * (grad**2 - s)
                params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return params


def score_texts(params: Params | None, texts: list[str]) -> np.ndarray:
    """0 to 1 for each text: its most toxic window."""
    best = np.full(len(texts), -np.inf)
    if params is not None:
        words = read_words(texts)
        if len(words.owner):
            np.maximum.at(best, words.owner, logits(params, words, words.windows).astype(float))
    return np.where(np.isinf(best), 0.0, sigmoid(best))


def labelled_sample(labelled: DataFrame) -> tuple[list[str], list[int]]:
    """A bounded sample of (text, toxic 0 or 1), from columns of these names."""
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    every = rows.where(F.col("toxic").isin(0, 1) & (F.length("text") > 0))
    rows = every.where(F.length("text") <= LEARN_CHARS)
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    shares = [min(1.0, LEARN_ROWS / counts.get(label, 1)) for label in (0, 1)]
    order = F.xxhash64("text")
    draw = F.shiftrightunsigned(order, 11) / float(1 << 53)
    drawn = rows.where(draw < F.when(F.col("toxic") == 0, shares[0]).otherwise(shares[1]))
    picked = sorted(drawn.distinct().select(order, "text", "toxic").collect())
    for label in {0, 1} - counts.keys():
        # its texts are all longer than the bound: the shortest ones stand for it, in the same room altogether
        mine = every.where(F.col("toxic") == label)
        sizes = mine.select(F.length("text").alias("n"), order.alias("o")).distinct().orderBy("n", "o").limit(LEARN_ROWS).collect()
        kept = [r["o"] for r, total in zip(sizes, np.cumsum([r["n"] for r in sizes]), strict=True) if total <= LEARN_ROWS * LEARN_CHARS]
        kept = kept or [r["o"] for r in sizes[:1]]
        picked += sorted(mine.where(order.isin(kept)).distinct().select(order, "text", "toxic").collect()) if kept else []
    if len({toxic for _, _, toxic in picked}) < 2:
        return [], []
    return [text for _, text, _ in picked], [toxic for _, _, toxic in picked]


def fit(labelled: DataFrame) -> Params | None:
    """The network for the bounded sample of labelled rows, learned inside one task."""
    texts, labels = labelled_sample(labelled)
    if not texts:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("classes")
        for batch in batches:
            for texts, labels in zip(batch["texts"].to_pylist(), batch["labels"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(texts, labels))])], ["params"])

    sample = labelled.sparkSession.createDataFrame([(texts, labels)], "texts array<string>, labels array<int>")
    return pickle.loads(sample.coalesce(1).mapInArrow(tidied(run), "params binary").first()["params"])


def score_toxicity(documents: DataFrame, params: Params | None) -> DataFrame:
    """All columns, and score and predicted in place of columns of these names."""
    documents = documents.drop("score", "predicted")
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("classes", "powers")
        for batch in batches:
            for part, texts in text_parts(batch.column(at)):
                scores = pa.array(score_texts(params, texts), pa.float64())
                piece = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*piece.columns, scores], [*piece.schema.names, "score"])

    scored = documents.mapInArrow(tidied(run), StructType([*documents.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def with_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the rows that may be learned from."""
    rows = documents.where(~held_out()).select("doc_id", "text")
    return rows.join(labels.where(~held_out()).select("doc_id", "toxic"), "doc_id")


@register()
def op8_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from labelled ones that are not held out."""
    documents = table(spark, sf_dir, "documents")
    params = fit(with_labels(documents, table(spark, sf_dir, "labels")))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return score_toxicity(rows, params).drop("text")
