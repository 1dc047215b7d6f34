"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds every substring of some labelled text. A text is parsed, left to
right, into the longest phrases that occur in the labelled text: the automaton is followed while it has
the next character, then a phrase ends and the next one starts at the root. The number of phrases times
the bits of a place in the labelled text, per character, estimates the cross entropy; the language with
the least wins. The score is the runner-up's entropy over the sum of both, from 0.5 (undecided) to 1.

Before, text is mapped to lower-case letters; everything between letters becomes one blank. Missing
transitions are filled with those of the root and a phrase mark, so that all automata run in lockstep
over many segments of ``SEGMENT`` characters as one table look-up per step; letters beyond the
``LETTERS_KEPT`` commonest of the sample are looked up in a sorted list of moves. A phrase also ends at the end
of a segment; that costs every language the same half phrase.

Learning takes whole texts in the order of a hash of the text, ``LEARN_CHARS`` characters over all
languages; this bound keeps the tables small enough for every worker. All else covers whole texts, with
one batch in memory and no shuffle.

Defined results: ``und`` with score 0 for a null text or one without letters; ties go to the language that
sorts first; labelled rows without text or language are left out; without any labelled text all is
``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from panelreg.llm.batches import LETTER, char_classes, codepoints, forget_others, ragged, text_parts, tidied, worker_store
from panelreg.llm.registry import register, table

LEARN_CHARS = 160_000
#: So many labelled texts per language are drawn, of which those that fit the bound are used.
LEARN_TEXTS = 120
#: The commonest letters have columns in the table; moves by the others are looked up by key.
LETTERS_KEPT = 60
SEGMENT = 512
#: Characters that are parsed at once, one text at least.
TASK_CHARS = 250_000
UNKNOWN = "und"
BLANK, RARE = 0, 1


def labelled_texts(labelled: DataFrame, chars: int = LEARN_CHARS) -> dict[str, list[str]]:
    """A bounded sample of whole texts per language, from the columns text and lang."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    room = max(2_000, chars // len(counts))
    share = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, LEARN_TEXTS / n))))
    order = F.xxhash64("text")
    drawn = rows.where(
        (F.length("text") <= room) & (F.shiftrightunsigned(order, 11) / float(1 << 53) < share[F.col("lang")])
    )
    found: dict[str, list[str]] = {}
    left = dict.fromkeys(counts, room)
    picked = drawn.distinct().select("lang", "text", order.alias("o")).collect()
    for row in sorted(picked, key=lambda r: (r["lang"], r["o"], r["text"])):
        if len(row["text"]) <= left[row["lang"]]:
            left[row["lang"]] -= len(row["text"])
            found.setdefault(row["lang"], []).append(row["text"])
    if rare := [lang for lang in counts if lang not in found]:
        shortest = rows.where(F.col("lang").isin(rare)).groupBy("lang").agg(F.min_by("text", F.length("text")).alias("t"))
        found |= {r["lang"]: [r["t"]] for r in shortest.collect()}
    return found


def letters_only(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-case letters, runs of anything else being one blank; ends of the texts."""
    cps, ends = codepoints([t.lower() for t in texts])
    letter = char_classes()[cps] == LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~letter[1:]
    first = ends[:-1][ends[:-1] < len(cps)]
    keep[first] = letter[first]
    counts = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=counts[1:])
    return np.where(letter, cps, 0x20)[keep], counts[ends]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state by state; 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                link[target] = link[new] = copy
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
        last = new
    return moves


class Parser:
    """The automata of all languages as one table: (target state * width * 2 + phrase begins)."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        streams = {lang: letters_only(["\n".join(texts[lang])])[0] for lang in self.languages}
        seen = Counter(c for s in streams.values() for c in s.tolist() if c != 0x20)
        self.symbol_of = np.full(0x110000, RARE, np.int32)
        self.symbol_of[0x20] = BLANK
        for i, (char, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
            self.symbol_of[char] = i + 2
        self.width = min(len(seen), LETTERS_KEPT) + 2
        self.symbols = len(seen) + 2
        # an automaton has fewer than two states a symbol, beside its root; rows that aren't used take no memory
        states = np.empty((sum(2 * len(s) + 1 for s in streams.values()), self.width), np.int32)
        self.roots, self.bits, base = [], [], 0
        sparse: dict[int, int] = {}
        for lang in self.languages:
            symbols = self.symbol_of[streams[lang]].tolist()
            moves = suffix_automaton(symbols)
            table_ = states[base : base + len(moves)]
            table_[:] = -1
            for state, row in enumerate(moves):
                near = {c: to for c, to in row.items() if c < self.width}
                table_[state, list(near)] = list(near.values())
                for c in row.keys() - near.keys():
                    sparse[(state + base) * self.symbols + c] = (row[c] + base) * self.width * 2 + (state == 0)
            root = np.maximum(table_[0], 0)
            missing = table_ < 0
            np.copyto(table_, root, where=missing)
            missing[0] = True
            table_ += base
            table_ *= self.width * 2
            table_ += missing
            self.roots.append(base * self.width)
            self.bits.append(np.log2(max(2, len(symbols))))
            base += len(moves)
        self.table = states[:base].reshape(-1)

        self.sparse_keys = np.array(sorted(sparse), np.int64)
        self.sparse_moves = np.array([sparse[k] for k in self.sparse_keys.tolist()], np.int32)

    def sparse_step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """What the table would say for letters beyond it."""

        def look(states: np.ndarray) -> np.ndarray:
            keys = states.astype(np.int64) // self.width * self.symbols + symbols
            if not len(self.sparse_keys):
                return np.full(keys.shape, -1)
            at = np.minimum(np.searchsorted(self.sparse_keys, keys), len(self.sparse_keys) - 1)
            return np.where(self.sparse_keys[at] == keys, self.sparse_moves[at], -1)

        roots = np.array(self.roots, np.int64)[:, None]
        begun = look(np.broadcast_to(roots, states.shape))
        begun = np.where(begun < 0, roots * 2 + 1, begun)
        found = look(states)
        return np.where(found < 0, begun, found)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per language and text, and the characters that were parsed per text."""
        cps, ends = letters_only(texts)
        symbols = self.symbol_of[cps]
        sizes = np.diff(ends)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        place = ragged(np.zeros(len(texts), np.int64), pieces) * SEGMENT
        starts = ends[:-1][owner] + place
        lengths = np.minimum(SEGMENT, sizes[owner] - place)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        states = np.repeat(np.array(self.roots, np.int32)[:, None], len(starts), 1)
        counts = np.zeros((len(self.languages), len(starts)), np.int32)
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        for step, n in enumerate(live.tolist()):
            symbol = symbols[starts[:n] + step]
            found = self.table[states[:, :n] + np.where(symbol < self.width, symbol, RARE)]
            if len(far := np.flatnonzero(symbol >= self.width)):
                found[:, far] = self.sparse_step(states[:, far], symbol[far])
            counts[:, :n] += found & 1
            states[:, :n] = found >> 1
        totals = np.zeros((len(self.languages), len(texts)))
        for row, count in zip(totals, counts, strict=True):
            np.add.at(row, owner[order], count)
        return totals, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        """Language, score and parsed characters of each text."""
        totals, sizes = self.phrases(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), sizes.tolist()
        entropy = totals * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        best = entropy.argmin(0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
        ranked = np.sort(entropy, 0)
        second = ranked[1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(ranked[0] + second, 1e-300))
        return names, np.where(sizes > 0, score, 0.0).tolist(), sizes.tolist()


def parser(texts: dict[str, list[str]]) -> Parser:
    name = hashlib.md5(repr(sorted(texts.items())).encode()).hexdigest()
    store = worker_store("parsers")
    if name not in store:
        store.clear()
        store[name] = Parser(texts)
    return store[name]


def predict_language(documents: DataFrame, texts: dict[str, list[str]]) -> DataFrame:
    """All columns, and lang_pred, score and parsed (characters; 0 without a letter) in place of columns of these names."""
    documents = documents.drop("lang_pred", "score", "parsed")
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("parsed", LongType())]
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("classes", "parsers")
        rules = parser(texts)
        for batch in batches:
            for part, rows in text_parts(batch.column(at), TASK_CHARS):
                names, scores, parsed = rules.predict(rows)
                piece = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(parsed, pa.int64())],
                    [*piece.schema.names, "lang_pred", "score", "parsed"],
                )

    return documents.mapInArrow(tidied(run), StructType([*documents.schema.fields, *added]))


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


@register()
def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    documents = table(spark, sf_dir, "documents")
    texts = labelled_texts(documents.where(~held_out()))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return predict_language(rows, texts).drop("text", "parsed")
