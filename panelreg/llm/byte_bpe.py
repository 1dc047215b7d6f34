"""Byte-level BPE by a rank table: distinct words are merged once, texts gather their words' ids.

A text is cut into words by the tokenizer's pattern. The distinct words of a batch become rows of a
byte matrix, and ranked merges are folded over all rows at once: each step replaces, in every row that
still has one, the leftmost pair of lowest rank and looks up the two new pairs, until no row changes.
Words longer than ``ROW_BYTES`` are merged one by one with a heap in n log n steps. Decoding joins the
byte pieces of the ids.

Nothing is shuffled, and a task holds one batch of texts and a bounded cache of words; a lost task is
simply done again. The README says why the fold isn't made of Spark's higher-order functions.

Defined results: a null text is an empty one, without ids; lone surrogates can't occur in Spark's text;
repeated rows are repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from panelreg.llm.batches import (
    LETTER,
    SPACE,
    Recent,
    char_classes,
    codepoints,
    distinct_runs,
    forget_others,
    parts,
    ragged,
    tidied,
    worker_store,
)
from panelreg.llm.registry import register, table

ROW_BYTES = 48
CACHE_WORDS = 120_000
#: Characters that a task works on at a time, one text at least.
TASK_CHARS = 250_000
NO_RANK = np.iinfo(np.int32).max

#: The endings that the pattern cuts off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def word_cuts(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the words of all texts begin, by the pattern of ``public_tokenizers.PATTERN``."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cps]
    fresh = np.ones(n, bool)
    fresh[1:] = kind[1:] != kind[:-1]
    begins = ends[:-1][ends[:-1] < n]
    fresh[begins] = True
    text_end = np.zeros(n + 1, bool)
    text_end[ends] = True
    # the last blank before a word is cut from the blanks before it; a plain space joins the word
    runs = np.flatnonzero(fresh & (kind == SPACE))
    stops = np.append(np.flatnonzero(fresh), n)
    stops = stops[np.searchsorted(stops, runs, "right")]
    inner = stops[~text_end[stops]]
    fresh[inner - 1] = True
    fresh[inner[cps[inner - 1] == 0x20]] = False
    # an apostrophe that stands alone takes one of the endings with it
    quotes = np.flatnonzero(fresh & (cps == 0x27) & ~text_end[1:])
    quotes = quotes[kind[quotes + 1] == LETTER]
    padded = np.append(cps, [0, 0])
    for ending in sorted(ENDINGS, key=len):
        hit = np.ones(len(quotes), bool)
        for i, char in enumerate(ending):
            hit &= padded[quotes + 1 + i] == ord(char)
            if i:
                hit &= ~text_end[quotes + 1 + i]
        behind = quotes[hit] + 1 + len(ending)
        fresh[quotes[hit] + 1] = False
        more = behind[(behind < n) & ~text_end[behind]]
        fresh[more[kind[more] == LETTER]] = True
        quotes = quotes[~hit]
    return np.flatnonzero(fresh)


class Merger:
    """The rank file and the table of pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.pieces = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.base = max(self.pieces) + 1
        pairs = {
            self.ranks[piece[:i]] * self.base + self.ranks[piece[i:]]: rank
            for piece, rank in self.ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in self.ranks and piece[i:] in self.ranks
        }
        # open addressing in numpy: each key lies in the first free place from its home on
        self.bits = max(8, (len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        todo = np.array(list(pairs), np.int64)
        ranks = np.array(list(pairs.values()), np.int32)
        place = self.home(todo)
        while len(todo):
            free = self.keys[place] == -1
            self.keys[place[free]] = todo[free]
            won = self.keys[place] == todo
            self.values[place[won]] = ranks[won]
            todo, ranks, place = todo[~won], ranks[~won], (place[~won] + 1) & (len(self.keys) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, NO_RANK if none."""
        keys = left * self.base + right
        place = self.home(keys)
        found = np.full(len(keys), NO_RANK, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[place]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[place[hit]]
            on = ~hit & (there != -1)
            open_, place = open_[on], (place[on] + 1) & (len(self.keys) - 1)
        return found

    def merge_rows(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of the same length of at least two bytes."""
        rows = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        ids = self.bytes[rows]
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        size = np.full(len(words), ids.shape[1])
        live, made = np.arange(len(words)), [None] * len(words)
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            best = ranks[row, at]
            done = best == NO_RANK
            for i in np.flatnonzero(done).tolist():
                made[live[i]] = ids[i, : size[i]]
            keep = ~done
            live, ids, ranks, size, at, best = live[keep], ids[keep], ranks[keep], size[keep] - 1, at[keep], best[keep]
            if not len(live) or ids.shape[1] == 2:
                for word, rank in zip(live.tolist(), best.tolist(), strict=True):
                    made[word] = np.array([rank])
                break
            row = np.arange(len(live))
            ids[row, at] = best
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            # the pair that merged goes; its neighbours to the left and right are looked up again
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at + 1 < size)
            ranks[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])
            beyond = column >= (size - 1)[:, None]
            ranks[beyond] = NO_RANK
        return made

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word by a heap of pairs over a linked list."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(self.pieces[ids[x]] + self.pieces[ids[y]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        made: list[np.ndarray | None] = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                made[i] = np.array([rank])
            elif len(word) > ROW_BYTES:
                made[i] = self.merge_long(word)
            else:
                by_length.setdefault(len(word), []).append(i)
        for places in by_length.values():
            for i, ids in zip(places, self.merge_rows([words[i] for i in places]), strict=True):
                made[i] = ids
        return made

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def merger(path: str) -> Merger:
    store = worker_store("mergers")
    if path not in store:
        store[path] = Merger(path)
    return store[path]


def packed_ids(texts: list[str], rules: Merger, known: Recent) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one text after the other, and where each text's begin; the last entry is the end.

    ``known`` carries the words of earlier texts, their ids in four bytes each."""
    cps, ends = codepoints(texts)
    starts = word_cuts(cps, ends)
    stops = np.append(starts[1:], len(cps))
    first, place = distinct_runs(cps, starts, stops)
    text = "".join(texts)
    names = [text[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
    new = known.missing(names)
    if new:
        words = [names[i].encode("utf-8", "surrogatepass") for i in new]
        for i, ids in zip(new, rules.encode_words(words), strict=True):
            known.new[names[i]] = ids.astype("<i4").tobytes()
    words = list(map(known.new.__getitem__, names))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
    flat = np.frombuffer(b"".join(words), "<i4")
    before, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
    counts = np.append(0, np.cumsum(sizes))
    return flat[ragged(before, sizes)], counts[np.searchsorted(starts, ends)]


def encode_texts(texts: list[str], rules: Merger, known: Recent) -> list[list[int]]:
    """Ids of each text; ``known`` carries the words of earlier texts."""
    ids, cuts = packed_ids(texts, rules, known)
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """All columns and ``token_ids``, an array of integers, in place of a column of that name."""
    documents = documents.drop("token_ids")
    schema = StructType([*documents.schema.fields, StructField("token_ids", ArrayType(IntegerType()))])
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("mergers", "words", "classes", "decimals")
        rules = merger(path)
        known = worker_store("words").setdefault(path, Recent(CACHE_WORDS))
        for batch in batches:
            lengths = pc.utf8_length(batch.column(at)).fill_null(0).to_pylist()
            for part in parts(lengths, TASK_CHARS):
                piece = batch.slice(part.start, part.stop - part.start)
                flat, cuts = packed_ids([t or "" for t in piece.column(at).to_pylist()], rules, known)
                ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*piece.columns, ids], [*piece.schema.names, "token_ids"])

    return documents.mapInArrow(tidied(run), schema)


def digest_tokens(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = merger(path)
        store = worker_store("decimals")
        names = store.setdefault(path, {i: b"%d" % i for i in rules.pieces})
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for ids in batch["token_ids"]:
                ids = ids.values.to_numpy(zero_copy_only=False).tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
                decoded_sha.append(hashlib.sha256(rules.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = tokens.select("doc_id", "token_ids")
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@register()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again from the ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digest_tokens(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
