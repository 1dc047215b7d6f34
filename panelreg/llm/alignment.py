"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and the links that this gives.

Both tokenizers encode a blank and the text. The token ends of both, as byte offsets, go into dictionaries
from the end to the token's index; the keys that both hold, sorted, cut the two id lists into groups, and
within a group every token of one is linked with every token of the other.

Texts are cut into chunks before each blank that follows a letter, digit, sign or mark. There the first
tokenizer's pattern begins a new word, and no piece of the second goes on (its vocabulary is checked for that), so
chunks are encoded and aligned one by one with the same result. A worker keeps the chunks it met lately, and
encodes new ones many at a time. A chunk whose tokens don't give its bytes back makes its text one without tokens.

The corpus-wide number of documents that hold an id pair linked is summed up per task first. The pairs that
are most frequent, up to ``SENT_PAIRS``, are sent to the tasks that sum up each document's links; the links of
a document whose pairs aren't among them are summed up by a join on the pair.

Defined results: texts that are null or empty, and those whose tokens don't give the blank and the text back, have
no tokens; repeated rows and rows without doc_id are documents each; an empty table gives no rows. The
added columns (a_ids, b_ids, a_sizes, b_sizes: ids, and tokens per group) replace columns of their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from panelreg.llm.batches import parts, ragged, worker_store
from panelreg.llm.near_dedup import written
from panelreg.llm.registry import register, table

#: A worker forgets its chunks beyond so many of them, or so many characters.
KEPT_CHUNKS, KEPT_CHARS = 400_000, 8_000_000
#: Text that is cut and gathered at once.
PART_BYTES = 300_000
#: New chunks that are encoded together.
JOINED_CHARS = 50_000
#: Id pairs that are sent to the tasks: the most frequent ones.
SENT_PAIRS = 1_000_000
#: Pairs a task adds up before it hands them on.
HELD_PAIRS = 1_000_000
#: Tokens of both tokenizers worked off at once, and links of a group beyond which its equal ids are merged.
PART_TOKENS, GROUP_LINKS = 200_000, 4_096
#: A pair is one number: the first id times this, and the second.
PAIR = 1 << 20

#: Rows that a task gets at a time: lists of ids are long.
BATCH_ROWS = 256

ADDED = ("a_ids", "b_ids", "a_sizes", "b_sizes")
PACKED = {"a_ids": "<u2", "b_ids": "<u2", "a_sizes": "<u4", "b_sizes": "<u4"}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it can be seen, else 256 and on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(unseen)}


class Aligner:
    """The two tokenizers, the bytes of their tokens, and the chunks met lately.

    A chunk is a number; its ids and group sizes are a range of four flat arrays."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        level = byte_level()
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(map(level.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on behind a blank: texts can't be cut into chunks")
        self.widths = [np.array(list(map(len, known)), np.int64) for known in (self.bytes_a, self.bytes_b)]
        self.blank = self.b.piece_to_id("▁")
        self.ends_chunk: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        #: numbers of the chunks that may be followed by another, and of all others
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        self.chars = 0
        #: ids by both tokenizers and group sizes of both, where a chunk's begin in them, and whether it came back
        self.values = [np.zeros(0, np.int32) for _ in ADDED]
        self.begins = [np.zeros(1, np.int64) for _ in ADDED]
        self.sound = np.zeros(0, bool)

    def cuttable(self, word: str) -> bool:
        """A blank behind the word begins a new chunk."""
        if not word:
            return False
        char = word[-1]
        if char not in self.ends_chunk:
            self.ends_chunk[char] = unicodedata.category(char)[0] in "LNPSM"
        return self.ends_chunk[char]

    def cut(self, text: str) -> list[str]:
        """The chunks of the text, without the blank that each begins with."""
        made: list[str] = []
        whole = True
        for word in text.split(" "):
            if whole:
                made.append(word)
            else:
                made[-1] += " " + word
            whole = self.cuttable(made[-1])
        return made

    def learn(self, chunks: list[str]) -> None:
        """Encode and align new chunks, those that others may follow many at a time."""
        if not chunks:
            return
        joined: list[list[str]] = [[]]
        size = 0
        for chunk in chunks:
            self.chars += len(chunk)
            if self.cuttable(chunk):
                if size > JOINED_CHARS:
                    joined.append([])
                    size = 0
                joined[-1].append(chunk)
                size += len(chunk) + 1
        found = [part for group in joined if group for part in self._aligned(group)]
        found += [part for chunk in chunks if not self.cuttable(chunk) for part in self._aligned([chunk])]
        for names, _, _, _ in found:
            for name in names:
                home = self.inner if self.cuttable(name) else self.last
                home[name] = len(self.inner) + len(self.last)
        for i in range(len(ADDED)):
            self.values[i] = np.concatenate([self.values[i], *(p[1][i] for p in found)])
            sizes = np.concatenate([p[2][i] for p in found])
            self.begins[i] = np.concatenate([self.begins[i], self.begins[i][-1] + np.cumsum(sizes)])
        self.sound = np.concatenate([self.sound, *(np.full(len(p[0]), p[3]) for p in found)])

    def _aligned(self, chunks: list[str]) -> list[tuple]:
        """Chunks, their ids and group sizes one after another, how many of them each chunk has, whether they came back."""
        text = " ".join(chunks)
        ids = [
            self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids,
            self.b.encode(text) if text else [self.blank],
        ]
        source = (" " + text).encode("utf-8", "surrogatepass")
        if any(b"".join(map(known.__getitem__, i)) != source for i, known in zip(ids, (self.bytes_a, self.bytes_b), strict=True)):
            # the chunk that doesn't come back is found by halving
            if len(chunks) > 1:
                half = len(chunks) // 2
                return self._aligned(chunks[:half]) + self._aligned(chunks[half:])
            return [(chunks, [np.zeros(0, np.int32)] * len(ADDED), [np.zeros(1, np.int64)] * len(ADDED), False)]
        ids = [np.array(i, np.int32) for i in ids]
        ends_a, ends_b = (
            dict(zip(np.cumsum(width[i]).tolist(), range(1, len(i) + 1), strict=True)) for i, width in zip(ids, self.widths, strict=True)
        )
        common = sorted(ends_a.keys() & ends_b.keys())
        cuts = [np.array([0, *map(ends.__getitem__, common)], np.int64) for ends in (ends_a, ends_b)]
        sizes = chunks if text.isascii() else [c.encode("utf-8", "surrogatepass") for c in chunks]
        last = np.searchsorted(common, np.cumsum(list(map(len, sizes))) + np.arange(1, len(chunks) + 1)) + 1
        counts = [np.diff(c[last], prepend=0) for c in cuts]
        groups = np.diff(last, prepend=0)
        return [(chunks, [*ids, *(np.diff(c).astype(np.int32) for c in cuts)], [*counts, groups, groups], True)]

    def align(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Values of ids by both tokenizers and of how many of each a group has, and where each text's begin; the last is the end."""
        if len(self.inner) + len(self.last) > KEPT_CHUNKS or self.chars > KEPT_CHARS:
            self.forget()
        cut, new = [], {}
        for text in texts:
            chunks = text.split(" ") if text else []
            missing = [c for c in chunks if c not in self.inner]
            if not all(map(self.cuttable, missing)):
                chunks = self.cut(text)
                missing = [c for c in chunks if c not in self.inner and c not in self.last]
            cut.append(chunks)
            new |= dict.fromkeys(missing)
        self.learn(list(new))
        numbers: list[int] = []
        for chunks in cut:
            found = list(map(self.inner.get, chunks))
            if found and found[-1] is None:
                found[-1] = self.last[chunks[-1]]
            numbers += found
        number = np.array(numbers, np.int64)
        owner = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        bad = np.bincount(owner[~self.sound[number]], minlength=len(texts)) > 0
        number, owner = number[~bad[owner]], owner[~bad[owner]]
        made = []
        for values, begins in zip(self.values, self.begins, strict=True):
            sizes = begins[number + 1] - begins[number]
            cuts = np.append(0, np.cumsum(np.bincount(owner, sizes, len(texts)).astype(np.int64)))
            made.append((values[ragged(begins[number], sizes)], cuts))
        return made


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile hands at most BATCH_ROWS rows to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def aligner(path_a: str, path_b: str) -> Aligner:
    store = worker_store("aligners")
    if (path_a, path_b) not in store:
        store[path_a, path_b] = Aligner(path_a, path_b)
    return store[path_a, path_b]


def listed(values: np.ndarray, cuts: np.ndarray, kind: str | None) -> pa.Array:
    """Lists of numbers, or their bytes where a kind is given."""
    if kind is None:
        return pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(values))
    data = values.astype(kind)
    offsets = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def align_documents(documents: DataFrame, path_a: str, path_b: str, packed: bool = False) -> DataFrame:
    """All columns, a_ids and b_ids, and a_sizes and b_sizes: how many of them each group has.

    They are arrays of integers; ``packed`` ones are the bytes of little-endian numbers, of 16 bits for ids and
    32 for sizes, which Spark stores and hands on many times faster."""
    documents = documents.drop(*ADDED)
    kinds = PACKED if packed else dict.fromkeys(ADDED)
    if packed and max(map(len, aligner(path_a, path_b).widths)) > 1 << 16:
        raise ValueError("ids of a vocabulary beyond 65536 can't be packed")
    schema = StructType([*documents.schema.fields, *(StructField(c, BinaryType() if packed else ArrayType(IntegerType())) for c in ADDED)])
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = aligner(path_a, path_b)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for part in parts(sizes, PART_BYTES):
                piece = batch.slice(part.start, part.stop - part.start)
                found = rules.align([t or "" for t in piece.column(at).to_pylist()])
                added = [listed(values, cuts, kind) for (values, cuts), kind in zip(found, kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *added], [*piece.schema.names, *ADDED])
        # other stages of this worker need the memory
        rules.forget()

    return documents.mapInArrow(run, schema)


def offsets_of(column: pa.Array) -> np.ndarray:
    """Where each list of a column begins in its numbers; the last entry is the end."""
    if not pa.types.is_binary(column.type):
        return column.offsets.to_numpy().astype(np.int64)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def flat(piece: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each list begins; the last entry is the end."""
    column = piece[name]
    offsets = offsets_of(column)
    if pa.types.is_binary(column.type):
        kind = np.dtype(PACKED[name])
        data = column.buffers()[2] or b""
        values = np.frombuffer(memoryview(data)[offsets[0] : offsets[-1]], kind)
        return values.astype(np.int64), (offsets - offsets[0]) // kind.itemsize
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(np.int64), offsets - offsets[0]


def merged_repeats(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Ids and their weights by both tokenizers, equal ids of large groups being one; the sizes are changed in place."""
    made = []
    large = np.flatnonzero(sizes_a * sizes_b > GROUP_LINKS).tolist()
    if not large:
        return [(a, None), (b, None)]
    for ids, sizes in ((a, sizes_a), (b, sizes_b)):
        ends = np.cumsum(sizes)
        kept, weights, last = [], [], 0
        for group in large:
            begin, end = ends[group] - sizes[group], ends[group]
            found, times = np.unique(ids[begin:end], return_counts=True)
            kept += [ids[last:begin], found]
            weights += [np.ones(begin - last, np.int64), times]
            last, sizes[group] = end, len(found)
        made.append((np.concatenate([*kept, ids[last:]]), np.concatenate([*weights, np.ones(len(ids) - last, np.int64)])))
    return made


def flat_cuts(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Where each list of a column begins."""
    cuts = offsets_of(batch[name])
    return cuts // np.dtype(PACKED[name]).itemsize if pa.types.is_binary(batch.schema.field(name).type) else cuts


def token_parts(batch: pa.RecordBatch) -> Iterator[slice]:
    """Neighbouring rows with at most PART_TOKENS tokens, or a single row."""
    n_a, n_b = (np.diff(flat_cuts(batch, c)) for c in ("a_ids", "b_ids"))
    return parts((n_a + n_b).tolist(), PART_TOKENS)


def links_of(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, pair and number of links of the distinct id pairs of each row, sorted by row and pair."""
    (a, _), (b, _) = flat(piece, "a_ids"), flat(piece, "b_ids")
    (sizes_a, cuts), (sizes_b, _) = flat(piece, "a_sizes"), flat(piece, "b_sizes")
    row = np.repeat(np.arange(len(piece)), np.diff(cuts))
    (a, times_a), (b, times_b) = merged_repeats(a, b, sizes_a, sizes_b)
    # each first id of a group with all second ids of the group
    times = np.repeat(sizes_b, sizes_a)
    place = ragged(np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a), times)
    pair = np.repeat(a, times) * PAIR + b[place]
    weight = None if times_a is None else np.repeat(times_a, times) * times_b[place]
    return distinct_pairs(np.repeat(row, sizes_a * sizes_b), pair, weight)


def distinct_pairs(row: np.ndarray, pair: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, pair and sum of weights (ones, if None), sorted by row and pair."""
    # a pair has twice the bits of PAIR, which leaves enough for the rows of a batch
    bits = 2 * (PAIR.bit_length() - 1)
    key = (row << bits) + pair
    if weight is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if weight is None:
        sums = np.diff(np.append(begins, len(key)))
    else:
        sums = np.add.reduceat(weight, begins)
    return key[begins] >> bits, key[begins] & (1 << bits) - 1, sums


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether it is its first id's highest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def handed(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        def added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            found, place = np.unique(np.concatenate(pairs), return_inverse=True)
            return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)

        waiting, size = [held], 0
        for batch in batches:
            for part in token_parts(batch):
                found, counts = np.unique(links_of(batch.slice(part.start, part.stop - part.start))[1], return_counts=True)
                waiting.append((found, counts))
                size += len(found)
                if size > HELD_PAIRS:
                    waiting = [added(*zip(*waiting, strict=True))]
                    size = len(waiting[0][0])
                    if size > HELD_PAIRS // 2:
                        yield handed(*waiting[0])
                        waiting, size = [held], 0
        yield handed(*added(*zip(*waiting, strict=True)))

    partial = aligned.select(*ADDED).mapInArrow(run, "pair long, n long")
    with small_batches(aligned.sparkSession):
        counts = written(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", PAIR.bit_length() - 1)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("highest"))
    return written(counts.join(highest, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")


def frequent_pairs(pairs: DataFrame, limit: int) -> tuple[pa.Table, int]:
    """The pairs of at least some number of documents, at most ``limit`` of them; and how many there are of all."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r[0]: r[1] for r in pairs.groupBy(power.alias("power")).agg(F.count(F.lit(1))).collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= limit:
        least -= 1
        total += sizes.get(least, 0)
    return pairs.where(F.col("n") >= 1 << least).toArrow().sort_by("pair"), sum(sizes.values())


def digest_links(aligned: DataFrame, limit: int = SENT_PAIRS) -> DataFrame:
    """Rows of aligned documents as n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; other columns kept."""
    spark = aligned.sparkSession
    kept = [c for c in aligned.columns if c not in ADDED]
    pairs = pair_counts(aligned)
    sent, total = frequent_pairs(pairs, limit)
    known = spark.sparkContext.broadcast(
        (sent["pair"].to_numpy(), sent["n"].to_numpy(), sent["best"].to_numpy(zero_copy_only=False))
    )
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    digest_kind = StructType([StructField(c, LongType()) for c in sums])
    digest_kind = digest_kind.add("groups_sha256", "string").add("rare", ArrayType(LongType())).add("links", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, best = known.value
        texts = endings()
        for batch in batches:
            for part in token_parts(batch):
                n = part.stop - part.start
                piece = batch.slice(part.start, n)
                owner, pair, links = links_of(piece)
                place = np.minimum(np.searchsorted(names, pair), max(len(names) - 1, 0))
                there = names[place] == pair if len(names) else np.zeros(len(pair), bool)
                mine, at, times = owner[there], place[there], links[there]
                n_links, n_best, count_sum = (np.zeros(n, np.int64) for _ in range(3))
                np.add.at(n_links, owner, links)
                np.add.at(n_best, mine, times * best[at])
                np.add.at(count_sum, mine, times * counts[at])
                left = np.append(0, np.cumsum(np.bincount(owner[~there], minlength=n))).astype(np.int32)
                sizes = [np.diff(flat_cuts(piece, c)) for c in ("a_ids", "b_ids", "a_sizes")]
                digest = pa.StructArray.from_arrays(
                    [
                        *(pa.array(x.astype(np.int64)) for x in (*sizes, n_links, n_best, count_sum)),
                        pa.array(group_digests(piece, texts)),
                        pa.ListArray.from_arrays(left, pa.array(pair[~there])),
                        pa.ListArray.from_arrays(left, pa.array(links[~there].astype(np.int64))),
                    ],
                    [*sums, "groups_sha256", "rare", "links"],
                )
                yield pa.RecordBatch.from_arrays([piece["kept"], digest], ["kept", "digest"])

    rows = aligned.select(F.struct(*kept).alias("kept"), *ADDED)
    schema = StructType([rows.schema["kept"], StructField("digest", digest_kind)])
    rows = rows.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())
    with small_batches(spark):
        rows = written(rows, "digests")
    if len(sent) == total:
        return rows.select("kept.*", *(f"digest.{c}" for c in (*sums, "groups_sha256")))
    rare = rows.select("_row", F.explode(F.arrays_zip("digest.rare", "digest.links")).alias("x")).select("_row", "x.*")
    rare = rare.join(pairs.withColumnRenamed("pair", "rare"), "rare")
    more = rare.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
        F.sum(F.col("links") * F.col("n")).alias("more_sum"),
    )
    both = rows.join(more, "_row", "left")
    summed = {"n_best": "more_best", "count_sum": "more_sum"}
    return both.select(
        "kept.*",
        *(
            (F.col(f"digest.{c}") + F.coalesce(summed[c], F.lit(0))).alias(c) if c in summed else F.col(f"digest.{c}")
            for c in (*sums, "groups_sha256")
        ),
    )


def endings() -> dict[str, list[bytes]]:
    """Decimal numbers with what may follow them, made once for a worker."""
    store = worker_store("decimals_with_ends")
    if not store:
        store |= {end: [] for end in ",|;"}
    return store


def group_digests(piece: pa.RecordBatch, texts: dict[str, list[bytes]]) -> list[str]:
    """The digest of each row's groups."""
    (a, cuts_a), (b, cuts_b) = flat(piece, "a_ids"), flat(piece, "b_ids")
    (sizes_a, cuts), (sizes_b, _) = flat(piece, "a_sizes"), flat(piece, "b_sizes")
    top = int(max(a.max(initial=0), b.max(initial=0))) + 1
    for end, known in texts.items():
        known.extend(b"%d%s" % (i, end.encode()) for i in range(len(known), top))
    top = len(texts[","])
    table = [*texts[","], *texts["|"], *texts[";"]]
    # token after token in the order of the groups, each with what follows it
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    code = np.zeros(len(a) + len(b), np.int64)
    a, b = a.copy(), b.copy()
    a[ends_a - 1] += top
    b[ends_b - 1] += 2 * top
    code[ragged(ends_a - sizes_a + ends_b - sizes_b, sizes_a)] = a
    code[ragged(ends_a + ends_b - sizes_b, sizes_b)] = b
    code = code.tolist()
    found, begin = [], 0
    for end in (cuts_a + cuts_b)[1:].tolist():
        joined = b"".join(map(table.__getitem__, code[begin:end]))[:-1]
        found.append(hashlib.sha256(joined).hexdigest() if joined else "")
        begin = end
    return found


@register()
def op13_end_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned, with the corpus-wide counts of their links."""
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    with small_batches(spark):
        aligned = written(align_documents(documents, *paths, packed=True).drop("text"), "aligned")
    return digest_links(aligned)
