"""Token ids as length-delimited binary records, with a separate offset index.

Encoding. A text is cut at white space and between letters, digits and other characters, where the
tokenizer always begins a new word; the distinct pieces go through the tokenizers library once per
worker (a bounded cache), and the ids are gathered back in text order. Characters whose treatment
depends on their neighbours (apostrophes, everything beyond Latin letters) keep their piece whole,
and a text that holds one of the tokenizer's added tokens is encoded as it is.

Files. Rows are dealt by ranges of doc_id, one file per range, ordered inside. A record is

    length of the payload, 8 bytes | masked checksum of these 8 bytes | payload | masked checksum | newline

little-endian, the checksum being CRC-32, masked by rotating right by 15 bits and adding 0xA282EAD8.
The payload is one byte (1 if there is a doc_id), the doc_id in 8 bytes and the ids in 2 bytes each (4
where the vocabulary needs it). Spark's text sink writes the records, so any file system works and a
repeated task replaces its file. The index (file, offset, length, ids before) is a Parquet table made by
reading the files, for shuffled reads of single records; totals of ids per file are summed up once more
to give the place of a document among all ids.

Bounds: a task holds one batch of texts, or one file; files are sized by ``FILE_BYTES`` of text.

Defined results: a null text is empty; null doc_ids come first; equal doc_ids are neighbours, in the
order of their ids; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelreg.llm.batches import Recent, codepoints, distinct_runs, parts, ragged, worker_store
from panelreg.llm.registry import register, table
from panelreg.session import new_path

FILE_BYTES = 8 << 20
CACHE_PIECES = 150_000
JOINED = 256
END_ID = 2
MASK = 0xA282EAD8

#: Kinds of characters for cutting: a cut lies between two different kinds, and between any two digits.
_BLANK, _LETTER, _DIGIT, _SIGN, _GLUE = range(5)
_CUTS = np.array([[_BLANK in (a, b) or a == b == _DIGIT or (a != b and _GLUE not in (a, b)) for b in range(5)] for a in range(5)])


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the code points below 0x250; all others are glue."""
    kinds, lower = np.full(0x251, _GLUE, np.uint8), np.arange(0x251, dtype=np.uint32)
    for cp in range(0x250):
        char = chr(cp)
        group = unicodedata.category(char)[0]
        if char in " \t\n\v\f\r":
            kinds[cp] = _BLANK
        elif group == "L" and len(char.lower()) == 1 and ord(char.lower()) < 0x250:
            kinds[cp], lower[cp] = _LETTER, ord(char.lower())
        elif cp < 0x80 and group == "N":
            kinds[cp] = _DIGIT
        elif 0x20 < cp < 0x7F and char != "'":
            kinds[cp] = _SIGN
    return kinds, lower


class PieceEncoder:
    """Ids of whole texts through a tokenizers file, each distinct piece being encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kinds, self.lower = _char_tables()
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.known = Recent(CACHE_PIECES)

    def ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def joined_ids(self, words: list[str]) -> list[bytes]:
        """Packed ids of single words, many words to a call: the last id of a word says so."""
        found: list[bytes] = []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self.ids([" ".join(g) for g in groups]), strict=True):
            stops = ((np.flatnonzero(self.ends_word[ids]) + 1) * self.width).tolist()
            if len(stops) != len(group):
                found += map(self.packed, self.ids(group))
            else:
                data = self.packed(ids)
                found += [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = ["" if self.added.search(t) else t for t in texts]
        cps, ends = codepoints(plain)
        # code points from 0x250 on take the last kind, and stay as they are
        kind, chars = self.kinds.take(cps, mode="clip"), self.lower.take(cps, mode="clip")
        if len(cps) and cps.max() >= 0x250:
            chars = np.where(cps < 0x250, chars, cps)
        fresh = np.ones(len(cps), bool)
        if len(cps):
            fresh[1:] = _CUTS.take(kind[:-1] * np.uint8(len(_CUTS)) + kind[1:])
            fresh[ends[:-1][ends[:-1] < len(cps)]] = True
        starts = np.flatnonzero(fresh)
        stops = np.append(starts[1:], len(cps))
        real = kind[starts] != _BLANK
        starts, stops = starts[real], stops[real]
        first, place = distinct_runs(chars, starts, stops)
        text = chars.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")
        names = [text[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        self.learn(names, kind, starts[first], stops[first])
        data = list(map(self.known.new.__getitem__, names))
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // self.width
        flat = np.frombuffer(b"".join(data), f"<u{self.width}")
        offsets = np.cumsum(sizes) - sizes
        tokens = flat[ragged(offsets[place], sizes[place])]
        counts = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes[place], out=counts[1:])
        cuts = counts[np.searchsorted(starts, ends)]
        made = [tokens[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        for i, (text, stand_in) in enumerate(zip(texts, plain, strict=True)):
            if text and not stand_in:
                made[i] = np.array(self.ids([text])[0], f"<u{self.width}")
        return made

    def learn(self, names: list[str], kind: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Encode the pieces that aren't known yet: single words many at a time, mixtures one by one."""
        new = np.array(self.known.missing(names), np.int64)
        if not len(new):
            return
        glued = np.append(0, np.cumsum(kind == _GLUE))
        mixture = glued[stops[new]] > glued[starts[new]]
        for group, encode in ((new[~mixture], self.joined_ids), (new[mixture], lambda x: map(self.packed, self.ids(x)))):
            pieces = [names[i] for i in group.tolist()]
            for piece, data in zip(pieces, encode(pieces), strict=True):
                self.known.new[piece] = data


def piece_encoder(path: str) -> PieceEncoder:
    store = worker_store("piece_encoders")
    if path not in store:
        store[path] = PieceEncoder(path)
    return store[path]


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    payload = struct.pack("<?q", doc_id is not None, doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(data: bytes | memoryview, at: int) -> tuple[int | None, bytes, int]:
    """doc_id and id bytes of the record at an offset, and where the next record begins."""
    size = bytes(data[at : at + 8])
    (length,) = struct.unpack("<Q", size)
    payload = bytes(data[at + 12 : at + 12 + length])
    sums = bytes(data[at + 8 : at + 12]) + bytes(data[at + 12 + length : at + 16 + length])
    if sums != struct.pack("<II", masked_crc(size), masked_crc(payload)):
        raise ValueError(f"broken record at byte {at}")
    there, doc_id = struct.unpack_from("<?q", payload)
    return doc_id if there else None, payload[9:], at + 17 + length


def range_bounds(documents: DataFrame) -> list[int]:
    """Where doc_id ranges of about FILE_BYTES of text begin, from the second range on."""
    size, rows = documents.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    files = min(-(-(size or 0) // FILE_BYTES), rows)
    if files < 2:
        return []
    shares = [i / files for i in range(1, files)]
    return sorted(set(documents.agg(F.percentile_approx("doc_id", shares, 100 * files)).first()[0]))


def encoded(documents: DataFrame, path: str, bounds: list[int]) -> DataFrame:
    """file, doc_id and the framed record of each document."""
    limits = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            keys, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for part in parts([len(t) for t in texts]):
                end = struct.pack("<H" if encoder.width == 2 else "<I", END_ID)
                records = [frame(k, i.tobytes() + end) for k, i in zip(keys[part], encoder.encode(texts[part]), strict=True)]
                files = [0 if k is None else int(np.searchsorted(limits, k, "right")) for k in keys[part]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files, pa.int32()), pa.array(keys[part], pa.int64()), pa.array(records, pa.binary())],
                    ["file", "doc_id", "record"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "file int, doc_id long, record binary")


def write_token_files(documents: DataFrame, tokenizer: str, folder: str) -> None:
    """Write ``folder/records`` and ``folder/index``."""
    bounds = range_bounds(documents)
    records = (
        encoded(documents, tokenizer, bounds)
        .repartitionById(len(bounds) + 1, F.col("file"))
        .sortWithinPartitions("file", "doc_id", "record")
        .select("file", F.col("record").cast("string"))
    )
    records.write.partitionBy("file").text(f"{folder}/records")
    width = piece_encoder(tokenizer).width
    read_records(documents.sparkSession, folder, width).drop("ids").write.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """Every record: file, path, offset, length, doc_id, n_tokens, start_in_file, ids_crc32, ids."""
    names = ["file", "path", "offset", "length", "doc_id", "n_tokens", "start_in_file", "ids_crc32", "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, path, content in zip(batch["file"], batch["path"], batch["content"], strict=True):
                rows, at, start = [], 0, 0
                while at < len(content):
                    doc_id, data, following = read_frame(content, at)
                    n = len(data) // width
                    ids = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                    rows.append((file, path, at, following - at - 1, doc_id, n, start, zlib.crc32(ids), ids))
                    at, start = following, start + n
                    if len(rows) == 2000 or at >= len(content):
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows = []

    kinds = "int string long long long long long long binary".split()
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.load(f"{folder}/records/file=*").select(
        F.regexp_extract("path", r"/file=(\d+)/[^/]*$", 1).cast("int").alias("file"), "path", "content"
    )
    return found.mapInPandas(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def placed_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``, the number of ids in all records before."""
    index = spark.read.parquet(f"{folder}/index")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    totals = totals.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(totals, "file").withColumn("start", F.col("start_in_file") + F.col("_before")).drop("_before")


@register()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as records, read back from the files."""
    folder = new_path(spark, "tokens")
    documents = table(spark, sf_dir, "documents")
    if documents.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    write_token_files(documents, public_tokenizers.path("word_bpe_49k.json"), folder)
    return placed_index(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
