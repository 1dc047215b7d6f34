"""Near-duplicate classes by BagMinHash signatures.

A text is the multiset of its shingles, ``SHINGLE`` lower-case words each (runs of letters and digits).
Weighted Jaccard similarity compares such multisets; classes are the connected components of links of at
least ``NEAR``.

Signatures. The weights of a shingle are cut into dyadic intervals (0,1], (1,2], (2,4], ... Every interval of
every shingle has a Poisson process of its length as rate, drawn from a hash of (shingle, interval, number of
the point); a point has a time, one of ``SIZE`` components and a place in the interval, the path through its
halves, and counts if the place is within the weight. A component keeps its earliest point. Two texts keep
the same point with the probability of their weighted Jaccard similarity. Points beyond the time by which
the components of a text are all but surely filled are never drawn; a text with a component left empty is
drawn again up to a later time.

Candidates. Equal multisets are one node from the start. Each of ``BANDS`` bands of components is a bucket
key. Buckets of up to ``SMALL`` nodes give all their pairs; in larger ones every node is paired with the
bucket's leader, and the bucket is split by each other band, where the same rule holds and the leader alone
remains for what is still large. So a node has a bounded number of partners on average, however many share
a bucket, and two similar nodes meet in many buckets with different leaders. That is a first pass: large
buckets whose nodes it left in several components are a crowd, and all of a crowd's nodes are joined exactly.

Crowds. A node's elements are put in one order for all, by how often they occur in the crowds (counted in
2 ** ``SLOT_BITS`` slots of their hash; any order gives all pairs, the count keeps common passages behind). Of two
nodes of similarity ``NEAR`` the first element they share lies in the first 1 - ``NEAR`` of the larger and in the first
(1 - ``NEAR``) / (1 + ``NEAR``) of the smaller, so nodes meet at those elements, if they are in different components, their
sizes are near enough and the elements that can still follow suffice.

Verification first bounds the similarity of a pair by its nodes' sketches, the numbers of their elements in each
of ``SKETCH`` slots of a hash: what two nodes share is at most the sum of the lesser numbers. Pairs whose bound
stays below ``NEAR`` go, and their texts aren't read. Then it computes the exact similarity: first one pair for each node, then those of the
others whose nodes aren't in one component yet, which leaves the components as they would be with all.
Components come from large-star and small-star rounds, each written to the shared folder.

Signatures are made batch by batch; buckets, leaders and components are grouped with partial aggregates,
and joins on hot buckets have a unique key on their other side, so adaptive execution can split them.

Defined results: null texts are empty ones; texts without words are alike if equal; texts of fewer than
``SHINGLE`` words are one shingle; every row is a document, also those with a repeated doc_id or none (a
class_id is null if no document of the class has a doc_id); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelreg.llm.batches import LETTER, NUMBER, char_classes, codepoints, distinct_runs, forget_others, mixed, ragged, text_parts, tidied, word_runs
from panelreg.llm.registry import register, table
from panelreg.session import new_path

SHINGLE = 5
NEAR = 0.8
SIZE, BANDS = 64, 16
SMALL = 6
#: Leaders differ between so many groups of bands.
ORDERS = 4
#: Nodes to verify are sent to the tasks that read the texts up to so many, joined by a shuffle above.
SENT_ROWS = 1_000_000
#: Counts of elements in crowds are kept for so many bits of their hash.
SLOT_BITS = 18
#: Numbers in a node's sketch, the largest that it holds, and characters that are worked off at once.
SKETCH, FULL, PART = 128, 65_535, 300_000
#: Pairs whose sketches are compared at once.
PAIRS = 2_000
#: Bounds of sizes and places give way by so much to rounding.
SLACK = 1e-6
#: Components left empty at the first attempt: SIZE * exp(-SPARE) of a text's SIZE components.
SPARE = np.log(SIZE) + 4

_GOLD, _REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_UNIT = 1.0 / (1 << 53)


def name_of(text: str) -> int:
    """64 bits of a digest: words and texts are told apart by it."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shingle_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of the distinct shingles, in this order."""
    texts = [t.lower() for t in texts]
    cps, ends = codepoints(texts)
    kinds = char_classes()[cps]
    starts, stops = word_runs(cps, ends, (kinds == LETTER) | (kinds == NUMBER))
    unlike, place = distinct_runs(cps, starts, stops)
    text = "".join(texts)
    names = [name_of(text[a:b]) for a, b in zip(starts[unlike].tolist(), stops[unlike].tolist(), strict=True)]
    words = np.array(names, np.uint64)[place]
    cuts = np.searchsorted(starts, ends)
    counts = np.diff(cuts)
    # one shingle for short texts; texts without words are shingles themselves
    number = np.maximum(counts - SHINGLE + 1, 1)
    owner = np.repeat(np.arange(len(texts)), number)
    first = ragged(cuts[:-1], number)
    code = np.full(len(first), np.uint64(SHINGLE), np.uint64)
    for i in range(SHINGLE):
        there = i < counts[owner]
        word = np.zeros(len(first), np.uint64)
        word[there] = words[first[there] + i]
        code = mixed(code * _GOLD + word)
    bare = np.flatnonzero(counts == 0)
    if len(bare):
        place = np.cumsum(number)[bare] - 1
        code[place] = mixed(np.array([name_of(texts[i]) for i in bare.tolist()], np.uint64) + _GOLD)
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))[: len(code)]
    begins = np.flatnonzero(fresh)
    return owner[begins], code[begins], np.diff(np.append(begins, len(code)))


def unit(bits: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * _UNIT


def signatures(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """BagMinHash: the earliest point of each component, by its hash; a row for each text."""
    total = np.bincount(owner, weight, texts)
    found = np.zeros((texts, SIZE), np.uint64)
    todo = np.flatnonzero(total > 0)
    spare = SPARE
    while len(todo):
        chosen = np.zeros(texts, bool)
        chosen[todo] = True
        mine = chosen[owner]
        horizon = SIZE * spare / np.maximum(total, 1e-300)
        empty = _draw(owner[mine], code[mine], weight[mine], horizon, found)
        todo, spare = todo[empty[todo]], 2 * spare
    return found


def _draw(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, horizon: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Fill ``found`` with the earliest points up to each text's horizon; tells which texts have gaps."""
    # interval k > 0 is (2**(k-1), 2**k]; the last one may reach beyond the weight
    intervals = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    row = np.repeat(np.arange(len(owner)), intervals)
    level = ragged(np.zeros(len(owner), np.int64), intervals)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, low, 1.0)
    text, top = owner[row], weight[row]
    seed = mixed(code[row] + level.astype(np.uint64) * _REPEAT)
    until = horizon[text]
    clock = np.zeros(len(row))
    points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(seed):
        seed = seed + _GOLD
        bits = mixed(seed)
        clock = clock - np.log(unit(bits)) / rate
        live = clock <= until
        seed, clock, rate, low, top, until, text, bits = (
            x[live] for x in (seed, clock, rate, low, top, until, text, bits)
        )
        more = mixed(bits)
        inside = low + rate * unit(mixed(more)) <= top
        slot = text * SIZE + (more % np.uint64(SIZE)).astype(np.int64)
        points.append((clock[inside], slot[inside], bits[inside]))
    times, slots, names = (np.concatenate(x) for x in zip(*points, strict=True)) if points else ([], [], [])
    order = np.argsort(times)[::-1]
    flat = found.reshape(-1)
    filled = np.zeros(len(flat), bool)
    flat[slots[order]] = names[order]  # the last one written is the earliest
    filled[slots] = True
    return ~filled.reshape(found.shape).all(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of each text."""
    rows = found.reshape(len(found), BANDS, SIZE // BANDS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        key = mixed(key * _GOLD + rows[:, :, i])
    return key.astype(np.int64)


def bag_names(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int) -> list[bytes]:
    """A digest of each text's multiset."""
    cuts = np.searchsorted(owner, np.arange(texts + 1)).tolist()
    both = np.stack([code, weight.astype(np.uint64)], 1)
    return [hashlib.md5(both[a:b].tobytes()).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def elements_of(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A hash for each shingle and each of its repeats."""
    repeat = ragged(np.zeros(len(code), np.int64), weight).astype(np.uint64)
    return mixed(np.repeat(code, weight) + repeat * _REPEAT)


def sketches(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int) -> list[bytes]:
    """How many elements of each text fall in each slot."""
    slot = (elements_of(code, weight) % np.uint64(SKETCH)).astype(np.int64)
    counts = np.bincount(np.repeat(owner, weight) * SKETCH + slot, minlength=texts * SKETCH)
    rows = np.minimum(counts, FULL).astype("<u2").reshape(texts, SKETCH)
    return [row.tobytes() for row in rows]


def read_key() -> Column:
    """What a text is found by: null and repeated doc_ids don't matter, and ``read_bags`` tells equal keys apart."""
    return F.xxhash64("doc_id", "text")


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, key, name (of the multiset), sketch and bands (keys) of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("classes")
        for batch in batches:
            for part, texts in text_parts(batch["text"], PART):
                n = len(texts)
                owner, code, weight = shingle_bags(texts)
                keys = band_keys(signatures(owner, code, weight, n))
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel()))
                both = (pa.array(f(owner, code, weight, n), pa.binary()) for f in (bag_names, sketches))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][part], batch["key"][part], *both, lists], ["doc_id", "key", "name", "sketch", "bands"]
                )

    rows = documents.select("doc_id", read_key().alias("key"), "text")
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, key bigint, name binary, sketch binary, bands array<bigint>")


def read_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Nodes, their elements one after the other, and where each node's end, of rows (node, name, text).

    Elements are shingles with the number of the repeat mixed in. Rows whose text doesn't have the name, as
    equal keys can bring about, are left out."""
    for batch in batches:
        for part, texts in text_parts(batch["text"], PART):
            n = len(texts)
            owner, code, weight = shingle_bags(texts)
            asked = batch["name"][part].to_pylist()
            same = np.array([x == y for x, y in zip(asked, bag_names(owner, code, weight, n), strict=True)])
            mine = same[owner]
            owner, code, weight = (np.cumsum(same) - 1)[owner[mine]], code[mine], weight[mine]
            cuts = np.searchsorted(owner, np.arange(int(same.sum()) + 1))
            yield batch["node"][part].filter(pa.array(same)), elements_of(code, weight), np.append(0, np.cumsum(weight))[cuts]


def bags(texts: DataFrame) -> DataFrame:
    """node and elements of rows (node, name, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, flat, ends in read_bags(batches):
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([node, lists], ["node", "elements"])

    return texts.mapInArrow(tidied(run), "node bigint, elements array<bigint>")


def slots_of(flat: np.ndarray) -> np.ndarray:
    return (flat >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(texts: DataFrame) -> np.ndarray:
    """How many elements of the rows (node, name, text) fall in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for _, flat, _ in read_bags(batches):
            total += np.bincount(slots_of(flat), minlength=len(total))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

    found = texts.mapInArrow(tidied(run), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    # only the order counts
    return np.unique(counts, return_inverse=True)[1].astype(np.int32)


def prefixes(texts: DataFrame, counts: np.ndarray, near: float) -> DataFrame:
    """node, size (elements) and, rarest first, the elements of which near nodes share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, flat, ends in read_bags(batches):
            size = np.diff(ends)
            owner = np.repeat(np.arange(len(size)), size)
            flat = flat[np.lexsort((flat, counts[slots_of(flat)], owner))]
            place = ragged(np.zeros(len(size), np.int64), size)
            kept = place <= (1 - near) * size[owner] + SLACK
            cuts = np.append(0, np.cumsum(np.bincount(owner[kept], minlength=len(size)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(cuts, pa.array(flat[kept].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([node, pa.array(size), lists], ["node", "size", "elements"])

    return texts.mapInArrow(tidied(run), "node bigint, size bigint, elements array<bigint>")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage is a file scan from here on."""
    path = new_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucket_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) from rows of (bucket, rank, node): all pairs of small buckets, leader pairs of larger ones;
    and the rows of the larger ones."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", "rank").alias("leader")).where("n > 1")
    shared = written(rows.join(sizes, "bucket"), "buckets")
    few = shared.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    first = few.select(F.posexplode("nodes").alias("i", "a"), "nodes")
    every = first.select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(SMALL))).alias("b"))
    many = shared.where(F.col("n") > SMALL)
    star = many.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return every.unionByName(star), many.drop("n", "leader")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of nodes that share a band, leader pairs in large buckets; and bucket and node of those."""
    rank = F.xxhash64("node", F.col("band") % ORDERS)
    rows = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    pairs, large = bucket_pairs(rows.select("bucket", rank.alias("rank"), "node"))
    split = large.join(nodes.select("node", "bands"), "node").select("node", "rank", "bucket", F.explode("bands").alias("key"))
    again = split.where("key <> bucket").select(F.xxhash64("bucket", "key").alias("bucket"), "rank", "node")
    return pairs.unionByName(bucket_pairs(again)[0]).distinct(), large.select("bucket", "node")


def crowds(large: DataFrame, roots: DataFrame) -> DataFrame:
    """node and root of the nodes in large buckets that hold more than one component."""
    rows = with_root(large, roots, "node").withColumnRenamed("root_node", "root")
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rows.join(several.select("bucket"), "bucket", "left_semi").select("node", "root").distinct()


def crowd_pairs(crowd: DataFrame, nodes: DataFrame, documents: DataFrame, near: float) -> DataFrame:
    """Distinct pairs (a < b) from rows (node, root): all of at least ``near`` and different roots, and some others."""
    texts = texts_of(crowd.select("node"), nodes, documents)
    kept = prefixes(texts, slot_counts(texts), near).groupBy("node").agg(
        F.first("size").alias("size"), F.first("elements").alias("elements")
    )
    placed = kept.join(crowd, "node").select("node", "root", "size", F.posexplode("elements").alias("place", "element"))
    rows = written(placed.select("element", "node", "root", "size", (F.col("size") - F.col("place")).alias("after")), "prefixes")
    several = rows.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rows = written(rows.join(several.select("element"), "element", "left_semi"), "prefixes")

    def side(frame: DataFrame, label: str) -> DataFrame:
        return frame.withColumnsRenamed({c: f"{c}_{label}" for c in frame.columns if c != "element"})

    def enough(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
        """a may be the smaller one, sizes are near enough, and what follows the shared element can make up the similarity."""
        alike = (F.col(low_a) <= F.col(high_b)) & (F.col(high_a) + SLACK >= F.col(low_b) * near)
        needed = (F.col(low_a) + F.col(low_b)) * (near / (1 + near))
        return alike & (F.least("after_a", "after_b") + SLACK >= needed)

    # the smaller one of two shares one of its first elements by a shorter measure
    shorter = rows.where(F.col("size") - F.col("after") <= (1 - 2 * near / (1 + near)) * F.col("size") + SLACK)

    def groups(frame: DataFrame) -> DataFrame:
        return frame.groupBy("element", "root").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("after").alias("after"))

    # components first, so that nodes of one component never meet
    met = side(groups(shorter), "a").join(side(groups(rows), "b"), "element").where("root_a <> root_b")
    met = met.where(enough("low_a", "high_a", "low_b", "high_b"))
    few = side(shorter, "a")
    met = met.select("element", "root_a", "root_b", "low_b", "high_b", "after_b").join(few, ["element", "root_a"])
    met = met.where(enough("size_a", "size_a", "low_b", "high_b")).drop("low_b", "high_b", "after_b")
    pairs = met.join(side(rows, "b"), ["element", "root_b"]).where(enough("size_a", "size_a", "size_b", "size_b"))
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def possible(pairs: DataFrame, nodes: DataFrame, near: float) -> DataFrame:
    """The pairs whose sketches allow a similarity of ``near``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PAIRS):
                piece = batch.slice(at, PAIRS)
                one, two = (np.frombuffer(b"".join(piece[c].to_pylist()), "<u2").reshape(-1, SKETCH).astype(np.int64) for c in ("sa", "sb"))
                shared = np.minimum(one, two).sum(1)
                kept = shared * (1 + near) >= near * (one.sum(1) + two.sum(1)) - SLACK
                # a full slot may hold more than it says
                kept |= (one == FULL).any(1) | (two == FULL).any(1)
                yield pa.RecordBatch.from_arrays([piece[c].filter(pa.array(kept)) for c in "ab"], ["a", "b"])

    known = nodes.select("node", "sketch")
    both = pairs
    for side in "ab":
        both = both.join(known.withColumnsRenamed({"node": side, "sketch": f"s{side}"}), side)
    return both.select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a bigint, b bigint")


def texts_of(asked: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """node, name and text of the asked nodes."""
    named = written(nodes.join(asked, "node").select("node", "name", "key"), "asked")
    if named.count() <= SENT_ROWS:
        named = F.broadcast(named)
    return documents.select(read_key().alias("key"), "text").join(named, "key").select("node", "name", "text")


def links(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, near: float = NEAR) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is at least ``near``."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    elements = bags(texts_of(asked, nodes, documents)).groupBy("node").agg(F.first("elements").alias("elements"))
    shared = F.size(F.array_intersect("ea", "eb"))
    a = elements.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    b = elements.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    both = pairs.join(a, "a").join(b, "b")
    return both.where(shared / (F.size("ea") + F.size("eb") - shared) >= near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node it is connected with, for all nodes that have a link."""

    def rounds(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = sides.join(least, "a")
        if large:
            made = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            made = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return made.where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = written(edges, "links")
    state = mark(edges)
    while True:
        edges = written(rounds(rounds(edges, True), False), "links")
        before, state = state, mark(edges)
        if before == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined(pairs: DataFrame, found: DataFrame | None, nodes: DataFrame, documents: DataFrame, near: float) -> tuple[DataFrame, DataFrame]:
    """Links and components of the pairs and of the links found before."""
    # one pair for each node first; of the others only those that would join two components
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    fresh = written(links(first, nodes, documents, near), "links")
    found = found.unionByName(fresh) if found is not None else fresh
    roots = components(found)
    apart = with_root(with_root(pairs, roots, "a"), roots, "b").where("root_a <> root_b").select("a", "b")
    rest = written(apart.join(first, ["a", "b"], "left_anti"), "pairs")
    found = written(found.unionByName(links(rest, nodes, documents, near)), "links")
    return found, components(found)


def near_classes(documents: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size (documents) for every document."""
    rows = written(signed(documents), "signatures")
    named = rows.groupBy("name").agg(
        F.min("doc_id").alias("least"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    nodes = written(named.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs, large = candidates(nodes)
    found, roots = joined(written(possible(pairs, nodes, near), "pairs"), None, nodes, documents, near)
    crowd = written(crowds(large, roots), "crowd")
    if not crowd.isEmpty():
        pairs = written(possible(crowd_pairs(crowd, nodes, documents, near), nodes, near), "pairs")
        found, roots = joined(pairs, found, nodes, documents, near)
    placed = with_root(nodes.select("node", "name", "least", "copies"), roots, "node")
    classes = placed.groupBy("root_node").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    known = placed.join(classes, "root_node").select("name", "class_id", "class_size")
    return rows.select("doc_id", "name").join(known, "name").select("doc_id", "class_id", "class_size")


def with_root(rows: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """Add root_<node>, the root of that column's node; a node without links is its own."""
    named = roots.select(F.col("node").alias(node), F.col("root").alias(f"root_{node}"))
    return rows.join(named, node, "left").withColumn(f"root_{node}", F.coalesce(f"root_{node}", node))


@register()
def op2_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_classes(table(spark, sf_dir, "documents"))
