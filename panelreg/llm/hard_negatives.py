"""Hard negatives by spanning trees of anchors: a parent's scores bound its children's.

A row's score is its inner product with the anchor, in whole numbers. Anchors are dealt into blocks of at most
``BLOCK`` neighbours (near by the signs of a few fixed projections), and each block gets a minimum spanning
tree of Euclidean distances. Walking the tree, a candidate whose score at the parent lies in [low, high] has a
score in [low - d, high + d] at the child, d being the length of the edge times the candidate's norm. Only
candidates whose interval meets the child's window are scored again; the others carry the interval on.

Two walks over all rows. The first finds each anchor's positives: the window begins at the worst of the best
rows of the anchor's label that the task has so far. The second finds the negatives of each positive: the
windows are those of the positives' scores, and their lower ends rise likewise. Tasks hand on the best few rows
for each anchor and window, and a window function keeps the best of all.

A block is one row of a written table. Blocks of at most ``SENT_NUMBERS`` numbers together are sent to the tasks
that scan the rows, one such lot after the other, so neither driver nor task ever holds more than that,
however many anchors there are. Every row is seen by every block; no pair leaves a task but the best few.

Whole numbers are exact: products and sums below 2 ** 53 are made in doubles, above that in Python's
integers. A score beyond 64 bits is the last number that fits.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a
shorter vector is followed by zeros; a null vec_id is no anchor and comes last among ties; rows with the same
vec_id are rows of their own; an anchor without positives or without negatives in a window gives no rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelreg.llm.near_dedup import written
from panelreg.llm.registry import register, table
from panelreg.session import new_path

LABELS, MOVED, ANCHORS = 10, 7, 100
POSITIVES, NEGATIVES = 5, 5
#: The window of a positive's score: negatives score at least so many hundredths of it, and at most all.
LEAST_PERCENT = 80
SCALE = 256
#: Anchors in a tree, numbers in the trees that are sent at a time, and rows that are scored at once.
BLOCK, SENT_NUMBERS, ROWS = 1024, 1 << 22, 4096
#: Signs of so many projections bring near anchors into the same block.
SIGNS = 16
#: Bounds give way by this share, and by one, to rounding.
SLACK = 1e-9
EXACT = 2.0**53

LAST = np.iinfo(np.int64).max


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (moved where the id says so), vector (of whole numbers, as doubles) and row, of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    doubles = F.col("embedding").cast("array<double>")
    # floor of a double as a double: beyond 2 ** 52 every double is whole
    whole = F.transform(doubles, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        moved.cast("long").alias("label"),
        whole.alias("vector"),
        F.monotonically_increasing_id().alias("row"),
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are followed by zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    made = np.zeros((len(sizes), width))
    made[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return made


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products, held to 64 bits."""
    if len(rows) and float(np.abs(rows).max(initial=0)) * float(np.abs(anchor).sum()) >= EXACT:
        anchor = [int(x) for x in anchor.tolist()]
        exact = [sum(int(x) * y for x, y in zip(row, anchor, strict=True)) for row in rows.tolist()]
        return np.array([max(-LAST, min(LAST, s)) for s in exact], np.int64)
    return (rows @ anchor).astype(np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order (parents first, a node's largest subtree last), parent (-1 for the root) and edge length of each vector."""
    n = len(vectors)
    parent, edge = np.full(n, -1), np.zeros(n)
    near, source = np.full(n, np.inf), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    at = 0
    reached = []
    for _ in range(n):
        open_[at] = False
        reached.append(at)
        distance = np.sqrt(((vectors - vectors[at]) ** 2).sum(1))
        closer = open_ & (distance < near)
        near[closer], source[closer] = distance[closer], at
        if open_.any():
            following = int(np.where(open_, near, np.inf).argmin())
            if not open_[following]:  # distances beyond the range of doubles
                following = int(np.flatnonzero(open_)[0])
                source[following] = at
            parent[following], edge[following] = source[following], near[following]
            at = following
    weight = np.ones(n, np.int64)
    for node in reversed(reached[1:]):
        weight[parent[node]] += weight[node]
    children: dict[int, list[int]] = {}
    for node in reached[1:]:
        children.setdefault(int(parent[node]), []).append(node)
    order, stack = [], [0] if n else []
    while stack:
        node = stack.pop()
        order.append(node)
        # the last one pushed is walked first
        stack += sorted(children.get(node, ()), key=lambda c: (-weight[c], c))
    return np.array(order, np.int64), parent, edge


def signs(width: int) -> np.ndarray:
    """Fixed projections, for bringing near anchors together."""
    return np.random.default_rng(11).standard_normal((width, SIGNS))


def anchor_blocks(anchors: DataFrame, width: int) -> DataFrame:
    """Rows of at most BLOCK anchors with their tree: row, vec_id, label, vector (of all, one after another), order, parent, edge."""
    kinds = "row array<long>, vec_id array<long>, label array<long>, vector array<double>, order array<long>, parent array<long>, edge array<double>"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch["vector"], width)
            norm = np.maximum(np.abs(vectors).max(1, initial=0), 1e-300)[:, None]
            bits = (vectors / norm) @ signs(width) > 0
            # neighbours in this order differ in one sign
            place = np.bitwise_xor.accumulate(bits, 1) @ (1 << np.arange(SIGNS)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64))], [*batch.schema.names, "place"])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        vectors = matrix(rows["vector"].chunk(0), width)
        order, parent, edge = spanning_tree(vectors)
        columns = [rows["row"], rows["vec_id"], rows["label"], vectors.ravel(), order, parent, edge]
        return pa.RecordBatch.from_arrays([pa.array([c.to_numpy() if hasattr(c, "to_numpy") else c]) for c in columns], kinds.split()[::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while len(batch):
                part, batch = batch.slice(0, BLOCK - size), batch.slice(BLOCK - size)
                held, size = [*held, part], size + len(part)
                if size == BLOCK:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    coded = anchors.mapInArrow(code, "vec_id long, label long, vector array<double>, row long, place long")
    count = anchors.count()
    ranged = coded.repartitionByRange(max(1, -(-count // BLOCK)), "place", "row").sortWithinPartitions("place", "row")
    return ranged.mapInArrow(run, kinds)


class Tree:
    """A block of anchors with its tree, as sent to the tasks."""

    def __init__(self, block):
        self.row, self.vec_id, self.label = (np.array(block[c], np.int64) for c in ("row", "vec_id", "label"))
        self.vectors = np.array(block["vector"]).reshape(len(self.row), -1)
        self.order, self.parent = block["order"], np.array(block["parent"])
        self.edge = np.array(block["edge"])
        self.last_use = np.full(len(self.row), -1)
        for step, node in enumerate(self.order):
            if self.parent[node] >= 0:
                self.last_use[self.parent[node]] = step

    def walk(self, rows: np.ndarray, windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor the places of the candidates that were scored, and their scores.

        ``windows(anchor, low, high)`` says which candidates may matter, by bounds of their scores."""
        norms = np.sqrt((rows * rows).sum(1)) * (1 + SLACK)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for step, node in enumerate(self.order):
            parent = int(self.parent[node])
            if parent < 0:
                found = np.arange(len(rows))
                low, high = np.empty(len(rows)), np.empty(len(rows))
            else:
                low, high = held[parent]
                reach = norms * self.edge[node] * (1 + SLACK) + 1
                reach = reach + np.abs(low) * SLACK + np.abs(high) * SLACK
                low, high = low - reach, high + reach
                if self.last_use[parent] == step:
                    del held[parent]
                found = np.flatnonzero(windows(node, low, high))
            exact = scores(rows if len(found) == len(rows) else rows[found], self.vectors[node])
            low[found] = high[found] = exact
            if self.last_use[node] > step:
                held[node] = low, high
            yield node, found, exact


def best_first(score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best: higher scores, then smaller ids."""
    if len(score) > 4 * n:
        # all that tie with the n-th stay
        edge = np.partition(score, len(score) - n)[len(score) - n]
        few = np.flatnonzero(score >= edge)
    else:
        few = np.arange(len(score))
    return few[np.lexsort((row[few], vec_id[few], -score[few]))[:n]]


class Best:
    """The n best rows of each key so far."""

    def __init__(self, n: int):
        self.n, self.held = n, {}

    def floor(self, key) -> int | None:
        """The score a further row must reach."""
        rows = self.held.get(key)
        return int(rows[0][-1]) if rows is not None and len(rows[0]) == self.n else None

    def add(self, key, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(score):
            return
        if key in self.held:
            score, vec_id, row = (np.concatenate(x) for x in zip(self.held[key], (score, vec_id, row), strict=True))
        few = best_first(score, vec_id, row, self.n)
        self.held[key] = score[few], vec_id[few], row[few]


def pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """vec_id (the largest number for null), label, row and vectors of at most ROWS rows."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            piece = batch.slice(at, ROWS)
            vec_id = piece["vec_id"].fill_null(LAST).to_numpy()
            yield vec_id, piece["label"].to_numpy(), piece["row"].to_numpy(), matrix(piece["vector"], width)


def out(best: Best, names: list[str]) -> pa.RecordBatch:
    """Rows of key columns, score, vec_id and row."""
    keys = [np.repeat(np.array([k[i] for k in best.held], np.int64), [len(v[0]) for v in best.held.values()]) for i in range(len(names))]
    rest = [np.concatenate([np.zeros(0, np.int64), *(v[i] for v in best.held.values())]) for i in range(3)]
    ids = pa.array(rest[1], mask=rest[1] == LAST)
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(rest[0]), ids, pa.array(rest[2])], [*names, "score", "vec_id", "row"])


def positive_rows(rows: DataFrame, trees, width: int, n: int) -> DataFrame:
    """anchor (row) and score, vec_id and row of each task's best rows of its label, for the anchors of the sent trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n)
        for vec_id, label, row, vectors in pieces(batches, width):
            for tree in trees.value:

                def windows(node: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    mine = label == tree.label[node]
                    floor = best.floor((tree.row[node],))
                    return mine if floor is None else mine & (high >= floor)

                for node, found, score in tree.walk(vectors, windows):
                    kept = (label[found] == tree.label[node]) & (row[found] != tree.row[node])
                    best.add((tree.row[node],), score[kept], vec_id[found[kept]], row[found[kept]])
        yield out(best, ["anchor"])

    return rows.mapInArrow(run, "anchor long, score long, vec_id long, row long")


def negative_rows(rows: DataFrame, trees, targets, width: int, n: int, least: int) -> DataFrame:
    """anchor (row), positive_score and score, vec_id and row of each task's best rows of other labels in the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, wanted = Best(n), targets.value

        def bottom(key: tuple[int, int]) -> int:
            floor = best.floor(key)
            lowest = -(-least * key[1] // 100)
            return lowest if floor is None else max(lowest, floor)

        for vec_id, label, row, vectors in pieces(batches, width):
            for tree in trees.value:

                def windows(node: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    meets, anchor = np.zeros(len(low), bool), int(tree.row[node])
                    for top in wanted.get(anchor, ()):
                        meets |= (high >= bottom((anchor, top))) & (low <= top)
                    return meets & (label != tree.label[node])

                for node, found, score in tree.walk(vectors, windows):
                    other, anchor = label[found] != tree.label[node], int(tree.row[node])
                    for top in wanted.get(anchor, ()):
                        kept = other & (score <= top) & (score >= bottom((anchor, top)))
                        best.add((anchor, top), score[kept], vec_id[found[kept]], row[found[kept]])
        yield out(best, ["anchor", "positive_score"])

    return rows.mapInArrow(run, "anchor long, positive_score long, score long, vec_id long, row long")


def best_of(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Add ``rank``, from 1, and keep the n best of each key."""
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def lots(blocks: DataFrame) -> Iterator[list[Tree]]:
    """The trees, as many at a time as may be sent together."""
    held: list[Tree] = []
    for block in blocks.toLocalIterator():
        tree = Tree(block)
        if held and sum(t.vectors.size for t in held) + tree.vectors.size > SENT_NUMBERS:
            yield held
            held = []
        held.append(tree)
    if held:
        yield held


def mine(
    embeddings: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    spark = embeddings.sparkSession
    context = spark.sparkContext
    rows = written(usable(embeddings), "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    anchors = rows.where(F.col("vec_id") % every == 0)
    folder = new_path(spark, "negatives")
    kinds = "anchor long, positive_score long, positive_id long, rank int, negative_id long, negative_score long"
    rows.sparkSession.createDataFrame([], kinds).write.parquet(f"{folder}/lot=0")
    for lot, trees in enumerate(lots(written(anchor_blocks(anchors, width), "anchor-blocks")), 1):
        sent = context.broadcast(trees)
        near = written(best_of(positive_rows(rows, sent, width, positives), ["anchor"], positives), "positives")
        # at most ``positives`` scores for each anchor of the lot
        targets: dict[int, list[int]] = {}
        for anchor, score in near.where("score >= 0").select("anchor", "score").distinct().collect():
            targets.setdefault(anchor, []).append(score)
        hard = best_of(
            negative_rows(rows, sent, context.broadcast(targets), width, negatives, least), ["anchor", "positive_score"], negatives
        )
        hard = hard.select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs.join(hard, ["anchor", "positive_score"]).select(*(c.split()[0] for c in kinds.split(", "))).write.parquet(f"{folder}/lot={lot}")
    found = spark.read.schema(kinds).parquet(folder)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS alike,
         CAST(list_dot_product(a.vector, v.vector) AS BIGINT) AS score
  FROM vectors a JOIN vectors v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""


@register(SQL)
def op11_anchor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor."""
    return mine(table(spark, sf_dir, "embeddings"))
