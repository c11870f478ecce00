"""Hard negatives by spanning trees of anchors: a score at one anchor bounds those at its neighbours.

For anchors a and b and a candidate c, the score of b and c differs from that of
a and c by at most |a - b| * |c|. Anchors are dealt to groups of similar ones; in
each block of candidates the anchors of a group form a minimum spanning tree, all
candidates are scored at its root, and each further anchor takes the bounds of its
parent, widened by the edge, and scores again only the candidates whose bounds
overlap the window of scores that it looks for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftframe.llm.common import written
from weftframe.operators.indexing import with_row_index

# anchors of a group, which meet the candidates of a block in one task
GROUP_ANCHORS = 512
BLOCK_ROWS = 16_384
# projections whose signs tell similar anchors
SIGNS = 16
# integers up to here are exact in double precision
_EXACT = 1 << 53
# slack for rounding in bounds, as a share of the numbers involved
_SLACK = 1e-9


def whole_vectors(table: DataFrame, is_anchor, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v: array<long>, own, anchor) of the rows that take part, each once.

    Components are ``floor(scale * x)``. Rows with a null id, label or vector, or any
    null or non-finite component, take no part; repeated rows count once.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = table.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", odd))
    v = F.transform("vector", lambda x: F.floor(x * scale).cast("long"))
    rows = rows.select("id", "label", v.alias("v")).distinct()
    # tells rows of one id apart
    return rows.withColumn("own", F.xxhash64("id", "label", "v")).withColumn("anchor", is_anchor(F.col("id")))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of numbers; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (at, n) in enumerate(zip(offsets[:-1].tolist(), sizes.tolist())):
        out[i, :n] = values[at : at + n]
    return out


def spanning_tree(points: np.ndarray) -> tuple[list[int], np.ndarray, list[list[int]]]:
    """Parents (-1 at the root, row 0), edge lengths and children, largest subtree last, of a minimum spanning tree."""
    n = len(points)
    parent = np.full(n, -1)
    edge = np.zeros(n)
    near = ((points - points[:1]) ** 2).sum(axis=1).astype(np.float64)
    source = np.zeros(n, np.int64)
    near[0] = np.inf
    order = [0]
    out = np.ones(n, bool)
    out[0] = False
    for _ in range(n - 1):
        new = int(np.argmin(np.where(out, near, np.inf)))
        parent[new], edge[new], out[new] = source[new], np.sqrt(near[new]), False
        order.append(new)
        distance = ((points - points[new]) ** 2).sum(axis=1)
        closer = out & (distance < near)
        near[closer], source[closer] = distance[closer], new
    size = np.ones(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for node in order[:0:-1]:
        size[parent[node]] += size[node]
        children[parent[node]].append(node)
    for below in children:
        below.sort(key=lambda c: size[c])
    return parent.tolist(), edge, children


def walk(anchors: np.ndarray, rows: np.ndarray, overlapping):
    """(anchor, candidate places, exact scores) for every anchor of a group against one block.

    ``overlapping(anchor, low, high)`` tells from bounds on the scores which candidates
    may count; only those are scored again. Bounds of others go on to the children.
    """
    exact = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < _EXACT
    if exact:
        anchors, rows = anchors.astype(np.float64), rows.astype(np.float64)
    points = anchors.astype(np.float64)
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    parent, edge, children = spanning_tree(points)
    waiting: list[tuple[int, np.ndarray | None, np.ndarray | None]] = [(0, None, None)]
    while waiting:
        node, low, high = waiting.pop()
        if low is None:
            low = high = rows @ anchors[node]
            places = np.flatnonzero(overlapping(node, low, high))
            scores = low[places]
            low = high = low.astype(np.float64)
        else:
            reach = norms * edge[node]
            reach += _SLACK * (np.abs(low) + np.abs(high) + reach) + 1e-6
            low, high = low - reach, high + reach
            places = np.flatnonzero(overlapping(node, low, high))
            # all at once where most are due
            scores = (rows @ anchors[node])[places] if 2 * len(places) > len(rows) else rows[places] @ anchors[node]
            low[places] = high[places] = scores
        yield node, places, scores.astype(np.int64)
        # the largest subtree is opened last, so few bounds wait at a time
        waiting += [(child, low, high) for child in children[node][::-1]]


def _cells(rows: DataFrame, anchors: DataFrame, extra: list[str], schema: str, search) -> DataFrame:
    """``search`` over every (group of anchors, block of candidates), each in one task.

    ``anchors``: id, label, v, own, group and ``extra`` (array<long>) columns; ``search(anchors, candidates)``
    gets dicts of arrays and gives lists of columns.
    """
    spark = rows.sparkSession
    count = rows.count()
    groups = (anchors.agg(F.max("group")).first()[0] or 0) + 1
    blocks = max(1, -(-count // BLOCK_ROWS))
    none = F.lit(None).cast("array<long>")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select("group", every(blocks).alias("block"), F.lit(0).alias("role"), "id", "label", "v", "own", *extra)
    c = rows.select(every(groups).alias("group"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("role"), "id", "label", "v", "own", *[none.alias(x) for x in extra])
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def columns(parts: list[pa.RecordBatch], width: int) -> dict:
        t = pa.Table.from_batches(parts)
        found = {x: t.column(x).to_numpy() for x in ("id", "label", "own")}
        return found | {"v": _matrix(t.column("v"), width)} | {x: t.column(x).to_pylist() for x in extra}

    def run(batches):
        def close(parts):
            if parts[0] and parts[1]:
                width = max(int(np.diff(p.column("v").offsets.to_numpy()).max(initial=0)) for side in parts for p in side)
                out = search(columns(parts[0], width), columns(parts[1], width))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, target)], schema=target)

        cell, parts = None, ([], [])
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if first == last:
                    continue
                now = tuple(keys[first, :2].tolist())
                if now != cell:
                    yield from close(parts)
                    cell, parts = now, ([], [])
                parts[keys[first, 2]].append(batch.slice(first, last - first))
        yield from close(parts)

    both = a.unionByName(c)
    tasks = min(groups * blocks, 20_000)
    return both.repartition(tasks, "group", "block").sortWithinPartitions("group", "block", "role").mapInArrow(run, fields)


def _grouped(rows: DataFrame) -> DataFrame:
    """The anchors with the number of their group; similar ones come together, by signs of projections."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
            v = _matrix(lists, width).astype(np.float64)
            # components have the same projections in every batch
            signs = np.stack([v @ np.random.default_rng([5, i]).standard_normal(width) > 0 for i in range(SIGNS)], axis=1)
            code = signs @ (1 << np.arange(SIGNS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int64))], names=[*batch.schema.names, "code"])

    coded = rows.where("anchor").select("id", "label", "v", "own").mapInArrow(run, "id long, label long, v array<long>, own long, code long")
    placed = with_row_index(coded, ["code", "id", "label", "own"], "place")
    return placed.select("id", "label", "v", "own", F.floor(F.col("place") / GROUP_ANCHORS).cast("int").alias("group"))


def _first(found: DataFrame, keys: list[str], id_: str, score: str, top: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= top)


def _top(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, ties to the smaller id."""
    if len(ids) > 4 * top:
        least = -np.partition(-scores, top - 1)[top - 1]
        kept = np.flatnonzero(scores >= least)
        return kept[np.lexsort((ids[kept], -scores[kept]))[:top]]
    return np.lexsort((ids, -scores))[:top]


def positives(rows: DataFrame, anchors: DataFrame, top: int) -> DataFrame:
    """(anchor: its ``own``, positive, score): the ``top`` best rows of each anchor's label."""

    def search(a, c):
        order = np.argsort(c["label"], kind="stable")
        labels = c["label"][order]
        begin, end = np.searchsorted(labels, a["label"], "left"), np.searchsorted(labels, a["label"], "right")
        out = ([], [], [])

        def overlapping(node, low, high):
            due = np.zeros(len(low), bool)
            own = order[begin[node] : end[node]]
            own = own[c["id"][own] != a["id"][node]]
            if len(own) > top:
                # whatever cannot reach the top-th lower bound is out
                own = own[high[own] >= -np.partition(-low[own], top - 1)[top - 1]]
            due[own] = True
            return due

        for node, places, scores in walk(a["v"], c["v"], overlapping):
            best = _top(c["id"][places], scores, top)
            out[0].append(np.full(len(best), a["own"][node]))
            out[1].append(c["id"][places[best]])
            out[2].append(scores[best])
        return [np.concatenate(x) for x in out]

    found = _cells(rows, anchors, [], "anchor long, positive long, score long", search)
    return _first(found, ["anchor"], "positive", "score", top, "place").drop("place")


def negatives(rows: DataFrame, anchors: DataFrame, top: int, least: int, most: int) -> DataFrame:
    """(anchor, own, positive, positive_score, negative, score): per positive the ``top`` best rows of other labels
    with ``least * positive_score <= 100 * score <= most * positive_score``.

    ``anchors`` carries arrays ``positives`` and ``scores``.
    """

    def search(a, c):
        lows = [[-(-least * s // 100) for s in scores] for scores in a["scores"]]
        highs = [[most * s // 100 for s in scores] for scores in a["scores"]]
        out = ([], [], [], [], [], [])

        def overlapping(node, low, high):
            due = np.zeros(len(low), bool)
            for l, h in zip(lows[node], highs[node]):
                if l <= h:
                    due |= (high >= l) & (low <= h)
            return due & (c["label"] != a["label"][node]) & (c["id"] != a["id"][node])

        for node, places, scores in walk(a["v"], c["v"], overlapping):
            ids = c["id"][places]
            for positive, own, l, h in zip(a["positives"][node], a["scores"][node], lows[node], highs[node]):
                within = np.flatnonzero((scores >= l) & (scores <= h))
                best = within[_top(ids[within], scores[within], top)]
                out[0].append(np.full(len(best), a["id"][node]))
                out[1].append(np.full(len(best), a["own"][node]))
                out[2].append(np.full(len(best), positive))
                out[3].append(np.full(len(best), own))
                out[4].append(ids[best])
                out[5].append(scores[best])
        return [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]

    schema = "anchor long, own long, positive long, positive_score long, negative long, score long"
    return _cells(rows, anchors, ["positives", "scores"], schema, search)


def mine(
    table: DataFrame,
    is_anchor,
    label: Column | str = "label",
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 3,
    least: int = 50,
    most: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are integer inner products of ``floor(scale * x)``; higher first, ties by the
    smaller id. An anchor's positives are its best ``n_positives`` other rows of the same
    label; its negatives, for each positive, the best ``n_negatives`` rows of another label
    whose score is ``least`` to ``most`` hundredths of the positive's. All of it is exact.

    Rows as in ``whole_vectors``. Rows with the anchor's own id are neither positives nor
    negatives. Rows of one id with unlike labels or vectors are rows of their own. Of
    vectors of unequal length the common components count. Fewer rows than asked for give
    what there is; an anchor without positives, or without rows in a window, gives none.
    """
    spark = table.sparkSession
    rows = written(whole_vectors(table, is_anchor, key, vector, label, scale), "whole-vectors")
    anchors = written(_grouped(rows), "anchors")
    named = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if anchors.isEmpty():
        return spark.createDataFrame([], named)
    found = written(positives(rows, anchors, n_positives), "positives")
    # at most n_positives each; one id with one score asks once
    lists = found.groupBy("anchor").agg(F.sort_array(F.collect_set(F.struct("positive", "score"))).alias("p"))
    asked = anchors.join(lists, anchors["own"] == lists["anchor"])
    asked = asked.select("id", "label", "v", "own", "group", F.col("p.positive").alias("positives"), F.col("p.score").alias("scores"))
    best = negatives(rows, written(asked, "asked"), n_negatives, least, most)
    ranked = _first(best, ["own", "positive", "positive_score"], "negative", "score", n_negatives, "rank")
    return ranked.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
