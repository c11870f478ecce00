"""Nearest neighbours by multiprobe p-stable hashing, with exact distances at the end.

Each table hashes a vector to the cells that several Gaussian projections of it
fall in. A query visits cells in the order of the estimated probability that a
neighbour lies there, until the probabilities add up to a target; candidates of
all tables are compared by exact distance. Cells lie in blocks of bounded size;
a block's vectors are held in a task while the queries that visit it stream by.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftframe.llm.common import hash_sample, written

# bounded sample that the index is fitted on
FIT_ROWS = 20_000
FIT_QUERIES = 200
# vectors per cell aimed at, per block, and per part of a crowded cell; queries per task of probes
CELL_ROWS = 512
BLOCK_ROWS = 8_192
PROBED_QUERIES = 128
# cells a query considers per table and step
MOST_CELLS = 20_000


@dataclass
class Index:
    """Projections (table, hash, dimension), offsets, cell width, and the neighbour distance expected."""

    projections: np.ndarray
    offsets: np.ndarray
    width: float
    reach: float
    target: float
    most: int = MOST_CELLS

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Cell numbers, vectors by tables by hashes."""
        return np.floor(self.places(vectors)).astype(np.int64)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        return (np.einsum("nd,thd->nth", vectors, self.projections) + self.offsets) / self.width

    def codes(self, cells: np.ndarray, table: int) -> np.ndarray:
        """One number per cell combination of a table (last axis: hashes)."""
        with np.errstate(over="ignore"):
            code = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15 + table, np.uint64)
            for h in range(cells.shape[-1]):
                code = (code ^ cells[..., h].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                code ^= code >> np.uint64(31)
        return code.view(np.int64)

    def probes(self, vector: np.ndarray) -> np.ndarray:
        """Codes of the cells to visit, most promising first within each table.

        None at all where the cells considered in a table hold less than the target:
        such a query has to look at everything.
        """
        out = []
        for table, place in enumerate(self.places(vector[None])[0]):
            cells, chance = likely_cells(place, self.reach / self.width, self.most)
            order = np.argsort(-chance, kind="stable")
            mass = np.cumsum(chance[order])
            if mass[-1] < self.target:
                return np.zeros(0, np.int64)
            enough = int(np.searchsorted(mass, self.target)) + 1
            out.append(self.codes(cells[order[:enough]], table))
        return np.concatenate(out)


def likely_cells(place: np.ndarray, spread: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` cells around a place of one table, and the probability that a neighbour lies in each."""
    side = int(math.ceil(3.5 * spread)) + 1
    steps = np.arange(-side, side + 1)
    cells = np.zeros((1, 0), np.int64)
    chance = np.ones(1)
    for x in place:
        base = math.floor(x)
        low = (base + steps - x) / (spread * math.sqrt(2))
        mass = 0.5 * (_erf(low + 1 / (spread * math.sqrt(2))) - _erf(low))
        useful = np.flatnonzero(mass > 1e-4)
        chance = (chance[:, None] * mass[useful]).ravel()
        added = np.tile(base + steps[useful], len(cells))
        cells = np.column_stack((np.repeat(cells, len(useful), axis=0), added))
        if len(chance) > most:
            best = np.argpartition(-chance, most)[:most]
            cells, chance = cells[best], chance[best]
    return cells, chance


def fitting_hashes(hashes: int, spread: float, target: float, most: int) -> int:
    """The most hashes up to ``hashes`` whose cells considered hold the target for nine of ten places."""
    places = np.random.default_rng(11).uniform(0, 1, (20, hashes))
    while hashes > 1:
        kept = [likely_cells(p[:hashes], spread, most)[1].sum() for p in places]
        if np.mean(np.array(kept) >= target) >= 0.9:
            break
        hashes -= 1
    return hashes


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in np.ravel(x)]).reshape(np.shape(x))


def fit(vectors: DataFrame, rows: int, tables: int = 2, recall: float = 0.95, neighbours: int = 10, seed: int = 7) -> Index | None:
    """Index fitted on up to ``FIT_ROWS`` vectors in the order of a hash; None without vectors.

    The distance that neighbours are expected at is that of the sample, which is
    no nearer than in the whole table, so cells are rather visited than left out.
    The number of hashes follows ``rows``, so that a cell holds some hundreds of them,
    but is no larger than lets the cells that a query considers hold the target.
    """
    picked = hash_sample(vectors.select("vector"), "vector", FIT_ROWS, rows).collect()
    sample = np.array([r["vector"] for r in picked], np.float64)
    if not len(sample):
        return None
    queries = sample[:: max(1, len(sample) // FIT_QUERIES)][:FIT_QUERIES]
    nearest = []
    for q in queries:
        d = np.sort(np.sqrt(((sample - q) ** 2).sum(axis=1)))
        nearest.append(d[min(neighbours, len(d) - 1)])
    reach = float(np.median(nearest)) or 1e-9
    rng = np.random.default_rng(seed)
    width = 1.5 * reach
    trial = rng.standard_normal((16, sample.shape[1]))
    bits = []
    for p in trial:
        counts = np.unique(np.floor(sample @ p / width), return_counts=True)[1] / len(sample)
        bits.append(float(-(counts * np.log2(counts)).sum()))
    hashes = round(math.log2(max(2.0, rows / CELL_ROWS)) / max(0.05, float(np.mean(bits))))
    target = 1 - (1 - recall) ** (1 / tables)
    hashes = fitting_hashes(min(24, max(1, hashes)), reach / width, target, MOST_CELLS)
    projections = rng.standard_normal((tables, hashes, sample.shape[1]))
    offsets = rng.uniform(0, width, (tables, hashes))
    return Index(projections, offsets, width, reach, target, MOST_CELLS)


def valid_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector: array<double>) of rows with an id and a finite, non-zero vector of the common length.

    The common length is the most frequent one (the longer of equally frequent).
    """
    rows = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("vector", odd) & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (lengths["n"] if lengths else 0))


def _coded(distinct: DataFrame, index: Index) -> DataFrame:
    """(id, vector, code) rows of the indexed vectors, one per table."""

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1))
            cells = index.cells(vectors)
            for t in range(cells.shape[1]):
                codes = index.codes(cells[:, t], t)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes)], names=["id", "vector", "code"])

    return distinct.select("id", "vector").mapInArrow(run, "id long, vector array<double>, code long")


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _probed(queries: DataFrame, index: Index) -> DataFrame:
    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1))
            for first in range(0, len(vectors), 32):
                codes = [index.probes(v) for v in vectors[first : first + 32]]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(codes)))
                part = batch.slice(first, len(codes))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "codes"])

    return queries.select("id", "vector").mapInArrow(run, "id long, codes array<long>")


def _search_blocks(placed: DataFrame, visits: DataFrame, top: int, blocks: int) -> DataFrame:
    """(query, id, distance): per query and block the ``top`` nearest among the cells it visits.

    ``placed``: (block, id, vector, code); ``visits``: (block, id, vector, codes), codes
    null for a query that looks at the whole block. Vectors of a block come before
    its queries; a block's vectors and one batch of queries are in memory.
    """
    a = placed.select("block", F.lit(0).alias("role"), "id", "vector", F.array("code").alias("codes"))
    b = visits.select("block", F.lit(1).alias("role"), "id", "vector", "codes")

    def run(batches):
        block, ids, vectors, codes = None, [], [], []
        ready = None
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            blocks, roles = columns[0].to_numpy(), columns[1].to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(roles) != 0)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                part = batch.slice(first, last - first)
                if blocks[first] != block:
                    block, ids, vectors, codes, ready = blocks[first], [], [], [], None
                if roles[first] == 0:
                    ids.append(part.column(2).to_numpy())
                    vectors.append(_matrix(part.column(3)))
                    codes.append(part.column(4).flatten().to_numpy())
                    continue
                if not ids:
                    continue
                if ready is None:
                    code = np.concatenate(codes)
                    order = np.argsort(code, kind="stable")
                    ready = np.concatenate(ids)[order], np.concatenate(vectors)[order], code[order]
                yield from _nearest(part, *ready, top)

    schema = "query long, id long, distance double"
    rows = a.unionByName(b)
    return rows.repartition(min(blocks, 20_000), "block").sortWithinPartitions("block", "role").mapInArrow(run, schema)


def _nearest(part, ids, vectors, codes, top):
    queries, points = part.column(2).to_pylist(), _matrix(part.column(3))
    out_q, out_i, out_d = [], [], []
    for query, point, wanted in zip(queries, points, part.column(4)):
        if wanted.as_py() is None:
            rows = np.arange(len(ids))
        else:
            wanted = np.unique(wanted.values.to_numpy())
            begin, end = np.searchsorted(codes, wanted, "left"), np.searchsorted(codes, wanted, "right")
            sizes = end - begin
            begin, sizes = begin[sizes > 0], sizes[sizes > 0]
            if not len(sizes):
                continue
            rows = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        distance = np.sqrt(((vectors[rows] - point) ** 2).sum(axis=1))
        # a vector may come from several tables; keep spare ones for that
        found = ids[rows]
        found, first = np.unique(found, return_index=True)
        distance = distance[first]
        best = np.lexsort((found, distance))[:top]
        out_q += [query] * len(best)
        out_i += found[best].tolist()
        out_d += distance[best].tolist()
    if out_q:
        yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_d)], names=["query", "id", "distance"])


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    once = found.groupBy("query", "id").agg(F.min("distance").alias("distance"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


def nearest_neighbours(
    table: DataFrame,
    is_query,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    tables: int = 2,
    recall: float = 0.95,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row where ``is_query`` holds.

    Score is the Euclidean distance in double precision; ties go to the smaller id.
    Rows with the query's own id are no candidates. Rows without an id, and null,
    zero, non-finite or odd-length vectors take no part. Equal vectors are indexed
    once with their ``k + 1`` smallest ids, which is all an answer can need. A query
    whose cells hold too few rows, or too little of the target probability, is
    compared with all of them, block by block.
    """
    spark = table.sparkSession
    rows = written(valid_vectors(table, key, vector), "vectors")
    by_vector = Window.partitionBy("vector").orderBy("id")
    few = rows.distinct().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = written(distinct.withColumn("id", F.element_at("ids", 1)), "distinct-vectors")
    count = distinct.count()
    asked = rows.where(is_query(F.col("id"))).select("id", "vector").distinct()
    asked = written(asked, "asked")
    queries = written(asked.groupBy("vector").agg(F.min("id").alias("id")), "queries")
    index = fit(distinct, count, tables, recall, k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    blocks = max(1, -(-count * tables // BLOCK_ROWS))
    placed = _coded(distinct, index)
    crowded = placed.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS // 2)
    crowded = written(crowded.select("code", F.ceil(F.col("n") / (BLOCK_ROWS // 2)).cast("long").alias("parts")), "crowded")
    block = F.pmod(F.xxhash64("code", "part"), F.lit(blocks)).cast("int")
    placed = placed.join(crowded, "code", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    placed = written(placed.select(block.alias("block"), "id", "vector", "code"), "placed")
    asking = queries.count()
    spread = queries.repartition(min(20_000, asking // PROBED_QUERIES + 1), "id")
    visits = _probed(spread, index).select("id", F.explode("codes").alias("code")).join(crowded, "code", "left")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    visits = visits.groupBy("id", block.alias("block")).agg(F.collect_list("code").alias("codes"))
    visits = visits.join(queries, "id").select("block", "id", "vector", "codes")
    # own vector and k others
    top = k + 1
    found = written(_best(_search_blocks(placed, visits, top, blocks), top), "found")
    enough = found.groupBy("query").count().where(F.col("count") >= min(top, count))
    short = queries.join(enough, queries["id"] == enough["query"], "left_anti")
    # the others look at every block
    every = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("codes", F.lit(None).cast("array<long>"))
    rest = _best(_search_blocks(placed, every.select("block", "id", "vector", "codes"), top, blocks), top)
    found = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(rest)
    wide = found.join(distinct.select("id", "ids"), "id").select("query", "distance", F.explode("ids").alias("vec_id"))
    named = asked.join(queries.select("vector", F.col("id").alias("query")), "vector").select(F.col("id").alias("query_id"), "query")
    pairs = named.join(wide, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("distance").alias("score"))
