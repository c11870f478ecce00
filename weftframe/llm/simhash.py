"""SimHash fingerprints, links between close ones, and near-duplicate groups; groups of similar texts.

Fingerprints are 64 bits. Two of them at ``distance`` or fewer differing bits
agree on at least ``blocks - distance`` of ``blocks`` bit blocks, so they meet
under at least one choice of that many blocks. Links are sought under every
choice, then verified by counting the differing bits.

Similar texts meet by fingerprint first, then at their rarest shingles: see ``similar_texts``.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftframe.llm.common import discard, hash_sample, map_batches, settled, written
from weftframe.llm.components import connected_components

SEED = 42
BITS = 64
# shingle hashes whose bits are counted at a time, to bound memory on long texts
_PIECE = 1 << 15
# buckets up to this size are paired; larger ones go by stars, which stay linear
PAIR_LIMIT = 128
# texts of a crowded bucket that all others are compared with in a round
LEADERS = 4
# texts that frequent shingles are looked for in, and how many of those are known
COMMON_TEXTS = 4_000
MOST_COMMON = 200_000
# words whose hashes a worker keeps
_KNOWN_WORDS = 400_000
_known: dict[bytes, int] = {}


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(set_bits: np.ndarray) -> int:
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def shingle_spans(words: list[bytes], width: int) -> list[bytes]:
    """All runs of ``width`` words, blank-joined; fewer words make one run, none make none."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return [joined[s:e] for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())]


def shingle_fingerprint(text: bytes | None, width: int) -> int:
    """Majority bits over the hashes of all word shingles, repeats included."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    spans = shingle_spans(words, width)
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), _PIECE):
        piece = spans[at : at + _PIECE]
        hashes = np.fromiter((digest(s, SEED) for s in piece), np.uint64, len(piece))
        counts += _bits(hashes).sum(axis=0, dtype=np.int64)
    return _packed(counts * 2 > len(spans))


def _word_hashes(words) -> np.ndarray:
    if len(_known) > _KNOWN_WORDS:
        _known.clear()
    hashes = []
    for word in words:
        h = _known.get(word)
        if h is None:
            h = _known[word] = xxhash.xxh64_intdigest(word, SEED)
        hashes.append(h)
    return np.array(hashes, np.uint64)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Different hashes of all runs of ``width`` words; of all words if they are fewer."""
    words = _word_hashes((text or b"").lower().split())
    if not len(words):
        return np.zeros(0, np.int64)
    width = min(width, len(words))
    runs = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        runs = (runs + words[i : i + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return np.unique(runs.view(np.int64))


def word_fingerprint(text: bytes | None) -> int:
    """Majority bits over the distinct words, each weighing 1 + ln(its count).

    Changing a few words moves few bits, whereas each changed word breaks every
    shingle over it; so this finds candidates at lower similarity.
    """
    counted = Counter((text or b"").lower().split())
    if not counted:
        return 0
    hashes = _word_hashes(counted)
    weights = 1 + np.log(np.fromiter(counted.values(), np.float64, len(counted)))
    sums = np.zeros(BITS)
    for at in range(0, len(hashes), _PIECE):
        sums += weights[at : at + _PIECE] @ _bits(hashes[at : at + _PIECE])
    return _packed(sums * 2 > weights.sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int | None = 3) -> DataFrame:
    """(key, fingerprint: long) of every row; ``width`` None takes weighted words.

    A null text counts as empty; a text without words has fingerprint 0. Other
    columns are not read. Rows with a null key are kept.
    """

    def run(batch):
        if width is None:
            prints = [word_fingerprint(t) for t in batch["t"]]
        else:
            prints = [shingle_fingerprint(t, width) for t in batch["t"]]
        return {"k": batch["k"], "fingerprint": prints}

    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return map_batches(slim, run, "k long, fingerprint long").withColumnRenamed("k", key)


def block_masks(distance: int, blocks: int) -> list[int]:
    """One mask for each choice of the blocks that close fingerprints must share (as signed longs)."""
    if not 0 <= distance < blocks <= BITS:
        raise ValueError("distance must be below the number of blocks")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def with_buckets(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """One row per row and choice of blocks: its number and the shared bits."""
    masks = _longs(block_masks(distance, blocks))
    rows = prints.select("*", F.posexplode(masks).alias("choice", "mask"))
    return rows.withColumn("shared", F.col("fingerprint").bitwiseAND(F.col("mask"))).drop("mask")


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _sized(buckets: DataFrame) -> DataFrame:
    """Rows of buckets with two or more rows, with the bucket's size."""
    sizes = buckets.groupBy("choice", "shared").agg(F.count("*").alias("size")).where("size > 1")
    return buckets.join(sizes, ["choice", "shared"])


def points_around(prints: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, point) for every point that differs in ``radius`` or fewer bits, once each.

    A bit is flipped per step, above the one before; place 64 flips none and has none above it.
    So the plan holds no list of all flips.
    """
    points = prints.select("fingerprint", F.col("fingerprint").alias("point"), F.lit(-1).alias("bit"))
    for _ in range(radius):
        points = points.select("fingerprint", "point", F.explode(F.sequence(F.least(F.col("bit") + 1, F.lit(BITS)), F.lit(BITS))).alias("bit"))
        flip = F.when(F.col("bit") < BITS, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
        points = points.select("fingerprint", F.col("point").bitwiseXOR(flip).alias("point"), "bit")
    return points.select("fingerprint", "point")


def close_links(distinct: DataFrame, distance: int = 3, blocks: int = 5, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (x, y) between distinct fingerprints, enough to join all that are close.

    Buckets of up to ``pair_limit`` are paired. The fingerprints of larger ones
    meet instead at the points between them: whatever is within half the distance
    of a point links to the smallest fingerprint within the other half, which is
    close to both. That joins the same groups with rows in proportion to the
    fingerprints, however dense a bucket is. ``distance`` is 3 at most there.
    """
    sized = settled(_sized(with_buckets(distinct.select("fingerprint"), distance, blocks)), "buckets")
    cool = sized.where(F.col("size") <= pair_limit).select("choice", "shared", "fingerprint")
    a = cool.withColumnRenamed("fingerprint", "x")
    b = cool.withColumnRenamed("fingerprint", "y")
    pairs = a.join(b, ["choice", "shared"]).where((F.col("x") < F.col("y")) & (_differing("x", "y") <= distance))
    pairs = pairs.select("x", "y")

    hot = written(sized.where(F.col("size") > pair_limit).select("fingerprint").distinct(), "hot")
    if hot.isEmpty():
        return pairs.distinct()
    near = distance // 2
    centres = points_around(hot, near).groupBy("point").agg(F.min("fingerprint").alias("x"))
    # Spark takes exploded rows for as small as the table they come of; a broadcast of them would fill the driver
    stars = points_around(hot, distance - near).hint("merge").join(centres, "point").where(F.col("x") < F.col("fingerprint"))
    stars = stars.select("x", F.col("fingerprint").alias("y"))
    return pairs.union(stars).distinct()


def leader_links(leaders: DataFrame, distance: int = 3, blocks: int = 5, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``close_links`` between the leaders of (fingerprint, leader), as (a, b)."""
    # a table of its own: with the joins that follow it would be one plan of many stages for the driver to keep
    links = settled(close_links(leaders, distance, blocks, pair_limit), "close")
    return (
        links.join(leaders.select(F.col("fingerprint").alias("x"), F.col("leader").alias("a")), "x")
        .join(leaders.select(F.col("fingerprint").alias("y"), F.col("leader").alias("b")), "y")
        .select("a", "b")
    )


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of (id, fingerprint), a table: leaders of close fingerprints, and each with its equals."""
    leaders = written(prints.groupBy("fingerprint").agg(F.min("id").alias("leader")), "leaders")
    equals = prints.join(leaders, "fingerprint").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    return settled(leader_links(leaders).union(equals).where("a <> b"), "close-ids")


def near_groups(prints: DataFrame, key: str = "doc_id", distance: int = 3, blocks: int = 5, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(key, fingerprint, component_id): smallest key reachable over close fingerprints.

    Rows of equal fingerprint are one group before any pairing. Repeated keys are
    repeated rows; rows with a null key get the component of their fingerprint
    (null if it has no other). An empty table gives no rows.
    """
    leaders = prints.groupBy("fingerprint").agg(F.min(key).alias("leader"))
    leaders = written(leaders, "leaders")
    groups = connected_components(leader_links(leaders, distance, blocks, pair_limit))
    labels = leaders.join(groups, leaders["leader"] == groups["node"], "left").select(
        "fingerprint", F.coalesce("component", "leader").alias("component_id")
    )
    return prints.join(labels, "fingerprint").select(key, "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """Fingerprint, hexadecimal, and component of every row of ``docs``."""
    prints = written(fingerprints(docs, key, text, width), "prints")
    grouped = near_groups(prints, key, distance, blocks)
    return grouped.select(key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def parity_sketch(hashes: np.ndarray) -> bytes:
    """A bit per place, of as many places (a power of two) as there are hashes or more: whether an odd number falls there."""
    places = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount(hashes.view(np.uint64).astype(np.int64) & (places - 1), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Elements that only one of two sets has, at least: places where their parity sketches differ."""
    x, y = (a, b) if len(a) >= len(b) else (b, a)
    wide, places, y = int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little")
    while places > 8 * min(len(a), len(b)):  # folded, places of the wider one meet as in the narrower
        places //= 2
        wide = (wide >> places) ^ (wide & ((1 << places) - 1))
    return (wide ^ y).bit_count()


def profiles(texts: DataFrame, width: int) -> DataFrame:
    """(id, digest, fingerprint, size, sketch) of (id, digest, text): weighted words, number of different shingles
    and their parities (some 2 bits a word), so that most steps need not read or shuffle a text."""

    def run(batch):
        found = [shingle_hashes(t, width) for t in batch["text"]]
        return {
            "id": batch["id"],
            "digest": batch["digest"],
            "fingerprint": [word_fingerprint(t) for t in batch["text"]],
            "size": [len(h) for h in found],
            "sketch": [parity_sketch(h) for h in found],
        }

    return map_batches(texts.select("id", "digest", "text"), run, "id long, digest binary, fingerprint long, size int, sketch binary")


def with_room(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The different pairs (a, b) that may reach ``similarity`` by their sizes and sketches; loses none that do.

    Two sets of that similarity differ in at most (1 - s) / (1 + s) of their summed sizes.
    """
    left = sketched.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    right = sketched.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))
    most = (1 - similarity) / (1 + similarity)

    def run(batch):
        out = {"a": [], "b": []}
        for a, b, na, nb, sa, sb in zip(*(batch[c] for c in ("a", "b", "na", "nb", "sa", "sb"))):
            if least_difference(sa, sb) <= most * (na + nb) + 1e-6:
                out["a"].append(a)
                out["b"].append(b)
        return out

    met = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    met = met.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
    return map_batches(met.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long")


def jaccard_at_least(pairs: DataFrame, texts: DataFrame, width: int, similarity: float, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) whose word-shingle sets overlap by ``similarity`` or more.

    ``texts`` holds (id, text), ``sketched`` their ``profiles``; of several texts of an id one similar
    one is enough. Pairs that the sketches leave room for are compared on the texts, in tasks, pair by
    pair; only texts of those are shuffled.
    """
    pairs = settled(with_room(pairs, sketched, similarity).distinct(), "pairs")
    # a table, so that its size is known when the join with the texts is planned
    due = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "due")
    texts = texts.join(due, "id", "left_semi")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batch):
        out = {"a": [], "b": []}
        seen: dict[bytes, set] = {}  # a crowded bucket's leader comes in many pairs

        def spans(words: bytes | None) -> set:
            found = seen.get(words)
            if found is None:
                if len(seen) > 64:
                    seen.clear()
                found = seen[words] = set(shingle_spans((words or b"").lower().split(), width))
            return found

        for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
            sa, sb = spans(ta), spans(tb)
            both = len(sa & sb)
            if both >= similarity * (len(sa) + len(sb) - both):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_batches(joined, run, "a long, b long")


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that several texts of a bounded sample share, the most frequent last."""
    sample = hash_sample(texts.select("id", "text"), "id", COMMON_TEXTS, texts.count())

    def run(batch):
        found = [shingle_hashes(t, width) for t in batch["text"]]
        return {"hash": np.concatenate(found) if found else []}

    counted = map_batches(sample, run, "hash long").groupBy("hash").count().where("count > 2")
    rows = counted.orderBy(F.desc("count"), "hash").limit(MOST_COMMON).toArrow()
    return rows.column("hash").to_numpy()[::-1].copy()


def rare_shingles(texts: DataFrame, width: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """(hash, id, size, place): the first shingles of every text in one order for all texts.

    Shingles not known as frequent come first, by hash. Two sets of which the larger
    shares ``similarity`` of its shingles cannot both lack the other's first
    ``size - ceil(similarity * size) + 1``; so similar texts meet at one of them at
    least, whatever the order. It only decides how many others meet there.
    """
    by_hash = np.argsort(frequent)
    values, ranks = frequent[by_hash], by_hash + 1
    schema = "hash long, id long, size int, place int"
    names = ["hash", "id", "size", "place"]

    def run(batches):
        for batch in batches:
            parts, rows = [], 0
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                hashes = shingle_hashes(text, width)
                size = len(hashes)
                if not size:
                    continue
                rank = np.zeros(size, np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
                    rank = np.where(values[at] == hashes, ranks[at], 0)
                first = np.lexsort((hashes, rank))[: size - math.ceil(similarity * size - 1e-6) + 1]
                places = np.arange(len(first), dtype=np.int32)
                parts.append((hashes[first], np.full(len(first), id_, np.int64), np.full(len(first), size, np.int32), places))
                rows += len(first)
                if rows > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)
                    parts, rows = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)

    return texts.select("id", "text").mapInArrow(run, schema)


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose hash other rows have too, in one pass over the sorted rows."""

    def run(batches):
        held, hit = None, False  # the last row waits for the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            hashes = batch.column(0).to_numpy()
            same = hashes[1:] == hashes[:-1]
            before = np.concatenate(([hit], same))
            yield batch.slice(0, len(hashes) - 1).filter(pa.array(before[:-1] | same))
            held, hit = batch.slice(len(hashes) - 1), bool(before[-1])
        if hit:
            yield held

    return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, rows.schema)


def _may_be_similar(a, b, similarity: float) -> Column:
    """Whether sizes and places of a shared shingle leave room; true at the first one that similar texts share."""
    after = F.least(a["size"] - a["place"], b["size"] - b["place"])
    return (after >= similarity / (1 + similarity) * (a["size"] + b["size"]) - 1e-6) & (
        F.least(a["size"], b["size"]) >= similarity * F.greatest(a["size"], b["size"]) - 1e-6
    )


def _joined(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The groups that further links make of ``connected_components``' groups."""
    return connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found.select("a", "b")))


def _still_apart(pool: DataFrame, groups: DataFrame) -> DataFrame:
    """The pool, written, with the group of each text so far, without the buckets that lie in one group."""
    pool = pool.select("hash", "id", "size", "place")
    pool = pool.join(groups, pool["id"] == groups["node"], "left").withColumn("group", F.coalesce("component", "id"))
    pool = settled(pool.select("hash", "id", "size", "place", "group"), "pool")
    apart = pool.groupBy("hash").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    left = written(pool.join(apart.select("hash"), "hash", "left_semi"), "pool")
    discard(pool)
    return left


def _pairs_within(pool: DataFrame, similarity: float, side: int) -> DataFrame:
    """All pairs (a, b) of a bucket that may be similar and are in different groups.

    A bucket is cut into blocks of about ``side`` texts and every two blocks meet in
    their own join key, so a crowded one spreads over tasks.
    """
    sizes = pool.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    rows = pool.join(sizes, "hash").withColumn("blocks", F.ceil(F.col("n") / side).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["hash", "low", "high"]
    rows = rows.select("hash", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.struct("id", "size", "place", "group", "own").alias("x"))
    a, b = F.col("x"), F.col("y")
    # exploded rows: never to be broadcast by the size of the table they come of
    met = rows.hint("merge").join(rows.withColumnRenamed("x", "y"), keys).where((a["id"] < b["id"]) & (a["group"] != b["group"]))
    met = met.where(((F.col("low") == F.col("high")) | (a["own"] != b["own"])) & _may_be_similar(a, b, similarity))
    return met.select(a["id"].alias("a"), b["id"].alias("b"))


def similar_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    pair_limit: int = 64,
    rounds: int = 2,
) -> DataFrame:
    """(key, component_id): groups of equal texts and of texts at ``similarity`` or more.

    Texts of close SimHash fingerprints are compared first, and linked where their shingle
    sets confirm it. Exact: the rest meet in a bucket for each of their rarest shingles, as many as it
    takes for all similar ones to meet (``rare_shingles``), and are compared on the
    sets of ``width``-word shingles. Equal texts (A-Z in lower case, gaps alike) are
    one before any pairing. In a bucket of more than ``pair_limit`` texts all are first
    compared with a few of its texts, those with most links so far, for ``rounds``
    rounds; buckets that this brings into one group are done. All pairs that are left
    and not yet in one group are compared, however many. Null texts count as empty;
    texts without words are equal to each other. Null keys are left out. Repeated
    keys are one node, linked by any of their texts. ``docs`` is read several times.
    """
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+", " "))
    # copies get a profile too: that is less than a shuffle of all texts to leave them out
    profiled = written(profiles(known.select("id", F.unhex(F.sha2(plain, 256)).alias("digest"), "text"), width), "profiles")
    firsts = profiled.groupBy("digest").agg(F.min("id").alias("first"))
    same = settled(profiled.select("id", "digest").join(firsts, "digest").select("id", "first"), "first-texts")
    # copies take no part; texts are read where they are needed, not stored again
    kept = written(same.where("id = first").select("id").distinct(), "kept")
    distinct = known.join(kept, "id", "left_semi")
    sketched = written(profiled.join(kept, "id", "left_semi").select("id", "fingerprint", "size", "sketch"), "sketches")
    discard(profiled)
    links = settled(jaccard_at_least(fingerprint_pairs(sketched), known, width, similarity, sketched), "similar")
    rare = rare_shingles(distinct, width, similarity, frequent_shingles(known, width))
    groups = connected_components(links)
    pool = _still_apart(_repeated(rare), groups)
    for _ in range(rounds):
        sizes = pool.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > pair_limit)
        hot = written(pool.join(sizes.select("hash"), "hash"), "hot")
        if hot.isEmpty():
            break
        degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
        ranked = hot.join(degrees, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        order = Window.partitionBy("hash").orderBy(F.desc("links"), "id")
        lead = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS)
        lead = written(lead.select("hash", F.struct("id", "size", "place", "group").alias("y")), "leaders")
        a, b = F.col("x"), F.col("y")
        met = hot.select("hash", F.struct("id", "size", "place", "group").alias("x")).join(lead, "hash")
        met = met.where((a["group"] != b["group"]) & _may_be_similar(a, b, similarity))
        stars = met.select(F.least(a["id"], b["id"]).alias("a"), F.greatest(a["id"], b["id"]).alias("b"))
        found = settled(jaccard_at_least(stars, known, width, similarity, sketched), "similar")
        if not found.isEmpty():
            links, groups = links.union(found), _joined(groups, found)
        # leaders have met all others of their bucket
        rest = pool.join(lead.select("hash", b["id"].alias("id")), ["hash", "id"], "left_anti")
        last, pool = pool, _still_apart(rest, groups)
        discard(last, hot, lead)
    found = settled(jaccard_at_least(_pairs_within(pool, similarity, max(pair_limit, 512)), known, width, similarity, sketched), "similar")
    groups = _joined(groups, found)
    return same.join(groups, same["first"] == groups["node"], "left").select(
        F.col("id").alias(key), F.coalesce("component", "first").alias("component_id")
    )
