"""Merkle manifest of a table with a proof for every row, by multiproofs of leaf runs.

Rows are leaves; the leaves of each group, in order, are the bottom of a tree in
which up to ``ARITY`` consecutive nodes become one; the groups' tops are the leaves
of a further tree. Sorted leaves are dealt to runs. A run hashes the nodes that lie
wholly inside it; those that no single run covers are combined level by level. A run
then asks once for the few nodes outside it that its proofs need (at most
``2 * (ARITY - 1)`` a level, whatever its length), derives all others itself and
spells out the proof of each of its leaves.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftframe.llm.common import written

# consecutive nodes that become one
ARITY = 8
# leaves of a run, which is in memory in one task
RUN_ROWS = 16_384
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    """Hexadecimal SHA-256 of the fields one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered_text(text: Column, key: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the checksum of the key, else as it is."""
    chosen = F.crc32(key.cast("string")) % 3 == 0
    return F.when(chosen, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def level_sizes(n: int) -> list[int]:
    """How many nodes each level has, from ``n`` leaves up to one."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def covered(first: int, end: int, size: int, level: int, n: int) -> tuple[int, int]:
    """Nodes of a level, as a half-open range, whose leaves all lie in [first, end) of ``n``."""
    span = ARITY**level
    return -(-first // span), size if end == n else end // span


def missing(first: int, end: int, sizes: list[int]) -> list[tuple[int, int]]:
    """Coordinates (level, place) of the nodes that proofs of [first, end) need from outside: the least set."""
    out = []
    a, b = first, end - 1
    for level, size in enumerate(sizes[:-1]):
        low, high = a // ARITY * ARITY, min(size, (b // ARITY + 1) * ARITY)
        out += [(level, i) for i in [*range(low, a), *range(b + 1, high)]]
        a, b = a // ARITY, b // ARITY
    return out


def ancestors(first: int, leaves: list[str], sizes: list[int], outside: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Per level the nodes that proofs of the run need: its own ancestors and the fetched ones."""
    here = dict(enumerate(leaves, first))
    levels = [here]
    for level in range(len(sizes) - 1):
        here.update({i: h for (at, i), h in outside.items() if at == level})
        up: dict[int, list[str]] = {}
        for i in sorted(here):
            up.setdefault(i // ARITY, []).append(here[i])
        here = {i: _h("".join(hashes)) for i, hashes in up.items()}
        levels.append(here)
    return levels


def expand(place: int, leaf: str, levels: list[dict[int, str]], sizes: list[int]) -> tuple[list[str], str]:
    """Siblings of a leaf's path, level by level from left to right, and the top that folding ``leaf`` gives."""
    siblings: list[str] = []
    for level, size in enumerate(sizes[:-1]):
        low = place // ARITY * ARITY
        run = [levels[level][i] for i in range(low, min(size, low + ARITY))]
        own = place - low
        siblings += run[:own] + run[own + 1 :]
        leaf = _h("".join([*run[:own], leaf, *run[own + 1 :]]))
        place //= ARITY
    return siblings, leaf


def _runs(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, hash, fold and a payload; sorted by range already) with the run of each row and its place there.

    Adds ``part`` and ``run`` (which name the run within its group), ``at`` (order in
    the run), ``first`` (the run's first place in the group) and ``n`` (leaves of the group).
    """
    # both bit fields of the number that Spark gives to sorted rows: partition, then place
    numbered = leaves.withColumn("part", F.shiftright("_at", 33)).withColumn("at", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = numbered.groupBy("g", "part").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    # one row per partition of the sort and group that it touches
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    counts = counts.withColumn("n", F.sum("rows").over(Window.partitionBy("g")))
    rows = numbered.join(counts, ["g", "part"]).withColumn("place", F.col("at") - F.col("low"))
    rows = rows.withColumn("run", F.floor(F.col("place") / RUN_ROWS)).withColumn("first", F.col("before") + F.col("run") * RUN_ROWS)
    return rows.drop("_at", "low", "rows", "before", "place")


def _by_run(df: DataFrame) -> DataFrame:
    return df.repartition("g", "part", "run").sortWithinPartitions("g", "part", "run", "at")


def _each_run(batches):
    """(table of one run) by run, over sorted batches; columns g, part, run come first."""
    key, parts = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for low, high in zip([0, *cuts], [*cuts, len(keys)]):
            if low == high:
                continue
            if keys[low] != key and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            key = keys[low]
            parts.append(batch.slice(low, high - low))
    if parts:
        yield pa.Table.from_batches(parts)


_NODES = "g string, part long, run long, kind int, level int, place long, hash string, first long, n long"
# kinds of rows in that schema: a node made here, a node wanted, a run
_MADE, _WANTED, _RUN = 0, 1, 2


def _frontier(runs: DataFrame) -> DataFrame:
    """Of every run: the largest nodes that lie wholly inside it, the coordinates it misses, and the run itself."""

    def run(batches):
        for t in _each_run(batches):
            g, part, number, first, n = (t.column(c)[0].as_py() for c in ("g", "part", "run", "first", "n"))
            here = t.column("hash").to_pylist()
            end, sizes, out = first + t.num_rows, level_sizes(n), []
            low = first
            for level in range(len(sizes)):
                above = (0, 0) if level + 1 == len(sizes) else covered(first, end, sizes[level + 1], level + 1, n)
                # not under a larger node that is made here too
                out += [(_MADE, level, low + i, h) for i, h in enumerate(here) if not above[0] <= (low + i) // ARITY < above[1]]
                if above[0] >= above[1]:
                    break
                joined = lambda i: _h("".join(here[i * ARITY - low : (i + 1) * ARITY - low]))  # noqa: E731, B023
                here, low = [joined(i) for i in range(*above)], above[0]
            out += [(_WANTED, level, place, None) for level, place in missing(first, end, sizes)]
            out.append((_RUN, 0, 0, None))
            kind, level, place, hashes = zip(*out)
            fixed = {"g": g, "part": part, "run": number, "first": first, "n": n}
            same = {c: pa.array([v] * len(out), pa.string() if c == "g" else pa.int64()) for c, v in fixed.items()}
            yield pa.RecordBatch.from_arrays(
                [same["g"], same["part"], same["run"], pa.array(kind, pa.int32()), pa.array(level, pa.int32()),
                 pa.array(place, pa.int64()), pa.array(hashes, pa.string()), same["first"], same["n"]],
                names=["g", "part", "run", "kind", "level", "place", "hash", "first", "n"],
            )

    slim = _by_run(runs.select("g", "part", "run", "at", "hash", "first", "n"))
    return slim.mapInArrow(run, _NODES)


def _combined(frontier: DataFrame) -> DataFrame:
    """(g, level, place, hash, n) of all nodes that lie in no single run's larger node, and of the tops."""
    made = frontier.where(F.col("kind") == _MADE).select("g", "level", "place", "hash", "n")
    largest = made.agg(F.max("n")).first()[0] or 0
    here = made.where("level = 0")
    levels = [here]
    size = F.col("n")
    for level in range(1, len(level_sizes(largest))):
        # groups of more than one node at the level below
        up = here.where(size > ARITY ** (level - 1)).groupBy("g", F.floor(F.col("place") / ARITY).alias("place"), "n")
        joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]))
        up = up.agg(F.sha2(joined, 256).alias("hash")).select("g", F.lit(level).alias("level"), "place", "hash", "n")
        # what is made in one run is not under a node that needs several
        here = written(up.unionByName(made.where(F.col("level") == level)), "nodes")
        levels.append(here)
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _tops(nodes: DataFrame) -> DataFrame:
    """(g, top) of every group."""
    # a level is the last one when its single node covers all leaves
    last = (F.col("n") <= F.pow(F.lit(float(ARITY)), "level")) & ((F.col("level") == 0) | (F.col("n") > F.pow(F.lit(float(ARITY)), F.col("level") - 1)))
    return nodes.where(last).select("g", F.col("hash").alias("top"))


def _proved(runs: DataFrame, frontier: DataFrame, nodes: DataFrame, above: DataFrame | None, with_proof: bool) -> DataFrame:
    """Every leaf with its group's top and its proof; ``above`` holds (g, proof, ...) of the tops in the tree over the groups."""
    wanted = frontier.where(F.col("kind") == _WANTED).select("g", "part", "run", "level", "place")
    fetched = wanted.join(nodes.select("g", "level", "place", "hash"), ["g", "level", "place"])
    # at most 14 nodes a level
    fetched = fetched.groupBy("g", "part", "run").agg(F.collect_list(F.struct("level", "place", "hash")).alias("outside"))
    known = frontier.where(F.col("kind") == _RUN).select("g", "part", "run", "first", "n").join(fetched, ["g", "part", "run"], "left")
    if above is None:
        known = known.withColumn("above", F.lit(None).cast("array<string>")).withColumn("sizes", F.lit(None).cast("array<long>")).withColumn("own", F.lit(0).cast("long"))
    else:
        known = known.join(above, "g")
    empty = {"id": "long", "hash": "string", "fold": "string"}
    a = known.select("g", "part", "run", F.lit(-1).cast("long").alias("at"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "first", "n", "outside", "above", "sizes", "own")
    more = {"outside": "array<struct<level: int, place: long, hash: string>>", "above": "array<string>", "sizes": "array<long>", "own": "long"}
    b = runs.select("g", "part", "run", "at", *empty, "first", "n", *[F.lit(None).cast(t).alias(c) for c, t in more.items()])

    def run(batches):
        for t in _each_run(batches):
            head = {c: t.column(c)[0].as_py() for c in ("first", "n", "outside", "above", "sizes", "own")}
            ids, hashes, folds = (t.column(c).to_pylist()[1:] for c in ("id", "hash", "fold"))
            sizes = level_sizes(head["n"])
            outside = {(x["level"], x["place"]): x["hash"] for x in head["outside"] or []}
            levels = ancestors(head["first"], hashes, sizes, outside)
            top = levels[-1][0]
            upper, upper_sizes, place = head["above"] or [], head["sizes"] or [1], head["own"]
            root, out = _fold_up(top, upper, upper_sizes, place), []
            for i, (leaf, fold) in enumerate(zip(hashes, folds)):
                siblings, folded = expand(head["first"] + i, fold, levels, sizes)
                folded = root if folded == top else _fold_up(folded, upper, upper_sizes, place)
                proof = siblings + upper
                out.append((ids[i], leaf, top, root, proof if with_proof else None, _h("".join(proof)), folded, folded == root))
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PROVED)], schema=_PROVED)

    return _by_run(a.unionByName(b)).mapInArrow(run, _PROOFS)


_PROOFS = "id long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
_PROVED = pa.schema(
    [("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string())),
     ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]
)


def _fold_up(hash_: str, siblings: list[str], sizes: list[int], place: int) -> str:
    """The top that a node and its siblings, level by level, give."""
    at = 0
    for size in sizes[:-1]:
        low = place // ARITY * ARITY
        others, own = min(size, low + ARITY) - low - 1, place - low
        run = siblings[at : at + others]
        hash_ = _h("".join([*run[:own], hash_, *run[own:]]))
        at, place = at + others, place // ARITY
    return hash_


def _sorted_leaves(leaves: DataFrame, label: str) -> DataFrame:
    """Leaves (g, id, hash, fold) in the order of group, id and hash, over as many partitions as the sort has."""
    keys = ["g", F.col("id").asc_nulls_first(), "hash", "fold"]
    ordered = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn("_at", F.monotonically_increasing_id()), label)


def manifest(leaves: DataFrame, with_proof: bool = True) -> DataFrame:
    """(id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of every leaf.

    ``leaves``: g (string, not null: the group, in whose bytes' order the groups' tops
    follow each other), id (long), hash and fold (hexadecimal: the leaf, and the one to
    be verified in its place). Within a group leaves ascend by id, null first, then by
    hash. ``proof`` lists the siblings level by level through the group's top to the
    root; ``with_proof`` False leaves it null. A group of one leaf is its own top; one
    group's top is the root. Repeated rows are leaves of their own. No leaves, no rows.
    """
    ordered = _sorted_leaves(leaves, "leaves")
    runs = _runs(ordered)
    frontier = written(_frontier(runs), "frontier")
    nodes = _combined(frontier)
    # the tree over the groups is one of the same kind, whose only group is all groups
    tops = _tops(nodes).select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("hash"))
    tops = written(tops.repartitionByRange("name").sortWithinPartitions("name").withColumn("_at", F.monotonically_increasing_id()), "tops")
    upper = _runs(tops)
    upper_frontier = written(_frontier(upper), "upper-frontier")
    upper_nodes = _combined(upper_frontier)
    above = written(_paths(upper, upper_frontier, upper_nodes), "paths")
    return _proved(runs, frontier, nodes, above, with_proof)


def _paths(runs: DataFrame, frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, above, sizes, own): for every group the siblings of its top, the sizes of the levels, and its place."""
    named = runs.select("g", "part", "run", "at", F.col("name").alias("payload"), "hash", "first", "n")
    wanted = frontier.where(F.col("kind") == _WANTED).select("g", "part", "run", "level", "place")
    fetched = wanted.join(nodes.select("g", "level", "place", "hash"), ["g", "level", "place"])
    fetched = fetched.groupBy("g", "part", "run").agg(F.collect_list(F.struct("level", "place", "hash")).alias("outside"))
    head = fetched.select("g", "part", "run", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("n"), "outside")
    rows = named.withColumn("outside", F.lit(None).cast("array<struct<level: int, place: long, hash: string>>"))

    def run(batches):
        for t in _each_run(batches):
            skip = 1 if t.column("n")[0].as_py() is None else 0
            outside = {(x["level"], x["place"]): x["hash"] for x in (t.column("outside")[0].as_py() or [])} if skip else {}
            first, n = t.column("first")[skip].as_py(), t.column("n")[skip].as_py()
            hashes, names = t.column("hash").to_pylist()[skip:], t.column("payload").to_pylist()[skip:]
            sizes = level_sizes(n)
            levels = ancestors(first, hashes, sizes, outside)
            proofs = [expand(first + i, h, levels, sizes)[0] for i, h in enumerate(hashes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(proofs, pa.list_(pa.string())), pa.array([sizes] * len(names), pa.list_(pa.int64())),
                 pa.array(range(first, first + len(names)), pa.int64())],
                names=["g", "above", "sizes", "own"],
            )

    return _by_run(rows.unionByName(head)).mapInArrow(run, "g string, above array<string>, sizes array<long>, own long")


def documents_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    A leaf hashes doc_id, source, lang, n_chars and text, each as ``field`` writes it.
    The groups are the languages, null first. ``folded_root`` is what the leaf of the
    tampered text (``tampered_text``) gives with the siblings of the original. Nulls in
    any column, empty texts and repeated rows are leaves like others; a null doc_id
    comes first and is not tampered with. Other columns are not read.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"),
        F.col("doc_id").cast("long").alias("id"),
        leaf_hash([*values, F.col("text")]).alias("hash"),
        leaf_hash([*values, tampered_text(F.col("text"), F.col("doc_id"))]).alias("fold"),
    )
    proofs = manifest(leaves, with_proof=False)
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
