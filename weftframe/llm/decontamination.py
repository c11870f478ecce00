"""Benchmark passages in documents, found with a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every item. A document's words stream
through it; after each word it tells the longest run of words ending there that
some item holds. Once that run is as long as a window, the window has occurred.
A match of two words or more can only go on over neighbours that are neighbours
in some item, so stretches without enough such neighbours are skipped at once.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftframe.llm.common import written

# bytes of item text in one automaton; more items make more automata, each passed over the documents
BLOCK_BYTES = 4 << 20
# bytes of a text split into words at a time
_PIECE = 1 << 22
_RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<first: long, last: long>>"

# Fixed value: every ASCII byte but digits and lower-case letters parts words.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and other than ASCII, A-Z in lower case; a null text has none."""
    return (text or b"").translate(_FOLD).split()


def build(sequences: list[list[int]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Edges, suffix links and longest lengths of the automaton of all sequences; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def split(p: int, q: int, c: int) -> int:
        """A state for the runs of ``q`` that also end where ``p`` goes on with ``c``."""
        clone = len(edges)
        edges.append(dict(edges[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and edges[p].get(c) == q:
            edges[p][c] = clone
            p = link[p]
        return clone

    for sequence in sequences:
        last = 0
        for c in sequence:
            q = edges[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else split(last, q, c)
                continue
            new = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, q, c)
            last = new
    return edges, link, length


def automaton(items: list[tuple[str | None, bytes | None]], width: int) -> dict:
    """What a task needs to find the items' windows, as plain values."""
    known: dict[bytes, int] = {}
    sequences = [[known.setdefault(w, len(known)) for w in words_of(text)] for _, text in items]
    edges, link, length = build(sequences)
    base = max(1, len(known))
    # the state of each state's suffix of ``width`` words
    tail = [-1] * len(edges)
    for state in np.argsort(length, kind="stable").tolist():
        if length[state] >= width:
            tail[state] = state if length[link[state]] < width else tail[link[state]]
    full: dict[int, set] = {}
    short: dict[int, list] = {}
    for (item, _), sequence in zip(items, sequences):
        state = 0
        for n, c in enumerate(sequence, 1):
            state = edges[state][c]
            if n >= width:
                full.setdefault(tail[state], set()).add(item)
        if 0 < len(sequence) < width:
            short.setdefault(state, []).append((len(sequence), item))
    marked = [0] * len(edges)  # the nearest state up the links that ends a short item
    for state in np.argsort(length, kind="stable").tolist()[1:]:
        up = link[state]
        marked[state] = up if up in short else marked[up]
    pairs = np.unique([a * base + b for s in sequences for a, b in zip(s, s[1:])]).astype(np.int64)
    short_words = [s for s in sequences if 0 < len(s) < width]
    return {
        "known": known,
        "base": base,
        "edges": {state * base + c: to for state, out in enumerate(edges) for c, to in out.items()},
        "link": link,
        "length": length,
        "tail": tail,
        "full": {state: sorted(i for i in found if i is not None) for state, found in full.items()},
        "short": short,
        "marked": marked,
        "pairs": pairs,
        "short_pairs": np.unique([s[-2] * base + s[-1] for s in short_words if len(s) > 1]).astype(np.int64),
        "short_words": np.unique([s[0] for s in short_words if len(s) == 1]).astype(np.int64),
        "width": width,
    }


def word_numbers(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """The number of every word, -1 where no item holds it; a long text goes in pieces."""
    text = text or b""
    parts = []
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            piece = text[at:end].translate(_FOLD)
            cut = piece.rfind(b" ")
            # a word longer than a piece: look for its end
            while cut < 0 and end < len(text):
                more = text[end : end + _PIECE].translate(_FOLD)
                gap = more.find(b" ")
                piece, end = piece + (more if gap < 0 else more[: gap + 1]), end + (len(more) if gap < 0 else gap + 1)
                cut = len(piece) if gap < 0 else len(piece) - 1
            piece, at = piece[:cut], at + cut
            if not cut:
                at += 1
        else:
            piece, at = text[at:].translate(_FOLD), len(text)
        words = piece.split()
        parts.append(np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _contains(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def stretches(numbers: np.ndarray, a: dict) -> list[tuple[int, int]]:
    """Stretches of words in which a window can occur: neighbours are neighbours in an item."""
    n, width = len(numbers), a["width"]
    least = min(n, width)
    if not n:
        return []
    joined = np.zeros(n + 1, bool)  # word i follows word i - 1 in some item
    both = np.flatnonzero((numbers[1:] >= 0) & (numbers[:-1] >= 0))
    codes = numbers[both] * a["base"] + numbers[both + 1]
    good = _contains(a["pairs"], codes)
    joined[both[good] + 1] = True
    few = not len(a["short_pairs"]) and not len(a["short_words"])
    if few and (n < width or int(joined.sum()) < least - 1):
        return []
    starts = np.flatnonzero(~joined[:-1])
    ends = np.append(starts[1:], n)
    wanted = ends - starts >= width
    if not few:
        at = np.flatnonzero(_contains(a["short_words"], numbers))
        at = np.union1d(at, both[_contains(a["short_pairs"], codes)] + 1)
        wanted[np.searchsorted(starts, at, "right") - 1] = True
    return list(zip(starts[wanted].tolist(), ends[wanted].tolist()))


def matches(numbers: list[int], a: dict) -> tuple[np.ndarray, set]:
    """Which words lie in an occurring window, and the items whose windows occur."""
    edges, link, length, tail = a["edges"], a["link"], a["length"], a["tail"]
    full, short, marked, base, width = a["full"], a["short"], a["marked"], a["base"], a["width"]
    hit = np.zeros(len(numbers), bool)
    found: set = set()
    state = run = 0
    for i, c in enumerate(numbers):
        if c < 0:
            state = run = 0
            continue
        to = edges.get(state * base + c)
        while to is None and state:
            state = link[state]
            run = length[state]
            to = edges.get(state * base + c)
        if to is None:
            continue
        state, run = to, run + 1
        if run >= width:
            hit[i - width + 1 : i + 1] = True
            found.update(full[tail[state]])
        up = state if state in short else marked[state]
        while up:
            for n, item in short[up]:
                if n <= run:
                    hit[i - n + 1 : i + 1] = True
                    if item is not None:
                        found.add(item)
            up = marked[up]
    return hit, found


def _measured(text: bytes | None, a: dict) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, spans (first, last) of words in windows, and the items found."""
    numbers = word_numbers(text, a["known"])
    spans: list[tuple[int, int]] = []
    found: set = set()
    for first, end in stretches(numbers, a):
        hit, items = matches(numbers[first:end].tolist(), a)
        found |= items
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
        spans += [(first + b, first + e - 1) for b, e in zip(edge[::2].tolist(), edge[1::2].tolist())]
    return len(numbers), spans, found


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def item_blocks(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> list[dict]:
    """Automata over blocks of items, as broadcasts; a block holds about ``BLOCK_BYTES`` of text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    items = items.where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    shared = []
    for block in range(blocks):
        # in an order that does not depend on tasks
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        pairs = sorted(((r["item"], r["text"].encode()) for r in rows), key=lambda p: (p[0] is not None, p))
        shared.append(spark.sparkContext.broadcast(automaton(pairs, width)))
    return shared


def _with_matches(rows: DataFrame, benchmark: DataFrame, width: int, text: str, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``rows`` with n_words, n_hit, items and spans; a pass over the rows per block of items."""
    if width < 1:
        raise ValueError("a window has one word or more")
    schema = StructType([*rows.schema.fields, *_fields(rows)])
    place = rows.columns.index(text)
    blocks = item_blocks(benchmark, width, item, item_text) or [rows.sparkSession.sparkContext.broadcast(automaton([], width))]

    def marker(shared, again: bool):
        def run(batches):
            a = shared.value
            for batch in batches:
                own = batch.num_columns - (4 if again else 0)
                texts = batch.column(place).cast(pa.large_binary()).to_pylist()
                before = zip(batch.column(own + 2).to_pylist(), batch.column(own + 3).to_pylist()) if again else repeat(([], []))
                n_words, n_hit, items, spans = [], [], [], []
                for body, (old_items, old_spans) in zip(texts, before):
                    n, new, found = _measured(body, a)
                    both = _joined(new + [(s["first"], s["last"]) for s in old_spans])
                    n_words.append(n)
                    n_hit.append(sum(last - first + 1 for first, last in both))
                    items.append(sorted(found.union(old_items)))
                    spans.append([{"first": first, "last": last} for first, last in both])
                span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
                names = [*batch.schema.names[:own], "n_words", "n_hit", "items", "spans"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:own], *columns], names=names)

        return run

    done = rows.mapInArrow(marker(blocks[0], False), schema)
    for shared in blocks[1:]:
        done = written(done, "marked").mapInArrow(marker(shared, True), schema)
    return done


def _fields(rows: DataFrame) -> list[StructField]:
    return rows.sparkSession.createDataFrame([], _RESULT).schema.fields


def mark(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, items, spans) of every row of ``docs``.

    A window is ``width`` consecutive words of an item; an item of fewer words, but
    not none, is one window. ``items`` holds the ids, as text, of items of which a
    window occurs, in the order of their bytes; ``spans`` the stretches of words
    (from 0, both ends included) that lie in occurring windows, ``n_hit`` their words.

    Null and empty texts have no words. Rows repeat as given, null keys included.
    Items without text take no part; repeated ones count once; windows of an item
    without an id count as hits but name no item. An empty benchmark hits nothing.
    Other columns are not read.
    """
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    found = _with_matches(slim, benchmark, width, "t", item, item_text)
    return found.select(F.col("k").alias(key), "n_words", "n_hit", "items", "spans")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = list(_WORD.finditer(text.translate(_FOLD)))
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first].start()])
        at = places[last].end()
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    most_share: float = 0.5,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` without benchmark passages: columns as given, spans cut out of the texts.

    Rows of which more than ``most_share`` of the words lie in spans go as a whole.
    Texts without a span stay as they are, null ones too.
    """
    slim = docs.select(F.col(text).cast("string").alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = _with_matches(slim, benchmark, width, "t", item, item_text)
    kept = found.where(F.col("n_hit") <= most_share * F.col("n_words"))
    schema = StructType([*slim.schema.fields])

    def run(batches):
        for batch in batches:
            bodies = []
            for body, spans in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                bodies.append(without_spans(body, [(s["first"], s["last"]) for s in spans]) if spans else body)
            texts = pa.array(bodies, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column(1)], names=["t", "row"])

    cut = kept.select("t", "row", "spans").mapInArrow(run, schema)
    return cut.select(*[(F.col("t") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = mark(docs, benchmark, width)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
