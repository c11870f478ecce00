"""Token ids as Parquet list columns, in document order, with selective reads.

Texts are range-sorted by id first and encoded after, so the ids are written
where they are made. Row groups, pages and encodings are set on Spark's own
Parquet writer; its page indexes let a reader of a few documents, or of the
metadata alone, skip the other pages and columns.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftframe.llm.common import uncollected

# new chunks after which a worker drops those that it has not met since the last time, so it keeps some twice as many
KNOWN_CHUNKS = 350_000
# runs of marks it keeps with theirs
KNOWN_MARKS = 20_000


# Fixed rule of byte-level pre-tokens: bytes without a visible letter of their own take those from 256 on.
_PLAIN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN_BYTES)}


# marks that the pre-tokenizer cuts off behind letters, a run of them as one; not the apostrophe, which may keep letters
_MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")


class _Chunks(dict):
    """Ids of chunks that follow ``blank``, as bytes, found when first asked for; None where a text must go whole.

    ``aged`` drops the chunks that were not asked for since it was called before.
    """

    def __init__(self, encoder: Encoder, blank: str):
        super().__init__()
        self.encoder, self.blank = encoder, blank
        self.letters = "".join(chr(_BYTE_LETTERS[b]) for b in blank.encode())
        self.tokenize = encoder.tokenizer.model.tokenize
        self.older: dict[str, bytes | None] = {}

    def aged(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, chunk: str) -> bytes | None:
        if chunk in self.older:
            ids = self[chunk] = self.older.pop(chunk)
            return ids
        ids = None
        if self.encoder.direct and chunk.isalpha():
            # letters go to the tokenizer's merge model, which is what its pre-tokens go to
            seen = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = array("i", [t.id for t in self.tokenize(self.letters + seen)]).tobytes()
        elif self.encoder.direct and (stem := chunk.rstrip(_MARKS)).isalpha():
            ids = self[stem] + self.encoder.marks(chunk[len(stem) :])
        elif chunk and not chunk[0].isspace() and not chunk[-1].isspace():
            ids = self.encoder.whole(self.blank + chunk).tobytes()
        self[chunk] = ids
        return ids


class Encoder:
    """A tokenizers file with byte-level pre-tokens, remembering what chunks encode to.

    The pre-tokenizer always cuts before a blank that a visible character follows,
    and around a line end between two visible characters. So a text is cut there, and
    its chunks encode alone as they do within it. Texts with other gaps, whose chunks
    are empty or begin or end with white space, go to the tokenizer whole, and so do
    texts that hold the string of an added token. A chunk of letters and marks behind
    them is encoded as these two parts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings that the tokenizer gives an id of their own before it cuts a text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # first chunks of lines, and chunks after a blank
        self.first, self.later = _Chunks(self, ""), _Chunks(self, " ")
        self.line_end = self.whole("\n").tobytes()
        self.known_marks: dict[str, bytes] = {}
        # whether letters may go to the model directly: where that is what the whole tokenizer does
        self.direct = True
        trial = ["word", "Straße", "été,", "ñandú.", "日本", "x", "mot.)", "a$$$", "Wort<|!"]
        self.direct = all(self.later[c] == self.whole(" " + c).tobytes() for c in trial)
        self.later.clear()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def marks(self, run: str) -> bytes:
        """Ids of a run of marks."""
        ids = self.known_marks.get(run)
        if ids is None:
            if len(self.known_marks) > KNOWN_MARKS:
                self.known_marks.clear()
            ids = self.known_marks[run] = self.whole(run).tobytes()
        return ids

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of each text followed by ``end_id``."""
        if len(self.first) + len(self.later) > KNOWN_CHUNKS:
            self.first.aged()
            self.later.aged()
        first, later = self.first.__getitem__, self.later.__getitem__
        end = np.array([end_id], np.int32)
        out = []
        for text in texts:
            known = None
            if not any(a in text for a in self.added):
                lines = []
                for line in text.split("\n"):
                    parts = line.split(" ")
                    lines.append((first(parts[0]), *map(later, parts[1:])))
                try:
                    known = np.frombuffer(self.line_end.join(map(b"".join, lines)), np.int32)
                except TypeError:  # None, for a chunk that does not stand alone
                    pass
            out.append(np.concatenate((self.whole(text) if known is None else known, end)))
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2_000,
    partitions: int | None = None,
) -> None:
    """Write (key, part, start_in_part, n_tokens, ids) in ascending order of ``key``.

    ``ids`` is a list column, ``encoding`` "dictionary" or "delta". ``part`` numbers
    the files in key order and ``start_in_part`` counts the ids before a document in
    its file, so the position in the whole stream needs one sum per file. Null and
    empty texts have the end id alone. Null keys come first; equal keys are ordered
    by a hash of their text. Other columns are not read. No rows write no document.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")

    def run(batches):
        encoder = _encoder(tokenizer_path)
        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            rows = whole.num_rows
            sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            # encode a few million characters at a time
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // 2_000_000)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), rows]):
                batch = whole.slice(a, b - a)
                with uncollected():
                    ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()], end_id)
                counts = np.array([len(i) for i in ids], np.int64)
                ends = np.cumsum(counts)
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(before + ends - counts),
                        pa.array(counts),
                        lists,
                    ],
                    names=["k", "part", "start_in_part", "n_tokens", "ids"],
                )
                before += int(ends[-1]) if len(ends) else 0

    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t").asc(), F.col("t").asc()]
    ranged = slim.repartitionByRange(partitions, *order[:2]) if partitions else slim.repartitionByRange(*order[:2])
    tokens = ranged.sortWithinPartitions(*order).mapInArrow(
        run, "k long, part int, start_in_part long, n_tokens long, ids array<int>"
    )
    writer = (
        tokens.withColumnRenamed("k", key)
        .write.option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.enable.dictionary", "true" if encoding == "dictionary" else "false")
    )
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens) of every document; the id lists are not read.

    ``start`` is the number of ids of all documents before it. The sums per file,
    one row each, are added up in one task.
    """
    stored = spark.read.parquet(path).select(key, "part", "start_in_part", "n_tokens")
    return _with_start(spark, path, stored).select(key, "start", "n_tokens")


def _with_start(spark: SparkSession, path: str, stored: DataFrame) -> DataFrame:
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return stored.join(offsets, "part").withColumn("start", F.col("offset") + F.col("start_in_part"))


def read_documents(spark: SparkSession, path: str, first: int, last: int, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the documents with ``first`` <= key <= ``last``; page indexes skip the rest."""
    return spark.read.parquet(path).where(F.col(key).between(first, last)).select(key, "ids")


def read_span(spark: SparkSession, path: str, start: int, end: int, key: str = "doc_id") -> DataFrame:
    """(key, at, ids): the part of each document inside ids ``start`` to ``end`` of the whole stream."""
    stored = spark.read.parquet(path)
    placed = _with_start(spark, path, stored)
    inside = placed.where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start))
    first = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    length = F.least(F.col("start") + F.col("n_tokens"), F.lit(end)) - F.greatest(F.col("start"), F.lit(start))
    return inside.select(
        key, (F.col("start") + first).alias("at"), F.slice("ids", (first + 1).cast("int"), length.cast("int")).alias("ids")
    )


def checksums(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files' id lists.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            offsets = lists.offsets.to_pylist()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            counts = np.diff(np.array(offsets, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(counts), pa.array(sums, pa.int64())],
                names=["k", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )

    stored = spark.read.parquet(path).select(F.col(key).alias("k"), "part", "start_in_part", "ids")
    summed = stored.mapInArrow(run, "k long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    placed = _with_start(spark, path, summed)
    return placed.select(F.col("k").alias(key), "start", "n_tokens", "ids_crc32")
