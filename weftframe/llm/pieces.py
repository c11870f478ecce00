"""SentencePiece encoding and decoding by a Viterbi pass over many words at once.

A text becomes words that no piece crosses: each starts at a blank mark that
follows another character. Distinct words are encoded once per batch, words of
equal length advancing together, one character position per step. At each
position all substrings that end there are looked up by a rolling hash among the
sorted hashes of the pieces; the best predecessor of every word is one maximum.

What is maximal depends on the model file. For a unigram model it is the sum of
the piece scores. A merge (BPE) model keeps a segmentation only if merging would
leave every two neighbouring pieces apart; exactly one segmentation of each
prefix does, so the maximum is over 0 for pairs that stay apart and -infinity
for the others, and it gives the merge order's own result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftframe.llm.common import uncollected

# Fixed value: the mark that stands for a blank inside pieces.
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SLOTS = 23  # bits of a slot number in the table of known pairs
_NONE = np.int32(-1)
_LEADING = 22
# words a worker keeps with their ids
KNOWN_WORDS = 500_000
# words of one length that are encoded together
LANES = 20_000
# characters from which a word is cut where no piece can cross
LONG_WORD = 48


class Pieces:
    """A model file: pieces, scores, and what a merge model needs to know about pairs."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer, normalizer = model.trainer_spec, model.normalizer_spec
        self.merges = trainer.model_type == trainer.BPE
        if not self.merges and trainer.model_type != trainer.UNIGRAM:
            raise ValueError("only unigram and merge (BPE) models are supported")
        self.dummy_prefix = normalizer.add_dummy_prefix
        self.squeeze = normalizer.remove_extra_whitespaces
        self.plain = normalizer.name == "identity" and not normalizer.precompiled_charsmap
        if not self.plain:
            raise ValueError("only models without a character map are supported")
        kinds = np.array([p.type for p in model.pieces])
        self.texts = [p.piece for p in model.pieces]
        self.scores = np.array([p.score for p in model.pieces], np.float64)
        normal = proto.ModelProto.SentencePiece.NORMAL
        if any(t == proto.ModelProto.SentencePiece.USER_DEFINED for t in kinds):
            raise ValueError("user-defined pieces are not supported")
        self.unknown = int(np.flatnonzero(kinds == proto.ModelProto.SentencePiece.UNKNOWN)[0])
        byte_ids = np.flatnonzero(kinds == proto.ModelProto.SentencePiece.BYTE)
        self.byte_fallback = trainer.byte_fallback and len(byte_ids) == 256
        self.byte_ids = byte_ids.tolist()
        ids = np.flatnonzero(kinds == normal)
        if any(MARK in self.texts[i].lstrip(MARK) for i in ids):
            raise ValueError("pieces that cross a word start are not supported")
        self.longest = max(len(self.texts[i]) for i in ids)
        hashes = np.array([self._hash(self.texts[i]) for i in ids], np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order].astype(np.int32)
        # which leading hash bits occur at all: spares the search for most substrings
        self.maybe = np.zeros(1 << _LEADING, bool)
        self.maybe[hashes >> np.uint64(64 - _LEADING)] = True
        self.worst = float(self.scores[ids].min()) - 10.0
        self.known: dict[str, bytes] = {}
        self.known_marked: dict[str, bytes] = {}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.odd_ids = {self.unknown, *self.byte_ids}
        if self.merges:
            self._learn_merges(ids)
            # answers of the merge rule for pairs of neighbours, as many as there are slots
            self.pair_codes = np.full(1 << _SLOTS, -1, np.int64)
            self.pair_apart = np.zeros(1 << _SLOTS, bool)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _learn_merges(self, ids: np.ndarray) -> None:
        """Per piece the two pieces that merging makes it of, last step; itself for a character."""
        size = len(self.texts)
        # unknown characters get numbers from ``size`` on, one per character of a batch
        self.left = np.arange(size, dtype=np.int32)
        self.right = np.arange(size, dtype=np.int32)
        self.rank = np.full(size, np.iinfo(np.int32).max, np.int32)
        by_score = ids[np.argsort(-self.scores[ids], kind="stable")]
        self.rank[by_score] = np.arange(len(by_score))
        single = {self.texts[i]: int(i) for i in ids if len(self.texts[i]) == 1}
        place = {self.texts[i]: int(i) for i in ids}
        self.reachable = np.zeros(size, bool)
        for i in single.values():
            self.reachable[i] = True
        for i in by_score.tolist():
            piece = self.texts[i]
            if len(piece) < 2:
                continue
            parts = [single.get(c, -1) for c in piece]
            while len(parts) > 2:
                best, where = None, -1
                for k in range(len(parts) - 1):
                    if parts[k] < 0 or parts[k + 1] < 0:
                        continue
                    merged = place.get(self.texts[parts[k]] + self.texts[parts[k + 1]])
                    if merged is not None and merged != i and (best is None or self.rank[merged] < self.rank[best]):
                        best, where = merged, k
                if best is None:
                    break
                parts[where : where + 2] = [best]
            if len(parts) == 2 and min(parts) >= 0:
                self.left[i], self.right[i] = parts
                self.reachable[i] = True

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each substring hash, -1 where there is none."""
        found = np.full(len(hashes), _NONE, np.int32)
        rows = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _LEADING)])
        sought = hashes[rows]
        at = np.searchsorted(self.hashes, sought)
        at[at == len(self.hashes)] = 0
        found[rows] = np.where(self.hashes[at] == sought, self.ids[at], _NONE)
        return found

    def _joined(self, a: np.ndarray, b: np.ndarray, hashes: np.ndarray, powers: np.ndarray) -> np.ndarray:
        """Rank of the piece that two pieces merge into; the largest number if none."""
        found = self._find(hashes[a] * powers[b] + hashes[b])
        return np.where(found >= 0, self.rank[found], np.iinfo(np.int32).max)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray, hashes: np.ndarray, powers: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of neighbours: would merging both texts together leave these two?

        Undo both pieces' merges, latest first, always looking at the parts that
        touch. If at some point the touching parts merge into a piece that comes
        earlier than the merge just undone, merging would have crossed the border.
        On the left the earlier of equal ranks wins, as merging goes from the left.
        """
        a, b = a.copy(), b.copy()
        apart = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        most = np.iinfo(np.int32).max
        while len(live):
            x, y = a[live], b[live]
            joined = self._joined(x, y, hashes, powers).astype(np.int64)
            crossed = (joined < most) & (2 * joined < limit[live])
            apart[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            whole_x, whole_y = right[x] == x, left[y] == y
            live_on = ~(whole_x & whole_y)
            live, x, y, whole_x, whole_y = live[live_on], x[live_on], y[live_on], whole_x[live_on], whole_y[live_on]
            rx = np.where(whole_x, -1, rank[x].astype(np.int64))
            ry = np.where(whole_y, -1, rank[y].astype(np.int64))
            undo_left = rx > ry
            # a merge at the border of equal rank would come after one in the left
            # piece and before one in the right piece
            limit[live] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            a[live] = np.where(undo_left, right[x], x)
            b[live] = np.where(undo_left, y, left[y])
        return apart

    def _parts(self, word: str) -> list[str]:
        """A long word cut wherever no piece lies over the border, so that the parts encode alone."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(codes)
        hashes = codes
        covers = np.zeros(n + 1, np.int64)  # how many pieces begin less those that end, per inner border
        for size in range(2, min(self.longest, n) + 1):
            hashes = hashes[:-1] * _BASE + codes[size - 1 :]
            starts = np.flatnonzero(self._find(hashes) >= 0)
            np.add.at(covers, starts + 1, 1)
            np.add.at(covers, starts + size, -1)
        borders = np.flatnonzero(np.cumsum(covers)[1:n] == 0) + 1
        return [word[a:b] for a, b in zip([0, *borders.tolist()], [*borders.tolist(), n])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit) of distinct words; long ones by their parts."""
        parts = {i: self._parts(w) for i, w in enumerate(words) if len(w) > LONG_WORD}
        if not parts:
            return self._encode_lanes(words)
        whole = [w for i, w in enumerate(words) if i not in parts]
        pieces = list(dict.fromkeys(p for own in parts.values() for p in own))
        encoded = self._encode_lanes(whole + pieces)
        known = dict(zip(pieces, encoded[len(whole) :]))
        rest = iter(encoded)
        return [self._connected([known[p] for p in parts[i]]) if i in parts else next(rest) for i in range(len(words))]

    def _connected(self, parts: list[bytes]) -> bytes:
        """The ids of neighbouring parts; unknown characters side by side are one unknown piece."""
        if self.byte_fallback:
            return b"".join(parts)
        ids = np.frombuffer(b"".join(parts), np.int32)
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def _encode_lanes(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit) of distinct words, equal lengths together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        out = [b""] * len(words)
        at = 0
        while at < len(order):
            n = lengths[order[at]]
            end = int(np.searchsorted(lengths[order], n, side="right"))
            # long words are rare: fewer lanes keep the tables small
            lanes = max(1, min(LANES, 4_000_000 // max(1, int(n))))
            for first in range(at, end, lanes):
                chosen = order[first : min(first + lanes, end)]
                for i, ids in zip(chosen.tolist(), self._viterbi([words[i] for i in chosen], int(n))):
                    out[i] = ids
            at = end
        return out

    def _viterbi(self, words: list[str], n: int) -> list[bytes]:
        if not n:
            return [b""] * len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        lanes = len(words)
        prefix = np.zeros((lanes, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _BASE + (codes[:, i].astype(np.uint64) + np.uint64(1))
        power = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        score = np.full((lanes, n + 1), -np.inf)
        score[:, 0] = 0.0
        back = np.zeros((lanes, n + 1), np.int32)
        piece = np.full((lanes, n + 1), _NONE, np.int32)
        if self.merges:
            strange, tables = self._with_strangers(codes)
        # piece at each (size, start), one search per size
        pieces_at = {}
        for size in range(1, min(self.longest, n) + 1):
            found = self._find((prefix[:, size:] - prefix[:, :-size] * power[size]).ravel()).reshape(lanes, n - size + 1)
            if size == 1:
                found = np.where(found >= 0, found, strange if self.merges else self.unknown)
            pieces_at[size] = np.ascontiguousarray(found.T)
        for end in range(1, n + 1):
            best, source, chosen = np.full(lanes, -np.inf), np.zeros(lanes, np.int32), np.full(lanes, _NONE, np.int32)
            for size in range(1, min(self.longest, end) + 1):
                start = end - size
                ids = pieces_at[size][start]
                may = np.flatnonzero((ids >= 0) & np.isfinite(score[:, start]))
                if not len(may):
                    continue
                if self.merges:
                    gain = self._merge_gain(ids[may], piece[may, start], start, tables)
                else:
                    gain = np.where(ids[may] == self.unknown, self.worst, self.scores[ids[may]])
                total = score[may, start] + gain
                better = total > best[may]
                rows = may[better]
                best[rows], source[rows], chosen[rows] = total[better], start, ids[may][better]
            score[:, end], back[:, end], piece[:, end] = best, source, chosen
        return self._walk_back(words, n, back, piece)

    def _with_strangers(self, codes: np.ndarray):
        """Numbers after the pieces for characters that are no piece, and the tables that hold them."""
        size = len(self.texts)
        chars, inverse = np.unique(codes, return_inverse=True)
        inverse = inverse.reshape(codes.shape)
        own = size + np.arange(len(chars), dtype=np.int32)
        hashes = np.zeros(size + len(chars), np.uint64)
        powers = np.ones(size + len(chars), np.uint64)
        if not hasattr(self, "_piece_hashes"):
            self._piece_hashes = np.array([self._hash(t) for t in self.texts], np.uint64)
            self._piece_powers = np.array([pow(int(_BASE), len(t), 1 << 64) for t in self.texts], np.uint64)
        hashes[:size], powers[:size] = self._piece_hashes, self._piece_powers
        hashes[size:] = chars.astype(np.uint64) + np.uint64(1)
        powers[size:] = _BASE
        extra = np.arange(size, size + len(chars), dtype=np.int32)
        grown = lambda table, more: np.concatenate((table, more))
        tables = (
            hashes,
            powers,
            grown(self.rank, np.full(len(chars), np.iinfo(np.int32).max, np.int32)),
            grown(self.left, extra),
            grown(self.right, extra),
            grown(self.reachable, np.ones(len(chars), bool)),
        )
        return own[inverse], tables

    def _merge_gain(self, ids: np.ndarray, before: np.ndarray, start: int, tables) -> np.ndarray:
        hashes, powers, rank, left, right, reachable = tables
        allowed = reachable[ids]
        if start:
            code = (before.astype(np.int64) << 32) | ids
            slot = ((code.view(np.uint64) * _BASE) >> np.uint64(64 - _SLOTS)).astype(np.int64)
            apart = self.pair_apart[slot]
            new = np.flatnonzero(self.pair_codes[slot] != code)
            if len(new):
                distinct, first, inverse = np.unique(code[new], return_index=True, return_inverse=True)
                a, b = (distinct >> 32).astype(np.int32), (distinct & 0xFFFFFFFF).astype(np.int32)
                found = self._stay_apart(a, b, hashes, powers, rank, left, right)
                apart[new] = found[inverse]
                # characters that are no piece have other numbers in every batch
                lasting = (a < len(self.texts)) & (b < len(self.texts))
                kept = slot[new[first[lasting]]]
                # of pairs that share a slot the last one stays, in both tables
                self.pair_codes[kept], self.pair_apart[kept] = distinct[lasting], found[lasting]
            allowed = allowed & apart
        return np.where(allowed, 0.0, -np.inf)

    def _walk_back(self, words, n, back, piece) -> list[bytes]:
        lanes = len(words)
        size = len(self.texts)
        at = np.full(lanes, n)
        columns, starts = [], []
        rows = np.arange(lanes)
        while (at > 0).any():
            columns.append(np.where(at > 0, piece[rows, at], _NONE))
            at = np.where(at > 0, back[rows, at], 0)
            starts.append(at)
        ids = np.stack(columns[::-1], axis=1)
        used = ids >= 0
        flat = np.ascontiguousarray(ids[used], np.int32).tobytes()
        ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
        out, begin = [], 0
        for end in ends:
            out.append(flat[begin:end])
            begin = end
        odd = np.flatnonzero(((ids >= size) | (ids == self.unknown)).any(axis=1))
        if len(odd):
            starts = np.stack(starts[::-1], axis=1)
            for row in odd.tolist():
                out[row] = np.array(self._spelled(words[row], ids[row].tolist(), starts[row].tolist()), np.int32).tobytes()
        return out

    def _spelled(self, word: str, ids: list[int], starts: list[int]) -> list[int]:
        """Characters that are no piece as their UTF-8 bytes, or as one unknown per run."""
        out: list[int] = []
        for i, start in zip(ids, starts):
            if i < 0:
                continue
            if i < len(self.texts) and i != self.unknown:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.byte_ids[b] for b in word[start].encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def words_of(self, text: str) -> list[str]:
        """Marked words of a text; together they are the whole text."""
        if self.squeeze:
            text = " ".join(part for part in text.split(" ") if part)
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.dummy_prefix:
            marked = MARK + marked
        parts = marked.split(MARK)
        # an empty part is a mark followed by another: runs of marks stay with the next word
        words, run = ([parts[0]] if parts[0] else []), 0
        for part in parts[1:]:
            run += 1
            if part:
                words.append(MARK * run + part)
                run = 0
        if run:
            words.append(MARK * run)
        return words

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, in order.

        Texts whose blanks all stand alone are cut at blanks; their words are known
        under their text without the mark. Others are cut by ``words_of``.
        """
        split, usual = [], []
        for t in texts:
            alone = self.dummy_prefix and not self.squeeze and t and "  " not in t and MARK not in t
            alone = alone and t[0] != " " and t[-1] != " "
            usual.append(alone)
            split.append(t.split(" ") if alone else self.words_of(t))
        plain_new, marked_new = set(), set()
        for words, alone in zip(split, usual):
            (plain_new if alone else marked_new).update(words)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.known_marked.clear()
        plain_new.difference_update(self.known)
        marked_new.difference_update(self.known_marked)
        for new, known, mark in ((list(plain_new), self.known, MARK), (list(marked_new), self.known_marked, "")):
            known.update(zip(new, self.encode_words([mark + w for w in new])))
        out = []
        for words, alone in zip(split, usual):
            known = self.known if alone else self.known_marked
            out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32))
        return out

    def gives_back(self, ids: np.ndarray, sizes: np.ndarray, texts: list[bytes]) -> list[bool]:
        """Whether decoding gives each text; ``ids`` of all texts one after the other, ``sizes`` of them each.

        The bytes of all pieces are gathered at once.
        """
        if not hasattr(self, "_bytes"):
            whole = [t.replace(MARK, " ").encode() for t in self.texts]
            for i, b in self.byte_of.items():
                whole[i] = bytes([b])
            whole[self.unknown] = " ⁇ ".encode()
            self._bytes = np.frombuffer(b"".join(whole), np.uint8)
            self._sizes = np.fromiter(map(len, whole), np.int64, len(whole))
            self._starts = np.cumsum(self._sizes) - self._sizes
        lengths = self._sizes[ids]
        before = np.concatenate(([0], np.cumsum(lengths)))
        flat = self._bytes[np.repeat(self._starts[ids] - before[:-1], lengths) + np.arange(before[-1])].tobytes()
        edges = before[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        out = []
        for a, b, text in zip(edges, edges[1:], texts):
            if self.dummy_prefix and flat[a : a + 1] == b" " and a < b:
                a += 1
            out.append(flat[a:b] == text)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; unknown pieces come out as the model's unknown surface."""
        texts = self.texts
        if self.odd_ids.isdisjoint(ids):
            text = "".join([texts[i] for i in ids])
        else:
            out: list[str] = []
            held = bytearray()
            for i in ids:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(" ⁇ " if i == self.unknown else texts[i])
            if held:
                out.append(held.decode("utf-8", "replace"))
            text = "".join(out)
        text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _cut(batch: pa.RecordBatch, most: int = 4_000_000):
    """Slices of a batch of at most ``most`` characters, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """(key, ids: array<int>, n_pieces) of every row, from its whole text.

    ``check`` adds ``round_trip``: whether decoding the ids gives the text back.
    Null and empty texts have no ids. Rows repeat as given, null keys included; no
    other column is read. ``model_path`` must exist on every worker.
    """

    def run(batches):
        pieces = pieces_of(model_path)
        for whole in batches:
            for batch in _cut(whole):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                with uncollected():
                    ids = pieces.encode_batch(texts)
                sizes = np.array([len(i) for i in ids], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                flat = pa.array(np.concatenate(ids) if len(ids) else np.zeros(0, np.int32), pa.int32())
                columns = [batch.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(sizes)]
                names = ["k", "ids", "n_pieces"]
                if check:
                    bodies = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
                    columns.append(pa.array(pieces.gives_back(flat.to_numpy(), sizes, bodies), pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "k long, ids array<int>, n_pieces long" + (", round_trip boolean" if check else "")
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(run, schema).withColumnRenamed("k", key)


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows of piece ids; null ids give a null text."""

    def run(batches):
        pieces = pieces_of(model_path)
        for batch in batches:
            texts = [None if i is None else pieces.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    slim = encoded.select(F.col(key).cast("long").alias("k"), F.col(ids).alias("ids"))
    return slim.mapInArrow(run, "k long, text string").withColumnRenamed("k", key)
