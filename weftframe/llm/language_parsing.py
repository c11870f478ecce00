"""Language identification by cross-parsing against labelled text.

Each language's labelled text becomes a suffix automaton, which accepts exactly
the substrings of that text. A document is cut greedily into phrases, each the
longest match from where the last one ended; the fewer phrases a language needs,
the closer the document is to it. Phrases times log2(labelled length), per
character, is the cross-parsing entropy; the least entropy wins.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftframe.llm.common import has_letter

UNDETERMINED = "und"
# bounds of the labelled text: documents and characters per language, and languages
TRAIN_DOCS = 400
TRAIN_CHARS = 40_000
MOST_LANGUAGES = 200
# texts are parsed in pieces of this many characters, all pieces of a batch at once;
# a phrase ends at a piece's end, which adds at most one phrase per piece
PIECE = 256
# how sharply the score follows the gap in bits per character
_SHARPNESS = 12.0
# pieces parsed together, which bounds the memory of a task
_LANES = 16_384
_PARSED_BYTES = 8_000_000
_GAPS = regex.compile(r"\P{L}+")


def normalised(text: str) -> str:
    """Letters in lower case, everything between them as one blank."""
    return _GAPS.sub(" ", text.lower())


@dataclass
class Automaton:
    """``step[state, symbol]`` is the next state, or -1; symbol 0 stands for characters not seen."""

    language: str
    step: np.ndarray
    bits: float


def suffix_steps(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a symbol sequence, as a table."""
    steps: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for symbol in symbols:
        state = len(steps)
        steps.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = state
            at = links[at]
        if at >= 0:
            target = steps[at][symbol]
            if lengths[at] + 1 == lengths[target]:
                links[state] = target
            else:
                copy = len(steps)
                steps.append(dict(steps[target]))
                lengths.append(lengths[at] + 1)
                links.append(links[target])
                while at >= 0 and steps[at].get(symbol) == target:
                    steps[at][symbol] = copy
                    at = links[at]
                links[target] = links[state] = copy
        last = state
    table = np.full((len(steps), width), -1, np.int32)
    for state, row in enumerate(steps):
        for symbol, target in row.items():
            table[state, symbol] = target
    return table


class Model:
    """Automata of all languages over one alphabet; built once per worker from the texts."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        alphabet = sorted(set("".join(texts.values())))
        self.symbol_of = np.zeros(0x110000, np.int16)
        self.symbol_of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.automata = []
        for language in self.languages:
            symbols = self.symbol_of[np.array([ord(c) for c in texts[language]], np.int64)].tolist()
            # one more column that never matches: the filler after a piece's end
            steps = suffix_steps(symbols, len(alphabet) + 1)
            self.automata.append(Automaton(language, steps, float(np.log2(max(2, len(symbols))))))

    def bits_per_char(self, texts: list[str]) -> np.ndarray:
        """Cross-parsing entropy, texts by languages; every text in full."""
        lengths = np.array([len(t) for t in texts], np.int64)
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        phrases = np.zeros((len(texts), len(self.automata)))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        first = np.concatenate(([0], np.cumsum(pieces)))[:-1]
        begins = starts[owner] + (np.arange(len(owner)) - first[owner]) * PIECE
        sizes = np.minimum(PIECE, starts[owner + 1] - begins)
        for at in range(0, len(owner), _LANES):
            order = np.argsort(-sizes[at : at + _LANES], kind="stable") + at
            lane_sizes = sizes[order]
            running = np.searchsorted(-lane_sizes, -np.arange(1, PIECE + 1), side="right")
            grid = np.zeros((PIECE, len(order)), np.int16)
            for i in range(PIECE):
                n = running[i]
                if not n:
                    break
                grid[i, :n] = self.symbol_of[codes[begins[order[:n]] + i]]
            for k, automaton in enumerate(self.automata):
                np.add.at(phrases[:, k], owner[order], self._phrases(automaton.step, grid, running))
        bits = np.array([a.bits for a in self.automata])
        return phrases * bits / np.maximum(lengths, 1)[:, None]

    @staticmethod
    def _phrases(step: np.ndarray, grid: np.ndarray, running: np.ndarray) -> np.ndarray:
        flat, width = step.reshape(-1), step.shape[1]
        fresh = step[0]
        lanes = grid.shape[1]
        state = np.zeros(lanes, np.int32)
        count = np.ones(lanes, np.int32)
        for i in range(len(grid)):
            n = running[i]
            if not n:
                break
            symbols = grid[i, :n]
            following = flat[state[:n] * width + symbols]
            missed = np.flatnonzero(following < 0)
            if len(missed):
                # the phrase ended before this character, which begins the next one
                began = state[missed] > 0
                count[missed] += began
                again = fresh[symbols[missed]]
                unseen = again < 0
                count[missed] += unseen
                following[missed] = np.where(unseen, 0, again)
            state[:n] = following
        # a piece that ends right after an unseen character has no open phrase
        return count - (state == 0)


_models: dict[str, Model] = {}


def _model(texts: dict[str, str]) -> Model:
    name = hashlib.sha1(repr(sorted(texts.items())).encode()).hexdigest()
    if name not in _models:
        _models.clear()
        _models[name] = Model(texts)
    return _models[name]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Labelled text per language, from a bounded sample of the rows of ``docs``.

    Of each language, whole documents in the order of a hash of their text, up to
    ``docs_per_language``, joined until ``chars`` characters are reached. Rows
    without language, or without a letter, are not used. So the model, which goes to
    every task, holds at most ``chars`` characters for each of at most
    ``MOST_LANGUAGES`` languages; more languages are an error.
    """
    labelled = docs.where(F.col(lang).isNotNull() & has_letter(text)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # spread the pick: a few documents per hash class first, then per language
    rank = Window.partitionBy("lang", F.pmod(F.xxhash64("text"), F.lit(64))).orderBy(F.xxhash64("text", F.lit(7)), "text")
    few = labelled.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= -(-docs_per_language // 64)).drop("r")
    # a text with many copies counts once
    few = few.dropDuplicates(["lang", "text"])
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(7)), "text")
    few = few.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= docs_per_language)
    # what a text can add to the sample is bounded by the sample's size
    few = few.select("lang", "r", F.left("text", F.lit(chars)).alias("text"))
    found: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for row in few.orderBy("lang", "r").toLocalIterator():
        size = sizes.setdefault(row["lang"], 0)
        if len(sizes) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
        if size < chars:
            part = normalised(row["text"])[: chars - size]
            found.setdefault(row["lang"], []).append(part)
            sizes[row["lang"]] = size + len(part)
    return {language: " ".join(parts) for language, parts in found.items()}


def predict(docs: DataFrame, texts: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from its whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Otherwise score is the winner's share of 2^(-12 * bits per character)
    over the languages, from 0 to 1; ties go to the language first by name. Rows
    repeat as given, null keys included; no other column is read.
    """
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    found = _with_prediction(slim, texts, "t")
    return found.select(F.col("k").alias(key), "lang_pred", "score")


def keep_known(docs: DataFrame, texts: dict[str, str], least_score: float, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose language is told with ``least_score`` or more; columns as given."""
    packed = docs.select(F.col(text).cast("string").alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = _with_prediction(packed, texts, "t")
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _with_prediction(rows: DataFrame, texts: dict[str, str], text: str) -> DataFrame:
    """``rows`` with lang_pred and score; other columns pass through as they are."""
    shared = rows.sparkSession.sparkContext.broadcast(texts)
    place = rows.columns.index(text)

    def run(batches):
        model = _model(shared.value) if shared.value else None
        for batch in batches:
            column = batch.column(place)
            names: list[str] = []
            scores: list[float] = []
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            # texts of a few million bytes at a time
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // _PARSED_BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                for name, score in _winners(model, [normalised(v or "") for v in column.slice(a, b - a).to_pylist()]):
                    names.append(name)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def _winners(model: Model | None, texts: list[str]):
    if model is None:
        yield from ((UNDETERMINED, 0.0) for _ in texts)
        return
    for text, row in zip(texts, model.bits_per_char(texts)):
        if not text.strip():
            yield UNDETERMINED, 0.0
            continue
        weights = np.exp2(-_SHARPNESS * (row - row.min()))
        best = int(np.argmin(row))
        yield model.languages[best], float(weights[best] / weights.sum())


def held_out(key: str = "doc_id"):
    """True for a fifth of the documents, by the checksum of the id."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): learned without the held-out rows, predicted for all.

    A null key counts as held out.
    """
    rest = docs.where(~F.coalesce(held_out(key), F.lit(True)))
    predicted = predict(docs, learn(rest, text, lang), key, text)
    return predicted.select(key, F.coalesce(held_out(key), F.lit(True)).alias("held_out"), "lang_pred", "score")
