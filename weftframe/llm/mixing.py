"""Mixing by soft membership: document rates whose expected domain totals meet targets.

A classifier trained on a labelled table gives each document a posterior over
domains. Nonnegative rates are then fitted by projected gradient descent on the
squared relative errors of the expected tokens per domain. Every step is one
aggregation of a slim table to one number per domain; the steps so far, a few
numbers each, are folded per document, so no rates are stored between steps.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftframe.llm.common import hash_sample, written

# bounds of the labelled sample and of the words the classifier knows
TRAIN_ROWS = 6_000
VOCABULARY = 500
LEAST_DOCUMENTS = 8
MOST_STEPS = 40
TOLERANCE = 1e-6
_SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = bytes(b" "[0] if chr(i) in "!\"'(),-./:;?[]_`{}~" else i for i in range(256))
_MEASURES = 6


def _words(text: bytes) -> list[bytes]:
    return text.lower().translate(_PUNCTUATION).split()


def _measured(text: bytes, words: list[bytes], distinct: set[bytes]) -> list[float]:
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(words))),
        min(4.0, sum(text.count(bytes([s])) for s in _SYMBOLS) / n),
        len(distinct) / n,
        min(20.0, sum(map(len, distinct)) / max(1, len(distinct))),
        1 - len(set(lines)) / max(1, len(lines)),
        float(len(text.split()) / n),
    ]


@dataclass
class Classifier:
    """Softmax regression over known words and a few measures of the text."""

    domains: list[str]
    words: list[bytes]
    centre: np.ndarray = field(repr=False)
    scale: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        logits = np.column_stack(((features - self.centre) / self.scale, np.ones(len(features)))) @ self.weights
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def _features(texts: Sequence[bytes], places: dict[bytes, int]) -> tuple[np.ndarray, list[int]]:
    rows = np.zeros((len(texts), _MEASURES + len(places)))
    counts = []
    known = places.keys()
    for row, text in zip(rows, texts):
        words = _words(text)
        distinct = set(words)
        row[:_MEASURES] = _measured(text, words, distinct)
        for word in distinct & known:
            row[_MEASURES + places[word]] = 1.0
        counts.append(len(text.split()))
    return rows, counts


def _byte_texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def learn(docs: DataFrame, labels: DataFrame, domain: Column, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Classifier | None:
    """Classifier of ``domain``, an expression over ``labels``, from at most ``rows`` labelled documents.

    The sample is the labelled keys in the order of a hash, of repeated keys the text
    of smallest digest; of several domains of a key the first by name; labels without key or domain are left out. The vocabulary is the words most associated with a domain
    by chi-square among those of at least 8 sampled documents. None without labels.
    """
    known = labels.select(F.col(key).alias("k"), domain.alias("domain")).where("k is not null and domain is not null")
    chosen = hash_sample(known.groupBy("k").agg(F.min("domain").alias("domain")), "k", rows, known.count())
    sample = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sample = sample.join(F.broadcast(chosen), "k").groupBy("k", "domain").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    sample = written(sample, "labelled")

    def run(batches):
        for batch in batches:
            sets = [list(set(_words(t))) for t in _byte_texts(batch.column(1))]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            flat = pa.array([w for s in sets for w in s], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["domain", "words"])

    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    if not sizes:
        return None
    domains = sorted(sizes)
    total = sum(sizes.values())
    seen = sample.select("domain", "text").mapInArrow(run, "domain string, words array<binary>")
    seen = seen.select("domain", F.explode("words").alias("word")).groupBy("word")
    counts = seen.agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    n = F.col("n").cast("double")
    chi = F.lit(0.0)
    for i, d in enumerate(domains):
        expected = n * sizes[d] / total
        chi = chi + F.pow(F.col(f"n{i}") - expected, 2) / expected * total / F.greatest(total - n, F.lit(1.0))
    words = counts.where(n >= LEAST_DOCUMENTS).orderBy(chi.desc(), "word").select("word").limit(VOCABULARY).collect()
    words = [bytes(r["word"]) for r in words]
    places = {w: i for i, w in enumerate(words)}

    def features(batches):
        for batch in batches:
            rows_, _ = _features(_byte_texts(batch.column(1)), places)
            values = pa.array(list(rows_.astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["domain", "x"])

    taken = sample.select("domain", "text").mapInArrow(features, "domain string, x array<float>").toArrow()
    x = taken.column("x").combine_chunks().values.to_numpy().reshape(taken.num_rows, -1).astype(np.float64)
    y = np.array([domains.index(d) for d in taken.column("domain").to_pylist()])
    return _softmax_regression(domains, words, x, y)


def _softmax_regression(domains, words, x, y, steps: int = 500, penalty: float = 1e-5) -> Classifier:
    order = np.lexsort((*x.T[:_MEASURES], y))
    x, y = x[order], y[order]
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    scale[_MEASURES:] = 0.25
    design = np.column_stack(((x - centre) / scale, np.ones(len(x))))
    target = np.eye(len(domains))[y]
    longest = np.ones(design.shape[1])
    for _ in range(30):
        longest = design.T @ (design @ longest)
        longest /= np.linalg.norm(longest)
    rate = 1.0 / (0.55 * np.linalg.norm(design @ longest) ** 2 / len(x) + penalty)
    weights = look = np.zeros((design.shape[1], len(domains)))
    for step in range(steps):
        logits = design @ look
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        slope = design.T @ (odds / odds.sum(axis=1, keepdims=True) - target) / len(x) + penalty * look
        moved = look - rate * slope
        look = moved + step / (step + 3) * (moved - weights)
        weights = moved
    return Classifier(domains, words, centre, scale, weights)


def members(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, p0, p1, ...): words and domain posterior of every row, from its whole text."""
    # plain values: executors need not have this package, which a broadcast instance would ask for
    shared = docs.sparkSession.sparkContext.broadcast({f.name: getattr(classifier, f.name) for f in fields(classifier)})
    names = [f"p{i}" for i in range(len(classifier.domains))]

    def run(batches):
        model = Classifier(**shared.value)
        places = {w: i for i, w in enumerate(model.words)}
        for whole in batches:
            for first in range(0, whole.num_rows, 1_000):
                batch = whole.slice(first, 1_000)
                rows, counts = _features(_byte_texts(batch.column(1)), places)
                chances = model.posteriors(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), *[pa.array(c) for c in chances.T]], names=["k", "n_tokens", *names]
                )

    slim = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    schema = "k long, n_tokens long, " + ", ".join(f"{n} double" for n in names)
    return slim.mapInArrow(run, schema).withColumnRenamed("k", key)


def rate_column(steps: Sequence[Sequence[float]]) -> Column:
    """Rate of a row after the given gradient steps from 1, each projected to be nonnegative.

    The steps are one array value, so the generated code is the same for any number of them.
    """
    return _folded(steps)["rate"]


def _folded(steps: Sequence[Sequence[float]]) -> Column:
    """``rate`` after the steps, and ``ahead``, where momentum takes it before the next.

    A step holds the slope per domain, then the momentum that follows it.
    """
    begin = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    if not steps:
        return begin
    listed = F.array(*[F.array(*[F.lit(float(s)) for s in step]) for step in steps])
    domains = len(steps[0]) - 1

    def moved(state: Column, step: Column) -> Column:
        rate = state["ahead"]
        for i in range(domains):
            rate = rate - F.col(f"p{i}") * step[i]
        rate = F.greatest(F.lit(0.0), rate)
        return F.struct(rate.alias("rate"), (rate + step[domains] * (rate - state["rate"])).alias("ahead"))

    return F.aggregate(listed, begin, moved)


def target_totals(totals: Sequence[float], weights: Sequence[float], anchor: int | None = None, repeat: bool = True) -> list[float]:
    """Tokens wanted per domain at the given weights.

    The ``anchor`` domain is kept whole; without one, the total is the largest that
    needs no domain more than once. Without ``repeat`` no domain is asked for more
    than it has.
    """
    share = np.array(weights, float) / sum(weights)
    has = np.array(totals, float)
    if anchor is None:
        with np.errstate(divide="ignore"):
            whole = np.min(np.where(share > 0, has / np.where(share > 0, share, 1), np.inf))
    else:
        whole = has[anchor] / share[anchor]
    wanted = share * whole
    return (wanted if repeat else np.minimum(wanted, has)).tolist()


def fit_rates(members_: DataFrame, wanted, most_steps: int = MOST_STEPS) -> list[list[float]]:
    """Steps whose fold (``rate_column``) gives the rates; ``wanted`` maps current totals to targets.

    Minimises the sum over domains of (expected - target)^2 / current total, in the
    metric that weighs a document by its tokens; there a step of length 1 is safe,
    as its curvature is that of a stochastic matrix. Domains without tokens are left
    out. Steps carry momentum. Stops when no domain's total moves by more than 1e-6
    of it; a warning tells where ``most_steps`` came first.
    """
    names = [c for c in members_.columns if c.startswith("p") and c[1:].isdigit()]

    def expected(steps):
        weighed = members_.withColumn("_t", F.col("n_tokens") * _folded(steps)["ahead"])
        return [v or 0.0 for v in weighed.agg(*[F.sum(F.col("_t") * F.col(n)).alias(n) for n in names]).first()]

    current = expected([])
    targets = wanted(current)
    steps: list[list[float]] = []
    now = current
    for turn in range(most_steps):
        slope = [(e - t) / c if c > 0 else 0.0 for e, t, c in zip(now, targets, current)]
        steps.append([*slope, turn / (turn + 3)])
        before, now = now, expected(steps)
        if max((abs(a - b) / c for a, b, c in zip(now, before, current) if c > 0), default=0.0) < TOLERANCE:
            break
    else:
        warnings.warn(f"the rates moved a domain's total by more than {TOLERANCE} of it in the last of {most_steps} steps", stacklevel=2)
    return steps


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    weights: dict[str, float],
    key: str = "doc_id",
    text: str = "text",
    anchor: str | None = None,
    repeat: bool = True,
) -> DataFrame:
    """(key, n_tokens, domain, one posterior ``p_<domain>`` each, rate) of every row of ``docs``.

    Domains without a weight get 0. Null and empty texts have no tokens and the rate
    of their posterior. Rows repeat as given, null keys included. Without labels
    every rate is 1 and the domain is null. No rows give no rows.
    """
    classifier = learn(docs, labels, domain, key, text)
    if classifier is None:
        words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
        none = F.lit(None)
        return docs.select(
            F.col(key).cast("long").alias(key), F.size(words).cast("long").alias("n_tokens"), none.cast("string").alias("domain"), F.lit(1.0).alias("rate")
        )
    soft = written(members(docs, classifier, key, text), "members")
    wish = [weights.get(d, 0.0) for d in classifier.domains]
    at = classifier.domains.index(anchor) if anchor in classifier.domains else None
    steps = fit_rates(soft, lambda totals: target_totals(totals, wish, at, repeat))
    names = [f"p{i}" for i in range(len(wish))]
    top = F.greatest(*names) if len(names) > 1 else F.col("p0")
    best = F.coalesce(*[F.when(F.col(n) == top, F.lit(d)) for n, d in zip(names, classifier.domains)])
    return soft.select(
        key, "n_tokens", best.alias("domain"), *[F.col(n).alias(f"p_{d}") for n, d in zip(names, classifier.domains)], rate_column(steps).alias("rate")
    )


def chance(key: str = "doc_id", seed: int = 11) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))


def mixed(docs: DataFrame, rates: DataFrame, key: str = "doc_id", repeat: bool = True) -> DataFrame:
    """Rows of ``docs`` drawn at their rates: the whole part of the rate as copies, the rest by chance.

    Without ``repeat`` at most one copy. A key that occurs in several rows takes the
    largest of its rates; keys without a rate, null ones too, are kept once.
    """
    names = docs.columns
    packed = docs.select(F.col(key).alias("_k"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"))
    rate = rates.groupBy(F.col(key).alias("_k")).agg(F.max("rate").alias("_rate")).where("_k is not null")
    joined = packed.join(rate, "_k", "left").withColumn("_rate", F.coalesce("_rate", F.lit(1.0)))
    back = [F.col("_row").getField(n).alias(n) for n in names]
    if not repeat:
        return joined.where(chance("_k") < F.col("_rate")).select(*back)
    copies = F.floor("_rate") + F.when(chance("_k") < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*back)


def label_domain() -> Column:
    """Domain of a labelled document: toxic, good or poor, by its two marks."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


# Token shares asked for by the query and the pipeline.
WEIGHTS = {"good": 0.96, "poor": 0.03, "toxic": 0.01}
