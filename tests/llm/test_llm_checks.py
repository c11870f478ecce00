"""Decontamination, hard negatives and the manifest, against plain loops."""

import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from llm_inputs import CLASHES, DOC_SCHEMA, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from weftframe.llm import decontamination, hard_negatives, manifest

# --- decontamination


def plain_match(text, items, width):
    words = decontamination.words_of(text)
    hit, got = [False] * len(words), set()
    for item, body in items:
        own = decontamination.words_of(body)
        n = min(width, len(own))
        for s in range(len(own) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[s : s + n]:
                    got.add(item)
                    hit[p : p + n] = [True] * n
    return len(words), sum(hit), got


def test_automaton_against_every_window(monkeypatch):
    r = random.Random(1)
    for _ in range(400):
        alphabet = "abc"[: r.randint(1, 3)]
        text = lambda n: " ".join(r.choice(alphabet) * r.randint(1, 2) for _ in range(r.randint(0, n))).encode()  # noqa: E731, B023
        items = [(str(i), text(9)) for i in range(r.randint(0, 6))]
        monkeypatch.setattr(decontamination, "_PIECE", r.choice([1, 3, 7, 1000]))
        body = text(40)
        n, spans, found = decontamination._measured(body, decontamination.automaton(items, 4))
        assert (n, sum(last - first + 1 for first, last in spans), found) == plain_match(body, items, 4)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def test_words_and_windows_of_the_contract(spark):
    items = [(1, PASSAGE), (10, "ÉTUDE 7"), (2, None), (3, " .,"), (None, "alone here"), (1, PASSAGE)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = {
        1: "x, One TWO-three four five six seven eight nine; ten! y",
        2: "one two three four five six seven eight nine x ten eleven twelve",
        3: "Étude 7 ÉTUDE 7 étude_7",
        4: None,
        5: "",
        6: "alone here",
        7: "a " * 300_000 + PASSAGE,
    }
    docs = spark.createDataFrame([(k, v, None, None, None) for k, v in texts.items()] * 2, DOC_SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, benchmark).collect()}
    measured = {k: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for k, r in got.items()}
    # only A-Z is lowered, so É and é differ, TUDE and tude do not
    assert measured == {1: (12, 10, 1, True), 2: (13, 0, 0, False), 3: (6, 4, 1, True), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (2, 2, 0, True), 7: (300_012, 12, 1, True)}
    assert got[7]["items_sha256"] == sha256(b"1").hexdigest() and got[4]["items_sha256"] == sha256(b"").hexdigest()
    assert decontamination.contamination(docs, benchmark).count() == 14
    assert decontamination.contamination(docs, benchmark.where("false")).where("contaminated").isEmpty()
    assert decontamination.contamination(docs.where("false"), benchmark).count() == 0


def test_several_blocks_of_items_and_repeated_hits(spark, odd_docs, monkeypatch):
    r = random.Random(4)
    word = lambda: r.choice(["a", "b", "c"])
    items = [(i, " ".join(word() for _ in range(r.randint(1, 9)))) for i in range(30)]
    rows = [(i, " ".join(word() for _ in range(60)), None, None, None) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    assert len(decontamination.item_blocks(benchmark, 6)) > 2
    plain = [(str(i), t.encode()) for i, t in items]
    for row in decontamination.mark(docs, benchmark, 6).collect():
        assert (row["n_words"], row["n_hit"], set(row["items"])) == plain_match(rows[row["doc_id"]][1].encode(), plain, 6)
        assert row["items"] == sorted(row["items"])
    assert decontamination.mark(odd_docs, benchmark, 6).count() == odd_docs.count()


def test_spans_are_cut_and_covered_texts_go(spark):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    filler = "alpha beta gamma delta " * 10
    rows = [(1, f"{filler}<{PASSAGE}> omega", "en", "a", 1), (2, f"x {PASSAGE} y", "en", "a", 1), (3, "clean\ttext ", "en", "a", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})
    got = decontamination.decontaminate(docs, benchmark, most_share=0.5)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: f"{filler}<> omega", 3: "clean\ttext ", 4: None}


# --- hard negatives


def plain_negatives(rows, anchor_every, n_positives=5, n_negatives=3):
    out = []
    q = {i: [int(np.floor(256 * float(x))) for x in v] for i, v, _ in rows}
    label = {i: lb for i, _, lb in rows}
    for a in sorted(q):
        if a % anchor_every:
            continue
        score = {c: sum(x * y for x, y in zip(q[a], q[c])) for c in q if c != a}
        order = sorted(score, key=lambda c: (-score[c], c))
        for p in [c for c in order if label[c] == label[a]][:n_positives]:
            fits = [c for c in order if label[c] != label[a] and 50 * score[p] <= 100 * score[c] <= 95 * score[p]]
            out += [(a, p, n, c, score[p], score[c]) for n, c in enumerate(fits[:n_negatives], 1)]
    return Counter(out)


@pytest.mark.parametrize("group, block", [(512, 16_384), (4, 100)])
def test_negatives_against_all_scores(spark, monkeypatch, group, block):
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", group)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((6, 8))
    rows = [(int(i), (middles[i % 6] + 0.2 * rng.standard_normal(8)).round(2).tolist(), int(rng.integers(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "own", "anchor", "group", "block", "role", "code", "place", "rank", "positive", "score", "vector")})
    got = hard_negatives.mine(df, lambda i: i % 10 == 0).collect()
    assert Counter(tuple(r) for r in got) == plain_negatives(rows, 10)


def test_bounds_leave_candidates_out():
    rng = np.random.default_rng(3)
    anchors = np.floor(256 * (np.ones(16) + 0.01 * rng.standard_normal((20, 16)))).astype(np.int64)
    rows = np.floor(256 * rng.standard_normal((3_000, 16))).astype(np.int64)
    low, high = 900_000, 1_000_000
    seen = 0
    for node, places, scores in hard_negatives.walk(anchors, rows, lambda node, lo, hi: (hi >= low) & (lo <= high)):
        exact = rows @ anchors[node]
        assert set(np.flatnonzero((exact >= low) & (exact <= high))) <= set(places.tolist())
        assert (exact[places] == scores).all()
        seen += len(places)
    assert seen < 0.5 * len(rows) * len(anchors)


def test_odd_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, float(i % 4)], i % 2) for i in range(24)] + [(30, [0.5], 0), (31, [], 1), (32, [-1.0, -1.0], 0)]
    odd = [(40, None, 1), (41, [1.0, nan], 1), (42, [inf, 1.0], 1), (43, [None, 1.0], 1), (44, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(good + good[:5] + odd, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(df, lambda i: i % 10 == 0)
    assert Counter(tuple(r) for r in got.collect()) == plain_negatives(good, 10)
    assert hard_negatives.mine(df.where("vec_id = 10"), lambda i: i % 10 == 0).count() == 0
    empty = hard_negatives.mine(df.where("false"), lambda i: i % 10 == 0)
    assert empty.count() == 0 and empty.columns == got.columns


# --- manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_tree(leaves, arity=8):
    """Root and per leaf the siblings level by level."""
    paths, here, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    places = []
    while len(here) > 1:
        for path, i in zip(paths, at):
            low = i // arity * arity
            path.append((here[low:i], here[i + 1 : low + arity]))
        here = [h("".join(here[i : i + arity])) for i in range(0, len(here), arity)]
        at = [i // arity for i in at]
    return here[0], paths, places


def folded(leaf, path):
    for before, after in path:
        leaf = h("".join([*before, leaf, *after]))
    return leaf


def plain_manifest(rows):
    def leaf(r, text):
        values = [r[0], r[3], r[2], r[4], text]
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tampered(r):
        if r[0] is None or r[1] is None or crc32(str(r[0]).encode()) % 3:
            return r[1]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])

    out = []
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, tampered(r)), r[0]) for r in rows if r[2] == lang), key=lambda x: x[:4])
        groups.append((own, *plain_tree([o[2] for o in own])[:2]))
    root, tops, _ = plain_tree([g[1] for g in groups]) if groups else (None, [], [])
    for (own, top, paths), upper in zip(groups, tops):
        for o, path in zip(own, paths):
            proof = h("".join("".join(b) + "".join(a) for b, a in path + upper))
            new = folded(o[3], path + upper)
            out.append((o[4], o[2], top, root, proof, new, new == root))
    return Counter(out)


@pytest.mark.parametrize("run_rows", [7, 16_384])
def test_manifest_against_a_plain_tree(spark, odd_docs, monkeypatch, run_rows):
    monkeypatch.setattr(manifest, "RUN_ROWS", run_rows)
    rows = [tuple(r)[:5] for r in odd_docs.collect()]
    got = manifest.documents_manifest(odd_docs)
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(rows)
    r = random.Random(5)
    # a hot language, one of a single row, ten in all
    many = [(i, f"Text {i} É A{r.random()}", r.choice(["en"] * 9 + [None, "", "de", "fr", "Ä", "zh", "x1", "x2", "x3"]), None, i) for i in range(1_300)]
    many.append((-5, "One", "solo", "s", 3))
    docs = spark.createDataFrame(many, DOC_SCHEMA).repartition(9)
    assert Counter(tuple(x) for x in manifest.documents_manifest(docs).collect()) == plain_manifest(many)


def test_one_leaf_one_group_and_none(spark):
    for n in (1, 8, 9, 65):
        rows = [(i, "Same", "en", None, None) for i in range(n)]
        got = manifest.documents_manifest(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
        assert Counter(tuple(x) for x in got) == plain_manifest(rows)
    assert manifest.documents_manifest(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_missing_nodes_are_the_least_that_proofs_need():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 700)
        first = r.randrange(n)
        end = r.randint(first + 1, n)
        sizes = manifest.level_sizes(n)
        needed = set()
        for leaf in range(first, end):
            for level, size in enumerate(sizes[:-1]):
                low = leaf // 8 * 8
                needed |= {(level, i) for i in range(low, min(size, low + 8)) if i != leaf}
                leaf //= 8
        # what lies above a leaf of the run is derived, not fetched
        own = {(level, leaf // 8**level) for leaf in range(first, end) for level in range(len(sizes))}
        assert set(manifest.missing(first, end, sizes)) == needed - own


def test_full_proofs_on_request(spark):
    leaves = spark.createDataFrame([("=a", i, h(str(i)), h(str(i))) for i in range(20)], "g string, id long, hash string, fold string")
    got = manifest.manifest(leaves).collect()
    assert all(h("".join(r["proof"])) == r["proof_sha256"] and r["verified"] for r in got) and len(got) == 20


# --- long words without blanks


def test_long_unspaced_words_against_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    from weftframe.llm import pieces
    from weftframe.llm.common import vocabulary

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    texts = [
        "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(2_000)),
        "x1" * 600,
        "".join(r.choice("の日本語をテストするabc é") for _ in range(900)),
        "ab" * 40 + "日本" * 40 + "the quick" * 20,
        "a" * 120,
        "word " + "é" * 70 + "\n" + "日" * 60 + " end",
    ]
    assert [i.tolist() for i in pieces.pieces_of(path).encode_batch(texts)] == [library.encode(t) for t in texts]
