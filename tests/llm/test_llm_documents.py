"""Operators over documents: brute force, round trips, held-out accuracy and odd inputs."""

import math
import random
import re
import zlib
from itertools import combinations

import comparing
import duckdb
import numpy as np
import pytest
import xxhash
from llm_inputs import DOC_SCHEMA, SMALL, no_docs, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from weftframe.llm import components, language_parsing, licence_scan, mixing, pieces, quality_cascade, simhash, token_lists
from weftframe.llm.common import vocabulary, written
from weftframe.llm.components import connected_components
from weftframe.llm.queries import LLM_ORACLES, LLM_QUERIES
from weftframe.session import scratch_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
documents = lambda: duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_same_rows_and_types_as_duckdb(spark, small, name):
    con = comparing.connect(small)
    df = LLM_QUERIES[name](spark, small)
    assert comparing.type_gaps(con, LLM_ORACLES[name], df) == {}
    assert comparing.difference(con, LLM_ORACLES[name], df) is None


# --- near duplicates


def brute_print(text, width):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spans = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query_against_brute_force(spark, small):
    prints = {i: brute_print(t, 3) for i, t in documents()}
    groups = brute_groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in LLM_QUERIES["op10_simhash"](spark, small).collect()}
    assert got == {i: (format(p, "016x"), groups[i]) for i, p in prints.items()}


def test_blocks_meet_for_every_pair_within_the_distance():
    r = random.Random(5)
    for distance, blocks in ((3, 5), (6, 9), (3, 4)):
        masks = [m % (1 << 64) for m in simhash.block_masks(distance, blocks)]
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), distance):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_crowded_buckets_link_the_same_groups(spark):
    r = random.Random(6)
    centre = r.getrandbits(63)
    near = {centre}
    while len(near) < 150:
        p = r.choice(sorted(near))
        for bit in r.sample(range(40), r.randint(1, 4)):
            p ^= 1 << bit
        near.add(p)
    rows = [(i, p) for i, p in enumerate(sorted(near))]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    want = brute_groups(range(len(rows)), lambda a, b: (rows[a][1] ^ rows[b][1]).bit_count() <= 3)
    for limit in (8, 10_000):
        got = {x["doc_id"]: x["component_id"] for x in simhash.near_groups(df, pair_limit=limit).collect()}
        assert got == want


def test_points_around_are_all_within_a_radius_and_no_list_in_the_plan(spark):
    values = [0, -1, 1 << 62, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for radius, count in ((0, 1), (1, 65), (2, 2081)):
        points = simhash.points_around(df, radius)
        got = [(r["fingerprint"], r["point"]) for r in points.collect()]
        assert len(got) == len(set(got)) == count * len(values)
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius for a, b in got)
        assert len(points._jdf.queryExecution().toString()) < 20_000


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


def test_components_of_settled_groups_take_no_round(spark, monkeypatch):
    """Links that lead to the smallest node of their group are written once; a further link takes rounds."""
    tables = []
    write = components.written
    monkeypatch.setattr(components, "written", lambda *a: tables.append(a) or write(*a))
    stars = [(100, i) for i in range(101, 130)] + [(i, 200) for i in range(201, 230)]
    want = {**{i: 100 for i in range(100, 130)}, **{i: 200 for i in range(200, 230)}}
    for links, last in ((stars, 200), ([*stars, (129, 229)], 100)):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {i: min(last, c) for i, c in want.items()}
        assert (len(tables) == 1) == (links is stars)


def tasks_of(spark, name, job):
    """What ``job`` returns, and the tasks of all its Spark jobs."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        result = job()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return result, sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_components_take_few_tasks_however_small_the_links(spark):
    """A round takes one join for either step and one test, so the driver of a session with many partitions keeps few tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(12)] * 2, "a long, b long").coalesce(1)
        rows, tasks = tasks_of(spark, "components", lambda: connected_components(links).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r["node"]: r["component"] for r in rows} == {i: 0 for i in range(13)}
    assert len(rows) == 13
    assert tasks <= 720


def test_links_of_fingerprints_are_a_table_before_texts_are_paired(spark):
    """The plan that pairs texts reads them, instead of repeating the search for close fingerprints in itself."""
    prints = spark.createDataFrame([(i, i // 2 * 0x1111) for i in range(40)], "id long, fingerprint long")
    pairs = simhash.fingerprint_pairs(prints)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "bit_count" not in plan
    assert {(0, 1), (2, 3)} <= {(r["a"], r["b"]) for r in pairs.collect()}


def test_exploded_rows_are_never_broadcast(spark):
    """Their size is estimated by the table before the explode, so a broadcast would fill the driver."""
    prints = spark.createDataFrame([((1 << i) | (1 << j),) for i in range(30) for j in range(i)], "fingerprint long")
    links = simhash.close_links(prints, pair_limit=8)
    pool = spark.createDataFrame([(1, i, 10, 0, i) for i in range(600)], "hash long, id long, size int, place int, group long")
    for df, key in ((links, "point"), (simhash._pairs_within(pool, 0.8, 512), "high")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join [" in line and key + "#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
    near = {r["fingerprint"] for r in prints.collect()}
    got = {(r["x"], r["y"]) for r in links.collect()}
    assert {f for pair in got for f in pair} == near
    assert simhash._pairs_within(pool, 0.8, 512).count() == 600 * 599 // 2


def edited(text, seed, changes):
    r = random.Random(seed)
    words = text.split()
    for at in r.sample(range(len(words)), changes):
        words[at] = "new" + str(r.randint(0, 999))
    return " ".join(words)


@pytest.mark.parametrize("limit", [24, 4])
def test_similar_texts_finds_planted_copies_and_nothing_else(spark, limit):
    base = {i: prose(100 + i, 150) for i in range(30)}
    rows = [(i, t) for i, t in base.items()]
    rows += [(100 + i, edited(t, i, 1)) for i, t in base.items() if i < 20]
    rows += [(200 + j, edited(base[0], 50 + j, 2)) for j in range(40)]
    rows += [(300 + i, t.upper() + "  ") for i, t in base.items() if i < 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, pair_limit=limit).collect()}
    sets = {i: set(simhash.shingle_spans(t.lower().encode().split(), 5)) for i, t in rows}
    want = brute_groups(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    # clean texts stay alone, planted ones are found but for a few
    assert all(got[i] == i for i in range(20, 30))
    assert all(want[got[i]] == want[i] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)


def groups_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, **more).collect()}


def plain_groups(rows, similarity=0.8):
    sets = {i: set(simhash.shingle_spans(t.lower().encode().split(), 5)) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: top(i) for i in sets}


def test_copies_of_one_original_with_the_largest_id_stay_together(spark):
    r = random.Random(4)
    base = prose(77, 150).split()
    rows = [(10_000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for at in r.sample(range(150), 3):
            words[at] = f"edit{i}x{at}"
        rows.append((i + 1, " ".join(words)))
    expected = plain_groups(rows)
    assert expected[10_000] == 1
    assert groups_of(spark, rows) == expected
    assert groups_of(spark, rows, pair_limit=16, rounds=1) == expected


def test_appended_and_truncated_copies_are_found(spark):
    rows, i = [], 0
    for seed in range(60):
        base = prose(1_000 + seed, 100 + seed * 5).split()
        n = len(base)
        added = prose(5_000 + seed, n // 5).split()
        for words in (base, base + added[: n // 10], added[: n // 6] + base, base[n // 10 :], base[: n - n // 7]):
            i += 1
            rows.append((i, " ".join(words)))
    expected = plain_groups(rows)
    assert len(set(expected.values())) < 100
    assert groups_of(spark, rows) == expected


# --- quality


def test_order_of_rules_does_not_change_the_verdict(spark):
    docs = spark.createDataFrame([(i, prose(i, 30) if i % 3 else "## " * 30) for i in range(40)], "doc_id long, text string")
    worded = quality_cascade.with_words(docs)
    rules = quality_cascade.default_rules()
    ordered = quality_cascade.order_rules(worded, rules)
    assert {r.name for r in ordered} == {r.name for r in rules}
    kept = lambda rs: {r[0] for r in worded.where(quality_cascade.passes(rs)).select("doc_id").collect()}
    assert kept(ordered) == kept(rules) == kept(rules[::-1]) == {i for i in range(40) if i % 3}


def test_a_rule_that_rejects_much_at_low_cost_goes_first(spark):
    docs = spark.createDataFrame([(i, prose(i, 300)) for i in range(300)], "doc_id long, text string")
    costly = F.size(F.filter("words", lambda w: w.rlike("(e+|t+)+x(a|b)"))) > 10_000
    rules = [quality_cascade.Rule("never", costly), quality_cascade.Rule("all", F.col("n_words") > 0)]
    assert [r.name for r in quality_cascade.order_rules(quality_cascade.with_words(docs), rules)][0] == "all"


def test_repeated_words_of_a_text_with_one_long_passage_twice(spark):
    passage = prose(9, 12)
    text = f"{prose(10, 30)} {passage} {prose(11, 30)} {passage}"
    df = spark.createDataFrame([(text,), (passage,), ("a " * 9,), ("a " * 8,)], "text string")
    got = [r[0] for r in df.select(quality_cascade.repeat_words(F.split(F.trim("text"), " "))).collect()]
    assert got == [24, 0, 9, 0]


# --- language


def test_held_out_accuracy_of_languages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = LLM_QUERIES["op2_cross_parsing"](spark, small).join(docs.select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert row[1] > 20 and row[0] > 0.97
    assert found.where("score < 0 or score > 1 or score is null").isEmpty()
    assert {r["doc_id"]: r["held_out"] for r in found.collect()} == {
        i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in documents()
    }


def test_phrases_against_plain_longest_matches():
    r = random.Random(1)
    learned = {"a": "".join(r.choices("abc ", k=700)), "b": "".join(r.choices("bcd ", k=400))}
    model = language_parsing.Model(learned)

    def phrases(text, known):
        at = count = 0
        while at < len(text):
            n = 1
            while at + n <= len(text) and text[at : at + n] in known:
                n += 1
            at, count = at + max(1, n - 1), count + 1
        return count

    texts = ["".join(r.choices("abcdx ", k=r.randint(0, 700))) for _ in range(40)]
    for text, bits in zip(texts, model.bits_per_char(texts)):
        for known, got in zip(learned.values(), bits):
            cut = [text[i : i + language_parsing.PIECE] for i in range(0, len(text), language_parsing.PIECE)]
            assert got == pytest.approx(sum(phrases(t, known) for t in cut) * math.log2(len(known)) / max(1, len(text)))


# --- pieces and tokens


def test_pieces_are_the_librarys(spark, small):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    texts = [t for _, t in documents()] + ["", " ", "  a", " Hi   you\n\té 😀 ", "x" * 500, "日本語 ab", "aaaaaaaa bbbb", "\x00"]
    texts += ["".join(r.choices("etaoin shrdlu.,ETA 0123\n", k=50)) for _ in range(500)]
    model = pieces.pieces_of(path)
    got = model.encode_batch(texts)
    assert [g.tolist() for g in got] == library.encode(texts)
    assert [model.decode(g.tolist()) for g in got] == texts
    assert LLM_QUERIES["op3_sentencepiece"](spark, small).where("not round_trip").isEmpty()


def test_token_lists_against_the_tokenizer(spark, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want, start = {}, 0
    for i, text in documents():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = LLM_QUERIES["op8_token_lists"](spark, small).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_strings_of_added_tokens_get_their_ids():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    assert added
    texts = ["plain words, and more.\nnext line", "", *(f"one {a} two\n{a}three {a}" for a in added), *added, "one two"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [ids.tolist() for ids in token_lists.Encoder(path).encode(texts, 2)] == want


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_and_selective_reads(spark, small, encoding):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "tokens")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    token_lists.write_tokens(docs, path, vocabulary("byte_bpe_50k.json"), encoding=encoding, partitions=3)
    files = sorted(glob.glob(path.removeprefix("file:") + "/*.parquet"))
    ids = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert ids == sorted(ids) and len(ids) == docs.count()
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    column = next(meta.column(i) for i in range(meta.num_columns) if "ids" in meta.column(i).path_in_schema)
    assert column.has_offset_index
    used = " ".join(map(str, column.encodings))
    assert ("DELTA" in used) == (encoding == "delta") and ("DICTIONARY" in used) == (encoding == "dictionary")
    whole = [i for r in spark.read.parquet(path).orderBy("doc_id").collect() for i in r["ids"]]
    span = token_lists.read_span(spark, path, 100, 900).orderBy("at").collect()
    assert [i for r in span for i in r["ids"]] == whole[100:900]
    few = token_lists.read_documents(spark, path, 5, 9)
    assert [r["doc_id"] for r in few.orderBy("doc_id").collect()] == [5, 6, 7, 8, 9]
    plan = few._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id)" in plan
    assert "ids" not in token_lists.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]


# --- licences


def test_pruning_never_hides_a_match():
    r = random.Random(8)
    for name, bigrams in licence_scan._forms(licence_scan.TEMPLATES):
        telling = set(licence_scan.telling_words(bigrams, 0.8))
        text = next(t for t in licence_scan.TEMPLATES[name] if licence_scan.bigrams_of(t) == bigrams)
        words = licence_scan.words_of(text)
        for _ in range(60):
            kept = [w for w in words if r.random() > 0.12 or w not in telling]
            grams = set(licence_scan.bigrams_of(" ".join(kept)))
            if 2 * len(grams & set(bigrams)) >= 0.8 * (len(grams) + len(bigrams)):
                assert telling & set(kept)


# --- mixing


def test_rates_meet_targets_as_a_plain_solver_does(spark):
    r = np.random.default_rng(4)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    n = r.integers(1, 500, 400)
    rows = [(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(n, p))]
    soft = written(spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double, p2 double"), "soft")
    have = p.T @ n
    want = have * [1.0, 0.5, 0.6]
    steps = mixing.fit_rates(soft, lambda totals: want.tolist())
    rates = {x[0]: x[1] for x in soft.select("doc_id", mixing.rate_column(steps)).collect()}
    got = np.array([rates[i] for i in range(400)])
    assert (got >= 0).all()
    plain = np.ones(400)
    for _ in range(3000):
        plain = np.maximum(0, plain - p @ ((p.T @ (n * plain) - want) / have))
    assert np.abs(p.T @ (n * got) - p.T @ (n * plain)).max() < 1e-3 * have.min()


def test_domains_of_held_out_labels(spark, small):
    docs = spark.read.parquet(f"{small}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{small}/../sf0.1/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    classifier = mixing.learn(docs, labels.where(~apart), mixing.label_domain())
    soft = mixing.members(docs.join(labels.where(apart), "doc_id").drop("quality", "toxic"), classifier)
    best = F.greatest("p0", "p1", "p2")
    found = soft.withColumn("d", F.when(F.col("p0") == best, "good").when(F.col("p1") == best, "poor").otherwise("toxic"))
    truth = labels.select("doc_id", mixing.label_domain().alias("true"))
    assert found.join(truth, "doc_id").agg(F.avg((F.col("d") == F.col("true")).cast("double"))).first()[0] > 0.9


def test_a_repeated_key_is_one_row_of_the_labelled_sample(spark, monkeypatch):
    rows = [(i, prose(i, 30)) for i in range(40)] + [(7, prose(900 + i, 30)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(mixing, "_softmax_regression", lambda domains, words, x, y: seen.append(len(x)))
    mixing.learn(docs, labels, mixing.label_domain())
    assert seen == [40]


def test_drawing_by_rate(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("_rate"))
    rates = docs.select("doc_id", (F.col("doc_id") % 4 * 0.75).alias("rate"))
    counts = {r[0]: r[1] for r in mixing.mixed(docs, rates).groupBy(F.col("doc_id") % 4).count().collect()}
    assert 0 not in counts
    assert [round(counts[i] / 500, 1) for i in (1, 2, 3)] == pytest.approx([0.75, 1.5, 2.25], abs=0.11)
    once = mixing.mixed(docs, rates, repeat=False)
    assert once.count() == once.select("doc_id").distinct().count() and once.columns == docs.columns


# --- odd inputs


def runs(docs, labels, spark):
    path = scratch_path(spark, "tokens")
    token_lists.write_tokens(docs, path, vocabulary("byte_bpe_50k.json"))
    model = vocabulary("piece_bpe_32k.model")
    return {
        "language": language_parsing.identify(docs),
        "pieces": pieces.encode(docs, model, check=True),
        "quality": quality_cascade.judge(docs),
        "licence": licence_scan.scan(docs),
        "tokens": token_lists.checksums(spark, path),
        "mixing": mixing.mixing_rates(docs, labels, mixing.label_domain(), mixing.WEIGHTS),
        "simhash": simhash.near_duplicates(docs),
    }


def test_odd_documents_have_defined_results(spark, odd_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (6, 0, 0), (7, None, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int"
    )
    rows = {name: df.collect() for name, df in runs(odd_docs, labels, spark).items()}
    assert {name: len(r) for name, r in rows.items()} == dict.fromkeys(rows, 12)
    of = lambda name, i: next(r for r in rows[name] if r["doc_id"] == i)
    for i in (3, 4, 5, 8):
        assert (of("language", i)["lang_pred"], of("language", i)["score"]) == ("und", 0.0)
    assert of("language", 7)["lang_pred"] == "zz" and of("language", 6)["lang_pred"] == "en"
    assert all(r["round_trip"] for r in rows["pieces"]) and of("pieces", 3)["n_pieces"] == 0
    assert of("quality", 3)["base_failed"] and of("quality", 6)["n_words"] == 120_000 and of("quality", 6)["kept"]
    assert of("licence", 9)["license"] == "CC-BY-NC-4.0" and of("licence", 3)["license"] is None
    assert of("tokens", 3)["n_tokens"] == 1
    assert len({r["component_id"] for r in rows["simhash"] if r["doc_id"] in (1, 2)}) == 1
    assert of("simhash", 3)["fingerprint"] == "0" * 16 and of("simhash", 4)["component_id"] == 3
    assert all(r["rate"] >= 0 for r in rows["mixing"])


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {name: df.count() for name, df in runs(no_docs, labels, spark).items()} == dict.fromkeys(
        ["language", "pieces", "quality", "licence", "tokens", "mixing", "simhash"], 0
    )
    assert simhash.similar_texts(no_docs).count() == 0


def test_pipeline_stages_keep_columns_and_bear_odd_rows(spark, odd_docs, no_docs, small):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, small), name)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_pipeline_against_plain_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    con = comparing.connect(small)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({LLM_ORACLES['op5_quality_cascade']}) WHERE kept").fetchall()}
    good = written(corpus_pipeline.quality(spark, docs, small), "q")
    assert {r["doc_id"] for r in good.collect()} == kept
    told = written(corpus_pipeline.language(spark, good, small), "l")
    assert told.count() >= 0.99 * len(kept)
    single = written(corpus_pipeline.near_duplicates(spark, told, small), "n")
    texts = dict(told.select("doc_id", "text").collect())
    sets = {i: set(simhash.shingle_spans(t.encode().lower().split(), 5)) for i, t in texts.items()}
    groups = brute_groups(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    left = {r["doc_id"] for r in single.collect()}
    firsts = {i for i in sets if groups[i] == i}
    assert left == firsts
    assert single.columns == docs.columns == [f.split()[0] for f in DOC_SCHEMA.split(", ")]


def test_letters_with_runs_of_marks_need_no_whole_encoding(monkeypatch):
    """Ids as the library's; the whole tokenizer is asked for a run of marks once, never for the words before it."""
    encoder = token_lists.Encoder(vocabulary("byte_bpe_50k.json"))
    asked = []
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda text: asked.append(text) or whole(text))
    texts = ["Zebus%%% ran.] Zebus.] été%%%\nran!? (no '", "Kühe%%% ran%%%"]
    want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids.tolist() for ids in encoder.encode(texts, 2)] == [w.ids + [2] for w in want]
    assert sorted(asked) == [" '", " (no", "!?", "%%%", ".]"]


def test_frequent_chunks_outlive_rare_ones(monkeypatch):
    """A chunk of every batch is encoded once, however many rare ones come and go; those are dropped."""
    monkeypatch.setattr(token_lists, "KNOWN_CHUNKS", 20)
    encoder = token_lists.Encoder(vocabulary("byte_bpe_50k.json"))
    asked = []
    for chunks in (encoder.first, encoder.later):
        tokenize = chunks.tokenize
        monkeypatch.setattr(chunks, "tokenize", lambda text, f=tokenize: asked.append(text) or f(text))
    letters = "abcdefghijklmnopqrst"
    for a in letters:
        texts = [" ".join(["often", "often,", "Often", *(f"zeb{a}{b}" for b in letters)])]
        want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert [ids.tolist() for ids in encoder.encode(texts, 2)] == [w.ids + [2] for w in want]
        assert sum(len(c) + len(c.older) for c in (encoder.first, encoder.later)) <= 3 * (len(letters) + 4)
    assert [w for w in asked if w.endswith(("often", "Often"))] == ["often", "Ġoften", "ĠOften"]


def test_similar_texts_meet_by_fingerprint_and_are_checked(spark, monkeypatch):
    """Without any bucket of shingles: equal word counts give equal fingerprints, the shingle sets decide."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[150:] + words[:150])), (3, " ".join(words[::-1])), (4, "other " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "_repeated", lambda pool: pool.limit(0))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_sketches_never_lose_a_similar_pair():
    """A sketch never tells of more different elements than there are, and of enough to part unlike sets."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 400, 3000):
        for share in (0.0, 0.5, 0.8, 0.95, 1.0):
            pool = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 2 * n + 1))
            x = pool[:n]
            y = pool[n - int(share * n) : 2 * n - int(share * n)]
            apart = len(np.setxor1d(x, y))
            least = simhash.least_difference(simhash.parity_sketch(x), simhash.parity_sketch(y))
            assert least <= apart
            assert least == simhash.least_difference(simhash.parity_sketch(y), simhash.parity_sketch(x))
            if n >= 400 and share <= 0.5:
                assert least > 2 * n / 9  # what a similarity of 0.8 leaves room for


def test_only_texts_of_pairs_with_room_are_compared(spark, monkeypatch):
    """Texts that share a few rare shingles with others fall out before any text is shuffled."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    common = words(12)
    texts = [" ".join(common + words(200 + i)) for i in range(30)]
    base = words(200)
    texts += [" ".join(base + words(i)) for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = []
    room = simhash.with_room
    monkeypatch.setattr(simhash, "with_room", lambda *a: pairs.append(room(*a)) or pairs[-1])
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, pair_limit=8).collect()}
    assert groups == {i: min(i, 30) for i in range(33)}
    assert all(r["a"] >= 30 and r["b"] >= 30 for p in pairs for r in p.collect())
