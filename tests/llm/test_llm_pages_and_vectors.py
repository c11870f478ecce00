"""Page, archive and vector operators: literal cases, brute force and odd inputs."""

import gzip
import html
import io
import re
import struct
import zipfile

import duckdb
import numpy as np
import pytest
from llm_inputs import SMALL
from pyspark.sql import functions as F

from weftframe.llm import neighbours, web_archive, wrappers
from weftframe.llm.common import written
from weftframe.llm.queries import LLM_QUERIES
from weftframe.session import scratch_path

PAGE_SCHEMA = "page_id long, url string, html string"


def plain_article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"</?(p|h1)>", "\0", re.sub(r"</?b>", "", body.replace("<br>", " ")))
    blocks = (" ".join(html.unescape(b).split()) for b in body.split("\0"))
    return "\n".join(b for b in blocks if b)


def test_article_text_of_every_page(spark, small):
    want = {i: plain_article(h) for i, h in duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall()}
    got = LLM_QUERIES["op1_wrapper_text"](spark, small).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


PAGE = """<html><head><title>t</title></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="page has-sidebar"><article><h1>Head &amp; tail</h1><p>One <a href=x>two</a>
 three <span class="ad">buy <span>now</span></span> four<p>Five<ul><li>a<li>b</ul><form>f</form>
<script>if (a<b) "</p>"</script><div class="notice">n</div></article><section id="comments"><article>c</article></section></div>
<aside>s</aside><footer>f</footer></body></html>"""


def test_what_is_dropped_and_what_is_kept():
    assert wrappers.main_text(PAGE, None) == "Head & tail\nOne two three four\nFive\na\nb"
    assert wrappers.main_text("<p>a<p>b &lt; c", None) == "a\nb < c"
    assert wrappers.main_text("<!-- x", None) == ""
    assert wrappers.main_text("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"


def test_streams_align_to_optional_and_repeated_groups():
    pages = ["<body><h1>a</h1><p>b<p>c</body>", "<body><p>d</body>", "<body><h1>e</h1><div>f</div><p>g</body>"]
    wrapper = wrappers.groups_of(wrappers.parse(pages[0]))
    for page in pages[1:]:
        wrapper = wrappers._joined(wrapper, wrappers.groups_of(wrappers.parse(page)), False)
    assert wrappers.expression(wrapper) == "<><body>(<h1>#</h1>)?(<div>#</div>)?(<p>#</p>)+</body></>"
    assert wrapper[wrappers.PAGES] == 3


def test_a_host_teaches_where_its_article_lies(spark):
    """A page whose menu outweighs its text is read where the other pages of its host have theirs."""
    shape = "<body><div id=a><p>{}</p></div><div id=b><p>{}</p></div></body>"
    rows = [(i, "http://h/x", shape.format("menu", "word " * 80)) for i in range(9)]
    rows.append((9, "http://h/y", shape.format("many menu words here " * 2, "short")))
    pages = spark.createDataFrame([(i, u, h.replace("id=a", "class=main").replace("id=b", "class=story")) for i, u, h in rows], PAGE_SCHEMA)
    paths = written(wrappers.wrapper_paths(wrappers.infer_wrappers(pages)), "paths")
    assert paths.count() == 1
    assert len(wrappers.extract_text(pages, paths).collect()) == 10


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "http://a/b", PAGE), (3, "http://a/b", PAGE), (3, "http://a/b", PAGE), (4, "http://b", "<p>" * 30_000 + "x " * 200_000)]
    pages = spark.createDataFrame(rows, PAGE_SCHEMA).withColumns({c: F.lit(1) for c in ("host", "k", "u", "h", "path", "text")})
    paths = wrappers.wrapper_paths(wrappers.infer_wrappers(pages))
    got = wrappers.extract_text(pages, paths).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 39), (1, 0), (2, 0), (3, 39), (3, 39), (4, 399_999)]
    empty = pages.where("false")
    assert wrappers.extract_text(empty, wrappers.wrapper_paths(wrappers.infer_wrappers(empty))).count() == 0


# --- archives


def test_odd_pages_come_back_from_packages(spark):
    rows = [(5, "http://a", "x"), (3, "http://b", "x"), (9, None, None), (8, "bad\r\nurl", ""), (None, "u", "y"), (7, "u", "é\r\n\r\n😀" * 1000), (5, "http://a", "x")]
    pages = spark.createDataFrame(rows, PAGE_SCHEMA).withColumns({c: F.lit(1) for c in ("k", "body", "digest", "first", "n")})
    packages = web_archive.write_packages(pages, scratch_path(spark, "warc"))
    got = {r["page_id"]: r for r in web_archive.read_packages(packages).collect()}
    assert got[3]["record_type"] == "response" and bytes(got[3]["payload"]) == b"x"
    assert (got[5]["record_type"], got[5]["refers_to"], got[5]["payload_bytes"]) == ("revisit", 3, 1)
    assert (got[9]["refers_to"], got[9]["payload_bytes"]) == (8, 0)
    assert bytes(got[7]["payload"]).decode() == rows[5][2]
    assert got[None]["record_type"] == "response"
    assert web_archive.archive_round_trip(spark, pages).count() == 7
    assert web_archive.archive_round_trip(spark, pages.where("false")).count() == 0
    alone = web_archive.read_packages(web_archive.write_packages(pages, scratch_path(spark, "warc"), least_bytes=2))
    assert alone.where("record_type = 'revisit'").isEmpty()


def test_directories_of_both_kinds():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("archive/data.warc.gz", b"abc")
        z.writestr("indexes/é", b"defg")
        z.comment = b"PK\x05\x06 in a comment"[4:]
    members = web_archive.directory(plain, plain.getbuffer().nbytes)
    at = web_archive.data_start(plain, members["indexes/é"])
    assert plain.getvalue()[at : at + members["indexes/é"].size] == b"defg"
    # the same members under a ZIP64 directory with all 32-bit fields full
    data = b"".join(b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 3, 3, 1, 0) + b"n" + b"xyz" for _ in range(1))
    extra = struct.pack("<HHQQQ", 1, 24, 3, 3, 0)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, 1, len(extra), 0, 0, 0, 0, 2**32 - 1) + b"n" + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), len(data))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(data) + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 65535, 65535, 2**32 - 1, 2**32 - 1, 0)
    wide = io.BytesIO(data + entry + end64 + locator + end)
    member = web_archive.directory(wide, wide.getbuffer().nbytes)["n"]
    start = web_archive.data_start(wide, member)
    assert wide.getvalue()[start : start + member.size] == b"xyz"


def test_compressed_members_are_refused():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"a" * 1000)
    member = web_archive.directory(packed, packed.getbuffer().nbytes)["archive/data.warc.gz"]
    with pytest.raises(ValueError, match="stored"):
        web_archive.data_start(packed, member)


def test_a_damaged_record_is_an_error():
    record = web_archive._record(1, "http://a", b"abc", web_archive.base32_sha1(b"abc"), None, "2000-01-01T00:00:00Z")
    assert web_archive._row(web_archive.parse_record(gzip.decompress(gzip.compress(record))))[2] == 3
    with pytest.raises(ValueError, match="digest"):
        web_archive._row(web_archive.parse_record(record.replace(b"abc", b"abd")))


# --- vectors


def test_recall_and_distances_of_neighbours(spark, small):
    folder = f"{small}/../sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = LLM_QUERIES["op4_multiprobe_neighbours"](spark, folder).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(d[np.searchsorted(ids, mine["vec_id"])], mine["score"], rtol=1e-12)
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(mine["vec_id"]))
        total += 10
    assert hits / total >= 0.9


def exact(rows, is_query, k):
    want = []
    for q, a in rows:
        if is_query(q):
            near = sorted((float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), i) for i, b in rows if i != q)
            want += [(q, n + 1, i) for n, (_, i) in enumerate(near[:k])]
    return sorted(want)


def test_copies_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 0.0, float(i % 3)]) for i in range(40)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [1.0, None, 1.0]), (105, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + odd], "vec_id long, embedding array<double>, vector string")
    df = df.withColumns({c: F.lit(2) for c in ("id", "code", "block", "ids")})
    got = neighbours.nearest_neighbours(df, lambda i: i % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == exact(good, lambda i: i % 20 == 0, 10)
    few = neighbours.nearest_neighbours(df.where("vec_id < 4"), lambda i: i == 0).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == [3, 1, 2]
    assert neighbours.nearest_neighbours(df.where("false"), lambda i: i == 0).count() == 0


def test_no_query_stops_below_its_target(spark, monkeypatch):
    rng = np.random.default_rng(3)
    index = neighbours.Index(rng.standard_normal((2, 12, 16)), rng.uniform(0, 1.5, (2, 12)), 1.5, 1.0, 0.776)
    assert len(index.probes(rng.standard_normal(16))) == 0
    hashes = neighbours.fitting_hashes(12, 1 / 1.5, 0.776, neighbours.MOST_CELLS)
    assert 1 < hashes < 12 and neighbours.fitting_hashes(hashes, 1 / 1.5, 0.776, neighbours.MOST_CELLS) == hashes
    # few cells considered: all queries go to the pass over all blocks
    monkeypatch.setattr(neighbours, "MOST_CELLS", 1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3_000, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(df, lambda i: i % 300 == 0, recall=0.999).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == exact(rows, lambda i: i % 300 == 0, 10)
