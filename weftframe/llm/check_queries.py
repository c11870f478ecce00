"""Queries of the operators that look for, mine or prove rows: decontamination, hard negatives, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftframe.llm import decontamination, hard_negatives, manifest
from weftframe.llm.common import table
from weftframe.llm.registry import llm_query

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
dw AS (SELECT r, n, s, array_to_string(w[s:s+n-1], ' ') AS g
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT r, win.n, s, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
hits AS (SELECT r, count(DISTINCT s + k) AS n_hit FROM m, range(10) q(k) WHERE k < n GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


@llm_query("op11_decontamination", OP11_SQL)
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items whose passages occur in every document."""
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), width=10)


OP12_SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label, embedding
             FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM r),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, c.vec_id AS id, c.label AS cl,
             list_sum(list_transform(list_zip(a.q, c.q), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, al, id AS positive_id, score AS positive_score FROM s WHERE al = cl
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.cl <> s.al AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@llm_query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 50 == 0, label)


def _manifest_sql(levels: int = 9) -> str:
    """Up to 8**levels leaves of a language and 8**levels languages; what is one node goes up as it is."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    same = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    step = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), "
    # a step per byte: the table entry of the lowest byte, and the rest moved down
    crc += "lambda c, b: " + step + "), 4294967295)"
    parts = [
        f"t0 AS (SELECT doc_id, lang, sha256({same} || {field('text')}) AS leaf, "
        f"sha256({same} || {field('CASE WHEN ' + crc + ' % 3 = 0 THEN ' + _FOLD.format('text') + ' ELSE text END')}) AS fold FROM documents)",
        "t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, fold) - 1 AS pos, row_number() OVER () AS r FROM t0)",
        "a0 AS (SELECT lang, pos AS i, leaf AS h FROM t)",
        "p0 AS (SELECT r, lang, pos AS i, fold AS f, '' AS proof FROM t)",
    ]

    def climb(here: str, there: str, key: str, path: str, onward: str) -> list[str]:
        same_group = f"{key} IS NOT DISTINCT FROM s.{key}" if key else "true"
        group = f"PARTITION BY {key}, i // 8" if key else "PARTITION BY i // 8"
        everything = f"OVER (PARTITION BY {key})" if key else "OVER ()"
        return [
            f"{here}s AS (SELECT *, count(*) {everything} AS n, coalesce(string_agg(h, '') OVER ({group} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER ({group} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt FROM {here})",
            f"{there} AS (SELECT {key + ', ' if key else ''}i // 8 AS i, CASE WHEN min(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {here}s GROUP BY {key + ', ' if key else ''}i // 8)",
            f"{onward} AS (SELECT p.r, p.lang, p.i // 8 AS i, CASE WHEN s.n = 1 THEN p.f ELSE sha256(s.l || p.f || s.rt) END AS f, "
            f"CASE WHEN s.n = 1 THEN p.proof ELSE p.proof || s.l || s.rt END AS proof FROM {path} p JOIN {here}s s ON p.i = s.i AND {'p.' if key else ''}{same_group})",
        ]

    for level in range(levels):
        parts += climb(f"a{level}", f"a{level + 1}", "lang", f"p{level}", f"p{level + 1}")
    parts += [
        f"b0 AS (SELECT row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, lang FROM a{levels})",
        f"q0 AS (SELECT p.r, p.lang, b0.i, p.f, p.proof FROM p{levels} p JOIN b0 ON p.lang IS NOT DISTINCT FROM b0.lang)",
    ]
    for level in range(levels):
        parts += climb(f"b{level}", f"b{level + 1}", "", f"q{level}", f"q{level + 1}")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT t.doc_id, t.leaf, a.h AS subroot, b.h AS root, sha256(q.proof) AS proof_sha256, "
        f"q.f AS folded_root, q.f = b.h AS verified FROM t JOIN q{levels} q ON q.r = t.r "
        f"JOIN a{levels} a ON a.lang IS NOT DISTINCT FROM t.lang JOIN b{levels} b ON true"
    )


@llm_query("op13_merkle_manifest", _manifest_sql())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its tampered text is found out."""
    return manifest.documents_manifest(table(spark, folder, "documents"))
