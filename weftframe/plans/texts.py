"""Queries over text, date, CSV, JSON and XML functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftframe.functions import csvtext, dates, jsontext, strings, xmlpath, xmltext
from weftframe.plans.registry import query


def _on(df, key, column):
    return df.select(key, column.alias("result"))




@query(
    "str_upper",
    "SELECT doc_id, replace(upper(replace(text, 'ß', chr(57567))), chr(57567), 'ß') AS result FROM documents",
)
def str_upper(spark, t):
    return _on(t.documents, "doc_id", strings.upper("text"))


@query("str_lower", "SELECT doc_id, lower(text) AS result FROM documents")
def str_lower(spark, t):
    return _on(t.documents, "doc_id", strings.lower("text"))


PADDED = "chr(160) || '  ' || text || chr(9) || chr(10) || ' '"
WIDE_SPACE = "[\\s\\p{Z}]+"


def _padded(t):
    edges = F.concat(F.lit("   "), F.col("text"), F.lit("\t\n "))
    return t.documents.select("doc_id", edges.alias("text"))


@query("str_trim", f"SELECT doc_id, regexp_replace({PADDED}, '^{WIDE_SPACE}|{WIDE_SPACE}$', '', 'g') AS result FROM documents")
def str_trim(spark, t):
    return _on(_padded(t), "doc_id", strings.trim("text"))


@query("str_trimstart", f"SELECT doc_id, regexp_replace({PADDED}, '^{WIDE_SPACE}', '') AS result FROM documents")
def str_trimstart(spark, t):
    return _on(_padded(t), "doc_id", strings.trim_start("text"))


@query("str_trimend", f"SELECT doc_id, regexp_replace({PADDED}, '{WIDE_SPACE}$', '') AS result FROM documents")
def str_trimend(spark, t):
    return _on(_padded(t), "doc_id", strings.trim_end("text"))


@query("str_substring", "SELECT doc_id, substring(text, 7, 20) AS result FROM documents")
def str_substring(spark, t):
    return _on(t.documents, "doc_id", strings.substring("text", 6, 20))


@query("str_replace", "SELECT doc_id, replace(text, '. ', '; ') AS result FROM documents")
def str_replace(spark, t):
    return _on(t.documents, "doc_id", strings.replace("text", ". ", "; "))


@query(
    "str_split",
    """SELECT doc_id, CAST(len(string_split(text, '. ')) AS INTEGER) AS parts, string_split(text, '. ')[-1] AS final
       FROM documents""",
)
def str_split(spark, t):
    pieces = t.documents.select("doc_id", strings.split("text", ". ").alias("p"))
    return pieces.select("doc_id", F.size("p").alias("parts"), F.element_at("p", -1).alias("final"))


@query(
    "str_join",
    """SELECT doc_id, lang || '|' || coalesce(nullif(source, lang), '') || '|' || CASE WHEN n_chars > 500 THEN 'long'
              ELSE '' END AS result FROM documents""",
)
def str_join(spark, t):
    cells = F.array(F.col("lang"), F.col("source"), F.when(F.col("n_chars") > 500, "long"))
    return _on(t.documents, "doc_id", strings.join(cells, "|"))


@query(
    "str_padleft",
    """SELECT p_partkey, CASE WHEN length(p_name) < 12 THEN lpad(p_name, 12, '0') ELSE p_name END AS result FROM part""",
)
def str_padleft(spark, t):
    return _on(t.part, "p_partkey", strings.pad_left("p_name", 12, "0"))


@query(
    "str_padright",
    """SELECT p_partkey, CASE WHEN length(p_name) < 12 THEN rpad(p_name, 12, '.') ELSE p_name END AS result FROM part""",
)
def str_padright(spark, t):
    return _on(t.part, "p_partkey", strings.pad_right("p_name", 12, ".."))


@query(
    "str_truncate",
    """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substring(text, 1, 197) || '...' END AS result
       FROM documents""",
)
def str_truncate(spark, t):
    return _on(t.documents, "doc_id", strings.truncate("text", 200, "..."))


@query("str_format", "SELECT p_partkey, '<' || p_name || ' = ' || p_name || '>' AS result FROM part")
def str_format(spark, t):
    return _on(t.part, "p_partkey", strings.format_text("p_name", "<{0} = {item}>"))


@query("str_regexmatch", "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS result FROM documents")
def str_regexmatch(spark, t):
    return _on(t.documents, "doc_id", strings.regex_match("text", "[0-9]{3}"))


@query(
    "str_regexreplace",
    "SELECT doc_id, regexp_replace(text, '([a-z]+)ing', '<\\1>', 'g') AS result FROM documents",
)
def str_regexreplace(spark, t):
    return _on(t.documents, "doc_id", strings.regex_replace("text", "([a-z]+)ing", "<$1>"))


@query(
    "str_regexextract",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '([A-Z][a-z]+) ([a-z]+)')
                           THEN regexp_extract(text, '([A-Z][a-z]+) ([a-z]+)', 2) END AS result FROM documents""",
)
def str_regexextract(spark, t):
    return _on(t.documents, "doc_id", strings.regex_extract("text", "([A-Z][a-z]+) ([a-z]+)", 2))


@query("str_b64enc", "SELECT doc_id, base64(encode(text)) AS result FROM documents")
def str_b64enc(spark, t):
    return _on(t.documents, "doc_id", strings.base64_encode("text"))


@query("str_b64dec", "SELECT doc_id, decode(from_base64(base64(encode(text)))) AS result FROM documents")
def str_b64dec(spark, t):
    return _on(t.documents, "doc_id", strings.base64_decode(strings.base64_encode("text")))


@query("str_urlenc", "SELECT page_id, url_encode(url || ' *~+' || html) AS result FROM pages")
def str_urlenc(spark, t):
    return _on(t.pages, "page_id", strings.url_encode(F.concat("url", F.lit(" *~+"), "html")))


@query("str_urldec", "SELECT page_id, url || ' a+b' || html AS result FROM pages")
def str_urldec(spark, t):
    encoded = F.concat(strings.url_encode("url"), F.lit("%20a+b"), strings.url_encode("html"))
    return _on(t.pages, "page_id", strings.url_decode(encoded))


ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    "str_htmlenc",
    f"""SELECT page_id, array_to_string(list_transform(string_split({ESCAPED}, ''), lambda c:
          CASE WHEN unicode(c) BETWEEN 160 AND 255 OR unicode(c) > 65535 THEN '&#' || unicode(c) || ';' ELSE c END), '')
          AS result FROM pages""",
)
def str_htmlenc(spark, t):
    return _on(t.pages, "page_id", strings.html_encode("html"))


@query("str_htmldec", "SELECT doc_id, text AS result FROM documents")
def str_htmldec(spark, t):
    return _on(t.documents, "doc_id", strings.html_decode(strings.html_encode("text")))


@query("str_hash", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def str_hash(spark, t):
    return t.documents.select(
        "doc_id", strings.hash_text("text").alias("sha"), strings.hash_text("text", "md5").alias("md")
    )


@query("str_hash512")
def str_hash512(spark, t):
    return _on(t.documents, "doc_id", strings.hash_text("text", "sha512"))


@query("str_sha1", "SELECT doc_id, sha1(text) AS result FROM documents")
def str_sha1(spark, t):
    return _on(t.documents, "doc_id", strings.hash_text("text", "sha1"))


@query("str_array", "SELECT p_partkey, upper(p_name) AS result FROM part")
def str_array(spark, t):
    words = t.part.withColumn("words", F.split("p_name", " "))
    shouted = strings.apply_operation(F.col("words"), "upper", over_array=True)
    return _on(words, "p_partkey", strings.apply_operation(shouted, "join", separator=" "))


@query("new_guid", "SELECT o_orderkey, true AS valid FROM orders")
def new_guid(spark, t):
    made = t.orders.select("o_orderkey", strings.new_guid().alias("g"))
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return made.select("o_orderkey", F.col("g").rlike(shape).alias("valid"))


# --- dates and CSV -----------------------------------------------------------


@query(
    "date_format",
    """SELECT event_id, strftime(ts, '%d/%m/%Y %A %H:%M:%S %p') || substr(strftime(ts, '.%f'), 1, 5) || ' +05:30 +5' AS result
       FROM events""",
)
def date_format(spark, t):
    """In the offset of the text, with four digits of the fraction."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'7+05:30'")
    return _on(t.events, "event_id", dates.format_datetime(iso, "dd/MM/yyyy dddd HH:mm:ss tt.ffff zzz z"))


@query("now_iso", "SELECT o_orderkey, true AS same FROM orders")
def now_iso(spark, t):
    """Local and UTC text name the same instant."""
    stamped = t.orders.select("o_orderkey", dates.now_iso().alias("now"), dates.utc_now_iso().alias("utc"))
    return stamped.select("o_orderkey", (F.col("now").cast("timestamp") == F.col("utc").cast("timestamp")).alias("same"))


@query(
    "csv_parse_col",
    """SELECT c_custkey, 0 AS line_no, c_name AS name, c_mktsegment || ', "x"' AS note FROM customer
       UNION ALL SELECT c_custkey, 1, CAST(c_nationkey AS VARCHAR), NULL FROM customer""",
)
def csv_parse_col(spark, t):
    document = F.concat(
        F.lit("name,note\r\n"),
        F.col("c_name"),
        F.lit(',"'),
        F.col("c_mktsegment"),
        F.lit(', ""x"""\r\n\r\n'),
        F.col("c_nationkey").cast("string"),
    )
    source = t.customer.select("c_custkey", document.alias("csv"))
    return csvtext.parse_csv_text(source, "csv", ["name", "note"])


@query(
    "csv_text",
    "SELECT p_partkey, p_partkey || ',' || chr(34) || p_name || ', ' || chr(34) || chr(34) || p_type || repeat(chr(34), 3) || ',' AS line FROM part",
)
def csv_text(spark, t):
    quoted_name = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"'))
    line = csvtext.csv_line([F.col("p_partkey"), quoted_name, F.lit(None).cast("string")])
    return t.part.select("p_partkey", line.alias("line"))


# --- JSON --------------------------------------------------------------------


def _documents(t):
    """A JSON document per event: a detail object and two items."""
    item = F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("n"))
    other = F.struct(F.lit("user").alias("name"), F.col("user_id").alias("n"))
    document = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user")).alias("by")).alias(
                "detail"
            ),
            F.array(item, other).alias("items"),
        )
    )
    return t.events.select("event_id", "user_id", "event_type", "props", document.alias("doc"))


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(
    "json_path",
    f"""SELECT event_id, '[' || {K} || ',' || user_id || ']' AS result, 2 AS "matchCount" FROM events""",
)
def json_path(spark, t):
    return jsontext.json_path(_documents(t), "doc", "$.items[*].n").select("event_id", "result", "matchCount")


@query(
    "json_path_single",
    """SELECT event_id, '"' || event_type || '"' AS result, 1 AS "matchCount" FROM events""",
)
def json_path_single(spark, t):
    return jsontext.json_path(_documents(t), "doc", "$.detail.kind").select("event_id", "result", "matchCount")


@query(
    "json_path_filter",
    f"""SELECT event_id, CAST(({K} > 50)::INT + (user_id > 50)::INT AS INTEGER) AS matches FROM events""",
)
def json_path_filter(spark, t):
    found = jsontext.json_filter(F.col("doc"), "$.items", lambda x: F.try_variant_get(x, "$.n", "bigint") > 50)
    return _documents(t).select("event_id", F.size(found).alias("matches"))


@query(
    "json_extract_map",
    """SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who, CAST(NULL AS VARCHAR) AS nothing
       FROM events""",
)
def json_extract_map(spark, t):
    outputs = {"kind": "$.detail.kind", "who": "$.detail.by.user", "nothing": "$.detail.absent"}
    return _documents(t).select("event_id", *jsontext.extract_paths(F.col("doc"), outputs))


@query(
    "regex_extract_map",
    """SELECT page_id, nullif(regexp_extract(url, '://([^/]+)/', 1), '') AS host,
              nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
              nullif(regexp_extract(url, '[?].*', 0), '') AS rest, '' AS nothing, 'k=;' AS absent, NULL::VARCHAR AS broken
       FROM pages""",
)
def regex_extract_map(spark, t):
    source = F.concat_ws("\n", "url", "html")
    outputs = {"host": "(ht(tp))s?://(?<value>[^/]+)/", "title": "<title>(?<value>[^<]*)</title>"}
    return t.pages.select(
        "page_id",
        *jsontext.extract_patterns(source, outputs),
        *jsontext.extract_patterns(F.col("url"), {"rest": "[?].*"}),
        # a group that matches nothing, one that takes no part, and no pattern at all
        *jsontext.extract_patterns(
            F.concat("url", F.lit("k=;")),
            {"nothing": "k=(?<value>[a-z]*)(?:;|,)", "absent": "k=(?:(?<value>[a-z]+)|;)", "broken": "k=("},
        ),
    )


@query(
    "map_extract",
    """SELECT doc_id, lang AS language, source AS origin, CAST(NULL AS VARCHAR) AS missing FROM documents""",
)
def map_extract(spark, t):
    headers = t.documents.select(
        "doc_id", F.create_map(F.lit("Content-Language"), "lang", F.lit("X-Source"), "source").alias("headers")
    )
    outputs = {"language": "content-language", "origin": "X-SOURCE", "missing": "ETag"}
    return headers.select("doc_id", *jsontext.extract_keys(F.col("headers"), outputs))


@query(
    "json_parse",
    f"""SELECT event_id, {K} AS k, '{{"k":' || {K} || '}}' AS text FROM events""",
)
def json_parse(spark, t):
    parsed = t.events.select("event_id", jsontext.parse_json(F.col("props")).alias("v"))
    return parsed.select(
        "event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), jsontext.to_json(F.col("v")).alias("text")
    )


@query(
    "json_text",
    """SELECT '{"c_custkey":' || c_custkey || ',"segment":' ||
              coalesce('"' || nullif(c_mktsegment, 'BUILDING') || '"', 'null') || '}' AS result FROM customer""",
)
def json_text(spark, t):
    record = F.struct("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    return t.customer.select(jsontext.to_json(record).alias("result"))


@query(
    "json_merge",
    f"""SELECT event_id, '{{"kind":"' || event_type || '","tags":{{"user":' || user_id || ',"k":' || {K} || '}},"n":1}}'
        AS doc FROM events""",
)
def json_merge(spark, t):
    base = F.concat(
        F.lit('{"kind":"old","tags":{"user":'), F.col("user_id").cast("string"), F.lit(',"gone":1},"list":[1,2]}')
    )
    patch = F.concat(
        F.lit('{"kind":"'),
        F.col("event_type"),
        F.lit('","tags":{"gone":null,"k":'),
        F.get_json_object("props", "$.k"),
        F.lit('},"list":null,"n":1}'),
    )
    return jsontext.merge_by_key(
        t.events.select("event_id", base.alias("doc")), t.events.select("event_id", patch.alias("doc")), "event_id", "doc"
    )


@query(
    "json_diff",
    f"""SELECT event_id, 'replace' AS op, 'kind' AS path, '"' || event_type || '"' AS value FROM events
        UNION ALL SELECT event_id, 'remove', 'tags.gone', NULL FROM events
        UNION ALL SELECT event_id, 'add', 'tags.k', '{{"v":' || {K} || '}}' FROM events
        UNION ALL SELECT event_id, 'replace', 'list', '[1,3]' FROM events""",
)
def json_diff(spark, t):
    left = F.lit('{"kind":"old","tags":{"gone":1,"same":[]},"list":[1,2]}')
    right = F.concat(
        F.lit('{"kind":"'),
        F.col("event_type"),
        F.lit('","tags":{"same":[],"k":{"v":'),
        F.get_json_object("props", "$.k"),
        F.lit('}},"list":[1,3]}'),
    )
    return jsontext.diff_by_key(
        t.events.select("event_id", left.alias("doc")), t.events.select("event_id", right.alias("doc")), "event_id", "doc"
    )


@query(
    "json_flatten",
    f"""SELECT event_id, 'id' AS path, CAST(event_id AS VARCHAR) AS value FROM events
        UNION ALL SELECT event_id, 'detail.kind', '"' || event_type || '"' FROM events
        UNION ALL SELECT event_id, 'detail.by.user', CAST(user_id AS VARCHAR) FROM events
        UNION ALL SELECT event_id, 'items.0.name', '"k"' FROM events
        UNION ALL SELECT event_id, 'items.0.n', CAST({K} AS VARCHAR) FROM events
        UNION ALL SELECT event_id, 'items.1.name', '"user"' FROM events
        UNION ALL SELECT event_id, 'items.1.n', CAST(user_id AS VARCHAR) FROM events""",
)
def json_flatten(spark, t):
    return jsontext.flatten_json(_documents(t).select("event_id", "doc"), "doc")


@query(
    "json_unflatten",
    f"""SELECT event_id, '{{"id":' || event_id || ',"detail":{{"kind":"' || event_type || '","by":{{"user":' || user_id
        || '}}}},"items":{{"0":{{"name":"k","n":' || {K} || '}},"1":{{"name":"user","n":' || user_id || '}}}}}}' AS document
        FROM events""",
)
def json_unflatten(spark, t):
    flat = jsontext.flatten_json(_documents(t).select("event_id", "doc"), "doc", separator="/", position="at")
    return jsontext.unflatten_json(flat, ["event_id"], separator="/", position="at")


# --- XML ---------------------------------------------------------------------

ORDER_FIELDS = "`@id` string, status string, item array<string>"


def _xml_orders(t):
    record = F.struct(
        F.col("o_orderkey").alias("@id"),
        F.col("o_orderstatus").alias("status"),
        F.array("o_orderpriority", F.concat(F.lit("a<b & "), "o_orderstatus")).alias("item"),
    )
    return t.orders.select("o_orderkey", xmltext.record_xml(record, "order").alias("xml"))


@query(
    "xml_path",
    """SELECT o_orderkey, o_orderpriority || '|a<b & ' || o_orderstatus AS items FROM orders""",
)
def xml_path(spark, t):
    xml = _xml_orders(t)
    return xml.select("o_orderkey", F.array_join(xmltext.xml_path(F.col("xml"), "/order/item"), "|").alias("items"))


@query(
    "xml_codec",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_orderpriority AS head,
              'a<b & ' || o_orderstatus AS tail FROM orders""",
)
def xml_codec(spark, t):
    parsed = _xml_orders(t).select("o_orderkey", xmltext.xml_record(F.col("xml"), ORDER_FIELDS).alias("r"))
    return parsed.select(
        "o_orderkey",
        F.col("r.`@id`").alias("id"),
        F.col("r.status").alias("status"),
        F.col("r.item")[0].alias("head"),
        F.col("r.item")[1].alias("tail"),
    )


@query("xml_doctype", "SELECT page_id, true AS refused FROM pages WHERE html ILIKE '%<!doctype%'")
def xml_doctype(spark, t):
    checked = t.pages.select("page_id", xmltext.refuse_doctype(F.col("html"), on_error="null").alias("xml"))
    return checked.where(F.col("xml").isNull()).select("page_id", F.lit(True).alias("refused"))


@query(
    "xml_json",
    """SELECT o_orderkey, '{"@id":"' || o_orderkey || '","status":"' || o_orderstatus || '","item":["' || o_orderpriority
              || '","a<b & ' || o_orderstatus || '"]}' AS doc FROM orders""",
)
def xml_json(spark, t):
    """Any XML to JSON, and back and forth once more."""
    document = xmltext.xml_json(F.col("xml"))
    return _xml_orders(t).select("o_orderkey", xmltext.xml_json(xmltext.json_xml(document, "order")).alias("doc"))


@query(
    "xml_nodes",
    """SELECT o_orderkey, '"' || o_orderpriority || '"' AS head, 2 AS nodes FROM orders""",
)
def xml_nodes(spark, t):
    found = _xml_orders(t).select("o_orderkey", xmlpath.xml_nodes(F.col("xml"), "./item").alias("found"))
    return found.select("o_orderkey", F.col("found")[0].alias("head"), F.size("found").alias("nodes"))


@query(
    "xml_query",
    """SELECT o_orderkey,
              '{"@id":"' || o_orderkey || '","item":["' || o_orderpriority || '","a<b & ' || o_orderstatus || '"],"status":"'
                || o_orderstatus || '"}' AS whole, 1 AS wholes,
              '["' || o_orderpriority || '","a<b & ' || o_orderstatus || '"]' AS items, 2 AS n_items,
              '"a<b & ' || o_orderstatus || '"' AS second, 1 AS seconds,
              CASE WHEN o_orderkey > 1000 THEN '"' || o_orderstatus || '"' ELSE '[]' END AS late,
              CASE WHEN o_orderkey > 1000 THEN 1 ELSE 0 END AS lates FROM orders""",
)
def xml_query(spark, t):
    """Elements as records: absolute, anywhere, by position and by condition."""
    paths = {"whole": "/order", "items": "//item", "second": "/order/item[last()]", "late": "/order[@id > 1000]/status"}
    counts = {"whole": "wholes", "items": "n_items", "second": "seconds", "late": "lates"}
    found = _xml_orders(t).select("o_orderkey", xmlpath.xml_queries(F.col("xml"), paths).alias("q"))
    columns = [c for name, n in counts.items() for c in (F.to_json(f"q.{name}.result").alias(name), F.col(f"q.{name}.matchCount").alias(n))]
    return found.select("o_orderkey", *columns)
