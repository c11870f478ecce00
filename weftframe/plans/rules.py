"""Queries over data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftframe.operators.mapping import map_rows
from weftframe.operators.quality import check_rules, check_schema
from weftframe.plans.registry import query


def _segments(t):
    """Customers of which some have no or an empty segment, and a balance text."""
    return t.customer.withColumn(
        "segment",
        F.expr("case c_mktsegment when 'BUILDING' then null when 'MACHINERY' then '' else c_mktsegment end"),
    )


SEGMENT = "CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END"


def _oracle(table: str, key: str, field: str, rule: str, message: str, ok: str) -> str:
    return (
        f"SELECT {key}, '{field}' AS field, '{rule}' AS rule, '{message}' AS message FROM {table} "
        f"WHERE NOT coalesce({ok}, false)"
    )


def _errors(df, key, rule):
    return check_rules(df, [rule]).errors(key)


@query(
    "dq_required",
    _oracle("customer", "c_custkey", "segment", "required", "no value given", f"({SEGMENT}) <> ''"),
)
def dq_required(spark, t):
    return _errors(_segments(t), "c_custkey", {"field": "segment", "rule": "required"})


@query(
    "dq_type",
    """SELECT event_id, 'k' AS field, 'type' AS rule, 'value is no date' AS message FROM events
       UNION ALL SELECT event_id, 'event_type', 'type', 'value is no number' FROM events""",
)
def dq_type(spark, t):
    source = t.events.withColumn("k", F.concat(F.get_json_object("props", "$.k"), F.lit("!")))
    rules = [
        {"field": "k", "rule": "type", "value": "date"},
        {"field": "event_type", "rule": "type", "value": "number"},
        {"field": "value", "rule": "type", "value": "number"},
        {"field": "ts", "rule": "type", "value": "date"},
    ]
    return check_rules(source, rules).errors("event_id")


@query(
    "dq_minlength",
    _oracle(
        "customer", "c_custkey", "segment", "minlength", "text shorter than 9", f"length({SEGMENT}) >= 9"
    ),
)
def dq_minlength(spark, t):
    return _errors(_segments(t), "c_custkey", {"field": "segment", "rule": "minLength", "value": 9})


@query(
    "dq_maxlength",
    _oracle("documents", "doc_id", "text", "maxlength", "text longer than 1000", "length(text) <= 1000"),
)
def dq_maxlength(spark, t):
    return _errors(t.documents, "doc_id", {"field": "text", "rule": "maxLength", "value": 1000})


@query(
    "dq_min",
    _oracle("customer", "c_custkey", "c_acctbal", "min", "number below 0", "c_acctbal >= 0"),
)
def dq_min(spark, t):
    return _errors(t.customer, "c_custkey", {"field": "c_acctbal", "rule": "min", "value": 0})


@query(
    "dq_max",
    _oracle("part", "p_partkey", "label", "max", "too large", "CASE WHEN p_size > 10 THEN p_size END <= 40"),
)
def dq_max(spark, t):
    source = t.part.withColumn("label", F.expr("case when p_size > 10 then cast(p_size as string) else p_type end"))
    return _errors(source, "p_partkey", {"field": "label", "rule": "max", "value": "40", "message": "too large"})


@query(
    "dq_pattern",
    _oracle(
        "documents",
        "doc_id",
        "text",
        "pattern",
        "text unlike ^[A-Z][a-z]+",
        "regexp_matches(text, '^[A-Z][a-z]+')",
    ),
)
def dq_pattern(spark, t):
    return _errors(t.documents, "doc_id", {"field": "text", "rule": "pattern", "value": "^[A-Z][a-z]+"})


EMAIL_TEXT = "lower(c_mktsegment) || CASE WHEN c_acctbal > 0 THEN '@' ELSE ' at ' END || 'host' || c_nationkey || '.org'"


@query(
    "dq_email",
    f"""SELECT c_custkey, 'mail' AS field, 'email' AS rule, 'not an email address' AS message
        FROM (SELECT *, {EMAIL_TEXT} AS mail FROM customer)
        WHERE NOT regexp_matches(mail, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')""",
)
def dq_email(spark, t):
    source = t.customer.withColumn("mail", F.expr(EMAIL_TEXT))
    return _errors(source, "c_custkey", {"field": "mail", "rule": "email"})


@query(
    "dq_url",
    """SELECT page_id, 'link' AS field, 'url' AS rule, 'not a URL' AS message
       FROM pages WHERE url NOT LIKE 'https:%'""",
)
def dq_url(spark, t):
    source = t.pages.withColumn("link", F.when(F.col("url").startswith("https:"), F.col("url")).otherwise("/rel/path"))
    return _errors(source, "page_id", {"field": "link", "rule": "url"})


@query(
    "dq_enum",
    _oracle(
        "part", "p_partkey", "size", "enum", "value outside the list", "p_size IN (1, 2, 3, 5, 8, 13, 21)"
    ),
)
def dq_enum(spark, t):
    source = t.part.withColumn("size", F.col("p_size").cast("string"))
    return _errors(source, "p_partkey", {"field": "size", "rule": "enum", "value": [1, "2", 3.0, 5, "8.0", 13, 21]})


@query(
    "dq_minitems",
    _oracle(
        "documents",
        "doc_id",
        "lines",
        "minitems",
        "fewer than 3 entries",
        "len(string_split(text, chr(10))) >= 3",
    ),
)
def dq_minitems(spark, t):
    source = t.documents.withColumn("lines", F.split("text", "\n"))
    return _errors(source, "doc_id", {"field": "lines", "rule": "minItems", "value": 3})


@query(
    "dq_maxitems",
    _oracle("embeddings", "vec_id", "embedding", "maxitems", "more than 8 entries", "len(embedding) <= 8")
    + " UNION ALL SELECT vec_id, 'label', 'maxitems', 'more than 8 entries' FROM embeddings",
)
def dq_maxitems(spark, t):
    rules = [{"field": f, "rule": "maxItems", "value": 8} for f in ("embedding", "label")]
    return check_rules(t.embeddings, rules).errors("vec_id")


@query(
    "dq_custom",
    _oracle(
        "events",
        "event_id",
        "value",
        "custom",
        "condition does not hold",
        "value < 100 AND event_type <> 'error'",
    ),
)
def dq_custom(spark, t):
    rule = {"field": "value", "rule": "custom", "value": "value < 100 and item.event_type <> 'error'"}
    return _errors(t.events, "event_id", rule)


@query(
    "dq_schema",
    """SELECT o_orderkey, '/o_totalprice' AS field, 'maximum' AS rule, 'violates maximum 400000' AS message
       FROM orders WHERE o_totalprice > 400000
       UNION ALL SELECT o_orderkey, '/o_orderstatus', 'enum', 'violates enum ["O", "F"]'
       FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
       UNION ALL SELECT o_orderkey, '/buyer/key', 'type', 'violates type "string"' FROM orders
       UNION ALL SELECT o_orderkey, '/o_orderpriority', 'pattern', 'violates pattern "^[1-3]-"'
       FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
       UNION ALL SELECT o_orderkey, '', 'required', 'requires ''remark''' FROM orders""",
)
def dq_schema(spark, t):
    nested = t.orders.withColumn("buyer", F.struct(F.col("o_custkey").alias("key")))
    schema = {
        "type": "object",
        "required": ["o_orderkey", "remark"],
        "properties": {
            "o_totalprice": {"type": "number", "minimum": 0, "maximum": 400000},
            "o_orderstatus": {"enum": ["O", "F"]},
            "o_orderpriority": {"type": "string", "pattern": "^[1-3]-", "minLength": 3, "maxLength": 20},
            "buyer": {"type": "object", "properties": {"key": {"type": "string"}}},
        },
    }
    return check_schema(nested, schema).errors("o_orderkey")


@query(
    "dq_schema_nested",
    """WITH m AS (
         SELECT p_partkey, '/measures/0' AS place, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part
         UNION ALL SELECT p_partkey, '/measures/1', 'price', p_retailprice FROM part)
       SELECT p_partkey, place || '/value' AS field, 'multipleOf' AS rule, 'violates multipleOf 5' AS message
       FROM m WHERE name = 'size' AND value % 5 <> 0
       UNION ALL SELECT p_partkey, place || '/value', 'exclusiveMaximum', 'violates exclusiveMaximum 1000'
       FROM m WHERE value >= 1000
       UNION ALL SELECT p_partkey, place || '/unit', 'additionalProperties', 'nothing is allowed here'
       FROM m WHERE name = 'price'
       UNION ALL SELECT p_partkey, '/words', 'contains', 'violates contains {"enum": ["bolt", "widget"]}'
       FROM part WHERE NOT list_has_any(string_split(p_name, ' '), ['bolt', 'widget'])
       UNION ALL SELECT p_partkey, '/brand', 'not', 'violates not {"const": "Brand#13"}'
       FROM part WHERE p_brand = 'Brand#13'
       UNION ALL SELECT p_partkey, '/type', 'oneOf', 'violates oneOf [{"pattern": "^E"}, {"pattern": "O"}]'
       FROM part WHERE (p_type LIKE 'E%') = (p_type LIKE '%O%')
       UNION ALL SELECT p_partkey, '/inner/inner/size', 'type', 'violates type "string"' FROM part""",
)
def dq_schema_nested(spark, t):
    """A recursive schema with references over VARIANT documents, one for each part."""
    measure = lambda name, value: f"'name', '{name}', 'value', cast({value} as double)"
    document = F.expr(
        f"""parse_json(to_json(named_struct('brand', p_brand, 'type', p_type, 'words', split(p_name, ' '),
            'measures', array(named_struct({measure("size", "p_size")}, 'unit', cast(null as string)),
                              named_struct({measure("price", "p_retailprice")}, 'unit', 'EUR')),
            'inner', named_struct('inner', named_struct('size', p_size)))))"""
    )
    schema = {
        "$defs": {
            "measure": {
                "required": ["name", "value"],
                "properties": {"name": {"enum": ["size", "price"]}, "value": {"exclusiveMaximum": 1000}},
                "additionalProperties": False,
                "if": {"properties": {"name": {"const": "size"}}},
                "then": {"properties": {"value": {"multipleOf": 5}}},
            }
        },
        "type": "object",
        "properties": {
            "brand": {"not": {"const": "Brand#13"}},
            "type": {"oneOf": [{"pattern": "^E"}, {"pattern": "O"}]},
            "words": {"uniqueItems": True, "contains": {"enum": ["bolt", "widget"]}},
            "measures": {"prefixItems": [{"$ref": "#/$defs/measure"}], "items": {"$ref": "#/$defs/measure"}},
            "size": {"type": "string"},
            "inner": {"$ref": "#"},
        },
    }
    # a check of this size is worth spreading the rows of a file that Spark reads as few splits
    spread = t.part.repartition("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    parts = spread.select("p_partkey", document.alias("document"))
    return check_schema(parts, schema, column="document").errors("p_partkey")


@query(
    "dq_split",
    f"""SELECT c_custkey, coalesce(({SEGMENT}) <> '' AND c_acctbal >= 0, false) AS valid FROM customer""",
)
def dq_split(spark, t):
    rules = [{"field": "segment", "rule": "required"}, {"field": "c_acctbal", "rule": "min", "value": 0}]
    checked = check_rules(_segments(t), rules)
    good = checked.valid.select("c_custkey", F.lit(True).alias("valid"))
    return good.unionByName(checked.invalid.select("c_custkey", F.lit(False).alias("valid")))


@query(
    "dq_quarantine",
    """SELECT p_partkey AS id, p_size AS size, CAST(NULL AS VARCHAR) AS problem FROM part WHERE p_size > 25
       UNION ALL SELECT p_partkey, NULL, 'size: cannot convert ''' || p_type || ''' to int'
       FROM part WHERE p_size <= 25""",
)
def dq_quarantine(spark, t):
    source = t.part.withColumn("label", F.expr("case when p_size > 25 then cast(p_size as string) else p_type end"))
    mapping = {"id": "p_partkey", "size": {"path": "label", "convert": "int"}}
    mapped = map_rows(source, mapping, on_error="quarantine")
    good = mapped.result.withColumn("problem", F.lit(None).cast("string"))
    bad = mapped.rejected.select(
        F.col("p_partkey").alias("id"),
        F.lit(None).cast("int").alias("size"),
        F.concat_ws(": ", F.col("_errors")[0]["field"], F.col("_errors")[0]["message"]).alias("problem"),
    )
    return good.unionByName(bad)
