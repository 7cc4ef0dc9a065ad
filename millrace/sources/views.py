"""Input views derived from the base tables, defined alike for Spark and for DuckDB.

SQL text in ``CTES`` is the oracle's definition; the functions build the same rows with DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents that share one markdown text of ``source_md``: bounds its size however large a source is.
MD_DOCS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: one JSON text per order, its lines in the order of their own text."""
    line = F.concat(
        F.lit('{"part":'), F.col("l_partkey").cast("string"), F.lit(',"qty":'), F.col("l_quantity").cast("long").cast("string"),
        F.lit(',"flag":"'), F.col("l_returnflag"), F.lit('"}'),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("k"), "left")
    text = F.concat(
        F.lit('{"order":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('","priority":"'), F.col("o_orderpriority"),
        F.lit('","date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","lines":['), F.coalesce("lines", F.lit("")), F.lit("]}"),
    )
    return orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("text"))


ORDER_JSON = """
order_lines AS (SELECT l_orderkey AS k, string_agg(x, ',' ORDER BY x) AS lines FROM (
    SELECT l_orderkey, '{"part":' || l_partkey || ',"qty":' || l_quantity::BIGINT || ',"flag":"' || l_returnflag || '"}' AS x FROM lineitem) GROUP BY 1),
order_json AS (SELECT o_orderkey::VARCHAR AS doc_id,
    '{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '","date":"' || strftime(o_orderdate, '%Y-%m-%d')
    || '","lines":[' || coalesce(lines, '') || ']}' AS text FROM orders LEFT JOIN order_lines ON o_orderkey = k)"""


def source_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: markdown of up to MD_DOCS neighbouring documents of a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", F.floor(F.col("doc_id") / MD_DOCS).cast("long").alias("part"))
    piece = F.concat(F.lit("### doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"))
    langs = docs.groupBy("source", "part", "lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", piece.alias("p")))).alias("d"))
    body = F.concat(F.lit("## "), F.col("lang"), F.lit("\n"), F.array_join(F.transform("d", lambda x: x["p"]), "\n"))
    whole = langs.withColumn("b", body).groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("lang", "b"))).alias("l"))
    return whole.select(F.concat("source", F.lit("/"), F.col("part").cast("string")).alias("doc_id"), F.concat(F.lit("# "), "source", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["b"]), "\n")).alias("text"))


SOURCE_MD = f"""
source_langs AS (SELECT source, doc_id // {MD_DOCS} AS part, lang, '## ' || lang || chr(10) || string_agg('### doc ' || doc_id || chr(10) || chr(10) || text, chr(10) ORDER BY doc_id) AS b
                 FROM documents GROUP BY source, doc_id // {MD_DOCS}, lang),
source_md AS (SELECT source || '/' || part AS doc_id, '# ' || source || chr(10) || string_agg(b, chr(10) ORDER BY lang) AS text FROM source_langs GROUP BY source, part)"""


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, role``: region > nation > customer > order > part, nation > supplier; a cycle and a dangling edge a region."""
    t = lambda n: table(spark, sf_dir, n)

    def edge(df: DataFrame, a: str, x: str, b: str, y: str, role: str) -> DataFrame:
        return df.select(F.concat(F.lit(a + ":"), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b + ":"), F.col(y).cast("string")).alias("dst"), F.lit(role).alias("role"))

    parts = [
        edge(t("nation"), "region", "n_regionkey", "nation", "n_nationkey", "field"), edge(t("customer"), "nation", "c_nationkey", "customer", "c_custkey", "field"),
        edge(t("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey", "choice"), edge(t("orders"), "customer", "o_custkey", "order", "o_orderkey", "element"),
        edge(t("lineitem").select("l_orderkey", "l_partkey").distinct(), "order", "l_orderkey", "part", "l_partkey", "field"),
        edge(t("nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")), "nation", "n", "region", "n_regionkey", "extends"),
        edge(t("region"), "region", "r_regionkey", "missing", "r_regionkey", "extends"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STAR_EDGES = """
star_edges AS (
    SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'field' AS role FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'field' FROM customer
    UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'choice' FROM supplier
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'element' FROM orders
    UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'field' FROM lineitem
    UNION ALL SELECT 'nation:' || min(n_nationkey), 'region:' || n_regionkey, 'extends' FROM nation GROUP BY n_regionkey
    UNION ALL SELECT 'region:' || r_regionkey, 'missing:' || r_regionkey, 'extends' FROM region)"""


def query_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries: query_id, query, model, max_length), (passages: query_id, passage_id, pos, text)."""
    model = F.when(F.col("item_id") % 5 == 0, "listwise_medium").when(F.col("item_id") % 11 == 0, "unknown").otherwise("pairwise_nano")
    length = F.when(F.col("item_id") % 7 == 0, 600).when(F.col("item_id") % 3 == 0, 64)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), model.alias("model"), length.cast("int").alias("max_length"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), (F.col("doc_id") % 40).alias("q"), "text")
    passages = docs.join(queries.select("query_id"), F.col("query_id") % 40 == F.col("q"))
    return queries, passages.select("query_id", F.col("passage_id").cast("string").alias("passage_id"), F.col("passage_id").alias("pos"), "text")


QUERY_CANDIDATES = """
queries AS (SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 5 = 0 THEN 'listwise_medium' WHEN item_id % 11 = 0 THEN 'unknown' ELSE 'pairwise_nano' END AS model,
            (CASE WHEN item_id % 7 = 0 THEN 600 WHEN item_id % 3 = 0 THEN 64 END)::INT AS max_length FROM benchmark),
passages AS (SELECT query_id, doc_id::VARCHAR AS passage_id, doc_id AS pos, text FROM documents JOIN queries ON query_id % 40 = doc_id % 40)"""


def star_ir(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, fields, constraints): an order is an entity, its lines are the fields, quantities give constraints."""
    orders, customer, part = (table(spark, sf_dir, n) for n in ("orders", "customer", "part"))
    eid = F.concat(F.lit("orders#"), F.col("o_orderkey").cast("string"))
    entities = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderpriority").alias("bundle"), eid.alias("entity_id"), F.lit("object").alias("kind"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.concat("c_name", F.lit(" in segment "), "c_mktsegment").alias("description"), F.concat(F.lit("orders/"), F.col("o_orderstatus"), F.lit(".json")).alias("source_file"),
        F.lit("star").alias("source_id"), F.lit("1").alias("version"),
    )
    line = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    every = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*every))
    ref = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("part#"), F.col("l_partkey").cast("string")))
    fields = line.withColumn("pos", pos.cast("int")).join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("bundle"), eid.alias("entity_id"), "pos", F.concat(F.lit("line_"), F.col("pos").cast("string")).alias("name"),
        F.when(ref.isNull(), "integer").alias("type_prim"), ref.alias("type_ref"), F.col("p_name").alias("description"), (F.col("l_returnflag") == "R").alias("required"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("card_min"), F.when(F.col("l_linestatus") == "F", 1).alias("card_max"), F.col("l_quantity").cast("int").alias("quantity"),
    )
    constraints = fields.filter("quantity > 25").select("bundle", "entity_id", F.col("name").alias("field_name"), "pos", F.lit("range").alias("kind"), F.lit(1).alias("minimum"), F.col("quantity").alias("maximum"))
    return entities, fields, constraints


STAR_IR = """
entities AS (SELECT o_orderpriority AS bundle, 'orders#' || o_orderkey AS entity_id, 'object' AS kind, 'Order ' || o_orderkey AS name,
             c_name || ' in segment ' || c_mktsegment AS description, 'orders/' || o_orderstatus || '.json' AS source_file, 'star' AS source_id, '1' AS version
             FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
fields AS (SELECT o_orderpriority AS bundle, 'orders#' || o_orderkey AS entity_id, pos, 'line_' || pos AS name,
           CASE WHEN l_returnflag = 'N' THEN 'integer' END AS type_prim, CASE WHEN l_returnflag <> 'N' THEN 'part#' || l_partkey END AS type_ref,
           p_name AS description, l_returnflag = 'R' AS required, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS card_min, CASE WHEN l_linestatus = 'F' THEN 1 END AS card_max,
           l_quantity::INT AS quantity
           FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT AS pos FROM lineitem)
           LEFT JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
constraints AS (SELECT bundle, entity_id, name AS field_name, pos, 'range' AS kind, 1 AS minimum, quantity AS maximum FROM fields WHERE quantity > 25)"""


def star_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bundle, entity_id, pos, role, target``: an order extends, holds or chooses by its status."""
    orders = table(spark, sf_dir, "orders")
    status, customer = F.col("o_orderstatus"), F.concat(F.lit("customer#"), F.col("o_custkey").cast("string"))
    role = F.when(status == "F", "extends").when(status == "O", "element").otherwise("choice")
    targets = F.when(status == "P", F.array(customer, F.concat(F.lit("priority#"), "o_orderpriority"))).otherwise(F.array(customer))
    rows = orders.select(F.col("o_orderpriority").alias("bundle"), F.concat(F.lit("orders#"), F.col("o_orderkey").cast("string")).alias("entity_id"), role.alias("role"), F.posexplode_outer(targets).alias("pos", "target"))
    return rows.select("bundle", "entity_id", "pos", "role", "target")


STAR_RELATIONS = """
relations AS (
    SELECT o_orderpriority AS bundle, 'orders#' || o_orderkey AS entity_id, 0 AS pos, CASE o_orderstatus WHEN 'F' THEN 'extends' WHEN 'O' THEN 'element' ELSE 'choice' END AS role, 'customer#' || o_custkey AS target FROM orders
    UNION ALL SELECT o_orderpriority, 'orders#' || o_orderkey, 1, 'choice', 'priority#' || o_orderpriority FROM orders WHERE o_orderstatus = 'P')"""


def star_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of every kind: an enumeration for every fifth order, and one kind a field by its position."""
    entities, fields, ranges = star_ir(spark, sf_dir)
    at = F.col("pos")
    kind = F.when(at == 2, "length").when(at == 3, "pattern").when(at == 4, "format").when(at == 5, "const").when(at == 6, "rule")
    of = fields.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "bundle", "entity_id", F.col("name").alias("field_name"), "pos", "kind", F.when(at == 2, 1).alias("min_length"), F.when(at == 3, "^[0-9]+$").alias("pattern"),
        F.when(at == 4, "date").alias("format"), F.when(at == 5, F.col("quantity").cast("string")).alias("const"), F.when(at == 6, "checked").alias("message"), F.when(at == 6, "other.path").alias("target"),
    )
    key = F.substring("entity_id", 8, 20).cast("long")
    values = F.transform(F.sequence(F.lit(1), (key % 25 + 1).cast("int")), lambda i: F.concat(F.lit("v"), i.cast("string")))
    enums = entities.filter(key % 5 == 0).select("bundle", "entity_id", F.lit(0).alias("pos"), F.lit("enum").alias("kind"), values.alias("values"))
    return ranges.unionByName(of.withColumn("max_length", F.lit(None).cast("int")), True).unionByName(enums, True)


STAR_CONSTRAINTS = """
rich AS (SELECT *, NULL::INT AS min_length, NULL AS pattern, NULL AS format, NULL AS const, NULL AS message, NULL AS target, NULL::VARCHAR[] AS values FROM constraints
    UNION ALL SELECT bundle, entity_id, name, pos, CASE pos WHEN 2 THEN 'length' WHEN 3 THEN 'pattern' WHEN 4 THEN 'format' WHEN 5 THEN 'const' ELSE 'rule' END, NULL, NULL, CASE WHEN pos = 2 THEN 1 END,
        CASE WHEN pos = 3 THEN '^[0-9]+$' END, CASE WHEN pos = 4 THEN 'date' END, CASE WHEN pos = 5 THEN quantity::VARCHAR END, CASE WHEN pos = 6 THEN 'checked' END, CASE WHEN pos = 6 THEN 'other.path' END, NULL
        FROM fields WHERE pos BETWEEN 2 AND 6
    UNION ALL SELECT bundle, entity_id, NULL, 0, 'enum', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, list_transform(range(1, substr(entity_id, 8)::BIGINT % 25 + 2), lambda i: 'v' || i)
        FROM entities WHERE substr(entity_id, 8)::BIGINT % 5 = 0)"""


def star_inline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, entities, fields) of the star: every edge is a field of its source."""
    e = star_edges(spark, sf_dir)
    key = F.element_at(F.split("dst", ":"), -1)
    code = F.when(F.col("role") == "field", 0).when(F.col("role") == "choice", 1).when(F.col("role") == "element", 2).otherwise(3)
    e = e.select("src", "dst", F.concat("role", F.lit("_"), key).alias("name"), (key.cast("int") * 4 + code).alias("pos"))
    ids = e.select(F.col("src").alias("entity_id")).union(e.select("dst")).filter("entity_id NOT LIKE 'missing:%'").distinct()
    entities = ids.select("entity_id", F.lit("").alias("name"), F.element_at(F.split("entity_id", ":"), 1).alias("kind"))
    none = F.lit(None).cast("int")
    fields = e.select(F.col("src").alias("entity_id"), "pos", "name", F.lit(None).cast("string").alias("type_prim"), F.col("dst").alias("type_ref"), F.lit(0).alias("card_min"), none.alias("card_max"))
    return e.select("src", "dst", F.lit("field").alias("role"), "pos"), entities, fields


STAR_INLINE = """
f AS (SELECT src, dst, role || '_' || split_part(dst, ':', 2) AS name, split_part(dst, ':', 2)::INT * 4 + CASE role WHEN 'field' THEN 0 WHEN 'choice' THEN 1 WHEN 'element' THEN 2 ELSE 3 END AS pos FROM star_edges)"""


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: JSON, markdown, HTML and chat texts under one id space."""
    t = lambda n: table(spark, sf_dir, n)
    out = t("events").select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("doc_id"), F.col("props").alias("text"))
    out = out.unionByName(order_json(spark, sf_dir).select(F.concat(F.lit("order:"), "doc_id").alias("doc_id"), "text"))
    out = out.unionByName(source_md(spark, sf_dir).select(F.concat(F.lit("md:"), "doc_id").alias("doc_id"), "text"))
    out = out.unionByName(t("pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("doc_id"), F.col("html").alias("text")))
    return out.unionByName(t("conversations").select(F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("doc_id"), "text"))


RAW_PAYLOADS = f"""{ORDER_JSON}, {SOURCE_MD},
raw AS (SELECT 'event:' || event_id AS doc_id, props AS text FROM events
    UNION ALL SELECT 'order:' || doc_id, text FROM order_json UNION ALL SELECT 'md:' || doc_id, text FROM source_md
    UNION ALL SELECT 'page:' || page_id, html FROM pages UNION ALL SELECT 'turn:' || conv_id || '/' || turn, text FROM conversations)"""
