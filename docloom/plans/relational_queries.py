"""Listing, joins and roll-ups over catalog, user and role tables.

Users are ``customer``, roles ``nation``, groups ``region``; the link table
user_role is (c_custkey, c_nationkey).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.filters import boolean_filter
from docloom.plans.registry import query
from docloom.tables import Tables


def where(df: DataFrame, **filters: object) -> DataFrame:
    """Rows equal to every filter; None is no filter, and fields that ``df`` lacks are ignored."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), [(k, v) for k, v in filters.items() if v is not None and k in df.columns], df)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a totally ordered listing; the first is 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def term_filter(spec: dict) -> Column:
    """A predicate from a structured filter: term, terms, range, and bool of such (must, should, must_not)."""
    (kind, body), *_ = spec.items()
    if kind == "term":
        (field, value), *_ = body.items()
        return F.col(field) == value
    if kind == "terms":
        (field, values), *_ = body.items()
        return F.col(field).isin(*values)
    if kind == "range":
        (field, bounds), *_ = body.items()
        ops = {"gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v}
        return reduce(lambda a, b: a & b, (ops[o](F.col(field), v) for o, v in bounds.items()))
    if kind == "bool":
        parts = [term_filter(x) for x in body.get("must", ())] + [~term_filter(x) for x in body.get("must_not", ())]
        if body.get("should"):
            parts.append(reduce(lambda a, b: a | b, (term_filter(x) for x in body["should"])))
        return reduce(lambda a, b: a & b, parts)
    raise ValueError(f"unknown filter: {kind}")


EXPRESSION = re.compile(r"""\s*(\w+)\s*==\s*(?:'([^']*)'|"([^"]*)")\s*""")


def expression_filter(text: str) -> Column:
    """The predicate of an expression such as ``lang == 'en'``; any other form is an error."""
    m = EXPRESSION.fullmatch(text)
    if not m:
        raise ValueError(f"no filter expression of the form key == 'value': {text!r}")
    return F.col(m[1]).cast("string") == (m[2] if m[2] is not None else m[3])


def user_role(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"))


@query("SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, n_chars, 'completed' AS status FROM documents WHERE doc_id = 17")
def get_document(t: Tables) -> DataFrame:
    row = t.documents.filter("doc_id = 17")
    return row.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), "n_chars", F.lit("completed").alias("status"))


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20")
def list_documents(t: Tables) -> DataFrame:
    return page(where(t.documents, lang="en", no_such_field=1), [F.desc("n_chars"), F.asc("doc_id")], 1, 20).select("doc_id", "source", "lang", "n_chars")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def search_like(t: Tables) -> DataFrame:
    return t.part.filter(F.contains("p_name", F.lit("ring"))).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def filter_between(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderdate between timestamp_ntz'1995-01-01' and timestamp_ntz'1995-12-31'").select("o_orderkey", "o_orderdate")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def recent_rows(t: Tables) -> DataFrame:
    last = t.events.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))
    return t.events.join(F.broadcast(last), F.col("ts") >= F.col("since")).select("event_id", "ts", "event_type")  # one row


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 10 OFFSET 20")
def active_page(t: Tables) -> DataFrame:
    return page(t.customer.filter("c_acctbal > 0"), [F.asc("c_custkey")], 3, 10).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT DISTINCT c.c_custkey, c.c_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5)) AND c.c_mktsegment = 'BUILDING' AND c.c_acctbal > 0")
def complex_filter(t: Tables) -> DataFrame:
    roles = t.nation.filter(F.col("n_nationkey").isin(1, 3, 5)).select("n_name")
    users = where(t.customer, c_mktsegment="BUILDING").filter("c_acctbal > 0")
    joined = users.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(roles, "n_name", "left_semi")
    return joined.select("c_custkey", "c_name").distinct()


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3) AND event_type = (SELECT min(event_type) FROM events)")
def filter_metadata(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    first = t.events.agg(F.min("event_type").alias("event_type"))
    return t.events.join(F.broadcast(first), "event_type", "left_semi").withColumn("k", k).filter(F.col("k").isin(1, 2, 3)).select("event_id", "event_type", "k")  # one row


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def filter_expression(t: Tables) -> DataFrame:
    return t.documents.filter(expression_filter("lang == 'de'")).select("doc_id", "lang")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (3, 5, 7, 11) OR (lang = 'de' OR lang = 'fr') AND n_chars BETWEEN 200 AND 900 AND NOT (source = 'src0' OR source = 'it''s')")
def filter_boolean(t: Tables) -> DataFrame:
    asked = "doc_id in [3, 5, 7, 11] || (lang == \"de\" or lang == 'fr') and n_chars >= 200 and n_chars <= 900 and not (source == 'src0' or source == \"it's\")"
    return t.documents.filter(boolean_filter(asked, t.documents.columns)).select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('fr', 'de') AND n_chars >= 500 AND n_chars < 5000 AND NOT source = 'src0' AND (source = 'src1' OR source = 'src2')")
def filter_es_term(t: Tables) -> DataFrame:
    spec = {"bool": {"must": [{"terms": {"lang": ["fr", "de"]}}, {"range": {"n_chars": {"gte": 500, "lt": 5000}}}], "must_not": [{"term": {"source": "src0"}}], "should": [{"term": {"source": "src1"}}, {"term": {"source": "src2"}}]}}
    return t.documents.filter(term_filter(spec)).select("doc_id", "lang", "source", "n_chars")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0")
def indexable_docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.filter("quality = 1 and toxic = 0"), "doc_id").select("doc_id", "quality")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def filter_facets(t: Tables) -> DataFrame:
    rows = where(t.orders, o_orderstatus="O").filter("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'")
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT vec_id, label FROM embeddings WHERE label = 2 AND len(embedding) = 64")
def filter_conjunction(t: Tables) -> DataFrame:
    return where(t.embeddings, label=2).filter(F.size("embedding") == 64).select("vec_id", "label")


@query("SELECT c.c_custkey AS user_id, c.c_name AS user_name, n.n_name AS role_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = (SELECT max(n_name) FROM nation)")
def join_role_name(t: Tables) -> DataFrame:
    role = t.nation.join(F.broadcast(t.nation.agg(F.max("n_name").alias("n_name"))), "n_name", "left_semi")  # one row
    return user_role(t).join(role, F.col("role_id") == F.col("n_nationkey")).join(t.customer, F.col("user_id") == F.col("c_custkey")).select("user_id", F.col("c_name").alias("user_name"), F.col("n_name").alias("role_name"))


@query("SELECT DISTINCT c.c_custkey AS user_id FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey = 2 AND c.c_mktsegment = 'MACHINERY'")
def join_permission(t: Tables) -> DataFrame:
    allowed = t.nation.join(t.region.filter("r_regionkey = 2"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return t.customer.filter("c_mktsegment = 'MACHINERY'").join(allowed, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("user_id"))


@query("SELECT n.n_nationkey AS role_id, n.n_name AS role_name, coalesce(list_sort(list(c.c_custkey) FILTER (WHERE c.c_custkey IS NOT NULL)), []) AS user_ids FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2")
def left_join_nested(t: Tables) -> DataFrame:
    joined = t.nation.join(user_role(t), F.col("n_nationkey") == F.col("role_id"), "left")
    return joined.groupBy(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("role_name")).agg(F.array_sort(F.collect_list("user_id")).alias("user_ids"))


@query("SELECT c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 5000")
def raw_sql_join(t: Tables) -> DataFrame:
    views = {name: getattr(t, name) for name in ("customer", "nation", "region")}
    return t.spark.sql(
        "SELECT c.c_name, n.n_name, r.r_name FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 5000", **views
    )


_PERMISSIONS = [(0, "*", "read"), (1, "BUILDING", "*"), (2, "MACHINERY", "write"), (3, "*", "*"), (4, "FURNITURE", "read")]
_PERMISSION_SQL = "permissions(region, resource, action) AS (VALUES " + ", ".join(map(str, _PERMISSIONS)) + ")"


def permitted(requests: DataFrame, permissions: DataFrame, *keys: str) -> DataFrame:
    """Requests (keys, resource, action) that a permission grants, ``*`` standing for any; by equality joins."""
    wide = requests.withColumns({"r": F.explode(F.array("resource", F.lit("*"))), "resource0": F.col("resource"), "action0": F.col("action")}).withColumn("a", F.explode(F.array("action", F.lit("*"))))
    found = wide.drop("resource", "action").withColumnsRenamed({"r": "resource", "a": "action"}).join(permissions, [*keys, "resource", "action"], "left_semi")
    return found.drop("resource", "action").withColumnsRenamed({"resource0": "resource", "action0": "action"}).distinct()


@query(f"""WITH {_PERMISSION_SQL} SELECT c_custkey AS user_id FROM customer c JOIN nation n ON c_nationkey = n_nationkey WHERE EXISTS
    (SELECT 1 FROM permissions p WHERE p.region = n.n_regionkey AND p.resource IN (c.c_mktsegment, '*') AND p.action IN ('read', '*'))""")
def check_permission(t: Tables) -> DataFrame:
    granted = t.spark.createDataFrame(_PERMISSIONS, "region int, resource string, action string")
    asked = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("resource"), F.lit("read").alias("action"))
    return permitted(asked, granted, "region").select("user_id")


@query(f"""WITH {_PERMISSION_SQL}, has AS (SELECT c_custkey AS user_id, list_distinct(list(p.action)) AS actions, n.n_regionkey = 4 AS is_superuser FROM customer c JOIN nation n ON c_nationkey = n_nationkey
    LEFT JOIN permissions p ON p.region = n.n_regionkey AND p.resource IN (c.c_mktsegment, '*') GROUP BY ALL)
    SELECT user_id, is_superuser OR list_contains(actions, '*') OR list_has_all(actions, ['read', 'write']) AS allowed FROM has""")
def has_all_permissions(t: Tables) -> DataFrame:
    granted = t.spark.createDataFrame(_PERMISSIONS, "region int, p_resource string, action string")
    users = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_regionkey").alias("region"), F.explode(F.array("c_mktsegment", F.lit("*"))).alias("p_resource"))
    own = users.join(granted, ["region", "p_resource"], "left").groupBy("user_id", "region").agg(F.collect_set("action").alias("actions"))
    every = F.size(F.array_except(F.array(F.lit("read"), F.lit("write")), F.col("actions"))) == 0
    return own.select("user_id", ((F.col("region") == 4) | F.array_contains("actions", "*") | every).alias("allowed"))


@query("SELECT c_custkey AS user_id, list_has_any([n.n_name, r.r_name], [(SELECT min(r_name) FROM region), (SELECT max(n_name) FROM nation)]) AS allowed FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def has_any_role(t: Tables) -> DataFrame:
    wanted = t.region.agg(F.min("r_name").alias("a")).crossJoin(t.nation.agg(F.max("n_name").alias("b")))  # one row
    denied = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    users = t.customer.join(denied, "c_custkey", "left_anti").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(F.broadcast(wanted))
    return users.select(F.col("c_custkey").alias("user_id"), F.arrays_overlap(F.array("n_name", "r_name"), F.array("a", "b")).alias("allowed"))


@query("SELECT count(*) AS total FROM documents WHERE lang = 'en'")
def count_documents(t: Tables) -> DataFrame:
    return where(t.documents, lang="en").agg(F.count("*").alias("total"))


@query("SELECT n.n_name AS role_name, count(c.c_custkey) AS n_users FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def count_by_role(t: Tables) -> DataFrame:
    per_role = user_role(t).groupBy("role_id").agg(F.count("*").alias("n"))
    return t.nation.join(per_role, F.col("n_nationkey") == F.col("role_id"), "left").groupBy(F.col("n_name").alias("role_name")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_users"))


@query("SELECT source, count(*) AS document_count, CAST(sum(length(text) // 4) AS BIGINT) AS token_num, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS chunk_count FROM documents GROUP BY source")
def dataset_rollup(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("document_count"), F.sum(F.floor(F.length("text") / 4)).alias("token_num"), F.sum(F.size(F.split("text", "\n"))).alias("chunk_count"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 30")
def paged_listing(t: Tables) -> DataFrame:
    return page(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 30).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT total, CAST(ceil(total / 20) AS BIGINT) AS pages, 3 < ceil(total / 20) AS has_next, TRUE AS has_prev FROM (SELECT count(*) AS total FROM documents)")
def page_info(t: Tables) -> DataFrame:
    pages = F.ceil(F.col("total") / 20)
    return t.documents.agg(F.count("*").alias("total")).select("total", pages.alias("pages"), (F.lit(3) < pages).alias("has_next"), F.lit(True).alias("has_prev"))


@query("SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn, text), chr(10)) AS merged, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def ordered_merge(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    merged = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return t.conversations.groupBy("conv_id").agg(merged.alias("merged"), F.count("*").alias("n_turns"))


@query("""SELECT conv_id, count(*) AS n_segments, count(*) FILTER (WHERE role <> 'system') AS n_success, CASE WHEN count(*) FILTER (WHERE role = 'system') = 0 THEN 'success' WHEN count(*) FILTER (WHERE role <> 'system') = 0 THEN 'failed' ELSE 'partial' END AS status,
    list_sort(list(conv_id || '_' || turn) FILTER (WHERE role <> 'system')) AS node_ids FROM conversations GROUP BY conv_id""")
def merge_segments(t: Tables) -> DataFrame:
    # a turn stands for a segment; system turns for failed ones
    ok = F.col("role") != "system"
    rows = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_segments"), F.count_if(ok).alias("n_success"), F.array_sort(F.collect_list(F.when(ok, F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))))).alias("node_ids"))
    status = F.when(F.col("n_success") == F.col("n_segments"), "success").when(F.col("n_success") == 0, "failed").otherwise("partial")
    return rows.select("conv_id", "n_segments", "n_success", status.alias("status"), F.when(F.col("n_success") > 0, F.col("node_ids")).alias("node_ids"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE length(text) > 20) AS successful, count(*) FILTER (WHERE length(text) <= 20) AS failed, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS segments FROM documents")
def batch_summary(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("total"), F.count_if(F.length("text") > 20).alias("successful"), F.count_if(F.length("text") <= 20).alias("failed"), F.sum(F.size(F.split("text", "\n"))).alias("segments"))


@query("SELECT o_orderpriority AS group_id, CAST(floor(count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) * 100 / count(*)) AS BIGINT) AS progress FROM orders GROUP BY 1")
def group_progress(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("group_id")).agg(F.floor(F.count_if(F.col("o_orderstatus").isin("F", "P")) * 100 / F.count("*")).alias("progress"))


@query("SELECT n_nationkey AS role_id, n_name AS role_name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5")
def list_roles(t: Tables) -> DataFrame:
    return t.nation.orderBy("n_nationkey").offset(5).limit(10).select(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("role_name"))


@query("SELECT c.c_custkey AS user_id, c.c_name AS user_name, [n.n_name] AS roles FROM customer c JOIN nation n ON n_nationkey = c_nationkey WHERE c_name = (SELECT min(c_name) FROM customer)")
def get_user_with_roles(t: Tables) -> DataFrame:
    first = t.customer.agg(F.min("c_name").alias("c_name"))
    user = t.customer.join(F.broadcast(first), "c_name", "left_semi").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")  # one row
    return user.groupBy(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name")).agg(F.array_sort(F.collect_set("n_name")).alias("roles"))


@query("SELECT c_nationkey AS name_key, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1")
def unique_violations(t: Tables) -> DataFrame:
    # (nation, segment) taken as the key that should be unique
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("c_nationkey").alias("name_key"), "n")


