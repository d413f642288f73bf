"""Maintenance of collections, incremental re-processing, ingestion by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import boundaries as B, collection as K, incremental as I, vector
from docloom.plans.registry import query
from docloom.storage import fresh_folder, remove, settled
from docloom.tables import Tables


def edited(t: Tables) -> DataFrame:
    """A second version of every document: the French ones have lost their first line, those of one source have got one more."""
    cut = F.when(F.col("lang") == "fr", F.array_join(F.slice(F.split("text", "\n"), F.lit(2), F.greatest(F.size(F.split("text", "\n")) - 1, F.lit(0))), "\n")).otherwise(F.col("text"))
    return t.documents.withColumn("text", F.concat(cut, F.when(F.col("source") == "src0", F.lit("\nOne more line.")).otherwise(F.lit(""))))


V2 = """v2 AS (SELECT * EXCLUDE (text), (CASE WHEN lang = 'fr' THEN array_to_string(list_slice(string_split(text, chr(10)), 2, len(string_split(text, chr(10)))), chr(10)) ELSE text END)
    || CASE WHEN source = 'src0' THEN chr(10) || 'One more line.' ELSE '' END AS text FROM documents)"""
HASHES = """a AS (SELECT doc_id, md5(x) AS hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)), b AS (SELECT doc_id, md5(x) AS hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM v2)),
    diff AS (SELECT doc_id, hash, CASE WHEN x.p IS NULL THEN 'added' WHEN y.q IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT *, 1 AS p FROM a) x FULL JOIN (SELECT DISTINCT *, 1 AS q FROM b) y USING (doc_id, hash))"""


def _chunks(docs: DataFrame) -> DataFrame:
    return I.hashed_chunks(docs, "doc_id", F.split("text", "\n"))


@query(f"WITH {V2}, {HASHES} SELECT doc_id, hash, change FROM diff")
def incremental_diff(t: Tables) -> DataFrame:
    return I.diff(_chunks(t.documents), _chunks(edited(t)), "doc_id")


@query(f"""WITH {V2}, {HASHES}, n AS (SELECT doc_id, count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'unchanged') AS n_unchanged, count(*) AS n_new FROM b JOIN diff USING (doc_id, hash) GROUP BY doc_id),
    o AS (SELECT doc_id, count(*) FILTER (WHERE change = 'removed') AS n_removed, count(*) AS n_old FROM a JOIN diff USING (doc_id, hash) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n_old IS NULL THEN 'new' WHEN n_added + n_removed = 0 THEN 'unchanged' WHEN n_added + n_removed > n_new * 0.5 THEN 'reprocess' ELSE 'update' END AS status,
        coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed, coalesce(n_unchanged, 0) AS n_unchanged FROM n FULL JOIN o USING (doc_id)""")
def incremental_status(t: Tables) -> DataFrame:
    return I.status(_chunks(t.documents), _chunks(edited(t)), "doc_id")


@query(f"WITH {V2}, {HASHES} SELECT doc_id, hash, doc_id || '_chunk_' || hash AS node_id, change = 'unchanged' AS known FROM diff WHERE change <> 'removed'")
def incremental_node_map(t: Tables) -> DataFrame:
    old = _chunks(t.documents).select("doc_id", "hash").distinct().withColumn("known", F.lit(True))
    new = _chunks(edited(t)).select("doc_id", "hash").distinct()
    node = F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("chunk"), "hash")
    return new.join(old, ["doc_id", "hash"], "left").select("doc_id", "hash", node.alias("node_id"), F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH {V2} SELECT v.doc_id, md5(v.text) AS file_hash FROM v2 v JOIN documents d ON d.doc_id = v.doc_id WHERE md5(v.text) <> md5(d.text)")
def changed_documents(t: Tables) -> DataFrame:
    state = t.documents.select("doc_id", F.md5("text").alias("file_hash"), "source")
    return I.changed(state, edited(t).select("doc_id", F.md5("text").alias("file_hash"), "source"), "doc_id", "file_hash", "source").select("doc_id", "file_hash")


_COUNT = "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {0}) GROUP BY ALL"


@query(f"WITH {V2} SELECT b.doc_id, b.line, b.n - coalesce(a.n, 0) AS n FROM ({_COUNT.format('v2')}) b LEFT JOIN ({_COUNT.format('documents')}) a ON a.doc_id = b.doc_id AND a.line = b.line WHERE b.n > coalesce(a.n, 0)")
def added_lines(t: Tables) -> DataFrame:
    return I.added_lines(t.documents, edited(t), "doc_id", "text")


@query()
def incremental_chunks(t: Tables) -> DataFrame:
    # line diff of each document whose text has changed, against its old version
    new = edited(t).select("doc_id", F.col("text").alias("new"))
    both = t.documents.select("doc_id", F.col("text").alias("old")).join(new, "doc_id").filter("old <> new")
    return B.apply(both, "doc_id", ["old", "new"], B.diff_sections, "array<string>").select("doc_id", F.posexplode("value").alias("chunk_index", "text"))



_REQUESTS = """requests AS (SELECT label AS request, list(embedding ORDER BY vec_id) AS vectors, list(vec_id ORDER BY vec_id) AS ids, list('{"text": "t' || vec_id || '", "n": 1}' ORDER BY vec_id) AS metadata FROM embeddings WHERE vec_id < 10 OR label > 1 GROUP BY label),
    given AS (SELECT request, vectors, CASE WHEN request = 3 THEN ids[2:] ELSE ids END AS ids, CASE WHEN request = 4 THEN list_append(metadata, '{}') ELSE metadata END AS metadata FROM requests)"""


def _requests(t: Tables) -> DataFrame:
    """One request of a batch insert for each label; one has an id too few, one has metadata too many."""
    rows = t.embeddings.filter("vec_id < 10 or label > 1").select("label", F.struct("vec_id", "embedding", F.concat(F.lit('{"text": "t'), F.col("vec_id").cast("string"), F.lit('", "n": 1}')).alias("meta")).alias("r"))
    each = rows.groupBy(F.col("label").alias("request")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    part = lambda name: F.transform("rs", lambda r: r[name])
    ids = F.when(F.col("request") == 3, F.slice(part("vec_id"), F.lit(2), F.size("rs"))).otherwise(part("vec_id"))
    meta = F.when(F.col("request") == 4, F.array_append(part("meta"), F.lit("{}"))).otherwise(part("meta"))
    return each.select("request", part("embedding").alias("vectors"), ids.alias("ids"), meta.alias("metadata"))


@query(f"""WITH {_REQUESTS} SELECT request, CAST(unnest(ids) AS VARCHAR) AS id, CAST(generate_subscripts(ids, 1) - 1 AS BIGINT) AS pos, json_extract_string(unnest(metadata), '$.text') AS text, CAST(len(unnest(vectors)) AS INTEGER) AS dim
    FROM given WHERE len(ids) = len(vectors) AND len(metadata) = len(vectors)""")
def insert_requests(t: Tables) -> DataFrame:
    return K.request_rows(_requests(t), "request").select("request", "id", "pos", "text", F.size("vector").alias("dim"))


@query(f"""WITH {_REQUESTS} SELECT request, CASE WHEN len(ids) <> len(vectors) THEN len(ids) || ' ids for ' || len(vectors) || ' vectors' WHEN len(metadata) <> len(vectors) THEN len(metadata) || ' metadata for ' || len(vectors) || ' vectors' END AS error FROM given""")
def insert_request_errors(t: Tables) -> DataFrame:
    rows = _requests(t)
    return rows.select("request", K.request_errors(rows, dim=64).alias("error"))


def _negated(t: Tables) -> DataFrame:
    return t.embeddings.filter("label = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))


_SUM = "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5)"


def _summed(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.col("label").cast("int").alias("label"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query(f"SELECT vec_id, CAST(label AS INTEGER) AS label, {_SUM} AS total FROM (SELECT * FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding, label FROM embeddings)")
def insert_vectors(t: Tables) -> DataFrame:
    more = t.embeddings.withColumn("vec_id", F.col("vec_id") + 1000000)
    return _summed(K.insert(t.embeddings, more, "vec_id"))


@query(f"SELECT vec_id, CAST(label AS INTEGER) AS label, CASE WHEN label = 1 THEN -{_SUM} ELSE {_SUM} END + 0.0 AS total FROM embeddings")
def upsert_vectors(t: Tables) -> DataFrame:
    return _summed(K.upsert(t.embeddings, _negated(t), "vec_id"))


@query("SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 1")
def delete_vectors(t: Tables) -> DataFrame:
    return K.delete(t.embeddings, t.embeddings.filter("label = 1").select("vec_id")).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (1, 7, 42)")
def get_vectors(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([(1,), (7,), (42,), (-5,)], "vec_id long")
    return K.get(t.embeddings, wanted).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE FALSE")
def clear_collection(t: Tables) -> DataFrame:
    return K.clear(t.embeddings).select("vec_id", "label")


@query("SELECT k AS vec_id, k IN (SELECT vec_id FROM embeddings) AS deleted FROM (VALUES (1), (7), (-5)) v(k)")
def bulk_delete_result(t: Tables) -> DataFrame:
    return K.delete_result(t.embeddings, t.spark.createDataFrame([(1,), (7,), (-5,)], "vec_id long"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 32 ELSE len(embedding) END AS dim FROM embeddings WHERE vec_id % 7 = 0 OR embedding IS NULL OR len(embedding) <> 64")
def dimension_check(t: Tables) -> DataFrame:
    # all vectors of the table are whole, so every seventh is cut
    rows = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return K.wrong_dimension(rows, "embedding", 64).select("vec_id", F.size("embedding").cast("long").alias("dim"))


@query("SELECT count(*) AS n FROM embeddings WHERE label = 1")
def collection_count(t: Tables) -> DataFrame:
    return t.embeddings.filter("label = 1").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS row_count, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings")
def collection_stats(t: Tables) -> DataFrame:
    return K.stats(t.embeddings, "embedding")


#: The tables of a folder.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{n}' AS collection, count(*) AS n_rows FROM {n}" for n in TABLES))
def list_collections(t: Tables) -> DataFrame:
    each = [getattr(t, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("collection"), "n_rows") for n in t.names()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


@query("SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'failed' WHEN l.quality = 1 THEN 'completed' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def update_status(t: Tables) -> DataFrame:
    status = F.when(F.col("quality") == 0, "failed").when(F.col("quality") == 1, "completed").otherwise("pending")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT c_custkey AS user_id, c_nationkey AS role_id FROM customer UNION SELECT c_custkey, 0 FROM customer WHERE c_acctbal > 9000")
def assign_role(t: Tables) -> DataFrame:
    links = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"))
    more = t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("user_id"), F.lit(0).alias("role_id"))
    return links.unionByName(more).dropDuplicates(["user_id", "role_id"])


@query("SELECT n_name AS role_name FROM nation UNION SELECT * FROM (VALUES ('admin'), ('user'))")
def ensure_roles(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("admin",), ("user",), ("user",)], "role_name string")
    return K.add_missing(t.nation.select(F.col("n_name").alias("role_name")), wanted, "role_name")


@query(f"WITH {V2} SELECT doc_id, md5(text) AS hash FROM v2")
def upsert_documents(t: Tables) -> DataFrame:
    fresh = edited(t).filter("lang = 'fr' or source = 'src0'")
    return K.upsert(t.documents, fresh, "doc_id").select("doc_id", F.md5("text").alias("hash"))


@query()
def ann_lsh_recall(t: Tables) -> DataFrame:
    """Recall at 10 of an index by random hyperplanes against exact search, and the share of all rows that a query met: one row for each query."""
    from docloom.operators.lsh import candidates

    queries = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vector.top_k(queries, t.embeddings, 10, "cosine").select("query_id", "vec_id")
    found = candidates(queries, t.embeddings, 10).select("query_id", "vec_id", "n_found")
    n = t.embeddings.agg(F.count("*").alias("n"))
    each = exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.avg(F.col("n_found").isNotNull().cast("int")), 4).alias("recall"), F.max("n_found").alias("n_found"))
    return each.crossJoin(F.broadcast(n)).select("query_id", "recall", F.round(F.col("n_found") / F.col("n"), 4).alias("scanned"))  # one row


@query()
def ann_ivf_search(t: Tables) -> DataFrame:
    """Recall at 10 of a stored index that was built with two thirds of the rows, closed, opened and given the rest; the shares of codes and vectors that a query met."""
    from docloom.operators import ivf

    queries = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    folder = fresh_folder(t.spark, "ivf")
    later = F.pmod(F.xxhash64("vec_id"), F.lit(3)) == 0
    built = ivf.build(t.embeddings.filter(~later), folder)
    index = ivf.Index(t.spark, folder)
    index.add(t.embeddings.filter(later))
    # these vectors lie nearly as far from each other as random ones: three quarters of the lists
    found = index.search(queries, 10, n_probe=max(1, len(built.centroids) * 3 // 4), refine=4)
    exact = vector.top_k(queries, t.embeddings, 10, "cosine").select("query_id", "vec_id")
    n = t.embeddings.agg(F.count("*").alias("n"))
    each = exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.avg(F.col("n_read").isNotNull().cast("int")), 4).alias("recall"), F.max("n_read").alias("n_read"), F.max("n_compared").alias("n_compared"))
    share = lambda c: F.round(F.col(c) / F.col("n"), 4)
    out = settled(each.crossJoin(F.broadcast(n)).select("query_id", "recall", share("n_read").alias("codes_read"), share("n_compared").alias("vectors_compared")))  # one row
    remove(t.spark, folder)
    return out


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY event_type")
def stream_ingest(t: Tables) -> DataFrame:
    from docloom.streaming.ingest import ingest

    target = fresh_folder(t.spark, "events")
    rows = ingest(t.spark, f"{t.folder}/events.parquet", target, "event_id", order="ts")
    found = settled(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))
    remove(t.spark, target)
    return found


_OP = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END"


@query(f"""SELECT user_id, event_id, ts, op, value FROM (SELECT *, {_OP} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND op <> 'delete'""")
def stream_changes(t: Tables) -> DataFrame:
    """Events as inserts, updates and deletes of users, in files without order, some of them twice; the stream is stopped in the middle and goes on."""
    from docloom.streaming.changes import ChangedTable

    changes = t.events.select("user_id", "event_id", "ts", F.expr(_OP).alias("op"), "value")
    folder = fresh_folder(t.spark, "changes")
    part = lambda n: changes.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n)
    table = ChangedTable(t.spark, folder, changes.schema, "user_id", ["ts", "event_id"])
    for n in (2, 0):
        part(n).write.mode("append").parquet(f"{folder}/in")
    table.follow(f"{folder}/in", files_per_batch=1)
    table.compact()
    part(1).unionByName(part(2)).write.mode("append").parquet(f"{folder}/in")
    again = ChangedTable(t.spark, folder, changes.schema, "user_id", ["ts", "event_id"])
    again.follow(f"{folder}/in", files_per_batch=1)
    found = settled(again.current())
    remove(t.spark, folder)
    return found


_KEPT = "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


@query(f"SELECT * FROM ({_KEPT}) WHERE k IS NULL OR k <> 7")
def delete_by_metadata(t: Tables) -> DataFrame:
    """A collection whose metadata have no schema loses the rows with one value of a field."""
    from docloom.operators import metadata

    kept, root = metadata.collection(t.spark, "meta"), "events"
    kept.create(root, metadata.with_metadata(t.events, "props").select("event_id", "event_type", "props"))
    kept.delete_where(root, metadata.field("props", "k", "long") == 7)
    found = settled(kept.read(root).select("event_id", "event_type", metadata.field("props", "k", "long").alias("k")))
    remove(t.spark, kept.root)
    return found


@query(f"SELECT * FROM ({_KEPT}) WHERE k >= 20 AND k < 40 AND event_type IN ('view', 'click')")
def search_by_metadata(t: Tables) -> DataFrame:
    from docloom.operators import metadata
    from docloom.operators.filters import boolean_filter

    rows = metadata.with_metadata(t.events, "props")
    asked = boolean_filter("props['k'] >= 20 and props['k'] < 40 && event_type in [\"view\", 'click']", rows.columns, "props", "variant")
    return rows.filter(asked).select("event_id", "event_type", metadata.field("props", "k", "long").alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t: Tables) -> DataFrame:
    """Event-time windows of an hour, with rows up to ten minutes late, by the same code for batches and streams."""
    from docloom.streaming.ingest import windowed

    found = windowed(t.events.select("ts", "event_type"), "ts", "1 hour", "10 minutes", "event_type")
    return found.select(F.col("window.start").alias("hour"), "event_type", "n")
