"""A stored approximate index: inverted lists of short codes, and the vectors beside them.

K-means on a bounded sample gives each list a centroid; every row goes to the list
of its nearest centroid.  Lists are folders of one table, partitioned by list, so a
search reads the lists that its queries probe and no others, and inserts are files
more in these folders.  A row is stored with four bits a component beside the vector:
the codes of the probed lists are read to find ``refine * k`` candidates a query, and
only these are looked up and compared by their vectors.

Queries and the rows of a list meet in cells of bounded size, so neither a long list
nor a list that many queries probe fills one task.  Centroids (``MAX_LISTS`` of them at
most) go to all tasks.  Rows without a vector are left out; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.bm25 import top
from docloom.operators.vector import AT_ONCE, best, cosine_of, matrix
from docloom.storage import file_system

#: Lists of an index, rows that centroids are fitted on, queries and rows of one cell.
MAX_LISTS, SAMPLE, CELL = 4096, 100_000, 8192
#: Four bits hold the whole numbers from -LEVEL to LEVEL.
LEVEL = 7


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of four bits a component, two in a byte."""
    most = np.abs(x).max(axis=1, keepdims=True, initial=0)
    levels = np.rint(np.divide(x, most, out=np.zeros_like(x), where=most > 0) * LEVEL).astype(np.int8) + LEVEL + 1
    if levels.shape[1] % 2:
        levels = np.pad(levels, ((0, 0), (0, 1)), constant_values=LEVEL + 1)
    return (levels[:, ::2] | levels[:, 1::2] << 4).astype(np.uint8)


def decode(codes: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors near the ones that were encoded."""
    levels = np.empty((len(codes), codes.shape[1] * 2), np.float32)
    levels[:, ::2], levels[:, 1::2] = codes & 15, codes >> 4
    return _unit(levels[:, :dim] - (LEVEL + 1))


def _far(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T


class Index:
    """An index in a folder; ``build`` makes one, ``Index(spark, folder)`` opens it."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.folder, self.key, self.vector = spark, folder.rstrip("/"), key, vector
        found = spark.read.parquet(f"{self.folder}/centroids").orderBy("list").collect()  # MAX_LISTS rows at most
        self.centroids = np.array([r.centroid for r in found], float)

    def rows(self) -> DataFrame:
        """All stored rows: list, key, code, vector."""
        return self.spark.read.parquet(f"{self.folder}/lists")

    def add(self, rows: DataFrame) -> None:
        """Writes more rows into the lists."""
        centroids, key, vector = self.centroids, self.key, self.vector

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unit(matrix(pa.chunked_array([batch.column(1)])))
                    own = pa.array(_far(x, centroids).argmin(1).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in encode(x)], pa.binary()), batch.column(1), own], names=[key, "code", vector, "list"])

        kept = rows.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>").alias(vector))
        made = kept.mapInArrow(run, f"{key} {kept.schema[key].dataType.simpleString()}, code binary, {vector} array<float>, list int")
        made.repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.folder}/lists")

    def compact(self) -> None:
        """Rewrites the lists with few files each, into a folder of their own that then takes their place."""
        fs, lists = file_system(self.spark, f"{self.folder}/lists")
        path = lambda name: file_system(self.spark, f"{self.folder}/{name}")[1]
        self.rows().repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{self.folder}/lists-new")
        fs.delete(path("lists-old"), True)
        if not (fs.rename(lists, path("lists-old")) and fs.rename(path("lists-new"), lists)):
            raise OSError(f"the lists in {self.folder} couldn't be replaced; they are in lists-old")
        fs.delete(path("lists-old"), True)

    def probes(self, queries: DataFrame, n_probe: int) -> DataFrame:
        """query_id, v, list: the ``n_probe`` lists nearest to each query."""
        centroids = self.centroids
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(_far(_unit(matrix(pa.chunked_array([batch.column(1)]))), centroids), axis=1, kind="stable")[:, :n_probe]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query_id", "v", "lists"])

        asked = queries.filter(F.col(self.vector).isNotNull()).select("query_id", F.col(self.vector).cast("array<float>").alias("v"))
        return asked.mapInArrow(run, f"query_id {kind}, v array<float>, lists array<int>").select("query_id", "v", F.explode("lists").alias("list"))

    def search(self, queries: DataFrame, k: int = 10, n_probe: int = 8, refine: int = 5, cell: int = CELL) -> DataFrame:
        """query_id, key, score (cosine, rounded to 6 places), rank, n_read (codes that the query met), n_compared (vectors).

        ``queries`` has query_id and a column of the index's vector name.
        """
        dim, wanted = self.centroids.shape[1], refine * k
        probed, stored = self.probes(queries, n_probe), self.rows()
        lists = [r.list for r in probed.select("list").distinct().collect()]  # MAX_LISTS at most
        stored = stored.filter(F.col("list").isin(lists))  # prunes folders
        size = lambda df, name: df.groupBy("list").agg(F.count("*").alias(name))
        sizes = size(stored, "n_x").join(size(probed, "n_q"), "list").select("list", "n_x", F.ceil(F.col("n_x") / cell).cast("int").alias("xs"), F.ceil(F.col("n_q") / cell).cast("int").alias("qs"))
        sizes = F.broadcast(sizes)  # a row for each list
        deal = lambda df, of, own, n, other, m: df.join(sizes, "list").withColumn(own, F.pmod(F.xxhash64(of), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        q = deal(probed, "query_id", "qb", "qs", "xb", "xs").select("list", "qb", "xb", F.col("query_id").alias("id"), "v")
        x = deal(stored.select("list", self.key, "code"), self.key, "xb", "xs", "qb", "qs").select("list", "qb", "xb", F.col(self.key).alias("id"), "code")
        kinds = [q.schema["id"].dataType.simpleString(), x.schema["id"].dataType.simpleString()]

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            found: list[list[pa.Array]] = [[], [], []]
            if a.num_rows and b.num_rows:
                left, ids, own = _unit(matrix(a["v"])), b["id"].to_numpy(), a["id"].to_numpy()
                right = decode(np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, -1), dim)
                for low in range(0, len(own), AT_ONCE):
                    score = left[low : low + AT_ONCE] @ right.T
                    i, j = best(score, ids, wanted)
                    for into, values in zip(found, (own[low + i], ids[j], score[i, j])):
                        into.append(pa.array(values))
            types = [a.schema.field("id").type, b.schema.field("id").type, pa.float64()]
            place = pa.array([b["list"][0].as_py() if b.num_rows else 0] * sum(map(len, found[0])), pa.int32())
            return pa.table([*(pa.chunked_array([c.cast(t) for c in own], t) for own, t in zip(found, types)), place], ["query_id", "vec", "guess", "list"])

        guesses = q.groupBy("list", "qb", "xb").cogroup(x.groupBy("list", "qb", "xb")).applyInArrow(meet, f"query_id {kinds[0]}, vec {kinds[1]}, guess double, list int")
        chosen = top(guesses, wanted, "query_id", F.desc("guess"), "vec").select("query_id", "list", F.col("vec").alias(self.key))
        read = probed.join(sizes, "list").groupBy("query_id").agg(F.sum("n_x").alias("n_read"))
        vectors = stored.select("list", self.key, F.col(self.vector).alias("b"))
        met = chosen.join(vectors, ["list", self.key]).join(queries.select("query_id", F.col(self.vector).alias("a")), "query_id")
        scored = met.select("query_id", self.key, F.round(cosine_of(F.col("a"), F.col("b")), 6).alias("score"))
        compared = scored.groupBy("query_id").agg(F.count("*").alias("n_compared"))
        return top(scored, k, "query_id", F.desc("score"), self.key).join(read, "query_id").join(compared, "query_id")


def build(rows: DataFrame, folder: str, n_lists: int | None = None, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> Index:
    """An index of all ``rows`` in ``folder``; centroids are fitted on ``sample`` rows at most, chosen by a hash of the key.

    Without ``n_lists``, as many lists as the square root of the rows, ``MAX_LISTS`` at most.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = rows.filter(F.col(vector).isNotNull())
    n = usable.select(key).count()
    if not n:
        raise ValueError("there are no vectors to fit an index on")
    n_lists = min(n_lists or max(1, round(math.sqrt(n))), MAX_LISTS, n)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = F.transform(vector, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(F.lit(0.0)))
    some = usable.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))).select(array_to_vector(unit).alias("features"))
    # a sample of few rows may come out smaller than the number of lists
    model = KMeans(k=n_lists, seed=seed, maxIter=15).fit(some if n > sample else usable.select(array_to_vector(unit).alias("features")))
    centroids = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    rows.sparkSession.createDataFrame(centroids, "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder.rstrip('/')}/centroids")
    index = Index(rows.sparkSession, folder, key, vector)
    index.add(rows)
    return index
