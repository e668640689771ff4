"""Vector search over array columns, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 for vectors of unlike length."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _gap(a: Column, b: Column, f) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(1.7976931348623157e308))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_gap(a, b, lambda d: d * d))


def manhattan(a: Column, b: Column) -> Column:
    return _gap(a, b, F.abs)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer: cosine, dot, or 1 / (1 + distance) for euclidean and manhattan."""
    if metric == "cosine":
        n = norm(a) * norm(b)
        return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
    if metric == "dot":
        return dot(a, b)
    return 1.0 / (1.0 + {"euclidean": euclidean, "manhattan": manhattan}[metric](a, b))


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact search: id and score of the k nearest rows, ties to the smaller id; partitions keep k each before the merge."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(F.col(id_col), similarity(metric, F.col(vec), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def nearest_sharded(vectors: DataFrame, query: list[float], k: int, shards: int, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact search over shards by hash of the id: each keeps its k nearest, which are then merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_col, F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"), similarity(metric, F.col(vec), q).alias("score"))
    w = Window.partitionBy("shard").orderBy(F.desc("score"), id_col)
    best = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(k)


BLOCK_ROWS = 2048  # vectors, or query vectors, that are packed into one row and multiplied together


def _scores(metric: str, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Similarity of each query (row of the result) with each vector (column)."""
    if metric in ("cosine", "dot"):
        d = q @ rows.T
        if metric == "dot":
            return d
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        return np.divide(d, n, out=np.zeros_like(d), where=n > 0)
    p = 2 if metric == "euclidean" else 1
    return np.stack([1 / (1 + np.linalg.norm(rows - x, ord=p, axis=1)) for x in q])


def _packed(df: DataFrame, id_col: str, vec: str, side: str, by: str | None = None) -> DataFrame:
    """Blocks of up to BLOCK_ROWS vectors of one length: <side>_ids, <side>_width, <side>_values (all in one array), and the int column `by`, alike in a block."""
    names = [f"{side}_ids", f"{side}_width", f"{side}_values", *([by] if by else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(key)))
            arrays = [pa.array([ids], pa.list_(pa.int64())), pa.array([key[0]], pa.int32()), pa.array([values], pa.list_(pa.float32() if values.dtype == np.float32 else pa.float64()))]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array([key[1]], pa.int32())] if by else [])], names=names)

        for b in batches:
            ids, values = b.column(0).to_numpy(), b.column(1)
            lengths = pc.list_value_length(values).to_numpy()
            group = b.column(2).to_numpy() if by else np.zeros(len(ids), np.int32)
            for n, g in {(int(n), int(g)) for n, g in zip(lengths, group)}:
                at = np.flatnonzero((lengths == n) & (group == g))
                flat = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                for i in range(0, len(at), BLOCK_ROWS):
                    part = held.setdefault((n, g), [])
                    part.append((ids[at[i : i + BLOCK_ROWS]], flat[i * n : (i + BLOCK_ROWS) * n]))
                    if sum(len(x) for x, _ in part) >= BLOCK_ROWS:
                        yield out((n, g))
        for key in list(held):
            yield out(key)

    kind = dict(df.dtypes)[vec]
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vec) > 0)).select(F.col(id_col).cast("bigint"), F.col(vec).cast("array<float>" if kind == "array<float>" else "array<double>"), *([by] if by else []))
    return rows.mapInArrow(run, f"{side}_ids array<bigint>, {side}_width int, {side}_values {'array<float>' if kind == 'array<float>' else 'array<double>'}" + (f", `{by}` int" if by else ""))


def _best_of_pairs(pairs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, id_col: str) -> DataFrame:
    """query_id, id, score and rank of the k rows of highest score of each query, from pairs of a query block (q_) and a block of rows (v_); other than the query itself, ties to the smaller id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda i, n: b.column(b.schema.get_field_index(n))[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            widths = [b.column(b.schema.get_field_index(f"{x}_width")).to_numpy() for x in "qv"]
            for i in range(b.num_rows):
                if widths[0][i] != widths[1][i]:
                    continue
                qid, ids = col(i, "q_ids"), col(i, "v_ids")
                s = score(col(i, "v_values").astype(float).reshape(len(ids), -1), col(i, "q_values").astype(float).reshape(len(qid), -1))
                s = np.where(qid[:, None] == ids[None, :], -np.inf, s)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, axis=1)
                keep = np.isfinite(best).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, order.shape[1])[keep]), pa.array(ids[order].ravel()[keep]), pa.array(best.ravel()[keep])], names=["query_id", id_col, "score"])

    found = pairs.mapInArrow(run, f"query_id bigint, `{id_col}` bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_of_each(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, id, score and rank (1 to k) for every query row against all other vectors, exactly; ties go to the smaller id.

    The stated queries meet all rows in blocks of BLOCK_ROWS: a task multiplies a block of queries with one of vectors
    and keeps k a query. Null, empty and unlike long vectors are left out. Nothing passes through the driver but what
    Spark itself broadcasts of a small set of queries.
    """
    pairs = _packed(vectors, id_col, vec, "v").crossJoin(_packed(queries, id_col, vec, "q"))  # of blocks
    return _best_of_pairs(pairs, lambda rows, q: _scores(metric, rows, q), k, id_col)


def nearest_of_each_sharded(queries: DataFrame, vectors: DataFrame, k: int, shards: int, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """As nearest_of_each over shards by hash of the id: each keeps k a query, which are then merged."""
    of = lambda i: vectors.where(F.pmod(F.xxhash64(id_col), F.lit(shards)) == i)
    found = [nearest_of_each(queries, of(i), k, metric, id_col, vec).drop("rank") for i in range(shards)]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _reranked(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, metric: str, id_col: str, vec: str) -> DataFrame:
    """The k nearest by the true vectors among those found (query_id and id)."""
    rows = found.select("query_id", id_col).join(vectors.select(id_col, F.col(vec).alias("_v")), id_col).join(queries.select(F.col(id_col).alias("query_id"), F.col(vec).alias("_q")), "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return rows.select("query_id", id_col, similarity(metric, F.col("_v"), F.col("_q")).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lsh_nearest(queries: DataFrame, vectors: DataFrame, k: int, candidates: int, id_col: str = "vec_id", vec: str = "embedding", bits: int = 1024, seed: int = 1) -> DataFrame:
    """query_id, id, score and rank of the k nearest (cosine) among the `candidates` rows a query whose sign hashes differ least.

    A vector's hash has a bit for each of `bits` random planes, on whose side it lies; hashes alone are compared with all
    rows, and only the vectors of candidates are ranked.
    """
    def hashed(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lengths = pc.list_value_length(b.column(1)).to_numpy()
                out = np.empty(b.num_rows, object)
                for n in set(lengths.tolist()):
                    at = np.flatnonzero(lengths == n)
                    rows = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                    planes = np.random.default_rng(seed).standard_normal((n, bits))
                    for i, h in zip(at, np.packbits(rows @ planes > 0, axis=1)):
                        out[i] = h.astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float32()))], names=[id_col, "hash"])

        rows = df.where(F.col(id_col).isNotNull() & (F.size(vec) > 0)).select(F.col(id_col).cast("bigint"), F.col(vec).cast("array<double>"))
        return rows.mapInArrow(run, f"`{id_col}` bigint, hash array<float>")

    def alike(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        rows, q = rows.astype(np.uint8), q.astype(np.uint8)
        return np.stack([-np.bitwise_count(rows ^ x).sum(axis=1, dtype=np.int32) for x in q]).astype(float)

    pairs = _packed(hashed(vectors), id_col, "hash", "v").crossJoin(_packed(hashed(queries), id_col, "hash", "q"))  # of blocks
    return _reranked(_best_of_pairs(pairs, alike, candidates, id_col), queries, vectors, k, "cosine", id_col, vec)


def _fitted_centres(rows: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k-means on a bounded sample."""
    k = min(k, len(rows))
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        of = _nearest_centre(rows, centres)
        n = np.bincount(of, minlength=k)
        total = np.stack([np.bincount(of, weights=x, minlength=k) for x in rows.T], axis=1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


def _sample(vectors: DataFrame, vec: str, rows: int, seed: int) -> np.ndarray:
    """About `rows` vectors (all, if there are fewer), for fitting; they come to the driver."""
    some = vectors.where(F.size(vec) > 0).select(F.col(vec).cast("array<double>").alias("v"))
    n = some.count()
    return np.array([r["v"] for r in (some if n <= rows else some.sample(rows / n, seed=seed)).collect()])


class IvfIndex:
    """Inverted lists: every vector belongs to its nearest centre; a search reads the lists of the nearest centres only."""

    def __init__(self, vectors: DataFrame, lists: int, id_col: str = "vec_id", vec: str = "embedding", seed: int = 1, fit_rows: int = 20_000):
        """Centres are fitted to about fit_rows sampled rows (all, if there are fewer); every row is indexed."""
        self.id_col, self.vec = id_col, vec
        self.centres = _fitted_centres(_sample(vectors, vec, fit_rows, seed), lists, seed)
        self.index = self._listed(vectors.where(F.size(vec) > 0), 1).withColumn("list", F.col("lists")[0]).drop("lists")

    def _listed(self, df: DataFrame, n: int) -> DataFrame:
        """df with `lists`, the n nearest."""
        centres, at = self.centres, df.columns.index(self.vec)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                d = (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(np.argsort(d, axis=1)[:, :n].astype(np.int32)), pa.list_(pa.int32()))], names=[*b.schema.names, "lists"])

        return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", lists array<int>")

    def probes(self, query: list[float], share: float = 0.1) -> list[int]:
        """The nearest lists: a tenth of them, and at least one."""
        d = ((self.centres - np.asarray(query)) ** 2).sum(axis=1)
        return [int(i) for i in np.argsort(d)[: self._many(share)]]

    def _many(self, share: float) -> int:
        return max(1, int(np.ceil(share * len(self.centres))))

    def search(self, query: list[float], k: int, metric: str = "cosine", share: float = 0.1) -> DataFrame:
        return nearest(self.index, query, k, metric, self.id_col, self.vec, F.col("list").isin(self.probes(query, share)))

    def search_each(self, queries: DataFrame, k: int, metric: str = "cosine", share: float = 0.1) -> DataFrame:
        """query_id, id, score and rank for every query row, other than itself: blocks of queries meet the blocks of the lists nearest to them."""
        near = self._listed(queries.where(F.size(self.vec) > 0).select(self.id_col, self.vec), self._many(share))
        q = _packed(near.select(self.id_col, self.vec, F.explode("lists").alias("list")), self.id_col, self.vec, "q", "list")
        pairs = _packed(self.index, self.id_col, self.vec, "v", "list").join(q, "list")  # of blocks
        return _best_of_pairs(pairs, lambda rows, x: _scores(metric, rows, x), k, self.id_col)

    def save(self, path: str) -> None:
        """Partitioned by list, so that a search prunes files."""
        self.index.write.mode("overwrite").partitionBy("list").parquet(path)


class ProductQuantizer:
    """Each of m parts of a vector is coded as its nearest of at most 256 centres, fitted to a bounded sample."""

    def __init__(self, vectors: DataFrame, m: int, centres: int = 256, id_col: str = "vec_id", vec: str = "embedding", seed: int = 1, fit_rows: int = 20_000):
        sample = _sample(vectors, vec, fit_rows, seed)
        if sample.ndim != 2 or sample.shape[1] % m:
            raise ValueError("the length of the vectors must be a multiple of m")
        self.id_col, self.vec, self.m, self.width = id_col, vec, m, sample.shape[1] // m
        self.books = [_fitted_centres(part, centres, seed) for part in np.split(sample, m, axis=1)]

    def _mapped(self, df: DataFrame, column: str, name: str, kind: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        at, typ = df.columns.index(column), pa.list_(pa.float32() if kind == "array<float>" else pa.float64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(f(rows)), typ)], names=[*b.schema.names, name])

        return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {name} {kind}")

    def encode(self, df: DataFrame) -> DataFrame:
        """df, without null vectors, with `code`, m centre numbers."""
        books = self.books
        return self._mapped(df.where(F.size(self.vec) > 0), self.vec, "code", "array<float>", lambda rows: np.stack([_nearest_centre(part, book) for part, book in zip(np.split(rows, len(books), axis=1), books)], axis=1).astype(np.float32))

    def decode(self, df: DataFrame) -> DataFrame:
        """df with `approx`, the vector of the centres of its code."""
        books = self.books
        return self._mapped(df, "code", "approx", "array<double>", lambda codes: np.concatenate([book[c] for book, c in zip(books, codes.astype(int).T)], axis=1))

    def search_each(self, coded: DataFrame, queries: DataFrame, k: int, candidates: int, metric: str = "cosine") -> DataFrame:
        """query_id, id, score and rank of the k nearest among the `candidates` rows a query that are nearest by their codes.

        Asymmetric: the dot product (for cosine, of vectors of like length) or squared distance of a query and a code is
        a sum of m looked-up terms. Codes meet all queries in blocks; only the candidates' vectors are read and ranked.
        """
        books = self.books

        def score(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
            s = np.zeros((len(q), len(codes)))
            for part, book, c in zip(np.split(q, len(books), axis=1), books, codes.astype(int).T):
                term = part @ book.T if metric in ("cosine", "dot") else -(((part[:, None] - book[None]) ** 2).sum(axis=2))
                s += term[:, c]
            return s

        q = _packed(queries, self.id_col, self.vec, "q").withColumn("q_width", F.lit(0))
        v = _packed(coded.select(self.id_col, "code"), self.id_col, "code", "v").withColumn("v_width", F.lit(0))
        return _reranked(_best_of_pairs(v.crossJoin(q), score, candidates, self.id_col), queries, coded, k, metric, self.id_col, self.vec)
