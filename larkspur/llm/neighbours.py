"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by a sum of one word from each of ``BOOKS`` full-dimensional codebooks. The books begin as
residual k-means of a bounded sample and are then refitted together by least squares to the codes that beam search
finds. Every row is encoded by that beam search: ``BEAM`` partial sums are kept from book to book. The index holds the
codes, the length of the sum (the stored norm), a digest of the unit vector and the original vector; ``codes`` has one row
for each different unit vector, without vectors.

1. *Score.* A search looks up, for each query and codebook, the query's product with each word; a code's score is the sum
   of its entries over the stored norm. Tasks read codes alone and keep the ``SHORT`` best of each query, a row a task
   and query; merged by query they are *one* shortlist a query, of different vectors. Its order is total, so it doesn't
   depend on how rows lie in files or tasks.
2. *Rerank.* One pass over the vectors ranks those of the shortlists by the exact cosine of the original vectors in
   double precision. Equal vectors stand for their smallest ids, as many as can be among the k nearest; a task keeps a
   query's best k, and k rows a query and task are shuffled.

Queries come to the driver and the tasks ``QUERIES`` at a time and their shortlists with them, so their size is bounded.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
rows with a null id. Ties go to the smaller id; in shortlists, where scores of different vectors tie, to the smaller
digest. Rows that repeat an id count each for itself, but none is a neighbour of its own id. Fewer candidates than k are
all returned. Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.llm.arrow import blocks, map_arrow, schema_of
from larkspur.llm.scratch import Scratch

BOOKS, WORDS, BEAM = 16, 256, 4
#: Rows that the codebooks are fitted on (in the order of a hash of the id), and rounds of fitting.
SAMPLE, KMEANS_ROUNDS, REFITS = 8192, 6, 1
SHORT, QUERIES, QUERY_BLOCK, ROW_BLOCK = 512, 8192, 128, 8192
#: Rows that are encoded at a time.
ENCODED = 2048
#: Pairs of a row and a query that are ranked at a time.
PAIRS = 200_000


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        begin = np.searchsorted(near[order], np.arange(k))
        filled = np.bincount(near, minlength=k)
        ok = filled > 0
        centres[ok] = np.add.reduceat(x[order], begin[ok], axis=0) / filled[ok, None]
        if not ok.all():  # an empty word takes the vector that is served worst
            far = np.argsort(-((x - centres[near]) ** 2).sum(1))[: (~ok).sum()]
            centres[~ok] = x[far]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sums) of the rows of ``x``, by beam search over the books."""
    n, dim = x.shape
    words = books.shape[1]
    rest = x[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        width = rest.shape[1]
        flat = rest.reshape(-1, dim)
        error = (flat**2).sum(1)[:, None] - 2 * flat @ book.T + (book**2).sum(1)
        error = error.reshape(n, width * words)
        keep = min(beam, error.shape[1])
        best = np.empty((n, keep), np.int64)
        for j in range(keep):  # a few passes for the least are faster than a partition
            best[:, j] = error.argmin(1)
            error[np.arange(n), best[:, j]] = np.inf
        source, word = best // words, best % words
        codes = np.concatenate([np.take_along_axis(codes, source[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        rest = np.take_along_axis(rest, source[:, :, None], 1) - book[word]
    return codes[:, 0], x - rest[:, 0]


def fit(sample: np.ndarray, seed: int = 11) -> np.ndarray:
    """Codebooks (books, words, dimensions) of a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    k, dim = min(WORDS, len(sample)), sample.shape[1]
    books, rest = np.zeros((BOOKS, k, dim), np.float32), sample.copy()
    for m in range(BOOKS):
        books[m] = kmeans(rest, k, KMEANS_ROUNDS, rng)
        rest = rest - books[m][np.argmin((books[m] ** 2).sum(1) - 2 * rest @ books[m].T, axis=1)]
    for _ in range(REFITS):
        codes, _ = encode(sample, books)
        used = codes.astype(np.int64)
        left = sample - sum(books[m][used[:, m]] for m in range(BOOKS))
        gram, right = np.zeros((BOOKS, k, BOOKS, k), np.float32), np.zeros((BOOKS, k, dim), np.float32)
        for m in range(BOOKS):
            for j in range(m, BOOKS):
                pairs = np.bincount(used[:, m] * k + used[:, j], minlength=k * k).reshape(k, k)
                gram[m, :, j], gram[j, :, m] = pairs, pairs.T
            np.add.at(right[m], used[:, m], left)
        gram = gram.reshape(BOOKS * k, BOOKS * k) + 0.1 * np.eye(BOOKS * k, dtype=np.float32)
        books = books + np.linalg.solve(gram, right.reshape(BOOKS * k, dim)).reshape(BOOKS, k, dim).astype(np.float32)
    return books


@dataclass
class Index:
    """Codebooks; rows id, v, d (the unit vector's digest), codes, norm; codes d, codes, norm of each different d."""

    books: np.ndarray | None
    rows: DataFrame
    codes: DataFrame | None
    dim: int


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v) that take part if their length is that of most."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))


def build(s: Scratch, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    rows = usable(vectors, id_col, vector_col)
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most["dim"] if most else 0
    rows = rows.filter(F.size("v") == dim)
    if not dim:
        return Index(None, rows, None, 0)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toArrow()
    x = _matrix(sample["v"].combine_chunks(), dim)
    books = fit((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
    spark_schema = schema_of("id bigint, v array<double>, d bigint, codes binary, norm double")
    arrow_schema = to_arrow_schema(spark_schema)
    wide = books.astype(np.float64)  # so that codes don't depend on which rows are encoded together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, ENCODED):
            x = _matrix(batch.column(1), dim)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0  # no negative zeros
            codes, sums = encode(unit, wide)
            norm = np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
            digests = np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in unit], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(arrow_schema.field("v").type), pa.array(digests), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], schema=arrow_schema)

    held = s.write(map_arrow(rows, run, spark_schema))
    codes = held.groupBy("d").agg(F.min(F.struct("codes", "norm")).alias("c")).select("d", "c.*")
    return Index(books, held, s.write(codes), dim)


def shortlist(scores: np.ndarray, most: int, keys: np.ndarray | None = None) -> list[np.ndarray]:
    """Of each row of ``scores`` the numbers of the ``most`` best; ties go to smaller ``keys`` (or numbers)."""
    n = scores.shape[1]
    if n <= most:
        return [np.arange(n)] * len(scores)
    cut = np.partition(scores, n - most, axis=1)[:, n - most]
    out = []
    for j, (row, least) in enumerate(zip(scores, cut, strict=True)):
        sure = np.flatnonzero(row > least)
        ties = np.flatnonzero(row == least)
        if keys is not None and len(ties) > most - len(sure):
            ties = ties[np.argsort(keys[j][ties], kind="stable")]
        out.append(np.concatenate([sure, ties[: most - len(sure)]]))
    return out


def copies(unit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, begin, count): the rows that stand for each different vector, those of one together, by the first's number.

    ``ids`` ascend. A vector has its first k rows, and as many more as one of their ids may take from them.
    """
    raw = np.ascontiguousarray(unit + 0.0)  # no negative zeros
    _, first, group, count = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True, return_counts=True)
    place = np.argsort(np.argsort(first))  # groups in the order of their first rows
    rows, count = np.argsort(place[group], kind="stable"), count[np.argsort(first)]
    begin = np.cumsum(count) - count
    for g in np.flatnonzero(count > k):
        own = ids[rows[begin[g] : begin[g] + count[g]]]
        most = max(np.searchsorted(own, own[:k], "right") - np.searchsorted(own, own[:k], "left"))
        count[g] = min(count[g], k + most)
    return rows, begin, count


class Best:
    """The ``most`` best (score, key) of each of ``n`` queries so far."""

    def __init__(self, n: int, most: int):
        self.score, self.key, self.most = np.full((n, most), -np.inf), np.full((n, most), np.iinfo(np.int64).max), most

    def add(self, begin: int, scores: np.ndarray, keys: np.ndarray) -> None:
        """``scores`` of the queries from ``begin`` on, a column for each of ``keys``."""
        at = slice(begin, begin + len(scores))
        every = np.concatenate([self.score[at], scores], axis=1)
        names = np.concatenate([self.key[at], np.broadcast_to(keys, scores.shape)], axis=1)
        for j, kept in enumerate(shortlist(every, self.most, names)):
            self.score[begin + j], self.key[begin + j] = every[j, kept], names[j, kept]


def _shortlists(spark: SparkSession, index: Index, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(d, query) of each query's shortlist, ordered by d; queries by their number."""
    books = index.books.astype(np.float64)
    held = spark.sparkContext.broadcast(unit)
    spark_schema = schema_of("query int, scores binary, ds binary")
    arrow_schema = to_arrow_schema(spark_schema)
    n, most = len(ids), SHORT

    def made(numbers: list[int], scores: list[np.ndarray], ds: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([x.tobytes() for x in scores], pa.binary()), pa.array([x.tobytes() for x in ds], pa.binary())], schema=arrow_schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = held.value, Best(n, most)
        for batch in blocks(batches, ROW_BLOCK):
            d, norm = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(d), -1)
            for b in range(0, n, QUERY_BLOCK):
                table = np.matmul(books, q[b : b + QUERY_BLOCK].T).transpose(0, 2, 1)
                scores = np.zeros((table.shape[1], len(d)))
                for m in range(len(books)):
                    scores += table[m][:, codes[:, m]]
                best.add(b, scores / norm, d)
        good = best.score > -np.inf
        for b in range(0, n, 512):
            some = [j for j in range(b, min(n, b + 512)) if good[j].any()]
            yield made(some, [best.score[j][good[j]] for j in some], [best.key[j][good[j]] for j in some])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, None
        for batch in batches:
            for number, scores, ds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != last:
                    if last is not None:
                        yield done(last, best)
                    last, best = number, Best(1, most)
                best.add(0, np.frombuffer(scores)[None], np.frombuffer(ds, np.int64))
        if last is not None:
            yield done(last, best)

    def done(number: int, best: Best) -> pa.RecordBatch:
        good = best.score[0] > -np.inf
        return made([number], [best.score[0][good]], [best.key[0][good]])

    here = map_arrow(index.codes.select("d", "codes", "norm"), score, spark_schema)
    merged = map_arrow(here.repartition("query").sortWithinPartitions("query"), merge, spark_schema)
    found = merged.select("query", "ds").toArrow()  # a row a query, with SHORT numbers at most
    held.destroy()
    lists = [np.frombuffer(x, np.int64) for x in found["ds"].to_pylist()]
    d = np.concatenate([np.empty(0, np.int64), *lists])
    numbers = np.repeat(found["query"].to_numpy(), [len(x) for x in lists]).astype(np.int32)
    order = np.lexsort((numbers, d))
    return d[order], numbers[order]


def _reranked(spark: SparkSession, index: Index, ids: np.ndarray, unit: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """query_id, vec_id, score: of each task the k nearest of each query among its shortlist."""
    held = spark.sparkContext.broadcast((ids, unit, *pairs))
    spark_schema = schema_of("query_id bigint, vec_id bigint, score double")
    arrow_schema = to_arrow_schema(spark_schema)
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, listed, number = held.value
        who, of, score = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)

        def best(who: np.ndarray, of: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((of, -score, who))
            first = np.searchsorted(who[order], who[order])
            order = order[np.arange(len(order)) - first < k]
            return who[order], of[order], score[order]

        for batch in blocks(batches, ROW_BLOCK):
            d = batch.column(2).to_numpy()
            on = np.flatnonzero(np.searchsorted(listed, d, "right") > np.searchsorted(listed, d))
            if not len(on):
                continue
            batch, d = batch.take(pa.array(on)), d[on]
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            row_id, x = batch.column(0).to_numpy()[order], _matrix(batch.column(1), dim)[order]
            rows = x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0
            stand, begin, count = copies(rows, row_id, k)
            kept = stand[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
            low, high = np.searchsorted(listed, d[order][kept]), np.searchsorted(listed, d[order][kept], "right")
            ends = np.cumsum(high - low)
            start = 0
            while start < len(kept):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS)))
                many = (high - low)[start:stop]
                row = np.repeat(kept[start:stop], many)
                query = number[np.repeat(low[start:stop] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                other = row_id[row] != ids[query]
                row, query = row[other], query[other]
                exact = (rows[row] * q[query]).sum(1)  # row by row, so that equal vectors tie
                who, of, score = best(np.concatenate([who, query]), np.concatenate([of, row_id[row]]), np.concatenate([score, exact]))
                start = stop
        yield pa.RecordBatch.from_arrays([pa.array(ids[who], pa.int64()), pa.array(of, pa.int64()), pa.array(score)], schema=arrow_schema)

    return map_arrow(index.rows.select("id", "v", "d"), run, spark_schema)


def search(s: Scratch, index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query (id, v) by cosine."""
    spark = queries.sparkSession
    n = queries.count() if index.dim else 0
    sets = max(1, -(-n // QUERIES))
    found = None
    for part in range(sets if n else 0):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(sets)) == part).toArrow().sort_by("id")
        if not own.num_rows:
            continue
        ids, q = own["id"].to_numpy(), _matrix(own["v"].combine_chunks(), index.dim)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        here = _reranked(spark, index, ids, q, _shortlists(spark, index, ids, q), k)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        here = s.write(here.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        found = here if found is None else found.unionByName(here)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if found is None else found


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row of which ``is_query`` holds."""
    with Scratch(vectors.sparkSession) as s:
        index = build(s, vectors, id_col, vector_col)
        queries = usable(vectors.filter(is_query), id_col, vector_col).filter(F.size("v") == index.dim)
        return s.keep(search(s, index, queries, k))
