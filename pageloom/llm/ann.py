"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Squared distance is |q|^2 + |x|^2 - 2 q.x, so the nearest vectors have the largest q.x - |x|^2 / 2: a maximum inner
product search in which |x|^2 is kept exactly and x is quantised. An error of a code along x spoils the scores of just
those queries for which x matters, so it is weighed heavier than an error across x, both when codebooks are fitted and
when codes are chosen. Codes have four bits for each pair of dimensions; two codes share a byte. A search adds up table
entries, one look-up a byte, and the best few rows are ranked again by their true distance. That gives a distance to
beat. A row is at least as far from a query as the query is from the row's code, less the norm of what the code leaves
out (or the other way round); every row that this bound does not rule out is measured truly as well, so none is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_key, shared_folder, ship, written

CENTRES = 16
#: Rows scanned at a time in a task, and queries sent to the tasks at a time.
ROWS, QUERIES = 4096, 1024


@dataclass
class Quantiser:
    """Codebooks (parts, 16, 2) for vectors less ``mean``, padded to an even number of pairs; weight of parallel error."""

    mean: np.ndarray
    books: np.ndarray
    weight: float

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """(n, parts, 2) of the vectors less the mean."""
        out = np.zeros((len(vectors), len(self.books) * 2), np.float64)
        out[:, : vectors.shape[1]] = vectors - self.mean
        return out.reshape(len(vectors), -1, 2)

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """(n, parts) codes: nearest centres first, then each part in turn by the whole anisotropic error."""
        x = self.parts(vectors)
        codes = ((x[:, :, None] - self.books[None]) ** 2).sum(-1).argmin(-1)
        unit = direction(x)
        for _ in range(sweeps):
            codes = self.sweep(x, unit, codes)
        return codes.astype(np.uint8)

    def sweep(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        along = self.along(x, unit, codes)
        for m in range(len(self.books)):
            error = x[:, m, None] - self.books[m][None]
            parallel = (unit[:, m, None] * error).sum(-1)
            at = np.arange(len(x)), codes[:, m]
            rest = along - parallel[at]
            codes[:, m] = ((error**2).sum(-1) + (self.weight - 1) * (rest[:, None] + parallel) ** 2).argmin(1)
            along = rest + parallel[at[0], codes[:, m]]
        return codes

    def along(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The signed error of each row along its own direction."""
        return (unit * (x - self.decode(codes))).sum((1, 2))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """(n, parts, 2) of the centres."""
        return self.books[np.arange(len(self.books)), codes]


def direction(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum((1, 2), keepdims=True)), 1e-12)


def fit_quantiser(sample: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Quantiser:
    """Codebooks from a sample; ``threshold`` is the share of the norm above which a score counts, and sets the weight."""
    mean, dims = sample.mean(0), sample.shape[1]
    parts = -(-dims // 4) * 2  # an even number: two codes a byte
    weight = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    q, rng = Quantiser(mean, np.zeros((parts, CENTRES, 2)), weight), np.random.default_rng(seed)
    x = q.parts(sample)
    q.books = np.stack([x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m] for m in range(parts)])
    codes, unit = ((x[:, :, None] - q.books[None]) ** 2).sum(-1).argmin(-1), direction(x)
    for at in range(rounds):
        w = 1.0 if at < rounds // 2 else weight  # plain k-means first
        along = q.along(x, unit, codes)
        for m in range(parts):
            rest = along - (unit[:, m] * (x[:, m] - q.books[m, codes[:, m]])).sum(-1)
            for k in range(CENTRES):
                if len(i := np.flatnonzero(codes[:, m] == k)):
                    u = unit[i, m]
                    metric = len(i) * np.eye(2) + (w - 1) * u.T @ u
                    goal = x[i, m].sum(0) + (w - 1) * (u * ((u * x[i, m]).sum(1) + rest[i])[:, None]).sum(0)
                    q.books[m, k] = np.linalg.solve(metric, goal)
            along = rest + (unit[:, m] * (x[:, m] - q.books[m, codes[:, m]])).sum(-1)
        codes = ((x[:, :, None] - q.books[None]) ** 2).sum(-1).argmin(-1) if w == 1.0 else q.sweep(x, unit, codes)
    return q


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part: finite, without nulls, not zero."""
    v = F.col("vector")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null and size(vector) > 0")
    fine = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.filter(F.coalesce(fine, F.lit(False)))


def build_index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", sample_rows: int = 8000) -> tuple[DataFrame, dict[int, Quantiser]]:
    """An index of every usable row, (vec_id, vector, codes, length, rest) written to the shared folder, and its quantisers.

    length is the squared norm of what the codes stand for, rest the norm of what they leave out; both less the mean.
    Vectors of each length have a quantiser of their own, fitted on about sample_rows rows by hashed id: distances are
    defined between vectors of one length only. Lengths are few; each is a number of dimensions in use.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, key, column)
    quantisers = {}
    for dims, n in sorted(tuple(r) for r in rows.groupBy(F.size("vector")).count().collect()):
        mine, share = rows.filter(F.size("vector") == dims), min(1.0, sample_rows / n)
        taken = mine.filter(hex_key("ann:", F.col("vec_id").cast("string")) <= int(share * (1 << 60))).orderBy("vec_id").limit(2 * sample_rows).collect()
        taken = taken or mine.orderBy("vec_id").limit(sample_rows).collect()
        quantisers[dims] = fit_quantiser(np.array([r.vector for r in taken]))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, same in by_length(batch):
                quantiser = quantisers[dims]
                for at in range(0, len(same), ROWS):
                    block = same.iloc[at : at + ROWS]
                    vectors = np.stack(block["vector"].to_numpy())
                    codes = quantiser.encode(vectors)
                    packed, centres = codes[:, 0::2] | codes[:, 1::2] << 4, quantiser.decode(codes)
                    rest = np.sqrt(((quantiser.parts(vectors) - centres) ** 2).sum((1, 2)))
                    yield block.assign(codes=[row.tobytes() for row in packed], length=(centres**2).sum((1, 2)), rest=rest)

    schema = "vec_id long, vector array<double>, codes binary, length double, rest double"
    none = {"codes": F.lit(b""), "length": F.lit(0.0), "rest": F.lit(0.0)}
    index = rows.mapInPandas(encode, schema) if quantisers else rows.withColumns(none)
    return written(index), quantisers


def by_length(batch: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    sizes = batch["vector"].map(len)
    return [(int(dims), batch[sizes == dims]) for dims in sizes.unique()]


def search(index: DataFrame, quantisers: dict[int, Quantiser], queries: DataFrame, k: int = 10, rerank: int = 150) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, by true Euclidean distance, ties to smaller ids.

    queries: (vec_id, vector) rows; each is held against the index's rows of its own length. They may be many: they go
    to the tasks in blocks of about QUERIES rows, and each block meets all index rows, block by block. A row with the
    query's own id is no candidate. In each block of rows, ``rerank`` rows by table scores are measured truly, and then
    all others that could be nearer than the k-th so far; of equal vectors only the first k + 1 ids can be among a
    query's k nearest, so only they are looked at. Repeated queries get one answer; a query of a length that the index
    does not have gets none.
    """
    spark = index.sparkSession
    ship(spark)
    queries = queries.dropDuplicates(["vec_id"]) if quantisers else queries.limit(0)
    blocks = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    path = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    found = None
    for b in range(blocks):
        rows = [r for r in queries.filter(block == b).orderBy("vec_id").collect() if len(r.vector) in quantisers] if quantisers else []
        if not rows:
            continue
        asked = {d: [r for r in rows if len(r.vector) == d] for d in {len(r.vector) for r in rows}}
        sent = spark.sparkContext.broadcast([(np.array([r.vec_id for r in own]), np.array([r.vector for r in own]), quantisers[d]) for d, own in asked.items()])

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            best = {vectors.shape[1]: Nearest(ids, vectors, q, k, rerank) for ids, vectors, q in sent.value}
            for batch in batches:
                for dims, same in by_length(batch):
                    for at in range(0, len(same) if dims in best else 0, ROWS):
                        best[dims].look(same.iloc[at : at + ROWS])
            for nearest in best.values():
                yield nearest.frame()

        found = index.mapInPandas(scan, "query_id long, vec_id long, score double")
        if blocks > 1:  # each block's rows are written, so that no plan holds all blocks
            found.write.mode("append").parquet(path)
            sent.unpersist()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if blocks > 1:
        found = spark.read.schema("query_id long, vec_id long, score double").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Nearest:
    """The nearest rows so far of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, q: Quantiser, k: int, rerank: int) -> None:
        self.ids, self.vectors, self.mean, self.k, self.rerank = ids, vectors, q.mean, k, rerank
        self.less = vectors - q.mean
        self.square = (self.less**2).sum(1)
        tables = np.einsum("nmd,mkd->nmk", q.parts(vectors), q.books)
        #: For each byte of a code, the sum of its two entries, for every query.
        self.tables = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(ids), -1, 256).astype(np.float32)
        #: What single precision may add to a sum of entries or take from it.
        self.slack = (self.tables.shape[1] + 1) * 2.0**-23 * np.abs(self.tables).max(2).sum(1, dtype=np.float64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.distance = np.full((len(ids), k), np.inf)

    def look(self, block: pd.DataFrame) -> None:
        rows, vectors = block["vec_id"].to_numpy(np.int64), np.stack(block["vector"].to_numpy())
        codes = np.frombuffer(b"".join(block["codes"]), np.uint8).reshape(len(rows), -1)
        order = np.argsort(rows, kind="stable")
        _, same = np.unique(np.ascontiguousarray(vectors[order]).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
        by_group = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.diff(same[by_group], prepend=-1))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        keep = order[np.sort(by_group[place <= self.k])]
        rows, vectors, codes = rows[keep], vectors[keep], codes[keep]
        length, rest = block["length"].to_numpy(np.float64)[keep], block["rest"].to_numpy(np.float64)[keep]
        less = vectors - self.mean
        square = (less**2).sum(1)
        half = (square / 2).astype(np.float32)
        for at in range(0, len(self.ids), 128):
            mine = slice(at, at + 128)
            sums = np.zeros((len(self.ids[mine]), len(rows)), np.float32)
            for j in range(codes.shape[1]):
                sums += self.tables[mine, j][:, codes[:, j]]
            own = self.ids[mine, None] == rows[None]
            scores = sums - half
            scores[own] = -np.inf
            some = min(self.rerank, len(rows))
            near = np.argpartition(-scores, some - 1, axis=1)[:, :some]
            true = np.sqrt(((self.vectors[mine, None] - vectors[near]) ** 2).sum(-1))
            true[rows[near] == self.ids[mine, None]] = np.inf
            found, distance = np.concatenate([self.found[mine], rows[near]], 1), np.concatenate([self.distance[mine], true], 1)
            first = np.lexsort((found, distance), axis=1)[:, : self.k]
            self.found[mine], self.distance[mine] = np.take_along_axis(found, first, 1), np.take_along_axis(distance, first, 1)
            np.put_along_axis(own, near, True, 1)
            self.look_at_rest(at, rows, vectors, less, square, self.within(mine, sums, length, rest, square) & ~own)

    def within(self, mine: slice, sums: np.ndarray, length: np.ndarray, rest: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Whether a row may be as near as the k-th found so far, by its code; what overflows may be."""
        coded = self.square[mine, None] + length - 2.0 * sums
        slack = 2 * self.slack[mine, None] + 1e-12 * (self.square[mine, None] + square)
        reach = (self.distance[mine, -1] * (1 + 1e-9) + 1e-12 * np.sqrt(self.square[mine] + square.max() + (self.mean**2).sum()))[:, None]
        far = coded - slack > (reach + rest) ** 2
        return ~(far | ((rest > reach) & (coded + slack < (rest - reach) ** 2)))

    def look_at_rest(self, at: int, rows: np.ndarray, vectors: np.ndarray, less: np.ndarray, square: np.ndarray, may: np.ndarray) -> None:
        """Measures the rows that may be nearer: by one product of matrices, and truly where its rounding leaves a doubt."""
        some = np.flatnonzero(may.any(1))
        columns = np.flatnonzero(may.any(0))
        if not len(some):
            return
        may, mine = may[np.ix_(some, columns)], some + at
        both = self.square[mine, None] + square[columns]
        slack = (len(self.mean) + 8) * 2.0**-50 * (both + (self.mean**2).sum())
        squares = both - 2 * self.less[mine] @ less[columns].T
        limit = (self.distance[mine, -1] * (1 + 1e-9)) ** 2
        if len(columns) >= self.k:
            limit = np.fmin(limit, np.partition(np.where(may, squares + slack, np.inf), self.k - 1, axis=1)[:, self.k - 1])
        query, row = np.nonzero(may & ~(squares - slack > limit[:, None]))
        query, row = mine[query], columns[row]
        for start in range(0, len(query), 1 << 16):
            q, r = query[start : start + (1 << 16)], row[start : start + (1 << 16)]
            true = np.sqrt(((self.vectors[q] - vectors[r]) ** 2).sum(-1))
            asked = np.unique(q)
            whose = np.concatenate([np.repeat(asked, self.k), q])
            found = np.concatenate([self.found[asked].ravel(), rows[r]])
            distance = np.concatenate([self.distance[asked].ravel(), true])
            order = np.lexsort((found, distance, whose))
            starts = np.searchsorted(whose[order], asked)
            first = order[starts[:, None] + np.arange(self.k)]
            self.found[asked], self.distance[asked] = found[first], distance[first]

    def frame(self) -> pd.DataFrame:
        there = np.isfinite(self.distance)
        return pd.DataFrame({"query_id": np.repeat(self.ids, there.sum(1)), "vec_id": self.found[there], "score": self.distance[there]})
