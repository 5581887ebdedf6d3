"""Vector code compression: a product quantiser of integers, trained by Hamerly's form of Lloyd's rounds.

A vector is cut into parts; each part position has a codebook. A pass over the vectors assigns every part to its nearest
entry, and what it knows is written with the vector: the entry, an upper bound of the distance to it, and a lower bound of
the distance to the second nearest. When entries move, the bounds move with them. Only where the upper bound is not
strictly below the lower one (or below half the way to the nearest other entry) is the upper bound made exact, and only
where it still is not are all entries measured, in integers, ties to the lower index. Bounds are rounded outwards, so a
part that is passed over has one nearest entry, and no tie is lost. Sums of parts are made in the tasks and added up by
Spark; the driver sees codebooks alone, whose size the parameters bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, remove, ship, without, written

#: Integers up to this size are coded: so squared distances of up to 4,096 components are whole longs.
LARGEST = 1 << 24
#: By so much, relatively, a bound is moved outwards at each step.
SLACK = 1e-12
#: Rows that are measured at once.
BLOCK = 4096


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs; saturated where a long ends."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def squared(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, width) integers to (k, width) entries; by floating point where that is exact."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    if 4 * parts.shape[1] * most * most < 1 << 53:
        x, c = parts.astype(float), book.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((parts - entry) ** 2).sum(1) for entry in book], 1)


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


class Book:
    """A part position's codebook and, for the bounds, how far its entries have moved since the last."""

    def __init__(self, entries: np.ndarray, last: np.ndarray | None) -> None:
        self.entries = entries
        k = len(entries)
        moved = up(np.sqrt(((entries - (entries if last is None else last)) ** 2).sum(1).astype(float)))
        self.moved, self.furthest = moved, int(moved.argmax())
        others = np.delete(moved, self.furthest)
        self.most, self.next_most = moved[self.furthest], others.max(initial=0.0)
        apart = squared(entries, entries)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.half = down(np.sqrt(apart.min(1).astype(float)) / 2) if k > 1 else np.full(k, np.inf)

    def scan(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entries, their exact squared distances, and lower bounds of the second nearest's distance."""
        n = len(parts)
        code, near, second = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf)
        for at in range(0, n, BLOCK):
            d = squared(parts[at : at + BLOCK], self.entries)
            rows, best = np.arange(len(d)), d.argmin(1)
            code[at : at + BLOCK], near[at : at + BLOCK] = best, d[rows, best]
            if d.shape[1] > 1:
                d[rows, best] = np.iinfo(np.int64).max
                second[at : at + BLOCK] = down(np.sqrt(d.min(1).astype(float)))
        return code, near, second

    def distance(self, parts: np.ndarray, code: np.ndarray) -> np.ndarray:
        return ((parts - self.entries[code]) ** 2).sum(1)

    def assign(self, parts: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Brings entries and bounds up to date, in place."""
        upper[:] = up(upper + self.moved[code])
        lower[:] = down(np.maximum(lower - np.where(code == self.furthest, self.next_most, self.most), 0.0))
        bound = np.maximum(lower, self.half[code])
        open_ = np.flatnonzero(upper >= bound)
        upper[open_] = up(np.sqrt(self.distance(parts[open_], code[open_]).astype(float)))
        open_ = open_[upper[open_] >= bound[open_]]
        code[open_], near, lower[open_] = self.scan(parts[open_])
        upper[open_] = up(np.sqrt(near.astype(float)))


def lists(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    """An array column of n components a row as a matrix of its own."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n).copy()


def assigned(rows: DataFrame, books: np.ndarray, last: np.ndarray | None, names: dict[str, str]) -> DataFrame:
    """The rows with code, upper and lower: measured anew if ``last`` is None, else brought up to date."""
    shared = rows.sparkSession.sparkContext.broadcast((books, last))
    parts, _, width = books.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = shared.value
        made = [Book(new[p], None if old is None else old[p]) for p in range(parts)]
        for batch in batches:
            x = lists(batch, names["ints"], parts * width)
            state = {}
            if old is not None:
                state = {k: lists(batch, names[k], parts) for k in ("code", "upper", "lower")}
            else:
                state = {"code": np.zeros((len(x), parts), np.int64), "upper": np.zeros((len(x), parts)), "lower": np.zeros((len(x), parts))}
            for p, book in enumerate(made):
                part = x[:, p * width : (p + 1) * width]
                if old is None:
                    state["code"][:, p], near, state["lower"][:, p] = book.scan(part)
                    state["upper"][:, p] = up(np.sqrt(near.astype(float)))
                else:
                    columns = [np.ascontiguousarray(state[k][:, p]) for k in ("code", "upper", "lower")]
                    book.assign(part, *columns)
                    for k, column in zip(("code", "upper", "lower"), columns, strict=True):
                        state[k][:, p] = column
            offsets = pa.array(np.arange(0, len(x) * parts + 1, parts, dtype=np.int32))
            for k, values in state.items():
                batch = with_column(batch, names[k], pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1))))
            yield batch

    kept = without(rows.columns, *(names[k].lower() for k in ("code", "upper", "lower")))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*[f"`{c}`" for c in kept]).dtypes), f"`{names['code']}` array<bigint>", f"`{names['upper']}` array<double>", f"`{names['lower']}` array<double>"])
    return rows.mapInArrow(of, schema)


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    if (at := batch.schema.get_field_index(name)) >= 0:
        return batch.set_column(at, name, column)
    return batch.append_column(name, column)


def refined(rows: DataFrame, books: np.ndarray, names: dict[str, str]) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; an entry without parts stays."""
    parts, entries, width = books.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)  # the last place counts
        for batch in batches:
            x, code = lists(batch, names["ints"], parts * width), lists(batch, names["code"], parts)
            for at in range(0, len(x), BLOCK):
                for p in range(parts):
                    to = code[at : at + BLOCK, p]
                    for w in range(width):
                        sums[p, :, w] += np.bincount(to, x[at : at + BLOCK, p * width + w], entries).astype(np.int64)
                    sums[p, :, width] += np.bincount(to, minlength=entries)
        used = np.argwhere(sums[:, :, width] > 0)
        totals = [sums[p, e] for p, e in used]
        columns = [np.repeat(used[:, 0], width + 1), np.repeat(used[:, 1], width + 1), np.tile(np.arange(width + 1), len(used)), np.concatenate(totals) if totals else np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total"])

    summed = rows.select(names["ints"], names["code"]).mapInArrow(of, "part long, entry long, place long, total long")
    sums = np.zeros((parts, entries, width + 1), np.int64)
    for r in summed.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toLocalIterator():
        sums[r.part, r.entry, r.place] = r.total
    count = sums[:, :, width :]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books)


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components, by part, entry and place within the part, joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, after_round: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, np.ndarray | None]:
    """``vectors`` without ``vector``, with ``code`` (an index a part) and ``error`` (long), and the (part, entry, place) codebooks.

    Rows whose vector is null or has null or infinite components or none-numbers are dropped. A component x becomes
    floor(scale * x). Codebooks start as the parts of the vectors of the least ``entries`` keys (null last, then by the
    vector); fewer vectors make fewer entries. The first vector's length is that of the codes: a length that ``parts`` does
    not divide is filled up with zeros at the end. Vectors of other lengths, or with an integer over 2**24 either way, have
    null code and error and teach nothing. Equal rows have equal codes; columns named code and error are replaced; an
    empty table stays empty and has no codebooks. after_round, if given, is called with each round's table of rows and bounds.
    """
    ship(vectors.sparkSession)
    kept = without(vectors.columns, vector.lower(), "code", "error")
    names = {k: free_name([*kept, "code", "error"], k + "_") for k in ("ints", "code", "upper", "lower")}
    ints = F.col(names["ints"])
    rows = vectors.filter(whole(F.col(vector))).select(*[F.col(f"`{c}`") for c in kept], integers(F.col(vector), scale).alias(names["ints"]))
    fits = ~F.exists(ints, lambda x: F.abs(x) > LARGEST)
    first = rows.filter(fits).select(key, ints).orderBy(F.col(key).asc_nulls_last(), ints).limit(1).collect()
    if not first:
        nothing = F.lit(None).cast("array<bigint>").alias("code"), F.lit(None).cast("bigint").alias("error")
        return rows.select(*[f"`{c}`" for c in kept], *nothing), None
    length = len(first[0][1])
    fits &= F.size(ints) == length
    fill = -length % parts if length else parts
    coded = rows.filter(fits).withColumn(names["ints"], F.concat(ints, F.array_repeat(F.lit(0).cast("long"), fill)))
    aside = rows.filter(~fits)
    start = coded.select(key, ints).orderBy(F.col(key).asc_nulls_last(), ints).limit(entries).collect()
    books = np.array([r[1] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    last, state = None, coded
    for _ in range(rounds):
        before, state = state, written(assigned(state, books, last, names))
        remove(before)
        if after_round:
            after_round(state)
        last, books = books, refined(state, books, names)
    final = assigned(state, books, last, names)
    shared = final.sparkSession.sparkContext.broadcast(books)
    width = books.shape[2]

    @F.pandas_udf("long")
    def error(x, code):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="int64")
        x, code = np.stack(x.to_list()).reshape(len(x), parts, width), np.stack(code.to_list())
        return pd.Series(sum(((x[:, p] - shared.value[p][code[:, p]]) ** 2).sum(1) for p in range(parts)))

    out = written(final.select(*[f"`{c}`" for c in kept], F.col(names["code"]).alias("code"), error(ints, F.col(names["code"])).alias("error")))
    remove(state)
    return out.unionByName(aside.select(*[f"`{c}`" for c in kept]), allowMissingColumns=True), books


def hex_code(code: Column) -> Column:
    """The indexes in part order, two hex digits each."""
    return F.array_join(F.transform(code, lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
