"""Page content as rows of operators: the matrix in effect at each drawing, nested forms, the footprint of each image.

The current matrix is a product over the operators before, which does not commute and which ``q`` and ``Q`` bracket. It is
associative, though, once a stretch of operators is summed up by what it does to the stack: how it ends the scopes that it
finds open, the scopes it leaves open, and its own matrix. So the operators of a content are cut into ranges, each range is
summed up in a task, the sums of a content, one a range, are folded in turn, and drawings are taken on from the stack that
the ranges before theirs leave. A content of any length is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.storage import checkpointed, ship, written

#: (a, b, c, d) of a matrix; where it moves things to does not matter for sizes.
Matrix = tuple[float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0)
#: Forms within forms, the page's own content counted. Fixed value.
MOST_LEVELS = 12
#: Operators as numbers; what a number stands for.
DO, SAVE, RESTORE, CHANGE = range(4)
OPS = ("Do", "q", "Q", "cm")
#: Rounds of products of many contents at once; what is nested deeper goes one by one. Fixed value.
MOST_ROUNDS = 64


def times(m: Matrix, n: Matrix) -> Matrix:
    """m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3])


class Stretch:
    """What a stretch of operators does to an unknown stack.

    ended: the matrices that had gathered in each open scope when it was ended; saved and current: the scopes left open and
    the matrix at the end, both relative to the scope reached. A stack that has no scope left to end keeps its matrix.
    """

    def __init__(self) -> None:
        self.ended: list[Matrix] = []
        self.saved: list[Matrix] = []
        self.current = UNIT

    def step(self, op: str, m: Matrix) -> None:
        if op == "q":
            self.saved.append(self.current)
        elif op == "cm":
            self.current = times(m, self.current)
        elif op == "Q" and self.saved:
            self.current = self.saved.pop()
        elif op == "Q":
            self.ended.append(self.current)
            self.current = UNIT

    def after(self, stack: list[Matrix], current: Matrix) -> tuple[list[Matrix], Matrix]:
        """The stack and matrix that it leaves of the given ones."""
        kept = max(0, len(stack) - len(self.ended))
        for i, m in enumerate(self.ended):
            current = stack[-1 - i] if i < len(stack) else times(m, current)
        return stack[:kept] + [times(m, current) for m in self.saved], times(self.current, current)

    def flat(self) -> tuple[list[float], ...]:
        return tuple([x for m in part for x in m] for part in (self.ended, self.saved, [self.current]))


def matrices(values: list[float]) -> list[Matrix]:
    return [tuple(values[i : i + 4]) for i in range(0, len(values), 4)]


def drawings(operators: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, name, a, b, c, d): each ``Do`` with the content's own matrix in effect there.

    operators: (keys, ord, op, numbers, name), a content per keys, in the order of ord. ``cm`` takes the last six numbers
    and is passed over with fewer or with a null among them; ``Q`` without an open ``q`` does nothing; other operators and a
    ``Do`` without a name do nothing. The operators are dealt and sorted once and gone through once; what is written are
    the drawings and the sums of the ranges' ends.
    """
    ship(operators.sparkSession)
    n = F.size("numbers")
    last = F.slice("numbers", n - 5, 4)
    fine = F.col("op").isin("q", "Q") | ((F.col("op") == "Do") & F.col("name").isNotNull()) | ((F.col("op") == "cm") & (n >= 6) & ~F.exists(last, lambda x: x.isNull()))
    code = F.when(F.col("op") == "Do", DO).when(F.col("op") == "q", SAVE).when(F.col("op") == "Q", RESTORE).otherwise(CHANGE).cast("tinyint").alias("op")
    m = [F.when(F.col("op") == "cm", F.get("numbers", n - 6 + i).cast("double")).alias(x) for i, x in enumerate("abcd")]
    rows = operators.filter(fine).select(*keys, "ord", code, *m, F.when(F.col("op") == "Do", F.col("name")).alias("name"))
    at = [F.xxhash64(*keys), *keys, "ord"]  # a hash ahead of the names: most comparisons end at it
    placed = rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("part", F.spark_partition_id())
    by = [*keys, "part"]
    sums = "ended array<double>, saved array<double>, current array<double>"
    named = typed(placed, [*by, "ord", "name"]) + ", a double, b double, c double, d double, scope int, "
    told = written(placed.mapInArrow(walked(keys), named + sums))
    ends = told.filter("name is null").select(*by, "ended", "saved", "current")
    starts = written(ends.groupBy(*keys).applyInPandas(folded(by), typed(placed, by) + ", starts array<double>"))
    found = told.filter("name is not null").join(starts.withColumnsRenamed({c: f"of_{c}" for c in by}), equal(by), "left")
    start = {f"s{x}": F.get("starts", F.col("scope") * 4 + i) for i, x in enumerate("abcd")}
    known = F.col("scope").isNull()
    found = found.withColumns(start)
    return found.select(*keys, "ord", "name", *[F.when(known, F.col(x)).otherwise(y).alias(x) for x, y in product("", "s").items()])


def equal(names: list[str]) -> Column:
    same = F.lit(True)
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return same


def typed(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in rows.select(*names).dtypes)


def folded(by: list[str]):
    """The matrices that the scopes of each range begin with: the one reached, then one for each scope that it ends."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        stack, current, ahead = [], UNIT, []
        for flat in zip(rows["ended"], rows["saved"], rows["current"], strict=True):
            stretch = Stretch()
            stretch.ended, stretch.saved, (stretch.current,) = map(matrices, flat)
            begun = [current]
            for i, m in enumerate(stretch.ended):
                begun.append(stack[-1 - i] if i < len(stack) else times(m, begun[-1]))
            ahead.append([x for m in begun for x in m])
            stack, current = stretch.after(stack, current)
        return rows[by].assign(starts=ahead)

    return of


def begins(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row has another key than the row before; the first row does."""
    other = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        x, y = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
        other |= ~same.to_numpy(zero_copy_only=False)
    return np.concatenate(([True], other))


def in_effect(op: np.ndarray, m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The matrix after each row of whole contents, the first rows of which are marked; as ``Stretch`` has it, all at once.

    A row points to the row whose matrix it keeps: ``cm`` to itself, ``Q`` to the ``q`` that it ends, others to the row
    ahead. Pointers are doubled, then each ``cm`` is multiplied with the one it points to ahead, those nearest to the
    start first.
    """
    n = len(op)
    rows, content = np.arange(n), np.cumsum(first) - 1
    step = (op == SAVE).astype(np.int64) - (op == RESTORE)
    height = np.cumsum(step)
    start = rows[first]
    height -= (height[start] - step[start])[content]
    apart = content * (2 * n + 2)  # so that a minimum up to a row is that of its content
    low = np.minimum(np.minimum.accumulate(height - apart) + apart, 0)
    level = height - low
    ahead = np.where(first, n, rows - 1)
    idle = np.append(low, 0)[ahead] > low
    points = np.append(np.where(op == CHANGE, rows, ahead), n)
    pairs = rows[(op == SAVE) | ((op == RESTORE) & ~idle)]
    pairs = pairs[np.argsort(content[pairs] * (n + 1) + level[pairs] + (op[pairs] == RESTORE), kind="stable")]
    ends = np.nonzero(op[pairs] == RESTORE)[0]
    points[pairs[ends]] = pairs[ends - 1]
    while not np.array_equal(further := points[points], points):
        points = further
    out = np.vstack((np.where((op == CHANGE)[:, None], m, 0.0), UNIT))
    todo, done, rounds = rows[op == CHANGE], np.zeros(n + 1, dtype=bool), 0
    before = points[np.append(ahead, n)]
    done[n] = True
    while len(todo) and rounds < MOST_ROUNDS:
        ready = done[before[todo]]
        now = todo[ready]
        out[now] = np.column_stack(times(tuple(m[now].T), tuple(out[before[now]].T)))
        done[now] = True
        todo, rounds = todo[~ready], rounds + 1
    for i in todo:
        out[i] = times(tuple(m[i]), tuple(out[before[i]]))
    return out[points[:n]]


def stepped(stretch: Stretch, whole: bool, op: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix after each row, since the scope of that number; -1: since the start of a content that is known from there."""
    effect, scope = np.zeros((len(op), 4)), np.full(len(op), -1)
    for i, (o, x) in enumerate(zip(op.tolist(), m.tolist(), strict=True)):
        if o != RESTORE or stretch.saved or not whole:
            stretch.step(OPS[o], tuple(x))
        effect[i] = stretch.current
        if not whole:
            scope[i] = len(stretch.ended)
    return effect, scope


def walked(keys: list[str]):
    """The drawings of a range of sorted operators, and what its first and last content do: only these can go on in others.

    The first content may have begun in a range before: its matrices are those since the scope that is told, counted in
    scopes ended. Contents that lie within a batch are done at once, those at its ends step by step.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, last, whole = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            own = [table[c].chunk(0) for c in keys]
            first = begins(own)
            if last is not None:
                own, table = [c.slice(1) for c in own], table.slice(1)
                first = first[1:]
            op = table["op"].to_numpy()
            m = np.column_stack([table[x].to_numpy() for x in "abcd"])
            size = len(op)
            at = np.nonzero(first)[0]
            head, tail = (at[0], at[-1]) if len(at) else (size, size)
            effect, scope = np.zeros((size, 4)), np.full(size, -1)
            if last is None:
                stretch, after = Stretch(), at[1] if len(at) > 1 else size
                effect[:after], scope[:after] = stepped(stretch, whole, op[:after], m[:after])
                ended = sums(table, 0, keys, stretch) if after < size else None
                head = after
            else:
                effect[:head], scope[:head] = stepped(stretch, whole, op[:head], m[:head])
                ended = sums(last, 0, keys, stretch) if head < size and not whole else None
            if head < size:
                if head < tail:
                    effect[head:tail] = in_effect(op[head:tail], m[head:tail], first[head:tail])
                stretch, whole = Stretch(), True
                effect[tail:], scope[tail:] = stepped(stretch, whole, op[tail:], m[tail:])
            drawn = np.nonzero(op == DO)[0]
            of_scope = pa.array(scope[drawn], pa.int32(), mask=scope[drawn] < 0)
            taken = table.select([*keys, "part", "ord", "name"]).take(pa.array(drawn))
            none = pa.nulls(len(drawn), pa.list_(pa.float64()))
            yield from pa.Table.from_arrays([*taken.columns, *effect[drawn].T.copy(), of_scope, none, none, none], [*taken.column_names, *"abcd", "scope", "ended", "saved", "current"]).to_batches()
            if ended is not None:
                yield ended
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield sums(pa.Table.from_batches([last]), 0, keys, stretch)

    return of


def sums(rows: pa.Table | pa.RecordBatch, at: int, keys: list[str], stretch: Stretch) -> pa.RecordBatch:
    """One row: what a content's operators in a range do."""
    row = [rows[c].slice(at, 1) for c in [*keys, "part", "ord"]]
    row = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in row]
    flat = [pa.array([x], pa.list_(pa.float64())) for x in stretch.flat()]
    none = [pa.nulls(1, rows["name"].type), *[pa.nulls(1, pa.float64())] * 4, pa.nulls(1, pa.int32())]
    return pa.RecordBatch.from_arrays([*row, *none, *flat], [*keys, "part", "ord", "name", *"abcd", "scope", "ended", "saved", "current"])


def product(first: str, second: str) -> dict:
    """The matrix of columns ``first``a to d, then that of ``second``a to d, as columns a to d."""
    m, n = ([F.col(f"{p}{x}") for x in "abcd"] for p in (first, second))
    return {"a": m[0] * n[0] + m[1] * n[2], "b": m[0] * n[1] + m[1] * n[3], "c": m[2] * n[0] + m[3] * n[2], "d": m[2] * n[1] + m[3] * n[3]}


def placements(operators: DataFrame, resources: DataFrame, objects: DataFrame, pages: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(doc, image, w, h): the largest drawn width and height, taken apart, of each image that a page draws.

    operators: (doc, content, ord, op, numbers, name); resources: (doc, content, name, target), the names that a content
    may draw; objects: (doc, id, kind, matrix, mask): kind is Image or Form, others are not drawn, a form's content has its
    id; a form's matrix is passed over unless its first four numbers are there; an image's soft mask gets its size too;
    pages: (doc, content). Names that stand for nothing draw nothing. A form inside itself is not drawn again, and
    ``most_levels`` contents deep nothing is. Each content's own drawings are found once; a round goes one form deeper and
    reads the drawings of forms only, and equal ways of getting there are one row. Images are met once, after the rounds.
    """
    own = drawings(operators, ["doc", "content"])
    linear = [F.get("matrix", i).cast("double") for i in range(4)]
    there = (F.size("matrix") >= 4) & ~F.exists(F.slice("matrix", 1, 4), lambda x: x.isNull())
    form = [F.when(F.coalesce(there, F.lit(False)), x).otherwise(F.lit(u)).alias(f"f{n}") for x, u, n in zip(linear, UNIT, "abcd", strict=True)]
    what = objects.select("doc", F.col("id").alias("target"), "kind", "mask", *form).filter(F.col("kind").isin("Image", "Form"))
    renamed = {x: f"o{x}" for x in "abcd"}
    targets = checkpointed(own.join(resources, ["doc", "content", "name"]).withColumnsRenamed(renamed).select("doc", "content", "target", *renamed.values()))
    within = checkpointed(targets.join(what.filter("kind = 'Form'").drop("kind", "mask"), ["doc", "target"]).distinct())
    inside = F.array().cast(f"array<{objects.schema['id'].dataType.simpleString()}>")
    level = pages.select("doc", "content", *[F.lit(u).alias(f"b{x}") for x, u in zip("abcd", UNIT, strict=True)], inside.alias("inside")).distinct()
    levels = [checkpointed(level)]
    for _ in range(1, most_levels):
        met = levels[-1].join(within, ["doc", "content"]).filter(~F.array_contains("inside", F.col("target"))).withColumns(product("o", "b"))
        deeper = {f"b{x}": m for x, m in product("f", "").items()}
        met = met.select("doc", F.col("target").alias("content"), *[m.alias(n) for n, m in deeper.items()], F.array_sort(F.array_append("inside", F.col("target"))).alias("inside"))
        level = checkpointed(met.distinct())
        if level.isEmpty():
            break
        levels.append(level)
    reached = reduce(DataFrame.unionByName, levels)
    drawn = reached.join(targets, ["doc", "content"]).filter(~F.array_contains("inside", F.col("target"))).withColumns(product("o", "b"))
    drawn = drawn.groupBy("doc", "target").agg(F.max(norm("a", "b")).alias("w"), F.max(norm("c", "d")).alias("h"))
    images = drawn.join(what.filter("kind = 'Image'").select("doc", "target", "mask"), ["doc", "target"])
    both = F.explode(F.when(F.col("mask").isNull(), F.array("target")).otherwise(F.array("target", "mask"))).alias("image")
    return images.select("doc", both, "w", "h").groupBy("doc", "image").agg(F.max("w").alias("w"), F.max("h").alias("h"))


def norm(x: str, y: str):
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
