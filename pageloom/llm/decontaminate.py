"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A mask names the token positions of a short window that count; the others may differ. Hashes of the masked windows of
documents and benchmark items are joined; each hit is verified on the tokens around it. An overlap is a window of
WIDTH aligned tokens (the whole item, if that is shorter) of which at least SIMILARITY are equal. The masks are chosen
so that every such window holds a hit: wherever 2 of 13 tokens are replaced, some place of the mask misses both. A
shorter item is laid over the text as a whole, under masks of which one misses the tokens that may differ; so a common
pair of words alone makes no hit. Nothing is lost to the hashing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

WIDTH, SIMILARITY = 13, 0.8
#: Positions that count in items of WIDTH tokens or more, at any place of the item.
MASKS = ((0, 1, 3, 6, 7),)
#: Distinct seeds of benchmark items that are broadcast at a time, at most; a larger benchmark goes in more blocks.
MOST_SEEDS = 50_000
#: Tokens by which a short item may hang over an end of a text: no more than may differ.
OVER = 2
BEFORE, AROUND = WIDTH - 1, 2 * WIDTH + 6


def needed(width: int) -> int:
    """How many of so many tokens must be equal."""
    return math.ceil(round(width * SIMILARITY, 9))


def masks(width: int) -> tuple[tuple[int, ...], ...]:
    """Masks of items of so many tokens (WIDTH: or more). A short item's lie at its start: where so few tokens differ
    as may, those of one class of places modulo the masks' number (of the two other classes, if one is small) are equal."""
    lost = width - needed(width)
    if width >= WIDTH:
        return MASKS
    if not lost or width // (lost + 1) >= 3:
        return tuple(tuple(range(c, width, lost + 1)) for c in range(lost + 1))
    return tuple(tuple(i for i in range(width) if i % 3 != c) for c in range(3))


def tokens(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def seeds(column: str, mask: tuple[int, ...], number: int, over: int = 0) -> Column:
    """(at, seed): the masked hash at each position of an array of tokens that leaves room for the mask, or hangs ``over``."""
    last = F.size(column) - 1 - mask[-1] + over
    seed = lambda i: F.xxhash64(F.lit(number), *[F.get(F.col(column), i + o) for o in mask])
    placed = F.transform(F.sequence(F.lit(-over), last), lambda i: F.struct(i.alias("at"), seed(i).alias("seed")))
    return F.when(last < -over, F.array().cast("array<struct<at:int,seed:bigint>>")).otherwise(placed)


def around(column: str, at: Column, pad: Column) -> Column:
    """AROUND tokens from BEFORE ahead of a position; ``pad`` where the text has none."""
    lead, start = F.greatest(BEFORE - at, F.lit(0)), F.greatest(at - BEFORE, F.lit(0))
    there = F.greatest(F.least(F.size(column) - start, AROUND - lead), F.lit(0))
    return F.concat(F.array_repeat(pad, lead), F.slice(column, start + 1, there), F.array_repeat(pad, AROUND - lead - there))


def bit_places(seed: Column, words: int) -> list[tuple[Column, Column]]:
    """(word, bit) of a seed's two bits in a filter of 64-bit words."""
    return [(F.shiftrightunsigned(seed, s).bitwiseAND(words - 1).cast("int"), F.shiftrightunsigned(seed, s + 26).bitwiseAND(63).cast("int")) for s in (0, 32)]


def seed_filter(found: DataFrame, n: int) -> tuple[Column, int]:
    """A literal array of longs with two bits set for every seed, and its length, which MOST_SEEDS bounds."""
    words = 1 << max(4, math.ceil(math.log2(max(1, n))))
    bits = F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in bit_places(F.col("seed"), words)])
    rows = found.select(F.inline(bits)).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).collect()
    at = {r.word: r.bits for r in rows}
    return F.split(F.lit(",".join(str(at.get(i, 0)) for i in range(words))), ",").cast("array<bigint>"), words


def benchmark_seeds(items: DataFrame, families: list[tuple[int, int, tuple[int, ...]]]) -> DataFrame:
    """(code, seed, item_size, item_around) of (code, tokens) rows of distinct texts, each seed in its surroundings once."""
    found = None
    for width, number, mask in families:
        long = width == WIDTH
        size = F.size("tokens")
        part = items.filter(size >= WIDTH if long else size == width).select("code", "tokens", F.inline(seeds("tokens", mask, number)))
        part = part if long else part.filter("at = 0")
        found = part if found is None else found.unionByName(part)
    placed = found.select("code", "seed", F.size("tokens").alias("item_size"), around("tokens", F.col("at"), F.lit(None).cast("bigint")).alias("item_around"))
    return placed.distinct()


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, best, width, first_word, last_word): one row for each document and item that overlap.

    best is the most equal tokens in a window of width tokens; first_word and last_word bound all overlapping windows in
    the document, counted in words from 0; a window may hang over an end of the text by tokens that differ. Null or
    wordless texts and items overlap nothing. Repeated keys count as one document, repeated items as one; items of equal
    tokens are searched once and named at the end. The distinct seeds are dealt into blocks of MOST_SEEDS at most,
    however long or alike the items; every block meets all documents. An empty table on either side gives no rows. Extra
    columns are not read.
    """
    all_items = benchmark.select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("tokens")).filter("size(tokens) > 0")
    code = F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").cast("binary"))
    all_items = written(all_items.select("item", code.alias("code"), "tokens"))
    items = written(all_items.groupBy("code").agg(F.any_value("tokens").alias("tokens")))
    widths = sorted(r.width for r in items.select(F.least(F.size("tokens"), F.lit(WIDTH)).alias("width")).distinct().collect())
    families = [(width, 10 * width + i, mask) for width in widths for i, mask in enumerate(masks(width))]
    read = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("tokens"))
    if not families:
        return read.filter("false").select(F.col("key").alias(key), F.lit(None).cast(all_items.schema["item"].dataType).alias(item), *[F.lit(0).alias(c) for c in ("best", "width", "first_word", "last_word")])
    placed = written(benchmark_seeds(items, families))
    blocks = max(1, -(-placed.count() // MOST_SEEDS))
    while True:  # dealt by hash, so a block may be over the mark at first
        block = F.pmod(F.xxhash64("code", "seed", "item_around"), F.lit(blocks))
        if placed.groupBy(block.alias("block")).count().agg(F.max("count")).first()[0] <= MOST_SEEDS:
            break
        blocks += 1 + blocks // 8
    used = []
    for b in range(blocks):
        part = block_overlaps(read, placed if blocks == 1 else written(placed.filter(block == b)), families)
        used.append(part if blocks == 1 else written(part))
    found = used[0]
    for more in used[1:]:
        found = found.unionByName(more)
    out = found.groupBy("key", "code").agg(F.max("best").alias("best"), F.max("width").alias("width"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    named = out.join(all_items.select("code", "item").distinct(), "code")
    same = named.groupBy("key", "item").agg(F.max("best").alias("best"), F.max("width").alias("width"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    return same.withColumnsRenamed({"key": key, "item": item})


def block_overlaps(read: DataFrame, mine: DataFrame, families: list[tuple[int, int, tuple[int, ...]]]) -> DataFrame:
    """Verified overlaps (key, code) with one block of seeds; a filter of them keeps all but hits from being unfolded."""
    bits, words = seed_filter(mine, mine.count())
    hashed = read.select("key", "tokens", *[seeds("tokens", mask, number, 0 if width == WIDTH else OVER).alias(f"seeds_{number}") for width, number, mask in families])

    def there(placed: Column) -> Column:
        tests = [F.getbit(F.get(bits, w), b) == 1 for w, b in bit_places(placed["seed"], words)]
        return tests[0] & tests[1]

    hits = [F.filter(f"seeds_{number}", there) for _, number, _ in families]
    unfolded = hashed.select("key", "tokens", F.inline(F.concat(*hits)))
    near = unfolded.select("key", "at", "seed", around("tokens", F.col("at"), F.lit(0).cast("bigint")).alias("around"))
    met = near.join(F.broadcast(mine), "seed")
    equal = F.zip_with("around", "item_around", lambda a, b: F.when(b.isNotNull(), (a == b).cast("int")))
    width = F.least("item_size", F.lit(WIDTH))
    met = met.select("key", "code", "at", width.alias("width"), equal.alias("equal"))
    starts = F.sequence(F.lit(0), F.lit(AROUND) - F.col("width"))
    windows = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice("equal", i + 1, F.col("width")), F.lit(0), lambda s, x: s + x).alias("same"), i.alias("i")))
    need = F.ceil(F.col("width") * SIMILARITY - 1e-9)
    good = F.filter("windows", lambda w: w["same"] >= need)  # null where the window leaves the item
    met = met.select("key", "code", "at", "width", windows.alias("windows")).select("key", "code", "at", "width", good.alias("good")).filter("size(good) > 0")
    first = F.col("at") - BEFORE + F.array_min(F.transform("good", lambda w: w["i"]))
    last = F.col("at") - BEFORE + F.array_max(F.transform("good", lambda w: w["i"])) + F.col("width") - 1
    best = F.array_max(F.transform("good", lambda w: w["same"]))
    return met.select("key", "code", best.alias("best"), "width", first.alias("first_word"), last.alias("last_word"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less the rows whose text overlaps an item; rows are told apart by key and text, so null keys are judged too."""
    mark = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    name = free_name(docs.columns, "mark")
    marked = docs.withColumn(name, mark)
    bad = written(find_overlaps(marked, benchmark, name, text).select(name).distinct())
    return marked.join(bad, name, "left_anti").select(*docs.columns)
