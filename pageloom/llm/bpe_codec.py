"""BPE encoding and decoding by a pair occurrence index.

The distinct pieces of a batch are laid out as one linked list of symbols. An index maps the merge rank of each adjacent
pair to all its positions; a heap holds the ranks that have any. The lowest rank is taken, its pair is merged at all
positions from left to right, and the neighbours that this makes are added to the lists of their ranks. A merge can only
make pairs of higher rank (this is tested when a vocabulary is read), so each rank is taken once for all pieces, and the
result is that of merging every piece by itself. Pieces repeat; the ids of runs between blanks are remembered up to a bound.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .bpe_count import MOST_BYTES, SEPARATORS, byte_symbols, lower, parse_vocabulary
from .common import kept, ship, without


#: In a linked list of symbols: between pieces, and merged away or unknown.
END, GONE = -1, -2


def without_overlaps(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending places of pairs of equal symbols, those that merging from left to right takes."""
    taken, inside = [], -1
    for i, j in zip(places.tolist(), after[places].tolist(), strict=True):
        if i == inside:
            inside = -1
        else:
            taken.append(i)
            inside = j
    return np.array(taken, np.int64)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches ``at`` of a flat array, one after the other."""
    n = sizes[at]
    return flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def normal(run: str) -> str:
    return run.lower() if run.isascii() else lower(unicodedata.normalize("NFC", run))


class Codec:
    """Ids of texts, by the content of a vocabulary file."""

    #: Runs and pieces that are remembered, and the longest of them; texts are taken in slices of about SLICE characters.
    REMEMBERED = 300_000
    LONGEST = 64
    SLICE = 2_000_000

    def __init__(self, content: str) -> None:
        v, spec = parse_vocabulary(content), json.loads(content)
        ids: dict[str, int] = spec["model"]["vocab"]
        merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in v.ranks], np.int64).reshape(-1, 3)
        made = np.full(max(ids.values()) + 1, -1)
        made[merges[:, 2]] = np.arange(len(merges))
        if len(set(merges[:, 2].tolist())) < len(merges) or (made[merges[:, :2]].max(1) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that only a later merge makes")
        keys = merges[:, 0] << 32 | merges[:, 1]
        self.merges: list[tuple[int, int, int]] = [tuple(m) for m in merges.tolist()]
        self.rank_of_key = np.argsort(keys)
        self.keys = keys[self.rank_of_key]
        symbols = byte_symbols()
        self.inner = np.array([ids.get(s, GONE) for s in symbols])
        self.last = np.array([ids.get(s + v.suffix, GONE) for s in symbols])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split, self.space = regex.compile(v.pattern), regex.compile(r"\s+")
        self.known: dict[str | int, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ranked(self, first: np.ndarray, second: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The places of pairs that have a rank, by rank."""
        keys = first << 32 | second
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = (self.keys[found] == keys) & (first >= 0) & (second >= 0)
        ranks, places = self.rank_of_key[found[known]], places[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for at, end in zip(cuts, cuts[1:], strict=False):
            yield int(ranks[at]), places[at:end]

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has: one index over all of them."""
        coded = [p.encode("utf-8", "replace") for p in pieces]
        sizes = np.array([len(c) for c in coded], np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = np.full(len(data) + len(pieces) + 1, END)  # an END stands before, between and behind the pieces
        at = np.arange(len(data)) + owner + 1
        symbols[at] = self.inner[data]
        symbols[at[ends]] = self.last[data[ends]]
        here = np.flatnonzero(symbols != GONE)
        before, after = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        before[here[1:]], after[here[:-1]] = here[:-1], here[1:]

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(first: np.ndarray, second: np.ndarray, places: np.ndarray) -> None:
            for rank, found in self.ranked(first, second, places):
                if rank not in index:
                    index[rank] = []
                    heappush(active, rank)
                index[rank].append(found)

        note(symbols[here[:-1]], symbols[here[1:]], here[:-1])
        while active:
            rank = heappop(active)
            a, b, new = self.merges[rank]
            lists = index.pop(rank)
            left = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left = left[(symbols[left] == a) & (symbols[after[left]] == b)]  # another merge may have taken one of the two
            if a == b:
                left = without_overlaps(left, after)
            right = after[left]
            behind = after[right]
            symbols[left], symbols[right] = new, GONE
            after[left], before[behind] = behind, left
            ahead, merged = before[left], np.full(len(left), new)
            note(symbols[ahead], merged, ahead)
            note(merged, symbols[behind], left)
        left = symbols[at] >= 0
        return symbols[at][left].astype(np.int32), np.bincount(owner[left], minlength=len(pieces))

    def learned(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs one after the other, and how many each has."""
        cut = [[run.lower()] if run.isascii() and run.isalpha() else self.split.findall(normal(run)) for run in runs]
        number: dict[str, int] = {}
        parts = np.array([number.setdefault(p, len(number)) for pieces in cut for p in pieces], np.int64)
        ids, sizes = self.merged(list(number))
        of_run = np.repeat(np.arange(len(runs)), [len(pieces) for pieces in cut])
        return gathered(ids, np.cumsum(sizes) - sizes, sizes, parts), np.bincount(of_run, sizes[parts], len(runs)).astype(np.int64)

    def remember(self, used: set[str | int]) -> None:
        """Makes room if need be, and finds the ids of runs that are not known; a special string's id stands for itself."""
        new = [r for r in used if r not in self.known]
        if len(self.starts) + len(new) > self.REMEMBERED:
            kept = [r for r in used if r in self.known]
            at = np.array([self.known[r] for r in kept], np.int64)
            self.flat, self.sizes = gathered(self.flat, self.starts, self.sizes, at), self.sizes[at]
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.known = {r: i for i, r in enumerate(kept)}
        special, runs = [r for r in new if isinstance(r, int)], [r for r in new if not isinstance(r, int)]
        ids, sizes = self.learned(runs)
        sizes = np.concatenate([np.ones(len(special), np.int64), sizes])
        self.known |= {r: len(self.starts) + i for i, r in enumerate([*special, *runs])}
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, np.array(special, np.int32), ids]), np.concatenate([self.sizes, sizes])

    def parts(self, text: str) -> Iterator[int | str]:
        """A text in order: the ids of its special strings, and what stands between, cut at blanks if it is long."""
        cut = self.special_split.split(text) if self.special_split and any(t in text for t in self.special) else [text]
        for part in cut:
            if part in self.special:
                yield self.special[part]
                continue
            at = 0
            while at < len(part):
                end = part.find(" ", at + self.SLICE)
                end = len(part) if end < 0 else end
                yield part[at:end]
                at = end

    def words(self, part: str) -> list[str]:
        """The runs between blanks; str.split would take SEPARATORS for blanks too."""
        return self.space.split(part) if any(c in part for c in SEPARATORS) else part.split()

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text, in order; a null text has none."""
        out: list[list[np.ndarray]] = []
        held: list[tuple[int, list[str | int]]] = []
        room = self.SLICE

        def put() -> None:
            used = set(chain.from_iterable(runs for _, runs in held))
            self.remember(used)
            at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(runs for _, runs in held)), np.int64)
            ends = np.cumsum([len(runs) for _, runs in held])
            upto = np.concatenate([[0], np.cumsum(self.sizes[at])])[np.concatenate([[0], ends]).astype(np.int64)]
            ids = gathered(self.flat, self.starts, self.sizes, at)
            for i, (text, _) in enumerate(held):
                out[text].append(ids[upto[i] : upto[i + 1]])
            for run in used:
                if isinstance(run, str) and len(run) > self.LONGEST:
                    del self.known[run]  # its place is free when room is made

        for text in texts:
            out.append([])
            for part in self.parts(text or ""):
                held.append((len(out) - 1, [part] if isinstance(part, int) else self.words(part)))
                room -= 1 if isinstance(part, int) else len(part)
                if room <= 0:
                    put()
                    held, room = [], self.SLICE
        if held:
            put()
        return [np.concatenate(of) if of else np.zeros(0, np.int32) for of in out]


class Tokens:
    """Texts of ids: the tokens joined by blanks, as the library has it for a vocabulary without a decoder."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        tokens: dict[int, str] = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        self.known = np.array([i in tokens for i in range(len(self.tokens))])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids; null for null. Null and unknown ids are passed over."""
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        fine = (flat >= 0) & (flat < len(self.known))
        fine[fine] = self.known[flat[fine]]
        upto = np.concatenate([[0], np.cumsum(fine)])[np.concatenate([[0], np.cumsum(sizes)])]
        tokens = pc.take(self.tokens, pa.array(flat[fine]))
        texts = pc.binary_join(pa.ListArray.from_arrays(upto.astype(np.int32), tokens), " ")
        return pc.if_else(pc.is_valid(ids), texts, pa.scalar(None, pa.string()))


def shared(spark: SparkSession, vocabulary: str) -> Broadcast[str]:
    if len(vocabulary) > MOST_BYTES:
        raise ValueError("the vocabulary is larger than may be broadcast")
    Codec(vocabulary)
    ship(spark)
    return spark.sparkContext.broadcast(vocabulary)


def cuts(sizes: pa.Array, room: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``room`` in all, so that a task holds little of a batch in Python's own form."""
    at, held = 0, 0
    for i, size in enumerate(sizes.to_pylist()):
        held += (size or 0) + 1
        if held >= room:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as ``ids``, an array of ints; a column of that name is replaced.

    vocabulary: the content of a vocabulary file. Ids are the library's, without special tokens at the ends; special
    strings inside a text are one id each. A null or empty text has no ids. Whole texts are encoded, however long;
    repeated rows repeat; an empty table stays empty.
    """
    content = shared(docs.sparkSession, vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept("codec", content.value, lambda: Codec(content.value))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for at, end in cuts(pc.binary_length(texts), codec.SLICE):
                found = codec.encode(texts.slice(at, end - at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield batch.slice(at, end - at).append_column(ids, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found))))

    rows = docs.select(*without(docs.columns, ids))
    return rows.mapInArrow(of, StructType([*rows.schema, StructField(ids, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids`` stand for as ``text``, as the library decodes them, special tokens too.

    A column of that name is replaced. Null ids give null, none give the empty text; null and unknown ids among others are
    passed over. Repeated rows repeat; an empty table stays empty.
    """
    content = shared(docs.sparkSession, vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept("tokens", content.value, lambda: Tokens(content.value))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for at, end in cuts(pc.list_value_length(lists), Codec.SLICE // 8):
                yield batch.slice(at, end - at).append_column(text, tokens.decode(lists.slice(at, end - at)))

    rows = docs.select(*without(docs.columns, text))
    return rows.mapInArrow(of, StructType([*rows.schema, StructField(text, StringType())]))
