"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text becomes a linked list of symbols. A heap holds the adjacent pairs that have a merge rank; the pair of
lowest rank (leftmost first) is popped and merged, its new neighbours are pushed. Each merge takes one symbol away, so
the count is the initial symbols less the merges; no token ids are made. No piece goes across white space, so a text is
counted run by run between blanks; runs repeat, so their counts are remembered up to a bound.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ship, without

#: A vocabulary file is broadcast; none may be larger.
MOST_BYTES = 64_000_000


@dataclass
class Vocabulary:
    """What counting needs of a vocabulary file: merge ranks, known symbols, the pattern of pieces, special strings."""

    ranks: dict[tuple[str, str], int]
    known: set[str]
    pattern: str
    special: list[str]
    suffix: str


def parse_vocabulary(content: str) -> Vocabulary:
    """From the JSON of a byte-level BPE with word ends, lower case, and one splitting pattern; others are refused."""
    spec = json.loads(content)
    model, steps = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or model["ignore_merges"] or model["unk_token"]:
        raise ValueError("not a vocabulary that this operator counts by")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    if level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"] or not split["invert"]:
        raise ValueError("not a vocabulary that this operator counts by")
    ranks: dict[tuple[str, str], int] = {}
    for rank, pair in enumerate(merges):
        ranks[pair] = rank
    return Vocabulary(ranks, set(model["vocab"]), split["pattern"]["Regex"], [t["content"] for t in spec["added_tokens"]], model["end_of_word_suffix"])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on, in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: What str.split takes for white space and the vocabulary's pattern does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


class Counter:
    """Counts tokens of texts; remembers runs and pieces up to a bound."""

    REMEMBERED = 300_000
    LONGEST = 64

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.symbols = byte_symbols()
        self.split = regex.compile(vocabulary.pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.space = regex.compile(r"\s+")
        self.counts: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Initial symbols less merges."""
        ranks, symbols = self.v.ranks, [self.symbols[b] for b in piece.encode("utf-8", "replace")]
        symbols[-1] += self.v.suffix
        n = len(symbols)
        if n == 1:
            return int(symbols[0] in self.v.known)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(ranks[pair], i) for i in range(n - 1) if (pair := (symbols[i], symbols[i + 1])) in ranks]
        heapify(heap)
        left = n
        while heap:
            rank, i = heappop(heap)
            j = after[i] if symbols[i] is not None else -1
            if j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # the pair is gone
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            left -= 1
            if after[j] >= 0:
                before[after[j]] = i
                if (new := ranks.get((symbols[i], symbols[after[i]]))) is not None:
                    heappush(heap, (new, i))
            if before[i] >= 0 and (new := ranks.get((symbols[before[i]], symbols[i]))) is not None:
                heappush(heap, (new, before[i]))
        return left - sum(s is not None and s not in self.v.known for s in symbols)

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(t in text for t in self.v.special):
            return len(self.special.findall(text)) + sum(map(self.part, self.special.split(text)))
        return self.part(text)

    def part(self, text: str) -> int:
        """The count of a text without special strings."""
        if any(c in text for c in SEPARATORS):
            return self.run(self.space.sub(" ", text))
        runs, counts = text.split(), self.counts
        new = set(runs).difference(counts)
        if not new:
            return sum(map(counts.__getitem__, runs))
        if len(counts) + len(new) > self.REMEMBERED:
            counts.clear()
            new = set(runs)
        long = {}
        for run in new:
            (counts if len(run) <= self.LONGEST and len(counts) < self.REMEMBERED else long)[run] = self.run(run)
        return sum(counts[r] if r in counts else long[r] for r in runs) if long else sum(map(counts.__getitem__, runs))

    def run(self, text: str) -> int:
        total, pieces = 0, self.pieces
        for p in self.split.findall(lower(unicodedata.normalize("NFC", text))):
            n = pieces.get(p)
            if n is None:
                n = self.piece(p)
                if len(p) <= self.LONGEST:
                    if len(pieces) >= self.REMEMBERED:
                        pieces.clear()
                    pieces[p] = n
            total += n
        return total


def lower(text: str) -> str:
    """Each character in lower case by itself: a final capital sigma stays an ordinary one."""
    return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))


def read_vocabulary(spark: SparkSession, path: str) -> str:
    """The content of a vocabulary file: by Spark if the path names a file system, else from the driver's disk."""
    if "://" in path:
        content = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path, encoding="utf-8") as file:
            content = file.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError("the vocabulary file is larger than may be broadcast")
    return content


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens (longs) and over_limit (n_tokens > limit); columns of those names are replaced.

    vocabulary: the content of a vocabulary file. A null text counts as empty, with 0 bytes and tokens. Special strings
    inside a text count one token each, as the library's default has it. Whole texts are counted, however long; repeated
    rows repeat; an empty table stays empty.
    """
    if len(vocabulary) > MOST_BYTES:
        raise ValueError("the vocabulary is larger than may be broadcast")
    parse_vocabulary(vocabulary)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        content = shared.value
        counter = kept("counter", content, lambda: Counter(parse_vocabulary(content)))
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    rows = docs.select(*without(docs.columns, "n_bytes", "n_tokens", "over_limit"))
    counted = rows.withColumn("n_tokens", of(F.col(text)))
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
