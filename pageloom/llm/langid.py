"""Language by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (1 to 5 letters, with a blank at word ends), by rank. A
text gets the same list; its distance to a language is the sum, over the text's n-grams, of how far each is out of
place in the language's list, absent ones counting as the worst. The nearest language is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, hex_key, ship, without, written

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4, 5)
#: Profiles that go to the tasks at a time; more languages are compared in several blocks.
MOST_LANGUAGES = 1000
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """The text in lower case, every run of other characters a blank; empty if there is no letter."""
    if not text or not LETTER.search(text):
        return ""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


def gram_hashes(spaced: str) -> np.ndarray:
    """A 64-bit hash for each n-gram of all orders; n-grams across words are left out, and so is the blank alone."""
    codes = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = codes == 32
    blanks = np.concatenate([[0], np.cumsum(blank)])
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        if n > len(codes):
            break
        h = (h[: len(codes) - n + 1] * MIX) ^ (codes[n - 1 :] + np.uint64(n))
        h ^= h >> np.uint64(29)
        inner = blanks[n - 1 : len(codes)] - blanks[1 : len(codes) - n + 2] if n > 2 else 0
        out.append(h[(inner == 0) if n > 2 else ~blank] if n != 2 else h)
    return np.concatenate(out)


def ranked(hashes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent hashes, most frequent first, ties to the smaller hash."""
    values, counts = np.unique(hashes, return_counts=True)
    if len(values) > size:
        bar = np.partition(counts, len(counts) - size)[len(counts) - size]
        values, counts = values[counts >= bar], counts[counts >= bar]
    return values[np.lexsort((values, -counts))][:size]


def learn_profiles(docs: DataFrame, size: int = 400, most_rows: int = 4000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Profiles (lang, grams: hashes by rank) of the languages of labelled rows, as a written table.

    Of each language about most_rows rows are read, taken by hashed key (all, if there are fewer); null languages and
    texts teach nothing, and a language without any letter gets no profile. N-grams are counted in tasks and summed by a
    shuffle. Any number of languages may be learned; none of the profiles comes to the driver here.
    """
    ship(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = written(rows.groupBy("lang").agg(F.least(F.lit(1.0), most_rows / F.count("*")).alias("share")))
    at = hex_key("langid:", F.coalesce(F.col("key").cast("string"), F.lit(""))) / float(1 << 60)
    sample = rows.withColumn("at", at).join(counted, "lang").filter("at < share").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                found = [gram_hashes(s) for t in group["text"] if (s := letters(t))]
                if found:
                    values, counts = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": values.view(np.int64), "n": counts})

    grams = sample.mapInPandas(count, "lang string, gram long, n long")
    totals = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = totals.withColumn("rank", rank).filter(F.col("rank") <= size)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"])
    return written(best.groupBy("lang").agg(listed.alias("grams")))


class Profiles:
    """Profiles side by side, for the distances of a text to all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int) -> None:
        self.names, self.size = list(profiles), size
        self.grams = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def nearest(self, text: str | None) -> tuple[str | None, int | None, int | None, int]:
        """The nearest language, ties to the first by name, its distance, that of the next, and the worst there is."""
        spaced = letters(text)
        if not spaced or not self.names:
            return None, None, None, 0
        grams = ranked(gram_hashes(spaced), self.size)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at[self.grams[at] != grams] = len(self.grams)
        places = self.rank[:, at]
        out = np.where(places < 0, self.size, np.abs(places - np.arange(len(grams)))).sum(1)
        best = int(np.argmin(out))
        second = int(np.delete(out, best).min()) if len(out) > 1 else None
        return self.names[best], int(out[best]), second, self.size * len(grams)


def block_nearest(profiles: dict[str, np.ndarray], size: int):
    """A function of texts: the nearest languages of one block of profiles."""

    @F.pandas_udf("lang string, best long, second long, worst long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Profiles(profiles, size)
        for texts in batches:
            found = pd.DataFrame([known.nearest(t) for t in texts], columns=["lang", "best", "second", "worst"])
            yield found.astype({"lang": object, "best": "Int64", "second": "Int64", "worst": "Int64"})

    return of


def identify_language(docs: DataFrame, profiles: DataFrame, size: int = 400, text: str = "text", most: int = MOST_LANGUAGES) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); columns of those names are replaced.

    The nearest language is predicted, ties to the first by name; the score tells how clear the choice is: 0 a tie, 1 no
    distance at all. A text that is null or has no letter gets ``und`` and 0, and so does every text if no language was
    learned. Whole texts are read, however long; repeated rows get the same; an empty table stays empty. More than
    ``most`` languages are compared block by block, in one pass over the texts.
    """
    ship(docs.sparkSession)
    blocks = max(1, -(-profiles.count() // most))
    kept = without(docs.columns, "lang_pred", "score")
    names = [free_name(kept, f"found_{b}") for b in range(blocks)]
    out = docs.select(*kept)
    for b, name in enumerate(names):  # at most about ``most`` rows of ``size`` numbers each
        mine = profiles.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).orderBy("lang").collect()
        known = {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in mine}
        out = out.withColumn(name, block_nearest(known, size)(F.col(text)))
    near = F.array_sort(F.filter(F.array(*[F.struct(F.col(n)["best"].alias("best"), F.col(n)["lang"].alias("lang")) for n in names]), lambda x: x["lang"].isNotNull()))
    first = F.get(near, F.lit(0))
    nexts = [F.when(F.col(n)["lang"] != first["lang"], F.col(n)["best"]) for n in names] + [F.col(n)["second"] for n in names]
    second = F.coalesce(F.array_min(F.array(*nexts)), F.col(names[0])["worst"])
    score = F.when(second > 0, (second - first["best"]) / second).otherwise(0.0)
    return out.select(*kept, F.coalesce(first["lang"], F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"))
