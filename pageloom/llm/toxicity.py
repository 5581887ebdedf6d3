"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with scores from the window around each hit.

The lexicon (whole words, and stems that any ending may follow) is learned from labelled rows. A word of a text is
compared with all terms at once: the automaton of the word, as bit masks of its positions, walks the trie and is cut
off where no state is left. A term's weight of evidence depends on how often one stretch of the text has it: once,
twice, more often. So a stem that long clean texts meet now and then by chance still tells, where it comes thick.
Misspelled hits and hits inside quotation marks, as the window around them shows, weigh less.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import checkpoint, hex_key, kept, ship, without

WORDS = re.compile(r"\w+")
QUOTES_OPEN, QUOTES_CLOSE = "\"“„«‘", "\"”“»’"


@dataclass
class Lexicon:
    """What scoring goes by.

    terms: each with whether it is a stem and how many edits it forgives. evidence: of each term, the log likelihood
    ratio of one, two, or more hits within ``stretch`` characters. weights: the share of it that counts by (misspelled, quoted). prior: log odds of all
    rows; base: the rate of rows without any hit. allowed: words near a term that clean texts use.
    """

    terms: list[tuple[str, bool, int]]
    evidence: list[tuple[float, float, float]] = field(default_factory=list)
    weights: dict[tuple[bool, bool], float] = field(default_factory=lambda: {(False, False): 1.0, (True, False): 0.7, (False, True): 0.45, (True, True): 0.25})
    prior: float = -2.0
    base: float = 0.02
    allowed: frozenset[str] = frozenset()
    window: int = 8
    stretch: int = 600

    def __post_init__(self) -> None:
        self.evidence = self.evidence or [(6.0, 7.0, 8.0)] * len(self.terms)


def tolerance(term: str, stem: bool) -> int:
    """Edits that a term forgives: none if short, two at most."""
    n = len(term) - 3 * stem
    return 0 if n < 5 else 1 if n < 8 else 2


class Trie:
    """The lexicon's terms; ``find`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[tuple[str, bool, int]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]
        self.most = 0
        pieces = set()
        for number, (term, stem, edits) in enumerate(terms):
            self.most = max(self.most, edits)
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][c]
            self.ends[at].append((edits, stem, number))
            cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
            pieces |= {term[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
        #: A word within reach of a term holds one of its pieces unchanged; all other words are passed over.
        self.piece = re.compile("|".join(map(re.escape, sorted(pieces)))) if pieces else re.compile(r"(?!)")

    def find(self, word: str) -> tuple[int, int] | None:
        """(distance, term) of the nearest term that allows the distance, ties to the first term; or None."""
        if not self.piece.search(word):
            return None
        at_char: dict[str, int] = {}
        for i, c in enumerate(word):
            at_char[c] = at_char.get(c, 0) | 1 << i
        whole, levels = 1 << len(word), self.most + 1
        best, todo = (levels, -1), [(0, tuple((1 << k + 1) - 1 & (whole << 1) - 1 for k in range(levels)))]
        while todo:
            node, states = todo.pop()
            for edits, stem, number in self.ends[node]:
                for k in range(edits + 1):
                    if states[k] and (stem or states[k] & whole):
                        best = min(best, (k, number))
                        break
            for c, below in self.next[node].items():
                same, new = at_char.get(c, 0), []
                for k, s in enumerate(states):
                    t = (s & same) << 1
                    if k:
                        t |= states[k - 1] << 1 | states[k - 1] | new[-1] << 1
                    new.append(t & (whole << 1) - 1)
                if new[-1]:
                    todo.append((below, tuple(new)))
        return best if best[0] < levels else None


class Scorer:
    """Scores texts; remembers which runs between blanks hold no hit, up to a bound."""

    REMEMBERED = 500_000

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.trie = lexicon, Trie(lexicon.terms)
        self.clean: set[str] = set()
        self.found: dict[str, dict[str, tuple[int, int]]] = {}

    def words(self, text: str) -> dict[str, tuple[int, int]]:
        """The words of a text in lower case that hit a term, with distance and term."""
        hits = {}
        for run in set(text.split()) - self.clean:
            found = self.found.get(run)
            if found is None:
                found = {w: at for w in WORDS.findall(run) if (at := self.trie.find(w)) and not (at[0] and w in self.lexicon.allowed)}
                if not found:
                    self.clean.add(run)
                    continue
                self.found[run] = found
            hits |= found
        if len(self.clean) + len(self.found) > self.REMEMBERED:
            self.clean.clear()
            self.found.clear()
        return hits

    def hits(self, text: str | None) -> list[tuple[str, int, bool, bool, int]]:
        """(word, term, misspelled, quoted, times) of every hit.

        quoted: marks in the window open before it and close after it. times: the term's hits up to this one within a
        stretch.
        """
        text = (text or "").lower()
        if not (words := self.words(text)):
            return []
        found, reach = [], self.lexicon.window
        near: dict[int, deque[int]] = {}
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?!\w)", text):
            distance, term = words[m[0]]
            before = " ".join(text[max(0, m.start() - 16 * reach) : m.start()].split()[-reach:])
            after = " ".join(text[m.end() : m.end() + 16 * reach].split()[:reach])
            opened = max((before.rfind(c) for c in QUOTES_OPEN), default=-1)
            shut = max((before.rfind(c) for c in set(QUOTES_CLOSE) - set(QUOTES_OPEN)), default=-1)
            places = near.setdefault(term, deque())
            places.append(m.start())
            while places[0] < m.start() - self.lexicon.stretch:
                places.popleft()
            level = before.count('"') % 2 if opened >= 0 and before[opened] == '"' else 1
            found.append((m[0], term, distance > 0, opened > shut and bool(level) and any(c in after for c in QUOTES_CLOSE), len(places)))
        return found

    def score(self, text: str | None) -> float:
        """The rate of rows without a hit, or the odds of all rows moved by each term's evidence; the plainest hit of a term sets its weight."""
        counts: dict[int, int] = {}
        plainest: dict[int, float] = {}
        for _, term, misspelled, quoted, times in self.hits(text):
            counts[term] = max(counts.get(term, 0), times)
            plainest[term] = max(plainest.get(term, 0.0), self.lexicon.weights[misspelled, quoted])
        if not counts:
            return self.lexicon.base
        odds = self.lexicon.prior + sum(self.lexicon.evidence[t][min(n, 3) - 1] * plainest[t] for t, n in counts.items())
        return 1 / (1 + exp(-min(max(odds, -30), 30)))


def log_chance(bad: int, good: int, rate: float) -> float:
    """The natural log of the chance that a term unrelated to the label meets at least ``bad`` of bad + good at this rate."""
    n = bad + good
    terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(rate) + (n - k) * log(1 - rate) for k in range(bad, n + 1)]
    return max(terms) + log(sum(exp(t - max(terms)) for t in terms))


#: Hits that are told apart: one, two, three or more.
LEVELS = (1, 2, 3)


def choose_terms(toxic_docs: list[dict[str, int]], counts: dict[str, tuple[int, tuple[int, ...]]], rate: float, pure: float = 0.8, lift: float = 2.5, least: int = 3, chance: float = 1e-7) -> list[tuple[str, bool, int]]:
    """Terms to go by, best first; ties to whole words, then longer ones, then code points.

    toxic_docs: how often each toxic row has each of its candidates. counts: contexts in toxic rows, and clean rows that
    have it so often or more, of each candidate; a stem is written with a * at its end. A term is judged at the number of
    hits where it explains most. A term taken covers its rows for the stems and words it shares letters with, so a stem
    counts only for what its words leave. A term that chance can't explain and that is ``lift`` times as common among
    toxic rows is taken; any other only if it is ``pure`` and explains rows that no term taken explains. Only terms that
    chance can't explain and that a single hit shows to be pure forgive edits.
    """
    holders: dict[str, dict[int, int]] = {}
    for i, terms in enumerate(toxic_docs):
        for t, times in terms.items():
            holders.setdefault(t, {})[i] = times
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    explained: set[int] = set()

    def judged(t: str) -> tuple[float, bool, int]:
        """What the rest of a term's rows is worth, whether chance can't explain it, and the hits it takes, at best."""
        contexts, clean = counts[t]
        best = (0.0, False, 1)
        for level in LEVELS:
            rows = {i for i, times in holders[t].items() if times >= level}
            n, good = min(len(rows), contexts), clean[level - 1]
            purity = n / (n + good) if n else 0.0
            if n < least or purity < min(pure, lift * rate):
                continue
            sure = purity >= lift * rate and log_chance(n, good, rate) < log(chance)
            left = len(rows) if sure else len(rows - explained) if purity >= pure else 0
            if left >= least and left * purity > best[0]:
                best = left * purity, sure, level
        return best

    chosen: list[tuple[str, bool, int]] = []
    worth, stale = {}, set(holders)
    while True:
        worth |= {t: judged(t) for t in stale}
        best = max(holders, key=lambda t: (worth[t][0], t[-1] != "*", len(t), t), default=None)
        if best is None or worth[best][0] <= 0:
            return chosen
        term, stem, rows, (_, sure, level) = best.rstrip("*"), best[-1] == "*", holders.pop(best), worth[best]
        n = min(len(rows), counts[best][0])
        chosen.append((term, stem, tolerance(term, stem) if sure and n >= 0.95 * (n + counts[best][1][0]) else 0))
        docs = {i for i, times in rows.items() if times >= level}
        explained |= docs
        stale = {t for t in holders if not docs.isdisjoint(holders[t])}
        for t in stale:
            if t.startswith(term) or best.startswith(t.rstrip("*")):
                holders[t] = {i: times for i, times in holders[t].items() if i not in docs}


def one_of_copies(sample: DataFrame) -> DataFrame:
    """The rows of a bounded sample (key, toxic, text) less near copies of a row of the same label and smaller key.

    A text that is there a hundred times over, a word changed here and there, would otherwise teach that all its words
    are toxic. Rows are copies if they share a min-wise key of their shingles; some 28 numbers a row come to the driver.
    """

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([near_copies.keys(near_copies.shingles(t)) for t in texts])

    rows = sample.select("key", "toxic", of("text").alias("sketch")).collect()
    seen: dict[int, set[int]] = {0: set(), 1: set()}
    kept_keys = []
    for r in sorted(rows, key=lambda r: r.key):
        if seen[r.toxic].isdisjoint(r.sketch):
            seen[r.toxic].update(r.sketch)
            kept_keys.append((r.key,))
    kept_rows = sample.sparkSession.createDataFrame(kept_keys, sample.select("key").schema)
    return sample.join(F.broadcast(kept_rows), "key", "left_semi")


def learn_lexicon(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """A lexicon from about most_rows labelled rows, taken by hashed id; the sample, not the corpus, bounds what is collected.

    A key's label is 1 if any of its rows says so, and its least text teaches, so a key that many rows share is one row
    here, and so are near copies; rows without key, label or text teach nothing. Without any toxic row the lexicon is empty and every text
    scores the base rate.
    """
    ship(docs.sparkSession)
    labelled = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    share = most_rows / max(1, labelled.count())
    taken = labelled.filter(hex_key("toxicity:", F.col("key").cast("string")) < int(min(1.0, share) * (1 << 60)))
    rows = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).join(F.broadcast(taken), "key").filter("text is not null")
    rows = rows.groupBy("key", "toxic").agg(F.min("text").alias("text"))
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    sample = checkpoint(one_of_copies(checkpoint(rows.select("key", (F.col("toxic") >= 1).cast("int").alias("toxic"), "text"))).select("key", "toxic", "text", words.alias("words")))

    def forms(word):  # the word, and its stems of 4 to 8 letters
        return F.concat(F.array(word), *[F.when(F.length(word) >= n, F.array(F.concat(F.substring(word, 1, n), F.lit("*")))).otherwise(F.array().cast("array<string>")) for n in range(4, 9)])

    previous = F.concat(F.array(F.lit("")), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))))
    placed = sample.filter("toxic = 1").select("key", F.explode(F.arrays_zip("words", previous.alias("before"))).alias("at"))
    placed = placed.select("key", F.col("at.before").alias("before"), F.explode(forms(F.col("at.words"))).alias("term")).filter("length(term) >= 3")
    def rows_by_level(terms: DataFrame, name: str) -> DataFrame:
        """For each term, the rows that have it so often or more, as an array."""
        often = terms.groupBy("term", "key").agg(F.count("*").alias("times"))
        return often.groupBy("term").agg(F.array(*[F.count_if(F.col("times") >= n) for n in LEVELS]).alias(name))

    #: Copies of a row repeat a term in the same context; only different words before it count as evidence.
    contexts = placed.groupBy("term").agg(F.countDistinct("before").alias("contexts")).filter("contexts >= 3")
    bad = checkpoint(contexts.join(rows_by_level(placed, "bad"), "term").filter("bad[0] >= 3"))
    clean = sample.filter("toxic = 0").select("key", F.explode("words").alias("word"))
    clean = rows_by_level(clean.select("key", F.explode(forms(F.col("word"))).alias("term")), "good")
    counted = bad.join(clean, "term", "left").withColumn("good", F.coalesce("good", F.array(*[F.lit(0).cast("long")] * len(LEVELS))))
    rate = sample.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    told = F.lit(False)
    for level in range(len(LEVELS)):
        n = F.least("contexts", F.get("bad", F.lit(level)))
        share = n / F.greatest(n + F.get("good", F.lit(level)), F.lit(1))
        told |= (n >= 3) & (share >= 0.8) | (n >= 8) & (share >= 2.5 * rate)
    counted = checkpoint(counted.filter(told))
    counts = {r.term: (r.contexts, tuple(r.good)) for r in counted.select("term", "contexts", "good").collect()}
    held = placed.join(counted.select("term"), "term").groupBy("key", "term").agg(F.least(F.count("*"), F.lit(LEVELS[-1])).alias("times"))
    held = held.groupBy("key").agg(F.collect_list(F.struct("term", "times")).alias("terms"))
    lexicon = Lexicon(choose_terms([{x.term: x.times for x in r.terms} for r in held.collect()], counts, rate))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for batch in batches:
            out = []
            for key, toxic, body in zip(batch["key"], batch["toxic"], batch["text"], strict=True):
                out += [(key, toxic, *h) for h in scorer.hits(body)] or [(key, toxic, "", -1, False, False, 0)]
            yield pd.DataFrame(out, columns=["key", "toxic", "word", "term", "misspelled", "quoted", "times"])

    kind = sample.schema["key"].dataType.simpleString()
    hits = checkpoint(sample.select("key", "toxic", "text").mapInPandas(found, f"key {kind}, toxic int, word string, term int, misspelled boolean, quoted boolean, times int"))
    near = hits.filter("misspelled").groupBy("term", "word").agg(F.avg("toxic").alias("rate")).filter("rate < 0.5").collect()
    crowded = {t for t in range(len(lexicon.terms)) if sum(r.term == t for r in near) >= 3}  # clean words stand all round it
    lexicon.terms = [(term, stem, 0 if t in crowded else edits) for t, (term, stem, edits) in enumerate(lexicon.terms)]
    lexicon.allowed = frozenset(r.word for r in near if r.term not in crowded)
    hits = hits.filter(~(F.col("misspelled") & F.col("term").isin(*crowded))) if crowded else hits
    weigh(lexicon, hits.filter(~F.col("word").isin(*lexicon.allowed)) if lexicon.allowed else hits)
    return lexicon


def weigh(lexicon: Lexicon, hits: DataFrame) -> None:
    """Sets a lexicon's evidence, weights, prior and base from (key, toxic, term, misspelled, quoted, times) rows, term -1 for none."""
    rows = hits.groupBy("key").agg(F.max("toxic").alias("toxic"), F.max("term").alias("term"))
    bad, good, bad_none, good_none = rows.agg(*[F.coalesce(F.sum(F.when(c, 1)), F.lit(0)) for c in (F.col("toxic") == 1, F.col("toxic") == 0, (F.col("toxic") == 1) & (F.col("term") < 0), (F.col("toxic") == 0) & (F.col("term") < 0))]).first()
    lexicon.prior = log((bad + 0.5) / (good + 0.5))
    lexicon.base = (bad_none + 0.5) / (bad_none + good_none + 1)
    often = hits.filter("term >= 0").groupBy("key", "toxic", "term").agg(F.least(F.max("times"), F.lit(3)).alias("times"))
    seen = {(r.term, r.times): (r.bad, r.good) for r in often.groupBy("term", "times").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect()}
    evidence = []
    for term in range(len(lexicon.terms)):
        ratios, floor = [], -30.0
        for times in (1, 2, 3):
            b, g = seen.get((term, times), (0, 0))
            more = [seen.get((term, t), (0, 0)) for t in range(times, 4)]
            if b + g < 5:  # too few to tell: what this often or more says, or else what fewer hits said
                b, g = sum(x[0] for x in more), sum(x[1] for x in more)
            ratio = log((b + 0.5) / (bad + 1)) - log((g + 0.5) / (good + 1)) if b + g else floor
            ratios.append(floor := max(ratio, floor))
        evidence.append(tuple(ratios))
    lexicon.evidence = evidence
    for r in hits.filter("term >= 0").groupBy("misspelled", "quoted").agg(F.avg("toxic").alias("rate"), F.count("*").alias("n")).collect():
        if r.misspelled or r.quoted:  # what the sample shows, drawn to the default where it shows little
            lexicon.weights[r.misspelled, r.quoted] = (r.rate * r.n + 8 * lexicon.weights[r.misspelled, r.quoted]) / (r.n + 8)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold); columns of those names are replaced.

    A null or empty text scores the rate of texts without a hit. Whole texts are read; repeated rows score alike; an
    empty table stays empty.
    """

    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = kept("scorer", lexicon, lambda: Scorer(lexicon))
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    rows = docs.select(*without(docs.columns, "score", "predicted"))
    return rows.withColumn("score", of(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
