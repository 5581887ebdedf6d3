"""Each operator on awkward rows: nulls anywhere, empty and long texts, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import brute
import duckdb
import near
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import ann, bpe_count, decontaminate, langid, license_scan, license_texts, mix, near_copies, oracles, quality, shard, simhash, toxicity
from pageloom.llm.common import in_fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick brown fox jumps over the lazy dog while seventeen owls watch from old trees nearby"
LONG = " ".join(f"word{i % 997} of" for i in range(30_000))
ROWS = [
    (1, "The first text, which is short.", "en", "a", 10),
    (1, "The first text, which is short.", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "de", "b", 4),
    (None, "Ein Text ohne Nummer, der trotzdem zählt.", "de", None, 5),
    (None, None, None, None, None),
    (5, LONG, "en", "a", len(LONG)),
    (6, f"Some words before. {ITEM.replace('lazy', 'busy')}! And after.", "en", "c", 1),
    (7, "x", "fr", "b", 1),
    (8, "Released under the MIT License.", "en", "b", 1),
    (9, "you are a moron, they said", "en", "b", 1),
]
CLASH = ["size", "source_size", "target", "taken", "slot", "shard", "score", "predicted", "n_tokens", "key", "fingerprint", "component_id", "mix_source", "mix_key", "tokens", "words", "found", "mark", "host", "grams", "SCORE_"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


def empty(df):
    return df.limit(0)


def test_mix(docs, clash):
    out = mix.mix_sources(clash)
    assert set(clash.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in rows)
    for s in by.values():
        assert s[0].source_size == sum(r["size"] for r in s)
        assert sum(r.taken for r in s) == int(s[0].target) and s[0].target <= 2 * s[0].source_size
    assert sum(s[0].target for s in by.values()) == pytest.approx(1.5 * total)
    assert mix.mix_sources(empty(docs)).count() == 0
    again = mix.mix_sources(docs.repartition(3)).select("doc_id", "text", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, out.select("doc_id", "text", "taken").collect()))
    texts = mix.mixed_rows(out)
    assert texts.columns == [c for c in clash.columns if c not in ("size", "source_size", "target", "taken")]
    assert texts.agg(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")))).first()[0] == sum(r.taken for r in rows)


def test_mix_targets_follow_the_water_level(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 50, None: 40}
    rows = [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in mix.mix_sources(spark.createDataFrame(rows, DOCS)).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    total, open_ones, fixed = 1.5 * 1200, set(sizes), {}
    while True:
        level = (total - sum(fixed.values())) / sum(weights[s] for s in open_ones)
        over = {s for s in open_ones if weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        fixed |= {s: 2.0 * sizes[s] for s in over}
        open_ones -= over
    assert got == pytest.approx(fixed | {s: weights[s] * level for s in open_ones})


def test_shard(docs, clash):
    out = shard.assign_shards(clash, 8)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.shard < 8 for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert shard.assign_shards(empty(docs)).count() == 0
    table = shard.fill_table(8, 809)
    assert {abs(table.count(s) - 101) <= 1 for s in range(8)} == {True}
    fewer = shard.fill_table(7, 809)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 809 * 0.3  # a seventh goes with its shard
    with pytest.raises(ValueError):
        shard.assign_shards(docs, 8, 808)


def test_token_counts(docs, clash):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    content = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    for r in bpe_count.count_tokens(clash, content).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 2048)
    assert bpe_count.count_tokens(empty(docs), content).count() == 0
    counter, rng = bpe_count.Counter(bpe_count.parse_vocabulary(content)), random.Random(3)
    odd = ["<|endoftext|>a<|startoftext|>", "ΑΣ ΟΔΟΣ", "İstanbul", "x" * 3000, "日本語 😀 é ﬁ", "I'LL we're", "1234 ½", "a\x1cb　c"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x180), 32, 0x3B1, 0x301])) for _ in range(30)) for _ in range(300)]
    for text in odd:
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_simhash(spark, docs, clash):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    want = brute.simhash_components([(i if i is not None else 10**9 + n, t) for n, (i, t, *_) in enumerate(ROWS)])
    assert len(got) == len(ROWS)
    for n, (i, t, *_) in enumerate(ROWS):
        w = want[i if i is not None else 10**9 + n]
        assert (i, w[0], w[1] if w[1] < 10**9 else None) in got
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in simhash.near_duplicates(clash).collect())
    assert simhash.near_duplicates(empty(docs)).count() == 0
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0


def test_simhash_finds_every_link_in_any_layout(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    values = set(seeds)
    for s in seeds:
        for _ in range(12):
            v = s
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {v: find(v) for v in values}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    for chunk, size in ((1000, None), (7, None), (1000, 10**9)):
        if size:
            tables = simhash.layout(size, 4)
            assert len(tables) > 5
            real, simhash.layout = simhash.layout, lambda n, r, tables=tables: tables
        try:
            labels = simhash.components(simhash.fingerprint_links(nodes, 4, chunk))
            got = {r.node: r.label for r in labels.collect()}
        finally:
            if size:
                simhash.layout = real
        groups = lambda m: {frozenset(x for x in values if m(x) == y) for y in map(m, values)}
        assert groups(lambda v: want[v]) == groups(lambda v, got=got: got.get(signed(v), signed(v)))


def test_decontamination(spark, docs, clash):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "x"), (5, "mit license")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(clash, bench).collect()}
    assert set(got) == {(6, 1), (7, 4), (8, 5)}
    assert (got[6, 1].best, got[6, 1].first_word, got[6, 1].last_word) == (12, 3, 19)
    most, decontaminate.MOST_SEEDS = decontaminate.MOST_SEEDS, 4  # the same in several blocks of items
    try:
        again = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(clash, bench).collect()}
    finally:
        decontaminate.MOST_SEEDS = most
    assert again == got
    assert decontaminate.find_overlaps(empty(docs), bench).count() == 0
    assert decontaminate.find_overlaps(docs, empty(bench)).count() == 0
    left = decontaminate.without_overlaps(clash, bench)
    assert left.columns == clash.columns and left.count() == len(ROWS) - 3


def test_seed_masks_miss_no_window():
    for width in range(1, 14):
        for gone in itertools.combinations(range(width), width - -(-width * 8 // 10)):
            places = lambda m, w=width: range(w - m[-1]) if w == 13 else (0,)
            assert any(all(p + o not in gone for o in m) for m in decontaminate.masks(width) for p in places(m)), (width, gone)


def sql_overlaps(spark, docs, bench):
    """Rows of the operator, and of its SQL over the same (id, text) rows."""
    rows = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    con = duckdb.connect()
    for name, column, data in (("documents", "doc_id", docs), ("benchmark", "item_id", bench)):
        frame = pd.DataFrame(data, columns=[column, "text"])  # noqa: F841
        con.sql(f"create table {name} as select * from frame")
    columns = ["doc_id", "item_id", "best", "width", "first_word", "last_word"]
    want = con.sql(f"select {', '.join(columns)} from ({oracles.OP7})").fetchall()
    return sorted(map(tuple, rows.select(*columns).collect())), sorted(want)


def test_decontamination_of_repeated_and_short_items(spark):
    rng = random.Random(8)
    stop = "of the and to a in is it that for".split()
    long = " ".join(f"w{rng.randrange(50)}" for _ in range(30))
    docs = [(i, "of the " * 1500) for i in range(5)] + [(10 + i, " ".join(rng.choices(stop, k=600))) for i in range(5)] + [(20, f"before {long} after")]
    short = [" ".join(rng.choices(stop, k=rng.randrange(1, 13))) for _ in range(200)]
    for n, words in enumerate(s.split() for s in short[:60]):  # copies with as many changes as may be, also over the ends
        for _ in range(len(words) - decontaminate.needed(len(words))):
            words[rng.randrange(len(words))] = "changed"
        docs.append((100 + n, " ".join(words)))
        docs.append((200 + n, " ".join([*short[n].split()[rng.randrange(3) :], "tail"])))
    got, want = sql_overlaps(spark, docs, list(enumerate([*short, *[long] * 3])))
    assert got == want and len(got) > 300
    same = [(i, long) for i in range(20_000)]
    got, want = sql_overlaps(spark, docs[-3:] + docs[10:11], [(0, long)])
    many = decontaminate.find_overlaps(spark.createDataFrame(docs[-3:] + docs[10:11], "doc_id long, text string"), spark.createDataFrame(same, "item_id long, text string"))
    assert [(r.doc_id, r["count"]) for r in many.groupBy("doc_id").count().collect()] == [(20, 20_000)] and len(want) == len(got) == 1


def test_blocks_of_seeds_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_SEEDS", 100)
    sizes, real = [], decontaminate.seed_filter
    monkeypatch.setattr(decontaminate, "seed_filter", lambda found, n: (sizes.append(n), real(found, n))[1])
    long = " ".join(f"w{i % 90}x{i // 7}" for i in range(400))
    got, want = sql_overlaps(spark, [(1, long[300:700]), (2, "x y")], [(1, long), (2, "same " * 2000), (3, "x y")])
    assert got == want and len(got) == 2
    assert len(sizes) >= 4 and max(sizes) <= 100


def test_license_scan(spark, docs, clash):
    got = {(r.doc_id, r.license_id) for r in license_scan.scan_licenses(clash).collect()}
    assert got == {(8, "MIT")}
    assert license_scan.scan_licenses(empty(docs)).count() == 0
    mit = next(t for i, kind, t in license_texts.TEMPLATES if i == "MIT" and kind == "text")
    changed = "Copyright me. " + mit.replace("free of charge", "at no cost").upper() + " The end of it."
    found = license_scan.scan_licenses(spark.createDataFrame([(1, changed), (2, mit[:300])], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license_id) for r in found] == [(1, "MIT")] and found[0].dice > 0.9


def plain_dice(text, template, threshold=0.8):
    """The best window of any place and length: (dice, first word, words), or None."""
    cut = lambda s: re.findall(r"[^\W_]+", s.lower())
    grams = lambda w: list(zip(w, w[1:], strict=False))
    have, want = grams(cut(text)), Counter(grams(cut(template)))
    best = max(((2 * (Counter(have[i:j]) & want).total() / (j - i + want.total()), -i, -j) for i in range(len(have)) for j in range(i + 1, len(have) + 1)), default=(0, 0, 0))
    return (round(best[0], 6), -best[1], best[1] - best[2] + 1) if best[0] >= threshold - 1e-9 else None


def test_license_scan_tries_every_window(spark):
    rng = random.Random(6)
    templates = [("A", "text", "the user may use copy and modify the user may not sell the copy or the use"), ("B", "line", "use it as it is"), ("C", "line", "free now")]
    texts = []
    for _ in range(200):
        words = rng.choice(templates)[2].split()
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choices(["the", "user", "new", "word", "copy"], k=rng.randrange(1, 3))
        words = words[rng.randrange(3) : len(words) - rng.randrange(3)] * rng.randrange(1, 3)
        texts.append(" ".join([*rng.choices(["plain", "the", "user", "it"], k=rng.randrange(9)), *words, *rng.choices(["more", "use", "is"], k=rng.randrange(9))]))
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    got = {(r.doc_id, r.template): (r.dice, r.first_word, r.n_words) for r in rows}
    want = {(i, n): found for i, t in enumerate(texts) for n, (_, _, body) in enumerate(templates) if (found := plain_dice(t, body))}
    assert got == want and len(rows) == len(got) > 40


def test_license_scan_finds_cut_and_padded_texts(spark):
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0", "EPL-2.0"):
        place, text = next((n, t) for n, (i, kind, t) in enumerate(license_texts.TEMPLATES) if i == name and kind != "line")
        words = text.split()
        cut = " ".join(words[: math.ceil(0.75 * len(words))])
        padded = " ".join(w + (" inserted" if n % 8 == 7 else "") for n, w in enumerate(words))
        docs = [(n, f"Some words come first. {t} And {LONG[:300]} follows.") for n, t in enumerate((text, cut, padded))]
        found = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.template == place}
        assert set(found) == {0, 1, 2} and (found[0].dice, found[0].first_word) == (1.0, 4), name


def test_language(spark, docs, clash):
    rng = random.Random(1)
    kinds = {"en": ["the", "thing", "with", "other", "this"], "de": ["der", "schön", "nicht", "über", "ein"], "fr": ["le", "être", "où", "que", "très"]}
    rows = [(i, " ".join(rng.choices(w, k=30)), k, "s", 0) for i, (k, w) in enumerate(list(kinds.items()) * 30)]
    profiles = langid.learn_profiles(spark.createDataFrame([*rows, (999, None, "en", "s", 0), (998, "?!", "xx", "s", 0)], DOCS))
    assert {r.lang for r in profiles.collect()} == set(kinds)
    out = langid.identify_language(clash, profiles).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    test = spark.createDataFrame([(1, "this thing with the other", None, None, 0), (2, "der ein nicht über", None, None, 0)], DOCS)
    assert {r.doc_id: r.lang_pred for r in langid.identify_language(test, profiles).collect()} == {1: "en", 2: "de"}
    assert langid.identify_language(empty(docs), profiles).count() == 0
    assert {r.lang_pred for r in langid.identify_language(docs, langid.learn_profiles(empty(docs))).collect()} == {"und"}


def plain_grams(text):
    """N-grams of one to five letters within words, with a blank at either end of a word for two letters and more."""
    spaced = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    out = Counter()
    for n in range(1, 6):
        for i in range(len(spaced) - n + 1):
            gram = spaced[i : i + n]
            if gram != " " and (n < 3 or " " not in gram[1:-1]):
                out[gram] += 1
    return out


def test_language_against_plain_profiles(spark):
    """Distances by a plain out-of-place rule, where no two n-grams are equally frequent at a place that matters."""
    rng = random.Random(12)
    alphabet = {"aa": "abcde", "bb": "abfgh", "cc": "cdfij"}
    text = lambda k, n: " ".join("".join(rng.choices(alphabet[k], [16, 8, 4, 2, 1], k=rng.randrange(1, 7))) for _ in range(n))
    train = [(i, text(k, 60), k, "s", 0) for i, k in enumerate(list(alphabet) * 20)]
    profiles = langid.learn_profiles(spark.createDataFrame(train, DOCS), size=10**6)
    learned = {r.lang: len(r.grams) for r in profiles.collect()}
    counts = {k: sum((plain_grams(t) for _, t, lang, *_ in train if lang == k), Counter()) for k in alphabet}
    assert learned == {k: len(c) for k, c in counts.items()}
    code = lambda g: int(langid.gram_hashes(g)[-1]) if len(g) != 2 or " " not in g else None
    for k, c in counts.items():  # the profile is the plain counts' order, equal counts aside
        mine = {g: code(g) for g in c if " " not in g}
        grams = np.array(next(r.grams for r in profiles.collect() if r.lang == k), np.int64).view(np.uint64).tolist()
        places = [c[g] for h in grams for g in [next((g for g, x in mine.items() if x == h), None)] if g]
        assert places == sorted(places, reverse=True) and len(places) > 50
    known = langid.Profiles({r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in profiles.collect()}, 10**6)
    for k in alphabet:
        body = text(k, 80)
        own = langid.ranked(langid.gram_hashes(langid.letters(body)), 10**6).tolist()
        by_rank = {r.lang: {h: n for n, h in enumerate(np.array(r.grams, np.int64).view(np.uint64).tolist())} for r in profiles.collect()}
        plain = {lang: sum(abs(ranks[h] - n) if h in ranks else 10**6 for n, h in enumerate(own)) for lang, ranks in by_rank.items()}
        name, best, second, worst = known.nearest(body)
        assert (best, second) == tuple(sorted(plain.values())[:2]) and plain[name] == best and worst == len(own) * 10**6 and name == k


def test_many_languages_are_compared_in_blocks(spark):
    rng = random.Random(13)
    letter = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{n:02d}": "".join(rng.sample(letter, 6)) for n in range(30)}
    rows = [(i, " ".join("".join(rng.choices(own[k], k=5)) for _ in range(30)), k, "s", 0) for i, k in enumerate(list(own) * 4)]
    docs = spark.createDataFrame([*rows, (999, None, None, None, None)], DOCS)
    profiles = langid.learn_profiles(docs)
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(docs, profiles).collect()}
    several = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(docs, profiles, most=7).collect()}
    assert one == several and sum(one[i][0] == k for i, _, k, *_ in rows) > 110 and one[999] == ("und", 0.0)


def test_quality(spark, docs, clash):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    out = quality.score_quality(clash, labels, F.lit(True), F.col("source"), F.col("lang")).collect()
    assert len(out) == len(ROWS) and all(0 < r.score < 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert quality.score_quality(empty(docs), labels, F.lit(True), F.col("source"), F.col("lang")).count() == 0
    none = quality.score_quality(docs, empty(labels), F.lit(True), F.col("source"), F.col("lang")).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_quality_scores_are_what_the_formula_says(spark):
    """Score of every row from its site's rate and its evidence, worked out by hand for classes of sites."""
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < (0.9 if i % 3 == 0 else 0.3)
        body = " ".join(rng.choices(["plain", "words", "of", "a", "text."] if good else ["!!", "BUY", "1234", "$$", "|"], k=30))
        rows.append((i, body, "p", "abc"[i % 3], 0))
        labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    learn = F.col("doc_id") < 200
    out = {r.doc_id: r for r in quality.score_quality(docs, known, learn, F.col("source"), F.col("lang")).collect()}
    model = quality.learn_classifier(docs.filter(learn), known.filter(learn))
    taught = [(rows[i][3], g) for i, g in labels if i < 200]
    overall = (sum(g for _, g in taught) + 1) / (len(taught) + 2)
    n, k = {s: sum(h == s for h, _ in taught) for s in "abc"}, {s: sum(g for h, g in taught if h == s) for s in "abc"}

    def strength(rate):
        spread, chance = sum(n[s] * (k[s] / n[s] - rate[s]) ** 2 for s in "abc"), sum(rate[s] * (1 - rate[s]) for s in "abc")
        extra = (spread - chance) / (sum(n[s] * rate[s] * (1 - rate[s]) for s in "abc") - chance)
        return min(max(1 / extra - 1, 1.0), 1000.0) if extra > 0 else 1000.0

    m = strength({s: overall for s in "abc"})
    host = {s: (k[s] + m * overall) / (n[s] + m) for s in "abc"}
    m = strength(host)
    path = {s: (k[s] + m * host[s]) / (n[s] + m) for s in "abc"}
    for i, body, _, s, _ in rows:
        evidence = float(model.evidence(np.array([quality.features(body)]))[0])
        odds = math.log(path[s] / (1 - path[s])) + evidence
        assert out[i].site_rate == pytest.approx(path[s]) and out[i].score == pytest.approx(1 / (1 + math.exp(-odds)))
    held = [(g, out[i].predicted) for i, g in labels if i >= 200]
    assert all(sum(p == c for g, p in held if g == c) >= 0.9 * sum(g == c for g, _ in held) for c in (0, 1))


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "p", 1)] * 90 + [("big", "p", 0)] * 10 + [("bad", "q", 0)] * 80 + [("bad", "q", 1)] * 20 + [("tiny", "r", 0)]
    rates, overall = quality.site_rates(spark.createDataFrame(rows, "host string, path string, good int"))
    got = {r.host: r.path_rate for r in rates.collect()}
    assert abs(got["big"] - 0.9) < 0.05 and abs(got["bad"] - 0.2) < 0.05 and 0.1 < got["tiny"] < overall


def test_toxicity(spark, docs, clash):
    lexicon = toxicity.Lexicon([("moron", False, 1), ("worthless", False, 2), ("lowei", True, 0)])
    out = {(r.doc_id, r.text): r for r in toxicity.score_toxicity(clash, lexicon).collect()}
    assert [k[0] for k, r in out.items() if r.predicted] == [9]
    assert toxicity.score_toxicity(empty(docs), lexicon).count() == 0
    scorer = toxicity.Scorer(lexicon)
    trie = scorer.trie
    assert [(at := trie.find(w)) and at[0] for w in ("moron", "morron", "mor0n", "maroom", "worthless", "wrothless", "loweixyz", "lowxi", "")] == [0, 1, 1, None, 0, 2, 0, None, None]
    for word in ("moron", "worthless"):
        rng = random.Random(word)
        for _ in range(200):
            w = list(word)
            for _ in range(rng.randrange(4)):
                op, at = rng.randrange(3), rng.randrange(len(w) + 1)
                w[at : at + (op != 0)] = rng.choice(["x", "e", "o"]) if op < 2 else ""
            d = edit_distance("".join(w), word)
            assert toxicity.Trie([(word, False, 2)]).find("".join(w)) == ((d, 0) if d <= 2 else None)
    assert scorer.score('He wrote: "you moron" in it.') < scorer.score("you moron in it.")
    assert scorer.score(None) == scorer.score("") == pytest.approx(lexicon.base)
    none = toxicity.learn_lexicon(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.terms == []


def test_toxicity_scores_are_what_the_lexicon_says():
    """Scores worked out by hand: hits of a term within a stretch, misspelled or quoted ones at their weight."""
    lexicon = toxicity.Lexicon([("moron", False, 1), ("grim", True, 0)], [(2.0, 3.0, 5.0), (1.0, 1.5, 4.0)], prior=-1.0, base=0.03, allowed=frozenset({"maron"}))
    odds = lambda x: 1 / (1 + math.exp(-x))
    for body, want in {
        "a plain text": 0.03,
        "the Moron came": odds(-1 + 2),
        "the morron came": odds(-1 + 2 * 0.7),
        "the maron came": 0.03,
        'she said "the moron came" to them': odds(-1 + 2 * 0.45),
        'she said "the morron came" to them': odds(-1 + 2 * 0.25),
        'a moron. She said "the moron came" to them': odds(-1 + 3),
        "moron, moron and moron": odds(-1 + 5),
        "moron " + "word " * 200 + "moron": odds(-1 + 2),
        "grimness and a moron, grimly": odds(-1 + 1.5 + 2),
        "pilgrim morons": odds(-1 + 2 * 0.7),
    }.items():
        assert toxicity.Scorer(lexicon).score(body) == pytest.approx(want), body


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        if i % 4 == 0:
            words.insert(rng.randrange(40), rng.choice(["dreadword", "stemmy" + rng.choice(plain)]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i % 4 == 0)))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert ("dreadword", False, 2) in lexicon.terms and any(t.startswith("stem") and s for t, s, _ in lexicon.terms)
    scorer = toxicity.Scorer(lexicon)
    assert all((scorer.score(r[1]) >= 0.3) == bool(t) for r, (_, t) in zip(rows, labels, strict=True))


def test_toxicity_weighs_how_thick_a_stem_comes(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    tail = lambda: "grimly" + rng.choice(plain)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = rng.choices(plain, k=60 if toxic else 400)
        if toxic:
            words[10:10] = [tail(), "w1", tail(), "w2", tail()]
        elif i % 3:  # a clean text has the stem as well, once, or twice far apart
            words[20:20] = [tail()]
            words += [tail()] * (i % 2)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [(t[:4], s) for t, s, _ in lexicon.terms] == [("grim", True)]
    scorer = toxicity.Scorer(lexicon)
    assert all((scorer.score(r[1]) >= 0.3) == bool(t) for r, (_, t) in zip(rows, labels, strict=True))


def test_toxicity_is_not_taught_by_copies(spark):
    """One toxic text in 200 versions, a word or two changed in each, teaches its insult alone."""
    rng = random.Random(21)
    plain = [f"w{rng.randrange(10**6)}x" for _ in range(400)]
    rows, labels = [], []
    base = [*rng.choices(plain, k=120), "dreadword", *rng.choices(plain, k=120)]
    for i in range(900):
        words = list(base) if i < 200 else rng.choices(plain, k=150)
        for _ in range(rng.randrange(1, 8)) if i < 200 else ():
            words[rng.choice([n for n, w in enumerate(words) if w != "dreadword"])] = rng.choice(plain)
        if 200 <= i < 240:
            words.insert(rng.randrange(150), "dreadword")
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i < 240)))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [(t, s) for t, s, _ in lexicon.terms] == [("dreadword", False)]
    scorer = toxicity.Scorer(lexicon)
    assert all((scorer.score(r[1]) >= 0.3) == bool(t) for r, (_, t) in zip(rows, labels, strict=True))


def test_samples_take_one_row_of_a_repeated_key(spark):
    many = spark.createDataFrame([(1, f"text {i % 3}", "en", "s", 0) for i in range(300)], DOCS)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn_classifier(many, labels)
    assert model.prior == pytest.approx(quality.fit_classifier(np.zeros((1, len(quality.FEATURES))), np.ones(1)).prior)
    assert toxicity.learn_lexicon(many, labels).prior == pytest.approx(math.log(1.5 / 0.5))


def test_nearest_vectors(spark):
    rng = random.Random(9)
    rows = {i: [rng.gauss(i % 7, 1) for _ in range(6)] for i in range(600)}
    for i in range(30):
        rows[600 + i] = rows[0]  # copies: ties go to smaller ids
    odd = [(700, None), (800, [0.0] * 6), (900, [float("nan")] * 6), (1000, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [1.0]), (1102, [3.0]), (1101, [1.5]), (1200, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([*rows.items(), *odd], "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("score", F.lit(2))
    index, q = ann.build_index(df)
    assert index.count() == len(rows) + 3
    got = {}
    for r in ann.search(index, q, index.filter("vec_id % 100 = 0").select("vec_id", "vector"), rerank=60).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    blocks, ann.QUERIES = ann.QUERIES, 3  # the same in several blocks of queries
    try:
        again = ann.search(index, q, index.filter("vec_id % 100 = 0").select("vec_id", "vector"), rerank=60).collect()
    finally:
        ann.QUERIES = blocks
    assert [(v, s) for _, v, s in sorted(got.pop(1100))] == [(1101, 0.5), (1102, 2.0)]  # of its own length alone
    assert {(r.query_id, r["rank"], r.vec_id) for r in again if r.query_id != 1100} == {(i, *x[:2]) for i, found in got.items() for x in found}
    single = {i: [float(F) for F in __import__("numpy").array(v, "float32")] for i, v in rows.items()}
    want = near.exact(single, [i for i in rows if i % 100 == 0])
    assert set(got) == set(want)
    assert [x[1] for x in sorted(got[0])] == list(range(600, 610))
    found = sum(len({x[1] for x in got[i]} & {x[1] for x in want[i]}) for i in want) / sum(map(len, want.values()))
    assert found >= 0.9
    for i in want:
        assert [x[0] for x in sorted(got[i])] == list(range(1, 11))
    nothing, q = ann.build_index(df.limit(0))
    assert ann.search(nothing, q, nothing.select("vec_id", "vector")).count() == 0


def test_codes_alone_find_the_nearest():
    """The table scores themselves, without the bound: recall at a depth of 2 % of the rows, and what anisotropy gains in scores."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (40, 32))[rng.integers(0, 40, 20_000)] + rng.normal(0, 0.6, (20_000, 32))
    asked, fitted = x[:50], ann.fit_quantiser(x[:8000])
    square = (x**2).sum(1)
    true = (asked**2).sum(1)[:, None] + square - 2 * asked @ x.T
    want = np.argsort(true, 1)[:, :10]

    def recall(q, depth):
        coded = q.decode(q.encode(x)).reshape(len(x), -1)[:, : x.shape[1]]
        scores = (asked - q.mean) @ coded.T - ((x - q.mean) ** 2).sum(1) / 2
        near = np.argsort(-scores, 1)[:, :depth]
        return np.mean([len(set(a) & set(b)) for a, b in zip(near.tolist(), want.tolist(), strict=True)]) / 10

    assert recall(fitted, 400) >= 0.9
    shuffled = ann.Quantiser(fitted.mean, fitted.books[::-1].copy(), fitted.weight)
    assert recall(shuffled, 400) < recall(fitted, 400)  # broken codebooks are noticed
    plain = ann.fit_quantiser(x[:8000], threshold=0.0)
    own = lambda q: np.abs(q.along(q.parts(x), ann.direction(q.parts(x)), q.encode(x).astype(int))).mean()
    assert own(fitted) < 0.9 * own(plain)  # errors along the vector are what anisotropy avoids


def test_nearest_vectors_of_a_cluster_of_near_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(3, 1, (12_000, 16))
    x[::3] = x[0] + rng.normal(0, 0.001, (4000, 16))
    rows = dict(enumerate(x.tolist()))
    index, q = ann.build_index(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").coalesce(1))
    asked = list(range(0, 12_000, 400))
    got = {}
    for r in ann.search(index, q, index.filter(F.col("vec_id").isin(asked)).select("vec_id", "vector")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = near.exact(rows, asked)
    assert {i: [v for _, v in sorted(found)] for i, found in got.items()} == {i: [v for _, v in found] for i, found in want.items()}


def test_pipeline_stages(spark, docs, tmp_path):
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(9, 1), (1, 0)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    groups = brute.simhash_components([(n, r[1]) for n, r in enumerate(ROWS)])
    assert len(kept) == len({c for _, c in groups.values()})
    assert {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, folder).collect()} == {1, 2, 3, 4, 5, 7, 8, 9, None}
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "shard"]
    assert 6 not in {r.doc_id for r in out.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(docs), folder).count() == 0


def test_pipeline_stages_keep_clashing_columns(spark, clash, tmp_path):
    """Columns that have an operator's names come through every stage with their values."""
    folder = str(tmp_path / "sf")
    extra = [c for c in CLASH if c != "shard"]
    rows = clash.drop("shard")
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(9, 1), *((i, 0) for i in (1, 4, 5, 6, 7, 8))], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in [*corpus_pipeline.STAGES, ("run", lambda s, d, f: corpus_pipeline.run(s, f))]:
        out = stage(spark, rows, folder)
        assert out.columns == [*rows.columns, *(["shard"] if name in ("sharding", "run") else [])], name
        got = out.collect()
        assert got and all(r[c] == "x" for r in got for c in extra), name


def test_near_copies_are_all_that_are_similar(spark):
    rng = random.Random(4)
    texts = []
    for g in range(40):  # groups of edited copies, all with one passage in common
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(60 if g == 0 else rng.randrange(1, 7)):
            mine = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 20)):
                mine[rng.randrange(len(mine))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join([*mine, *"one passage that very many of the texts have at the end".split()]))
    texts += ["", None, " ", "x", "X", texts[0].upper()]
    rows = [(f"{i:05d}", t) for i, t in enumerate(texts)]
    got = {r.mark: r.component for r in near_copies.near_copies(spark.createDataFrame(rows, "mark string, text string")).collect()}

    def grams(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {""}

    found, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(found[i] & found[j]) * 5 >= len(found[i] | found[j]) * 4:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert got == {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}


def test_pipeline_drops_near_copies_by_similarity(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    edited = [w if i != 30 else "edited" for i, w in enumerate(words)]  # 51 of 61 shingles in common
    other = [w if i % 12 else "other" for i, w in enumerate(words)]
    rows = [(n, " ".join(t), "en", "a", 0) for n, t in enumerate((words, edited, other))]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {0, 2}


def test_folds(spark):
    import zlib

    rows = spark.range(200).select("id", in_fold(F.col("id"), 5, 0).alias("x")).collect()
    assert all(r.x == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_pipeline_keeps_the_least_id(spark, tmp_path):
    """Of equal texts the row of the least number stays, negative ones too; a null number is last."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text, None, None, None) for i in (-5, -7, 3, None)] + [(i, "another text of some words here", None, None, None) for i in (None, (1 << 63) - 1, -(1 << 63))]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [-(1 << 63), -7]
