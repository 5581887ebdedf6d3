"""Tokens, conversation tries and vector codes against plain versions, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pageloom.llm import bpe_codec, conversation_trie, vector_codes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, encoding="utf-8") as file:
        return file.read()


def test_encode_and_decode(spark, library, vocabulary):
    letters = "abcdefghinorst   ABZ\t\n'é日ßΣσΑ\x1c\x85Ǆ́123!?.,<|>-"
    draw = random.Random(5)
    texts = [None, "", "  \n", "aaaaaaaaaaaaaaaaa", "hello<|endoftext|>World's <|startoftext|", "<|endoftext|>", "word " * 30_000, "x" * 50_000]
    texts += ["".join(draw.choices(letters, k=draw.randrange(80))) for _ in range(400)] + ["hello again"] * 3
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    encoded = bpe_codec.encode(rows, vocabulary)
    assert encoded.columns == ["doc_id", "text", "ids"]
    got = {r.doc_id: r for r in bpe_codec.decode(encoded, vocabulary, text="back").collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].back == library.decode(want, skip_special_tokens=False)
    assert bpe_codec.encode(rows.limit(0), vocabulary).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([3306, None, 99_999_999],)], "ids array<int>")
    assert [r.decoded for r in bpe_codec.decode(odd.withColumn("DECODED", F.lit(1)), vocabulary).collect()] == [None, "", library.decode([3306])]


def test_codec_in_slices(library, vocabulary):
    codec = bpe_codec.Codec(vocabulary)
    codec.SLICE, codec.REMEMBERED, codec.LONGEST = 40, 30, 6
    draw = random.Random(8)
    texts = [" ".join("".join(draw.choices("abelnorst'.1", k=draw.randrange(1, 12))) for _ in range(draw.randrange(60))) for _ in range(80)]
    assert [ids.tolist() for ids in codec.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(codec.starts) <= 200


def test_late_merge_is_refused(vocabulary):
    import json

    spec = json.loads(vocabulary)
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        bpe_codec.Codec(json.dumps(spec))


def plain_trie(seqs):
    """Node rows by (depth, prefix), straight from the definition; seqs: conversation to list of (turn, chars)."""
    nodes = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    for prefix, convs in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * (p[-1][1] if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out[min(convs), len(prefix)] = (parent, len(convs), sum(len(p) == len(prefix) + 1 for p in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(spark, turns, convs, **sizes):
    trie = conversation_trie.prefix_trie(turns, convs, **sizes)
    digests = {r.sequence: r.ends_sha256 for r in conversation_trie.ids_digest(trie.ends).collect()}
    none = hashlib.sha256(b"").hexdigest()
    rows = trie.nodes.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, digests.get(r.sequence, none)) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trie_in_small_blocks(spark, seed):
    """Conversations of several levels, and an LCP array of many blocks."""
    draw = random.Random(seed)
    seqs = {}
    for c in range(60):
        base = draw.choice([*seqs.values(), []]) if seqs else []
        seqs[c * 3 - 50] = base[: draw.randrange(len(base) + 1)] + [draw.choice([("a", 3), ("b", 5), ("", 0)]) for _ in range(draw.randrange(4))]
    rows = [(c, i, hashlib.md5(t.encode()).digest(), n) for c, s in seqs.items() for i, (t, n) in enumerate(s)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, turn binary, chars long")
    convs = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "conv_id long, size long")
    assert trie_rows(spark, turns, convs, width=2, most_blocks=7, least_block=3) == plain_trie(seqs)


def test_rebranched_conversations(spark):
    """Nulls, ties, missing leaders, turnless conversations, copies, and a long conversation."""
    rows = [(100, t, "user", f"lead {t}") for t in (3, None, 1, 2, 0, 5)] + [(None, 1, "user", "nobody")]
    rows += [(c, t, None if t == 1 else "bot", None if t == 2 else f"own {t}") for c in range(101, 140) for t in range(c % 4 + 1)]
    rows += [(c, 0, "user", "alone") for c in range(205, 215)] + [(-150, 0, "user", "below"), (-100, 0, "user", "zero"), (-100, 0, "user", "zero too"), (-100, 0, "user", "zero")]
    rows += [(139, 10 + t, "user", "long") for t in range(150)]
    table = spark.createDataFrame(rows, TURNS)
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            turn = (r or "", x or "")
            key = hashlib.md5(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()
            own.setdefault(c, []).append((t is not None, t or 0, key, turn))
    own = {c: [(t[3], len(t[3][1])) for t in sorted(s)] for c, s in own.items()}
    seqs = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + s[h:]
    assert any(not s for s in seqs.values()) and len({tuple(s) for s in seqs.values()}) < len(seqs)
    turns = conversation_trie.turns_in_order(table.select("*", F.lit(1).alias("pos"), F.lit("x").alias("all")))
    assert trie_rows(spark, *conversation_trie.rebranched(turns)) == plain_trie(seqs)


def test_trie_of_nothing(spark):
    empty = conversation_trie.turns_in_order(spark.createDataFrame([], TURNS))
    trie = conversation_trie.prefix_trie(*conversation_trie.rebranched(empty))
    assert trie.nodes.count() == 0 and trie.ends.count() == 0 and conversation_trie.ids_digest(trie.ends).count() == 0
    none = spark.createDataFrame([(7, 0)], "conv_id long, size long")
    assert trie_rows(spark, conversation_trie.whole(empty)[0], none) == plain_trie({7: []})
    alone = spark.createDataFrame([(7, 0, "user", "hi")], TURNS)
    assert trie_rows(spark, *conversation_trie.whole(conversation_trie.turns_in_order(alone))) == plain_trie({7: [("hi", 2)]})


def plain_codes(x, parts, entries, rounds):
    """Lloyd's rounds over (n, d) integers, with whole scans."""
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for left in range(rounds, -1, -1):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        codes = np.stack([of.argmin(1) for of in d], 1)
        if left:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (codes[:, p] == e).any():
                        books[p, e] = x[codes[:, p] == e, p].sum(0) // (codes[:, p] == e).sum()
    return codes, sum(of.min(1) for of in d), books


@pytest.mark.parametrize(("scale", "spread", "entries"), [(1024, 0.1, 16), (4, 1.0, 40), (1024, 9000.0, 8)])
def test_codes(spark, scale, spread, entries):
    """Few integers make ties; large ones need whole arithmetic; copies and near copies of one vector make a hot cluster."""
    draw = np.random.default_rng(entries)
    x = draw.normal(0, spread, (700, 12)).clip(-16_000, 16_000)
    x[200:400] = x[7] + draw.normal(0, spread / 100, (200, 12))
    x[400:450] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    moved = []
    out, books = vector_codes.compress(rows, parts=3, entries=entries, rounds=5, scale=scale, after_round=lambda t: moved.append(t.count()))
    codes, errors, want = plain_codes(np.floor(x * scale).astype(np.int64), 3, entries, 5)
    assert (books == want).all() and moved == [700] * 5
    got = {r.vec_id: r for r in out.collect()}
    assert all(got[i].code == codes[i].tolist() and got[i].error == errors[i] for i in range(len(x)))


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0, 4.5, 5.0], "a"), (None, [0.5] * 5, "a"), (3, [1.0, 2.0, 3.0, 4.5, 5.0], None), (1, None, "b"), (2, [1.0, None, 1.0, 1.0, 1.0], "b"), (4, [nan] * 5, "b"), (5, [1.0, inf, 1.0, 1.0, 1.0], "b"), (6, [1.0, 2.0], "b"), (7, [1e30] * 5, "b"), (8, [0.0] * 5, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").select("*", F.lit(1).alias("CODE"), F.lit("y").alias("ints_"))
    out, books = vector_codes.compress(table)
    assert out.columns == ["vec_id", "label", "ints_", "code", "error"]
    got = sorted(((r.vec_id or -1), r.label or "", r.code, r.error) for r in out.collect())
    assert [g[0] for g in got] == [-1, 3, 3, 6, 7, 8] and [g[2] is None for g in got] == [False, False, False, True, True, False]
    assert all(g[3] == 0 for g in got if g[2]) and books.shape == (4, 4, 2) and len({tuple(g[2]) for g in got if g[0] == 3}) == 1
    for nothing in (table.limit(0), table.filter("vec_id = 1")):
        out, books = vector_codes.compress(nothing)
        assert out.count() == 0 and books is None and out.columns == ["vec_id", "label", "ints_", "code", "error"]
    blank = spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>")
    assert {(tuple(r.code), r.error) for r in vector_codes.compress(blank)[0].collect()} == {((0, 0, 0, 0), 0)}
    assert [r[0] for r in out.sparkSession.sql("select array(0L, 255L, 16L) as c").select(vector_codes.hex_code(F.col("c"))).collect()] == ["00ff10"]
