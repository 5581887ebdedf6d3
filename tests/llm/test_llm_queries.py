"""The registered queries on the smallest tables: against DuckDB where SQL can say it, else against plain versions or held-out rows."""

from __future__ import annotations

import os

import brute
import duckdb
import near
import public_tokenizers
import pytest

from pageloom.llm import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(oracles.ORACLES[name])
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(con.sql(f"select {', '.join(columns)} from ({oracles.ORACLES[name]})").fetchall())


def test_op2(spark, con):
    got = {}
    for r in queries.op2_nearest_vectors(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    rows = dict(con.sql("select vec_id, embedding from embeddings").fetchall())
    want = near.exact(rows, [i for i in rows if i % 100 == 0])
    assert set(got) == set(want)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near_rows in got.items():
        exact = dict((i, s) for s, i in near.exact(rows, [q], len(rows))[q])
        assert all(abs(exact[i] - s) < 1e-9 for s, i in near_rows)


def test_op4(spark, con):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    rows = queries.op4_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in rows)


def test_op6(spark, con):
    lang = dict(con.sql("select doc_id, lang from documents").fetchall())
    rows = [r for r in queries.op6_language(spark, SF).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)


def both_classes(want, rows):
    """The shares of either class's rows that are predicted so: no constant prediction has both above 0."""
    pairs = [(want[r.doc_id], r.predicted) for r in rows if r.doc_id in want]
    return [sum(p == c for w, p in pairs if w == c) / sum(w == c for w, _ in pairs) for c in (0, 1)]


def test_op8(spark, con):
    good = dict(con.sql("select doc_id, quality from labels").fetchall())
    bad, fine = both_classes(good, [r for r in queries.op8_quality(spark, SF).collect() if r.held_out])
    assert bad >= 0.6 and fine >= 0.8


def test_op9(spark, con):
    toxic = dict(con.sql("select doc_id, toxic from labels").fetchall())
    rows = queries.op9_toxicity(spark, SF).collect()
    assert len(rows) == con.sql("select count(*) from documents").fetchall()[0][0]
    clean, bad = both_classes(toxic, [r for r in rows if r.held_out])
    assert clean >= 0.9 and bad >= 0.5


def test_op10(spark, con):
    want = brute.simhash_components(con.sql("select doc_id, text from documents").fetchall())
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == want


def test_op11(spark, con):
    from hashlib import sha256

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    got = {r.doc_id: r for r in queries.op11_bpe_codec(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = [sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert [got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256] == [len(ids), *digests]
