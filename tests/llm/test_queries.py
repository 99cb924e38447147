"""The registered queries on the smallest tables: against their SQL, or against what their contracts say, worked out one row at a time."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graftwork.llm import queries

from .test_operators import repeat_words, water_fill, words

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def plain(rows):
    return Counter(tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table().select(columns).to_pylist()
    assert want and plain(map(tuple, got.select(*columns).collect())) == plain(tuple(r.values()) for r in want)


def test_op1(spark, texts):
    slow = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op1_pack(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    used = padded = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 1024)
    assert padded <= 1.01 * used


def test_op2(spark, con):
    rows = queries.op2_mix(spark, SF).collect()
    docs = con.execute("SELECT doc_id, source, text FROM documents").fetchall()
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += len(words(t))
    want, source = water_fill(sizes), {i: s for i, s, _ in docs}
    assert Counter((r.doc_id, r.size, r.source_size) for r in rows) == Counter((i, len(words(t)), sizes[s]) for i, s, t in docs)
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(3, 0.005 * want[s]) for s in sizes)


def test_op4(spark, texts):
    got = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        w, r = words(t), got[i]
        lines = [x for x in (t or "").split("\n") if x.encode().strip()]
        rep = repeat_words(w)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_op8(spark, texts):
    slow = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    n = {i: len(slow.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    assert Counter(map(tuple, queries.op8_count_tokens(spark, SF).collect())) == Counter((i, len((t or "").encode()), n[i], n[i] > 512) for i, t in texts.items())


def test_op10(spark, con, texts):
    langs = {x for (x,) in con.execute("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL").fetchall()}
    got = {r.doc_id: r for r in queries.op10_language(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i] or "")) and r.lang_pred in langs | {"und"}
