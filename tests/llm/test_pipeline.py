"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from graftwork.llm import mixing, nearjoin, quality
from graftwork.storage import materialize

from .test_operators import awkward, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), name))
    return docs


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[1:-1])


def test_rules(spark, steps):
    ratio = quality.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(steps[0], ratio).where("kept").collect()}
    assert {r.doc_id: r.text for r in steps[1].collect()} == {r.doc_id: r.text for r in steps[0].collect() if r.doc_id in kept}


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_document_of_each_class_stays(steps):
    before = {r.doc_id: grams(r.text) for r in steps[1].collect()}
    up = {i: i for i in before}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(before)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(i for i in ids if find(i) == i)


def test_passages(steps):
    rows = sorted(steps[2].collect(), key=lambda r: r.doc_id)
    first: dict = {}
    want = {}
    for r in rows:
        w, gone, new = r.text.encode().split(), set(), []
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if first.get(key, r.doc_id) < r.doc_id:
                gone |= set(range(i, i + 50))
            else:
                new.append(key)
        first |= dict.fromkeys(new, r.doc_id)
        want[r.doc_id] = r.text if not gone else b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert {r.doc_id: r.text for r in steps[3].collect()} == {i: t for i, t in want.items() if t.split()}


def test_mix(steps):
    texts = {r.doc_id: r.text.encode().split() for r in steps[3].collect()}
    total = sum(map(len, texts.values()))
    got, copies = defaultdict(Counter), Counter()
    for r in steps[4].collect():
        own = Counter(r.text.encode().split())
        assert not own - Counter(texts[r.doc_id])
        got[r.doc_id] += own
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3 and all(n <= 2 * texts[i].count(w) for i, c in got.items() for w, n in c.items())
    assert sum(sum(c.values()) for c in got.values()) == pytest.approx(1.5 * total, rel=0.01)


def test_sequences(steps):
    sequences = defaultdict(list)
    for r in steps[5].collect():
        sequences[r.sequence_id].append((r.offset, r.length, len(r.ids)))
    for s in sequences.values():
        s.sort()
        at = 0
        for offset, length, size in s:
            assert offset == at and size == 4 * length
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert sum(n for s in sequences.values() for _, n, _ in s) == sum(r.doc_tokens for r in steps[5].where("start = 0").collect())


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, awkward()).cache()


def of(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_rules_on_awkward_rows(spark, odd):
    got = corpus_pipeline.keep_good(spark, odd, SF)
    assert got.columns == odd.columns
    scored = quality.score(odd, quality.fit(odd, spark.read.parquet(f"{SF}/labels.parquet")), keep=("text",))
    assert of(got.collect()) == Counter((r.doc_id, r.kept_text) for r in scored.where("kept").collect())


def test_one_of_each_on_awkward_rows(spark, odd):
    rows = sorted(((i, t) for i, t, *_ in awkward()), key=lambda r: (r[0] is None, r[0] or 0))
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    sets = [grams(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert got.columns == odd.columns
    assert of(got.collect()) == Counter(r for k, r in enumerate(rows) if find(k) == k)


def test_passages_on_awkward_rows(spark, odd):
    first: dict = {}
    for i, t, *_ in awkward():
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t, *_ in awkward():
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        if not w or len(gone) < len(w):
            want[i, t if not gone else b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    got = corpus_pipeline.drop_repeated_passages(spark, odd, SF)
    assert got.columns == odd.columns and of(got.collect()) == want


def test_mixing_on_awkward_rows(spark, odd):
    got = corpus_pipeline.mix_sources(spark, odd, SF)
    again = Counter(map(str, corpus_pipeline.mix_sources(spark, odd.repartition(2), SF).collect()))
    rows = got.collect()
    assert got.columns == odd.columns and Counter(map(str, rows)) == again  # reruns agree, whatever the order of the rows
    taken = Counter()
    limit = Counter()
    for i, t, _, s in awkward():
        for w in (t or "").encode().split():
            limit[i, s, w] += 2
    for r in rows:
        assert r.doc == "extra" and r.text.split()
        taken.update((r.doc_id, r.source, w) for w in r.text.encode().split())
    assert all(n <= limit[k] for k, n in taken.items())
    total = sum(len((t or "").encode().split()) for _, t, *_ in awkward())
    assert taken.total() == pytest.approx(1.5 * total, rel=0.02)


def test_packing_on_awkward_rows(spark, odd):
    rows = corpus_pipeline.pack_sequences(spark, odd, SF).collect()
    whole = Counter()
    for r in rows:
        if r.start == 0:
            whole[r.doc_id, r.doc_tokens] += 1
    assert whole.total() == len(awkward()) and sum(r.length for r in rows) == sum(n * k for (_, n), k in whole.items())


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_empty_tables(spark, name, stage):
    got = stage(spark, frame(spark, []), SF)
    assert got.count() == 0 and (name == "packing" or got.columns == frame(spark, []).columns)


def test_mix_is_laid_out_by_shards(spark, steps):
    """The seed and the size of shards move texts between shards, and change no total."""
    totals, order = set(), set()
    for how in ({}, {"seed": 1}, {"block_words": 64, "shard_slots": 8}):
        rows = mixing.mix_texts(steps[3], shard_col="of_shard", **how).collect()
        totals.add(round(sum(len(r.text.split()) for r in rows) / 100))
        order.add(tuple(sorted((r.of_shard, r.doc_id) for r in rows)))
    assert len(totals) <= 2 and len(order) == 3
    plan = mixing.mix_texts(steps[3])._jdf.queryExecution().toString()
    assert "hashpartitioning(shard" in plan


def test_one_of_each_with_names_of_its_own(spark):
    """Columns named as the operator names its own, with and without repeated ids."""
    names = ["gone_id", "number_of_row", "d", "f", "kept_0", "kept_1", "class_id", "doc"]
    text = "a b c d e f g h i j k l m n o p"
    for ids, left in (([1, 2, 3], [1, 3]), ([1, 1, 2], [1, 2])):
        texts = [text, text, "something else altogether is said here"]
        df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
        got = nearjoin.one_of_each(df)
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == left and all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
