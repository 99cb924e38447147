"""The string kernel and its table against the definition, the folding of texts, held-out documents and insults written in odd ways."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from graftwork.llm import queries, toxicity
from graftwork.llm.toxicity import DECAY, SPAN, N

SF = "/root/testdata/sf0.1"
INSULT = re.compile(r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b", re.IGNORECASE)


def shown(f):
    """Folded sentences as text."""
    text = "".join(" " if s == 0 else chr(96 + s) if s < 27 else "?" for s in f.sign.tolist())
    return [text[a : b + 1] for a, b in zip(f.edge, f.edge[1:], strict=False)]


def test_folding():
    texts = ["Hello,  World!! Is it?\nÉté 3.5 Straße. ", "", " \n ", "you i.d.i.o.t now", "no end", "漢字 a b", "a\x00b c"]
    f = toxicity.fold(texts)
    assert shown(f)[:6] == [" hello world ", " is it ", " ete stra?e ", " you idiot now ", " no end ", shown(f)[5]]
    assert f.doc.tolist() == [0, 0, 0, 3, 4, 5, 6]
    for none in ([], [""], ["", "1 2 3"]):
        assert not len(toxicity.fold(none).doc)


def phi(word):
    """key -> weight by the definition: all N places within SPAN."""
    out = {}
    for at in combinations(range(len(word)), N):
        if at[-1] - at[0] < SPAN:
            key = "".join(word[i] for i in at)
            out[key] = out.get(key, 0) + DECAY ** (at[-1] - at[0] + 1 - N)
    return out


def kernel(s, t):
    a, b = phi(s), phi(t)
    return sum(a[u] * b[u] for u in a.keys() & b.keys())


def fold_one(s):
    return toxicity.fold([s])


def test_features_are_whitened_kernel_values():
    words = [" idiot ", " moron ", " edition ", " the "]
    marks = toxicity.Landmarks([fold_one(w).sign.tobytes() for w in words])
    length = [kernel(w, w) ** 0.5 for w in words]
    gram = np.array([[kernel(a, b) / x / y for b, y in zip(words, length, strict=True)] for a, x in zip(words, length, strict=True)])
    f = toxicity.fold(["an idxiot", "editing"])
    got = marks.features(f, f.edge[:-1])
    value, vector = np.linalg.eigh(gram)
    for text, x in zip(shown(f), got, strict=True):
        k = np.array([kernel(text, w) / n for w, n in zip(words, length, strict=True)])  # shorter than a run, so all of it counts
        assert np.allclose(x, k @ vector / np.sqrt(value))
    # the table gives the machine's value of the best run
    weight = np.array([0.5, -1.0, 2.0, 0.25])
    run = toxicity._runs(f, marks.table(weight))
    assert np.allclose(run[f.edge[:-1]], got @ weight, atol=1e-4)


def test_runs_stay_within_sentences():
    rng = random.Random(3)
    table = np.zeros(1 << 20, np.float32)
    marks = toxicity.Landmarks([fold_one(" abcabc ").sign.tobytes()])
    table[marks.keys] = 1
    for _ in range(50):
        texts = ["".join(rng.choices("abc .\n", weights=[5, 5, 5, 2, 1, 1], k=rng.randint(0, 60))) for _ in range(4)]
        f = toxicity.fold(texts)
        if len(f.doc):
            got, at = toxicity._sums(f, table), 0
            keys = set(phi(" abcabc "))
            for s in shown(f):
                for i in range(len(s) - 1):
                    want = sum(DECAY ** (o[-1] - N + 1) for o in combinations(range(1, SPAN), N - 1) if i + o[-1] < len(s) and "".join([s[i], *(s[i + d] for d in o)]) in keys)
                    assert got[at + i] == pytest.approx(want, abs=1e-4)
                at += len(s) - 1


def test_the_machine_separates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(2, 0.5, (50, 3)), rng.normal(-2, 0.5, (500, 3))])
    y = np.r_[np.ones(50), -np.ones(500)]
    w, b = toxicity.machine(x, y, np.ones(len(y)))
    assert (np.sign(x @ w + b) == y).all()


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))


def test_held_out_documents(spark, model):
    """Against the labels of documents that weren't learned from: other languages have insults of their own, which no list here knows."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts, label = dict(docs.select("doc_id", "text").collect()), dict(labels.select("doc_id", "toxic").collect())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got.keys() == texts.keys() and all(0 <= s <= 1 for s in got.values())
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    english = [i for i in held if INSULT.search(texts[i] or "")]
    assert len(english) > 150 and np.mean([got[i] >= 0.7 for i in english]) >= 0.97
    bad, good = ([i for i in held if label.get(i) == x] for x in (1, 0))
    # so small a table has few toxic documents of each other language, and labels that no sentence earns
    assert len(bad) > 100 and np.mean([got[i] >= 0.7 for i in bad]) >= 0.5
    assert len(good) > 1000 and np.mean([got[i] >= 0.7 for i in good]) <= 0.005


def test_insults_in_odd_writing(spark, model):
    odd = ["You are an i d i o t.", "such an I-D-I-O-T", "what a stuupid man", "an IDIOT!", "c.l.o.w.n", "he is w o r t h l e s s", "a loseer", "id-iot", "an idxiot", "pa-thetic", "morron", "trassh"]
    fair = ["The edition of this.", "hello dear friend", "he is on the list", "", "12 34", None]
    df = spark.createDataFrame(list(enumerate(odd + fair)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert np.mean([got[i] >= 0.7 for i in range(len(odd))]) >= 0.75 and all(got[i] < 0.3 for i in range(len(odd), len(odd + fair)))


def test_awkward_rows(spark, model):
    rows = [(None, "idiot", "x"), (1, None, "x"), (2, "", None), (3, "idiot " + "fair words " * 200_000 + "\n", "x"), (3, "fair words " * 200_000 + " you idiot", "x"), (4, "x" * 3_000_000, "x"), (4, "é漢\x00😀", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(2)
    got = sorted(map(tuple, toxicity.score(df, model).collect()), key=str)
    assert len(got) == len(rows) and [s >= 0.7 for i, s in got if i == 3] == [True, True] and all(s < 0.3 for i, s in got if i in (1, 2, 4))
    assert toxicity.score(df.where("doc_id < 0"), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "idiot"), (2, None), (None, "fair")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(None, 1), (1, None)]):
        m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert m.table is None and {r.score for r in toxicity.score(docs, m).collect()} == {0.0}


def test_query(spark):
    rows = queries.op12_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
