"""Every operator against brute force, on a small table of awkward rows, and on an empty one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graftwork.llm import common, language, licenses, mixing, nearjoin, packing, quality, queries, substring, tokens, topk, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Names that operators use inside.
CLASHING = ["doc", "words", "rid", "fp", "kept", "size", "start", "target", "bucket", "prompt", "id", "path", "dir", "part", "th", "label", "trusted", "n", "block"]


def awkward() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = say(60), say(400)
    near = base.split()
    near[17] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, "en", "b"), (5, "", None, None), (6, " \n\t ", "de", None),
        (7, say(30) + " " + passage + " " + say(20), "de", "c"), (8, say(5) + "\n" + passage + "\n" + say(80), "de", "c"), (9, passage, "en", "c"), (10, "one", "en", "d"), (11, "one", "en", "d"),
        (12, "ha " * 200, "de", "d"), (13, say(9000), "en", "a"), (14, "x" * 40_000, "en", "a"), (15, "é ß 漢字 <|endoftext|> 😀　a\x1cb", "de", "\U0001f600"), (None, base, "en", "a"),
        (16, say(100), "en", "a"), (16, say(100), "en", "a"), (17, passage + " " + passage, "de", "e"), (17, passage + " " + passage, "de", "e"), (18, "line one\nline one\n\nline # two &", "de", "e"),
    ]
    return rows


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["extra"] * len(CLASHING)) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def words(text):
    return (text or "").encode().split()


def test_count_tokens(docs, empty):
    slow = Tokenizer.from_file(PATH)
    got = Counter(map(tuple, tokens.count_tokens(docs, PATH, window=500, overlap=16).collect()))
    want = Counter()
    for i, t, *_ in awkward():
        n = len(slow.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert got == want
    assert tokens.count_tokens(empty, PATH).count() == 0


def test_windows_agree_with_the_library():
    enc, rng = tokens.Encoder(PATH), random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "the", "é", "<|endoftext|>", "1", "!", "　", "漢字", "\x1c", "\xa0", "'s", "😀", "İ"]
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randint(0, 120)))
        want = enc._whole(text)
        assert enc.ids(text).tolist() == want
        assert enc.count(text, rng.randint(2, 50), rng.randint(1, 20)) == len(want)


def test_boundaries_are_stable():
    enc, rng = tokens.Encoder(PATH), random.Random(2)
    bits = [" ", "\n", "the", "'", "'s", "re", "1", "!", "é", "漢字", "。", "<|endoftext|>", "<|end", "\x1c", "\u0378", "٣", "\u3000"]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        want = enc._whole(text)
        for p in enc.boundaries(text, 0, len(text)).tolist():
            assert enc._whole(text[:p]) + enc._whole(text[p:]) == want


@pytest.mark.parametrize("text", ["漢字" * 60_000, "漢字日本語。" * 20_000, "aB3+/x9" * 20_000, "x" * 120_000, "some words " * 12_000])
def test_huge_texts_are_encoded_about_once(monkeypatch, text):
    enc, sizes = tokens.Encoder(PATH), []
    whole, ids = len(enc.ids(text)), enc.ids
    monkeypatch.setattr(enc, "ids", lambda t: sizes.append(len(t)) or ids(t))
    assert enc.count(text) == whole and sum(sizes) <= 1.1 * len(text)


def test_ids_of_all_texts_are_the_library_s(spark):
    enc = tokens.Encoder(PATH)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        text = r.text or ""
        assert enc.ids(text).tolist() == enc._whole(text) and enc.count(text, 3000, 64) == len(enc._whole(text))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers(docs, name):
    rows = tokens.count_tokens(docs.where("doc_id in (1, 4, 15)"), public_tokenizers.path(name)).collect()
    assert len(rows) == 3 and all(r.n_tokens > 0 for r in rows if r.doc_id != 4)


@pytest.mark.parametrize("limits", [(1024, 64, 1024), (64, 3, 40)])
def test_pack(docs, empty, limits):
    slow = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH, *limits).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
    wanted = Counter()
    for i, t, *_ in awkward():
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        wanted[i, len(ids)] += 1
        if wanted[i, len(ids)] == 1 and (i, t) not in [(a, b) for a, b, *_ in awkward() if [x[0] for x in awkward()].count(a) > 1]:
            own = sorted(pieces[i, len(ids)], key=lambda r: r.start)
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            assert b"".join(r.ids for r in own) == ids.tobytes()
            assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        total = sum(r.length for r in s)
        assert total <= limits[0] and total & (total - 1) == 0 and len(s) <= limits[1] and sum(r.loss_tokens for r in s) <= limits[2]
    assert packing.pack(empty, PATH).count() == 0


def test_pack_prompts(spark):
    df = spark.createDataFrame([(i, "please answer this " * 30, "yes indeed " * i) for i in range(40)], "doc_id long, ask string, text string")
    rows = packing.pack(df, PATH, 128, 8, 32, prompt_col="ask").collect()
    by = defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.loss_tokens
    assert max(by.values()) <= 32
    slow = Tokenizer.from_file(PATH)
    assert sum(by.values()) == sum(len(slow.encode("yes indeed " * i).ids) + 1 for i in range(40))


def water_fill(sizes: dict, share=1.5, cap=2.0) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        w, over = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / w
            if target[s] >= cap * sizes[s]:
                over += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
        left = over
    return target


def test_mix(docs, empty):
    sizes = Counter()
    for _, t, _, s in awkward():
        sizes[s] += len(words(t))
    want = water_fill(sizes)
    rows = mixing.mix(docs, block_words=32, shard_slots=16).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((i, len(words(t)), s) for i, t, _, s in awkward())
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]) for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(2), block_words=32, shard_slots=16).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix_texts(empty).count() == 0


def test_targets_of_sources_that_tie(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 1000), (None, 1000)], "source string, source_size long")
    target = lambda d, w: {r.source: r.target for r in mixing.target_sizes(d, w, 1.5, 2.0).collect()}
    assert target(sizes.where("source is not null"), (5.0, 2.0, 1.0, 5.0)) == pytest.approx({"a": 1495, "b": 20, "c": 20, "d": 1495})
    got = target(sizes, (5.0, 2.0, 1.0, 5.0, 5.0))
    assert got == pytest.approx({"a": 4490 / 3, "b": 20, "c": 20, "d": 4490 / 3, None: 4490 / 3})


def test_mix_draws(docs):
    m = mixing.Mix(docs, block_words=32, shard_slots=16)
    slots = m.slots.collect()
    per_shard = Counter(r.shard for r in slots)
    assert all(n == 16 for s, n in per_shard.items() if s < max(per_shard))  # a shard has its slots, from several sources
    assert len({r.source for r in slots if r.shard == 0}) > 1
    whole = Counter((r.source, r.epoch, r.block) for r in slots)
    assert max(whole.values()) == 1 and all(0 <= r.block < r.n for r in slots)
    texts = mixing.mix_texts(docs, block_words=32, shard_slots=16)
    assert texts.columns == docs.columns
    assert sum(len(words(r.text)) for r in texts.collect()) == sum(r.taken for r in mixing.mix(docs, block_words=32, shard_slots=16).collect())


def test_output_shards_hold_their_slots(docs):
    how = {"block_words": 32, "shard_slots": 16}
    m = mixing.Mix(docs, **how)
    want = Counter()  # words of a shard by source: those of its slots
    for r in m.slots.collect():
        q, rest = divmod(r.source_size, r.n)
        want[r.shard, r.source] += round((q + (r.block < rest)) * min(1.0, r.part))
    want = +want
    got, rows = Counter(), mixing.mix(docs, **how).collect()
    for r in rows:
        pairs = [tuple(map(int, x.split(":"))) for x in r.shards.split()]
        assert pairs == sorted(set(pairs)) and sum(n for _, n in pairs) == r.taken
        for shard, n in pairs:
            got[shard, r.source] += n
    texts = Counter()
    for r in mixing.mix_texts(docs, shard_col="of_shard", **how).collect():
        texts[r.of_shard, r.source] += len(words(r.text))
    assert len({k for k, _ in want}) > 1 and got == want and texts == want


def repeat_words(w):
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    mark = [False] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            mark[i : i + 8] = [True] * 8
    return sum(mark)


MASK = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x ^ (x >> 31)


def grams_of(text, buckets):
    """Buckets of a text's n-grams, one at a time in whole numbers."""
    h = [xxhash.xxh3_64_intdigest(w) for w in words(text)]
    form = [xxhash.xxh3_64_intdigest(quality._shape(w)) for w in words(text)]

    def runs(x, n):
        out = []
        for i in range(len(x) - n + 1):
            v = 0
            for y in x[i : i + n]:
                v = (v * 0x9E3779B97F4A7C15 + y) & MASK
            out.append(mixed(v))
        return out

    again = [1 if a == b else 2 for a, b in zip(h, h[1:], strict=False)]
    return Counter(x % buckets for x in [*map(mixed, h), *map(mixed, form), *runs(h, 2), *runs(form, 2), *runs(form, 3), *again])


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 0), (12, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ratio = quality.fit(docs, labels)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score(docs, ratio).collect())
    want = Counter()
    for i, t, *_ in awkward():
        w = words(t)
        lines = [x for x in (t or "").split("\n") if x.encode().strip()]
        rep = repeat_words(w)
        want[i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)] += 1
    assert got == want
    # the model and the scores from counts of n-grams taken one at a time
    counts = np.zeros((2, quality.BUCKETS))
    for i, t, *_ in awkward():
        for b, n in grams_of(t, quality.BUCKETS).items():
            counts[:, b] += n * (i in (1, 2, 7)), n
    expected = counts[1] * counts[0].sum() / counts[1].sum()
    known = np.log((counts[0] + quality.PRIOR) / (expected + quality.PRIOR))
    assert np.allclose(ratio, known, atol=1e-5)
    texts = defaultdict(set)
    for i, t, *_ in awkward():
        texts[i].add(t)
    for r in quality.score(docs, ratio).where("doc_id <> 16").collect():
        grams = grams_of(next(iter(texts[r.doc_id])), quality.BUCKETS)
        llr = sum(known[b] * n for b, n in grams.items()) / max(1, grams.total())
        assert r.llr == pytest.approx(llr, abs=1e-5) and r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    assert not quality.fit(docs, labels.limit(0)).any()
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    assert quality.kept_documents(docs, ratio).columns == docs.columns


def test_quality_counts(docs):
    marked = docs.select("text", (F.coalesce(F.col("doc_id") == 1, F.lit(False))).alias("trusted"))
    want = np.zeros((2, 512))
    for i, t, *_ in awkward():
        for b, n in grams_of(t, 512).items():
            want[:, b] += n * (i == 1), n
    assert np.array_equal(quality.count_grams(marked, 512), want)


def test_quality_held_out(spark):
    """Labelled documents that the model wasn't fitted on."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = quality.score(docs, quality.fit(docs, labels.where(fitted))).join(labels.where(~fitted), "doc_id").where("not base_failed")
    by = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    print(by)
    assert by.get((1, True), 0) >= 0.98 * (by.get((1, True), 0) + by.get((1, False), 0)) and by.get((0, False), 0) >= 0.9 * (by.get((0, True), 0) + by.get((0, False), 0)) > 0


def test_substring(docs, empty):
    for length in (50, 8):
        first = {}
        for i, t, *_ in awkward():
            w = words(t)
            for k in range(len(w) - length + 1):
                if i is not None:
                    key = tuple(w[k : k + length])
                    first[key] = min(first.get(key, i), i)
        want = Counter()
        for i, t, *_ in awkward():
            w, gone = words(t), [False] * len(words(t))
            for k in range(len(w) - length + 1):
                if i is not None and first[tuple(w[k : k + length])] < i:
                    gone[k : k + length] = [True] * length
            kept = [x for x, g in zip(w, gone, strict=True) if not g]
            want[i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, length).collect()) == want
    assert substring.remove_repeats(empty).count() == 0


def test_substring_crowds(docs, monkeypatch):
    """Anchors with many passages are cut into windows, and large tables joined by a shuffle, with the same result."""
    want = sorted(map(str, substring.remove_repeats(docs, 8).collect()))
    monkeypatch.setattr(substring, "CROWD", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(str, substring.remove_repeats(docs, 8).collect())) == want


def shingle_set(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_classes(docs, empty, monkeypatch):
    monkeypatch.setattr(nearjoin, "CHUNK", 2)
    rows = {(i, t) for i, t, *_ in awkward() if i is not None and words(t)}
    sets = {r: shingle_set(r[1]) for r in rows}
    up = {r: r for r in rows}

    def find(r):
        while up[r] != r:
            r = up[r]
        return r

    links = Counter()
    for a in rows:
        for b in rows:
            if a < b and (a[1] == b[1] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                up[y] = x
    least = defaultdict(lambda: 1 << 60)
    for r in rows:
        least[find(r)] = min(least[find(r)], r[0])
    want = Counter((i, least[find((i, t))] if (i, t) in rows else i, links[i, t]) for i, t, *_ in awkward())
    assert Counter(map(tuple, nearjoin.near_classes(docs).collect())) == want
    assert nearjoin.near_classes(empty).count() == 0
    assert nearjoin.one_of_each(docs).columns == docs.columns


def test_near_group_of_many(spark):
    """A group of near copies over many chunks: every link is counted."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    want = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = sorted(map(tuple, nearjoin.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(i, 0, n) for i, n in enumerate(want)]


def test_bayes_rule():
    least = nearjoin.least_matches(0.8, 1e-6)
    assert all(a < b for a, b in zip(least, least[1:], strict=False))
    s, rng = np.arange(4000, dtype=np.uint64), np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = nearjoin.signature(keys[:3500]), nearjoin.signature(keys[500:])  # similarity 3000 / 4000
    assert abs((a == b).mean() - 0.75) < 0.15 and len(s)


def char_grams(text, buckets):
    """Buckets of a text's character n-grams, one at a time."""
    low = "".join((c.lower() if len(c.lower()) == 1 and ord(c) < 0x10000 else c) if c.isalpha() else " " for c in text)
    low, out = re.sub(" +", " ", low), Counter()
    for n in (1, 2, 3, 4):
        for i in range(len(low) - n + 1):
            h = 0
            for k, c in enumerate(low[i : i + n]):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + k + 1) & MASK
            out[((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & MASK) >> 40) % buckets] += 1
    return out


@pytest.mark.parametrize(("together", "block"), [(256, 1 << 17), (1, 50)])
def test_language(docs, empty, monkeypatch, together, block):
    monkeypatch.setattr(language, "TOGETHER", together)  # more languages than go together are scored in passes
    monkeypatch.setattr(language, "BLOCK", block)
    n = language.BUCKETS
    counts, prior = {x: np.ones(n) for x in ("de", "en")}, Counter()
    for _, t, lang, _ in awkward():
        if t is not None and lang:
            prior[lang] += 1
            for b, k in char_grams(t, n).items():
                counts[lang][b] += k
    log = {x: np.log(c / c.sum()) for x, c in counts.items()}
    model = language.train(docs.select("text", "lang"))
    assert model[0] == ["de", "en"] and np.allclose(model[1][:, :n], np.stack([log["de"], log["en"]]), atol=1e-5)
    got = defaultdict(list)
    for r in language.predict(docs, model, keep=(F.col("source"),)).collect():
        got[r.doc_id].append(r)
    assert Counter((i, r.source) for i, x in got.items() for r in x) == Counter((i, s) for i, _, _, s in awkward())
    for i, t, _, _ in awkward():
        if i == 16 or i is None:
            continue
        score = {x: np.log((prior[x] + 1) / (prior.total() + 2)) + sum(log[x][b] * k for b, k in char_grams(t or "", n).items()) for x in log}
        best = max(score, key=score.get)
        for r in got[i]:
            if not any(c.isalpha() for c in t or ""):
                assert (r.lang_pred, r.score) == ("und", 0)
            else:
                assert r.lang_pred == best and r.score == pytest.approx(1 / sum(np.exp(s - score[best]) for s in score.values()), abs=1e-2)
    nothing = language.train(empty.select("text", "lang"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_language_features_are_those_of_each_text():
    texts = ["Ab, c", "", "É!é", "x\U0001d4b3y 1"]
    folded, doc, has = language._fold(texts)
    assert has.tolist() == [True, False, True, True]
    (bucket, of), = language._grams(folded, doc, 1 << 15)
    for i, t in enumerate(texts):
        assert Counter(bucket[of == i].tolist()) == char_grams(t, 1 << 15)


def test_language_held_out(spark):
    """Accuracy on documents that weren't learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = language.predict(docs.where(held), language.train(docs.where(~held).select("text", "lang")), keep=(F.col("lang"),)).collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(300)]
    rows += [(i, rows[7][1], "x") for i in range(300, 360)] + [(400, None, "x"), (None, rows[0][1], "x"), (401, [1.0] * 5 + [float("nan")], "x"), (402, [1.0] * 5 + [None], "x"), (403, [float("inf")] * 6, "x"), (7, rows[9][1], "x"), (404, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    good = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int)) for i, v, _ in rows if i is not None and i < 400]
    want = Counter()
    for i, v in good:
        if i % 20 == 0:
            found = sorted((-int(v @ u), j) for j, u in good if j != i)[:5]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=50, leaf_rows=8)
    assert Counter(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    few = topk.top_k(df.where("vec_id < 4"), F.col("vec_id") == 0, k=20).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]


def test_top_k_large_values(spark):
    df = spark.createDataFrame([(0, [1e7, 1e7]), (1, [1e7, 1e7 + 1]), (2, [-1e7, 3.0])], "vec_id long, embedding array<double>")
    rows = topk.top_k(df, F.col("vec_id") == 0, k=2).collect()
    x = [[64 * 10**7] * 2, [64 * 10**7, 64 * (10**7 + 1)], [-64 * 10**7, 192]]
    assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(j, sum(a * b for a, b in zip(x[0], x[j], strict=True))) for j in (1, 2)]


def test_top_k_of_values_beyond_a_long(spark):
    """Scores are cut to a long before they are compared; a component that can't be scaled takes its row out."""
    df = spark.createDataFrame([(0, [1e20]), (3, [1e20]), (2, [3e20]), (5, [-1e20]), (6, [1e-3]), (7, [1e308])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in sorted(topk.top_k(df, F.col("vec_id") == 0, k=4).collect(), key=lambda r: r["rank"])]
    assert got == [(2, topk.LONG[1]), (3, topk.LONG[1]), (6, 0), (5, topk.LONG[0])]


def test_top_k_over_many_cells(spark, monkeypatch):
    """Clustered vectors, a crowd of equal ones, more shards than cells: as brute force, and bounds keep queries from most cells."""
    monkeypatch.setattr(topk, "MAX_CELLS", 16)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(16, 4)) * 8
    rows = [(i, [float(x) for x in centre[i % 16] + rng.normal(size=4) * 0.1]) for i in range(1200)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1200, 1700)] + [(i, [float(i % 3), 1.0]) for i in range(1700, 1760)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    good = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int)) for i, v in rows]
    want = Counter()
    for i, v in good:
        if i % 20 == 0:
            found = sorted((-int(v @ u), j) for j, u in good if j != i and len(u) == len(v))[:7]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found))
    routed, route = [], topk._route
    monkeypatch.setattr(topk, "_route", lambda *a: (out := route(*a), routed.append(out.count()))[0])
    assert Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, shard_rows=40, leaf_rows=8).collect())) == want
    assert len(routed) > 1 and sum(routed) < 16 * 88 / 2


def test_kd_tree_is_walked_best_first():
    rng = np.random.default_rng(3)
    x, ids = np.floor(rng.normal(size=(2000, 3)) * 100), np.arange(2000)
    tree = topk.build(ids, x, 16)
    for n, (a, b) in enumerate(tree["rows"]):  # boxes are tight, and children split their parent's rows
        assert (tree["lo"][n] == tree["x"][a:b].min(0)).all() and (tree["hi"][n] == tree["x"][a:b].max(0)).all()
        if tree["kids"][n][0]:
            left, right = tree["rows"][tree["kids"][n]]
            assert left[0] == a and left[1] == right[0] and right[1] == b
    best = topk.Best(np.full(30, -1), x[:30], np.full(30, -np.inf), 5)
    taken = best.walk(tree)
    for q in range(30):
        want = sorted((-s, i) for i, s in enumerate((x @ x[q]).tolist()))[:5]
        assert list(zip((-best.s[best.q == q]).tolist(), best.v[best.q == q].tolist(), strict=True)) == want
    assert taken < 30 * len(tree["lo"]) / 4


def test_one_row_of_each_class_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (None, c), (None, d), (None, d), (4, None), (4, None), (5, "")]
    want = [(1, a), (2, b), (3, c), (None, d), (4, None), (4, None), (5, "")]
    of = lambda r: Counter(tuple(x) for x in nearjoin.one_of_each(spark.createDataFrame(r, "doc_id long, text string").repartition(3)).collect())
    assert of(rows) == Counter(want)
    assert of([r for r in dict(rows).items() if r[0]]) == Counter([(1, a), (2, b), (3, c), (4, None), (5, "")])


def test_licenses(spark, docs, empty):
    mit, apache = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Apache-2.0"][0]
    rows = [("a/LICENSE", mit), ("a/x.py", "no word of it"), ("a/b/c/y.py", None), ("a/b/z.py", "code\n" + apache + "\nmore code of many words that say nothing at all about it"), ("d/w.py", ""), ("a/e/copying", apache), ("a/e/f/v.py", "v"), (None, "x"), ("u.py", "u")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.how, r.from_dir) for r in licenses.scan(df, F.col("path")).collect()}
    assert got == {
        0: ("MIT", "file", "a"), 1: ("MIT", "inherited", "a"), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "notice", None), 4: (None, None, None),
        5: ("Apache-2.0", "file", "a/e"), 6: ("Apache-2.0", "inherited", "a/e"), 7: (None, None, None), 8: (None, None, None),
    }
    assert licenses.scan(docs, F.concat_ws("/", "source", F.col("doc_id").cast("string"))).count() == len(awkward())
    assert licenses.scan(empty, F.lit("a/b")).count() == 0


ORDINARY = {
    "This file is licensed under the MIT License.": "MIT", "Copyright 2019 Foo Inc. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This library is released under the MIT License, see the file LICENSE for details.": "MIT", "some other prose on the line. Released under the BSD 3-Clause License. and more": "BSD-3-Clause",
    "# Copyright (c) 2021 The Authors.\n#\n# Licensed under the Apache License, Version 2.0\n# (the \"License\"); you may not use\n# this file": "Apache-2.0", "// SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
    "The code is distributed under the terms of the MIT license": "MIT", "You may use it under the GNU General Public License, version 2, or a later one": "GPL-2.0", "w1 w2\nThis work is licensed under CC BY-NC 4.0 by w3": "CC-BY-NC-4.0",
    "Licensed under the Foo License, Version 2.0.": None, "Released under the Artistic License": None, "Copyright 2020 by X. All rights reserved, no permission is granted.": None, "w1 license w2": None,
}


def test_ordinary_wording_has_its_license(spark, docs):
    rows = [(i, " ".join(f"w{(7 * i + j) % 90} the of" for j in range(40))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ORDINARY)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dict(zip(range(100, 200), ORDINARY.values(), strict=False))
    whole = {r.doc_id: (r.license, r.cosine) for r in licenses.scan(df, F.lit(None)).collect()}
    assert {i: whole[i][0] for i in want} == want and all(whole[i][0] is None for i in range(60))
    # all weights from brute force
    known = licenses.Templates(licenses.TEMPLATES, Counter(t for _, x in rows for t in set(licenses._terms(x))), len(rows))
    assert {i: x[1] for i, x in whole.items() if x[1] >= licenses.LEAST} == {i: pytest.approx(c, abs=1e-8) for i, t in rows if (c := known.best_span(licenses._word.findall(t.lower()))[0]) >= licenses.LEAST}
    # weights of rare terms that come by the join are those that come by broadcast
    assert {r.doc_id: (r.license, r.cosine) for r in licenses.scan(df, F.lit(None), hot_terms=1).collect()} == whole


def test_frequencies_are_those_of_all_documents(spark):
    texts = ["the MIT License of a", "the the of", None, "", "a of zz", "THE license, of Zz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    noted = {t for x in (texts[0], texts[5]) for t in licenses._terms(x)}
    got = licenses.frequencies(df, spark.createDataFrame([(t,) for t in licenses._long(noted)], "term long"))
    want = Counter(t for x in texts if x for t in set(licenses._terms(x)))
    assert {r.term % (1 << 64): r.n for r in got.collect()} == {t: n for t, n in want.items() if t in noted}


def license_of(text):
    known = licenses.Templates(licenses.TEMPLATES)
    words, runs = known.runs_of(text.encode())
    got = max((known.best_span(r.split(" ")) for r in runs), key=lambda x: x[3], default=(0.0, None))
    return got[1] if got[0] >= licenses.LEAST else None


def test_bodies_of_licenses():
    two = f"Copyright 2020 X\n\n{licenses._CONDITIONS}:\n\n1. {licenses._NOTICE_KEPT}\n\nTHIS SOFTWARE IS PROVIDED AS IS"
    three = two.replace("\n\nTHIS", "\n3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS")
    short = two[: two.index("Redistributions in binary")]
    assert [license_of(t) for t in (two, three, short)] == ["BSD-2-Clause", "BSD-3-Clause", "BSD-2-Clause"]
    assert 2 * max(licenses.Templates(licenses.TEMPLATES).words) <= licenses.SPAN  # no block cuts a span
    assert license_of("SPDX-License-Identifier: MIT") == "MIT" and license_of("Released under MIT.") == "MIT"
    for name, text in licenses.BEGINNINGS.items():
        assert license_of("\n".join(["w1 w2 w3"] * 300 + [text.replace(", ", ",\n   ")] + ["and so on"] * 500)) == name


def test_best_span_is_that_of_all_spans():
    rng, known = random.Random(3), licenses.Templates(licenses.TEMPLATES)
    templates = [(len(t.split()), licenses._terms(t), known.needed[k]) for k, t in enumerate(t for _, texts in sorted(licenses.TEMPLATES.items()) for t in texts)]
    norm = lambda x: np.sqrt(sum((n * known.weight.get(t, known.other)) ** 2 for t, n in x.items()))
    for _ in range(15):
        words, best = rng.choices("licensed under the mit license a b released apache version 2.0 this".split(), k=12), (False, 0.0)
        for i in range(12):
            for j in range(i + 1, 13):
                span = licenses._terms(" ".join(words[i:j]))
                for k, (n, other, needed) in enumerate(templates):
                    if j - i <= 2 * n and needed <= span.keys():
                        cosine = min(1.0, sum(c * other[t] * known.weight.get(t, known.other) ** 2 for t, c in span.items()) / norm(span) / norm(other))
                        best = max(best, known.order(cosine, k)[:2])
        assert known.best_span(words)[3][:2] == (best[0], pytest.approx(best[1]))


def test_inheritance_of_the_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    known = licenses.Templates(licenses.TEMPLATES, Counter(t for r in docs if r.text for t in set(licenses._terms(r.text))), sum(bool(r.text) for r in docs))
    own, where, given = {}, {}, {}
    for r in docs:
        every = licenses._word.findall((r.text or "").lower())  # all of it, whatever the scan leaves out
        cosine, name, n, _ = known.best_span(every)
        own[r.doc_id] = name if cosine >= licenses.LEAST else None
        where[r.doc_id] = f"{r.source}" if r.doc_id % 12 == 0 else f"{r.source}/{r.doc_id // 1000}"
        if own[r.doc_id] and (r.doc_id % 4 == 0 or 2 * n >= len(every)):
            given.setdefault(where[r.doc_id], []).append((-round(cosine, 9), name))
    want = {}
    for i, d in where.items():
        up = next((x for x in (d, d.split("/")[0]) if x in given), None)
        want[i] = own[i] or (up and min(given[up])[1])
    rows = queries.op5_licenses(spark, sf).collect()
    assert {r.doc_id: r.license for r in rows} == want
    assert {r.how for r in rows} == {"file", "notice", "inherited", None} and any(r.from_dir and "/" not in r.from_dir and "/0/" in r.path for r in rows if r.how == "inherited")


def test_cosine_is_that_of_dense_vectors():
    known = licenses.Templates(licenses.TEMPLATES)
    text = "Licensed under the Apache License, Version 3"
    terms = licenses._terms(text)
    best = 0.0
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            other = licenses._terms(t)
            w = {x: known.weight.get(x, known.other) for x in {*terms, *other}}
            dot = sum(terms[x] * other[x] * w[x] ** 2 for x in w)
            best = max(best, dot / np.sqrt(sum((terms[x] * w[x]) ** 2 for x in w) * sum((other[x] * w[x]) ** 2 for x in w)))
    assert known.best(text)[0] == pytest.approx(best)


def test_warc_audit(spark):
    rows = [(i, f"http://x/{i}", "é" * (i % 7) if i % 5 else None) for i in range(-3, 2500)]
    df = spark.createDataFrame([*rows, (None, None, None)], "page_id long, url string, html string")
    leaves = lambda d: warc.leaves(d, F.col("page_id"), warc.record(F.col("url"), F.col("html")))
    other = df.where("page_id is null or page_id not in (0, 1024)").withColumn("html", F.when(F.col("page_id").isin(16, 2048), F.lit("bad")).otherwise(F.col("html"))).unionByName(spark.createDataFrame([(5000, "u", "h")], df.schema))
    got = {r.number: (r.kind, r.offset, r.length) for r in warc.audit(leaves(df), leaves(other)).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "missing", 1024: "missing", 16: "changed", 2048: "changed", 5000: "extra"}

    def size(r):
        body = (r[2] or "").encode()
        return len(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {r[1]}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body) + 4

    assert got[16][1:] == (sum(size(r) for r in rows if 0 <= r[0] < 16), size(rows[19]))
    assert warc.audit(leaves(df), leaves(df)).count() == 0
    # rows without a number are no record -1, and repeated ones count; names that clash are ignored
    odd = spark.createDataFrame([(None, "u", "a" * 50_000, "x", "y"), (None, "u", "b", "x", "y"), (-1, "u", "c", "x", "y"), (1 << 60, "u", None, "x", "y"), (1 << 60, "u", None, "x", "y")], "page_id long, url string, html string, number string, hash string")
    at = lambda a, b: Counter((r.number, r.kind, r.length) for r in warc.audit(leaves(a), leaves(b)).collect())
    one = size((0, "u", None))
    assert at(odd, odd.where("page_id is not null")) == {(None, "missing", size((0, "u", "a" * 50_000)) + size((0, "u", "b"))): 1}
    assert at(odd, odd.where("page_id <> -1 or page_id is null")) == {(-1, "missing", size((0, "u", "c"))): 1}
    assert at(odd, odd.dropDuplicates(["page_id", "html"])) == {(1 << 60, "changed", 2 * one): 1} and at(odd, odd) == {}
    assert at(odd.where("page_id = -1"), odd.where("page_id is null or page_id = -1"))[None, "extra", size((0, "u", "a" * 50_000)) + size((0, "u", "b"))] == 1
    assert warc.audit(leaves(df.limit(0)), leaves(df.limit(0))).count() == 0


def test_contexts_of_texts_beyond_the_positions_of_a_key(monkeypatch):
    """A text that is cut keeps each window in one context, under the anchor that it has in a whole text."""
    h = common.hash_words([f"w{random.Random(k).randrange(40)}".encode() for k in range(1000)])
    whole = {f + i: a for a, f, n in zip(*(x.tolist() for x in np.array(substring.contexts(h, 10), object)[[0, 2, 3]]), strict=True) for i in range(n)}
    low = (1 << substring._POS) - 1
    monkeypatch.setattr(substring, "_POS", 7)
    got = {}
    for a, f, n in zip(*(x.tolist() for x in np.array(substring.contexts(h, 10), object)[[0, 2, 3]]), strict=True):
        for i in range(n):
            assert f + i not in got
            got[f + i] = a
    assert got.keys() == whole.keys() == set(range(991)) and low > 1000


def test_license_templates_longer_than_a_block(spark):
    rng = random.Random(9)
    own = " ".join(f"term{rng.randrange(400)}" for _ in range(600))
    text = " ".join(f"plain{k % 50}" for k in range(300)) + " " + own + " " + " ".join(f"plain{k % 50}" for k in range(700))
    df = spark.createDataFrame([(1, text), (2, "nothing of the kind")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, F.concat(F.lit("a/"), F.col("doc_id").cast("string")), templates={"Own": [own], "Other": ["This is another license."]}).collect()}
    assert got[1].license == "Own" and got[1].cosine == pytest.approx(1.0) and got[2].license is None


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("Licensed under GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("# SPDX-License-Identifier: LGPL-2.1-or-later\nimport os", "LGPL-2.1"), ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"),
        ("The code is under the GNU GPL version 3", "GPL-3.0"), ("This project is MIT licensed.", "MIT"), ("Distributed under the Boost Software License, Version 1.0. See LICENSE.", "BSL-1.0"),
        ("Licensed under the Eclipse Public License, Version 2.0", "EPL-2.0"), ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("Released under the zlib license", "Zlib"),
        ("SPDX-License-Identifier: MIT", "MIT"), ("License: Apache-2.0", "Apache-2.0"), ("we only go there or later", None), ("the general public was there, version 3 or not", None),
    ],
)
def test_names_of_licenses(text, license):
    known = licenses.Templates(licenses.TEMPLATES)
    cosine, name, *_ = known.best_span(licenses._word.findall(text.lower()))
    assert (name if cosine >= licenses.LEAST else None) == license
