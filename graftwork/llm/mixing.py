"""Mixing sources to target weights, in DataFrame functions only.

Each source's documents, in a fixed pseudorandom order, form a line of words that is cut into blocks of equal length
(``block_words``, up to the rounding that lets them fill the line). A source with target t over blocks of b words takes
ceil(t / b) slots, the last of them in part, so totals meet the targets. The slots of all sources are dealt to
output shards by a permutation of all slot numbers: each shard's source counts are multinomial draws on condition
that the totals over all shards are the targets (without that condition, small sources would miss theirs by chance). Slot
k of a source reads block perm_e(k mod n) of epoch e = k div n, where perm_e is a keyed pseudorandom permutation of the
source's n block indexes; slots and blocks are joined by that index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1024
#: Slots of an output shard: about 260,000 words.
SHARD_SLOTS = 256
#: Slots of a source that are made together.
RUN_SLOTS = 4096
#: Rows of a source that are put in order together, on average.
BUCKET_ROWS = 2000
#: Repeats of one row that are laid out by one task.
REPEATS = 1024


def target_sizes(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> target: weights by rank in code point order, null last, repeating.

    All targets share ``share`` x the whole size by weight; those over cap x their source's size stop there and the
    rest is shared anew, until none is above. In closed form: with sources in the order of cap x size / weight, the
    first ones stop at their cap, and the rate of the others is what is left by weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    most = F.col("source_size") * F.lit(float(cap))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    all_ = W.partitionBy()
    r = ranked.withColumn("ratio", most / F.col("w"))
    r = r.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(all_) - F.coalesce(F.sum(most).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    r = r.withColumn("rate", F.col("left") / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))))
    # the first source in this order that the rate doesn't lift over its cap fixes the rate of it and all after it
    r = r.withColumn("level", F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("null"), "source", "rate"))).over(all_)["rate"])
    return r.select("source", "source_size", F.least(most, F.coalesce(F.col("level") * F.col("w"), most)).alias("target"))


def lay_out(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mark: Column | None = None) -> DataFrame:
    """doc_id, source, size, mark (a hash of the row), m (how many rows are like this one) and start: the words of its source before it.

    Texts are read once. Order within a source: by a bucket of the hashes of id and row, then id, size and row hash, so rows of one
    id have an order too. Equal rows are counted before anything is dealt out; buckets hold about BUCKET_ROWS rows whatever the
    source's share, and their totals are summed up in a second step.
    """
    mark = F.xxhash64(df[text_col]) if mark is None else mark
    rows = df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mark.alias("mark"))
    docs = materialize(rows.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("m")), "sizes")
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    laid = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    inner = W.partitionBy("source", "bucket").orderBy("doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, 0)
    laid = laid.withColumn("upto", F.sum(F.col("size") * F.col("m")).over(inner))
    totals = laid.groupBy("source", "bucket").agg(F.max("upto").alias("total"))
    outer = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.withColumn("base", F.coalesce(F.sum("total").over(outer), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    joined = laid.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    out = materialize(joined.select("doc_id", "source", "size", "mark", "m", (F.col("base") + F.col("upto") - F.col("size") * F.col("m")).alias("start")), "mix")
    discard(docs)
    return out


def each_row(docs: DataFrame) -> DataFrame:
    """A row of its own, with its own start, for each of the rows that were counted together."""
    every = lambda d, lo, hi: d.withColumn("i", F.explode(F.sequence(lo, hi))).withColumn("start", F.col("start") + F.col("i") * F.col("size")).drop("i")
    few = every(docs.where(F.col("m") <= REPEATS), F.lit(0).cast("long"), F.col("m") - 1)
    many = docs.where(F.col("m") > REPEATS).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("m") - 1).cast("long"), F.lit(REPEATS).cast("long"))))
    many = many.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "mark", "lot")
    return few.unionByName(every(many, F.col("lot"), F.least(F.col("lot") + REPEATS, F.col("m")) - 1).drop("lot"))


def plan_sources(sizes: DataFrame, weights, share, cap, block_words: int) -> DataFrame:
    """A row for each source: its size, target, number of blocks n, slots and the first of its slot numbers."""
    t = target_sizes(sizes, weights, share, cap)
    n = F.greatest(F.lit(1), F.round(F.col("source_size") / block_words)).cast("long")
    t = t.withColumn("n", n).withColumn("slots", F.least(F.ceil(F.col("target") * F.col("n") / F.greatest(F.col("source_size"), F.lit(1)) - 1e-9), F.ceil(F.lit(float(cap)) * F.col("n"))).cast("long"))
    first = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return t.withColumn("first", F.coalesce(F.sum("slots").over(first), F.lit(0)))


def draw_slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """A row for each slot: shard, source, epoch, block, and part: which share of the block it takes."""
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # slots are made from runs, so that a hot source's are made by many tasks
    runs = plan.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("slots") - 1) / RUN_SLOTS)).cast("int"))).alias("run")).where("slots > 0")
    # a number of its own: these rows are few and small, what is made of them isn't
    runs = runs.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("source"), F.col("run"))
    lo = F.col("run").cast("long") * RUN_SLOTS
    s = runs.select("source", "source_size", "target", "n", "slots", "first", F.explode(F.sequence(lo, F.least(lo + RUN_SLOTS, F.col("slots")) - 1)).alias("k"))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("source").cast("string"), F.lit("\0")), F.floor(F.col("k") / F.col("n")).cast("long"))
    s = s.withColumn("epoch", F.floor(F.col("k") / F.col("n")).cast("int"))
    s = s.withColumn("block", permutation(F.col("k") % F.col("n"), F.col("n"), key))
    s = s.withColumn("shard", F.floor(permutation(F.col("first") + F.col("k"), F.lit(max(1, total)), F.xxhash64(F.lit(seed), F.lit("shards"))) / shard_slots).cast("long"))
    exact = F.col("target") * F.col("n") / F.greatest(F.col("source_size"), F.lit(1))
    return s.withColumn("part", F.least(F.lit(1.0), exact - F.col("k"))).select("shard", "source", "epoch", "block", "part", "n", "source_size")


def permutation(x: Column, n: Column, key: Column, rounds: int = 24) -> Column:
    """A keyed pseudorandom bijection of 0 .. n-1: swap-or-not rounds.

    In a round x and its partner (pivot - x) mod n change places, or not, by a keyed hash of the larger of the two. Each
    round is a bijection of 0 .. n-1 whatever n is. The rounds are an aggregate over their numbers, so the expression
    stays small.
    """

    def round_(v: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(key, r) - v, n)
        return F.when(F.xxhash64(key, r, F.greatest(v, other)) >= 0, v).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), round_)


def block_start(j: Column) -> Column:
    """Words of a source before its block j: the first source_size mod n blocks have a word more than the others."""
    return j * F.expr("source_size div n") + F.least(j, F.expr("source_size % n"))


def block_of(pos: Column) -> Column:
    """The block in which a source's word ``pos`` lies."""
    q, r = F.expr("source_size div n"), F.expr("source_size % n")
    wide = r * (q + 1)
    return F.when(pos < wide, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - wide) / F.greatest(q, F.lit(1)))).cast("long")


def _takes(slots: DataFrame) -> DataFrame:
    """How often each block is taken whole, the share of it that a last slot takes, and ``by``: its slots, whole ones first."""
    by = F.sort_array(F.collect_list(F.struct((F.col("part") < 1).alias("cut"), "epoch", "shard")))
    return slots.groupBy("source", "block").agg(F.count(F.when(F.col("part") >= 1, 1)).alias("whole"), F.coalesce(F.max(F.when(F.col("part") < 1, F.col("part"))), F.lit(0.0)).alias("part"), by.alias("by"))


def _overlaps(docs: DataFrame, plan: DataFrame, takes: DataFrame, keys: list[str]) -> DataFrame:
    """(document, block) pairs with the words a..b of the document in it, the whole takes of it, ``to``: where a part ends, and ``by``: its shards."""
    d = docs.where("size > 0").select(*keys).join(_named(plan, "source_size", "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))))
    t = takes.select(F.col("source").alias("s"), F.col("block").alias("j"), "whole", "part", "by").hint("merge")  # it grows with the data
    d = d.join(t, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("j"))).drop("s", "j")
    lo, hi = block_start(F.col("block")), block_start(F.col("block") + 1)
    d = d.withColumn("lo", lo).withColumn("hi", hi)
    a = F.greatest(F.col("start"), F.col("lo")) - F.col("start")
    b = F.least(F.col("start") + F.col("size"), F.col("hi")) - F.col("start")
    to = F.col("lo") + F.round(F.col("part") * (F.col("hi") - F.col("lo"))).cast("long") - F.col("start")
    return d.select(*keys, a.alias("a"), b.alias("b"), "whole", F.greatest(a, F.least(b, to)).alias("to"), "by")


def _named(plan: DataFrame, *columns: str) -> DataFrame:
    return broadcast_if_small(plan.select(F.col("source").alias("s"), *columns), F.lit(64) + F.coalesce(F.octet_length(F.col("s").cast("string")), F.lit(0)))


class Mix:
    """The parts of a mix: ``docs`` (laid out, a row for each row), ``sources``, ``slots``; all are DataFrames."""

    def __init__(self, df: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mark: Column | None = None) -> None:
        if share > cap or min(weights) <= 0 or block_words < 1:
            raise ValueError("weights must be positive, and share at most cap")
        laid = lay_out(df, id_col, text_col, source_col, mark)
        sizes = laid.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
        self.docs = each_row(laid)
        # a row for each source; the running sums over them are one task's work
        self.sources = materialize(plan_sources(sizes, tuple(map(float, weights)), share, cap, block_words), "sources")
        self.slots = draw_slots(self.sources, shard_slots, seed)


def mix(df: DataFrame, **how) -> DataFrame:
    """doc_id, source, size (words), source_size, target (of its source, in words), taken (words that the mix takes),
    shards (which output shards take how many of these words: "shard:words" by a space, in the order of shards; else empty).

    A row for each row of ``df``. Null texts have size 0; a null source is a source of its own, last in order; null ids
    stay null; repeated rows each have their own place; a document without words, or of a source without any, takes 0;
    an empty table gives an empty result. Reruns agree: all draws are hashes of ``seed``, source and index, and rows of one id
    are told apart by their texts.
    """
    m = Mix(df, **how)
    taken = F.col("whole") * (F.col("b") - F.col("a")) + F.col("to") - F.col("a")
    keys = ["doc_id", "source", "size", "start"]
    by = F.transform("by", lambda x: F.struct(x["shard"].alias("shard"), (F.when(x["cut"], F.col("to")).otherwise(F.col("b")) - F.col("a")).alias("n")))
    got = _overlaps(m.docs, m.sources, _takes(m.slots), keys).groupBy("source", "start").agg(F.sum(taken).alias("taken"), F.flatten(F.collect_list(by)).alias("by"))
    some = F.filter("by", lambda x: x["n"] > 0)
    of = lambda shard: F.aggregate(F.filter(some, lambda x: x["shard"] == shard), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    shards = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(some, lambda x: x["shard"]))), lambda k: F.concat_ws(":", k.cast("string"), of(k).cast("string"))), " ")
    got = got.select(F.col("source").alias("s"), F.col("start").alias("at"), "taken", shards.alias("shards")).hint("merge")
    some = m.docs.where("size > 0").join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")), "left").select(*keys, "taken", "shards")
    rows = some.unionByName(m.docs.where("size = 0").select(*keys, F.lit(None).cast("long").alias("taken"), F.lit("").alias("shards")))
    return rows.join(_named(m.sources, "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def mix_texts(df: DataFrame, shard_col: str | None = None, **how) -> DataFrame:
    """The mix itself, in the columns of ``df``: a row for each copy of a document that the mix takes, shard by shard.

    A copy taken whole keeps its text as it is; of one taken in part, the words taken are joined by a space. A copy belongs to
    the shard of the slot that takes its first words; the rows of a shard lie in one partition, in pseudorandom order, so
    that sources are mixed in what is written. With ``shard_col``, a further column of that name, copies are cut where shards
    are: a row for the words of a document that a shard takes in an epoch. Rows without words aren't in the mix; null ids and
    sources, repeated rows and empty tables are as in ``mix``.

    Texts meet the mix once, at the end, by id and a hash of the whole row.
    """
    id_col, text = how.get("id_col", "doc_id"), how.get("text_col", "text")
    keys = ["doc_id", "source", "size", "start", "mark", "m"]
    mark = F.xxhash64(*(df[c] for c in df.columns))
    m = Mix(df, mark=mark, **how)
    o = _overlaps(m.docs, m.sources, _takes(m.slots), keys).select(*keys, "a", "b", "to", F.posexplode("by").alias("copy", "x"))
    o = o.withColumn("end", F.when(F.col("x.cut"), F.col("to")).otherwise(F.col("b"))).where("end > a")
    if shard_col:
        o = o.withColumn("copy", F.struct("x.shard", "x.epoch"))
    got = o.groupBy(*keys, "copy").agg(F.sum(F.col("end") - F.col("a")).alias("n"), F.sort_array(F.collect_list(F.struct("a", "end"))).alias("runs"), F.min_by("x.shard", "a").alias("shard"))
    got = materialize(got.select(F.col("doc_id").alias("of"), "size", F.xxhash64("mark", "start", "copy").alias("place"), F.col("mark").alias("marked"), "m", "n", "runs", "shard"), "taken")
    texts = df.select(*(df[c].alias(f"kept_{c}") for c in df.columns), mark.alias("mark"))
    same = lambda a, b: a[f"kept_{id_col}"].eqNullSafe(b["of"]) & (a["mark"] == b["marked"])
    size = F.lit(96) + 16 * F.size("runs")
    once = broadcast_if_small(got.where("m = 1"), size)
    rows = texts.join(once, same(texts, once))
    many = got.where("m > 1")
    if not many.isEmpty():  # equal rows: one of them stands for all, and is met by each copy of each
        names = many.select("of", "marked").distinct()
        one = texts.join(names, same(texts, names), "left_semi").dropDuplicates([f"kept_{id_col}", "mark"])
        rows = rows.unionByName(one.join(many, same(one, many)))
    words = F.regexp_extract_all(F.col(f"kept_{text}"), F.lit(WORD), 0)
    part = F.array_join(F.flatten(F.transform("runs", lambda x: F.slice("words", (x["a"] + 1).cast("int"), (x["end"] - x["a"]).cast("int")))), " ")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place")
    rows = rows.withColumn("words", F.when(F.col("n") < F.col("size"), words)).withColumn("part", F.when(F.col("n") < F.col("size"), part))
    out = {text: F.coalesce("part", f"kept_{text}")}
    if "n_chars" in df.columns:
        out["n_chars"] = F.when(F.col("part").isNotNull(), F.length("part")).otherwise(F.col("kept_n_chars")).cast(df.schema["n_chars"].dataType)
    return rows.select(*(out.get(c, F.col(f"kept_{c}")).alias(c) for c in df.columns), *([F.col("shard").alias(shard_col)] if shard_col else []))
