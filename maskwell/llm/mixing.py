"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.llm._shared import free_name, materialize

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MOST_EPOCHS = 2
BUCKETS = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(key: Column) -> Column:
    """A 60-bit number from the md5 of the id's text: the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Sources sort by code point, null last, and take the weights in turn. They
    share share[0]/share[1] of all sizes by weight; none gets more than
    ``most_epochs`` times its size, and what is above goes to the rest by
    weight. With the sources sorted by cap/weight, those before some rank are
    at their cap and the rest share evenly by weight, so running sums give the
    result of the repeated resharing at once. Sums are of integers: exact.
    One row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    turn = (F.row_number().over(order) - 1) % n
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn.cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_epochs)
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double").alias("capped"),
        F.sum("weight").over(after).cast("double").alias("open"),
        (F.sum("source_size").over(everything).cast("double") * share[0] / share[1]).alias("budget"),
    )
    level = (F.col("budget") - F.col("capped")) / F.col("open")
    fits = level * F.col("weight") <= F.col("cap")
    # the water level is that of the first source that stays below its cap
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("capped"), level.alias("x")))).over(everything)["x"])
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most_epochs: int = MOST_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    A source's rows are ordered by a hash key; prefix sums of sizes cut its mix
    at the whole number below its target, after whole epochs where the target
    exceeds the source. The row at the cut counts in part. Rows tied in key and
    doc_id follow in order of size, then text.

    Prefix sums are distributed: each source's key range is cut in ``buckets``
    equal parts, running sums over the parts' totals (one row for each) give
    the offsets, and only a part is sorted in one place; a source with a third
    of all rows is spread like any other. Texts are read once and never
    shuffled; the narrow rows are kept in the shared folder.

    Null text: size 0, taken 0. Null source: a source of its own. Null ids hash
    as empty text. Empty table: no rows. All sizes 0: targets 0.
    """
    return _placed(docs, F.xxhash64("text"), F.lit(None), weights, share, most_epochs, buckets).drop("source", "tie", "tie_more")


def _placed(docs: DataFrame, tie: Column, tie_more: Column, weights, share, most_epochs: int, buckets: int) -> DataFrame:
    """``mix``'s rows with source and the two hashes that order rows tied in key, doc_id and size."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        word_count(F.col("text")).alias("size"),
        random_key(F.col("doc_id")).alias("key"),
        tie.alias("tie"),
        tie_more.cast("long").alias("tie_more"),
    ).withColumn("bucket", F.floor(F.col("key") / (2**60 / buckets)).cast("int"))
    narrow, _ = materialize(narrow, "sizes")
    parts = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    goals = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, most_epochs)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "bucket", F.coalesce(F.sum("part").over(running), F.lit(0)).alias("offset"))
    g, o = goals.alias("g"), offsets.alias("o")
    plan = o.join(g, F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.*", "g.source_size", "g.target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie", "tie_more").rowsBetween(Window.unboundedPreceding, -1)
    rows = narrow.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    n, p = rows.alias("n"), plan.alias("p")
    rows = n.join(p, F.col("n.source").eqNullSafe(F.col("p.source")) & (F.col("n.bucket") == F.col("p.bucket"))).select("n.*", "p.offset", "p.source_size", "p.target")
    budget = F.floor("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs, rest = F.floor(budget / size).cast("long"), budget % size
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset") - F.col("inside")))
    return rows.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + cut).alias("taken"), "source", "tie", "tie_more")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def emit_mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most_epochs: int = MOST_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row once for each whole time
    that its words are taken, and the row at its source's cut with the words
    that are taken of it. Rows of which nothing is taken go.

    Rows equal in all columns are one row here, with the words that all of them
    are to give: nothing tells them apart, and the mix still meets its targets
    to the word. They are made one before the shuffle, however many they are.
    Rows meet their numbers by 128 bits of hash over all columns.
    """
    # hashes over the columns that can be hashed (maps can't)
    plain = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    gaps = [c.isNull() for c in plain]
    one, two = F.xxhash64(*plain, *gaps), F.xxhash64(F.lit(7), *gaps, *plain)
    sums = _placed(docs, one, two, weights, share, most_epochs, buckets).where("taken > 0")
    names = [free_name(docs, c) for c in ("mix_one", "mix_two", "mix_size", "mix_taken", "mix_part")]
    h1, h2, size, taken, part = names
    sums = sums.groupBy(F.col("tie").alias(h1), F.col("tie_more").alias(h2)).agg(F.max("size").alias(size), F.sum("taken").alias(taken))
    once = docs.withColumns({h1: one, h2: two}).dropDuplicates([h1, h2])
    rows = once.join(sums, [h1, h2])
    times, rest = F.floor(F.col(taken) / F.col(size)).cast("int"), F.col(taken) % F.col(size)
    copies = F.concat(F.array_repeat(F.lit(None).cast("long"), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    # taken is above 0, so each row has a copy; the outer form adds no filter below
    rows = rows.withColumn(part, F.explode_outer(copies))
    text = F.when(F.col(part).isNull(), F.col("text")).otherwise(first_words(F.col("text"), F.col(part)))
    return rows.withColumn("text", text).select(*docs.columns)
