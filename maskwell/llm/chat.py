"""Chat formatting: quotation linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm._shared import drop_path, free_name, materialize

MARKS = "^(?:[ \\t]*>)+"


def with_passages(df: DataFrame, text: str, lines: str, runs: str) -> DataFrame:
    """``df`` with ``lines``, the text's lines as (level, line), and ``runs``, runs of
    lines of equal quote level as (level, ord, lines).

    A line's level is its number of leading ``>`` marks (spaces and tabs may
    stand between); marks and outer white space are taken off the line. Each
    step is a column of its own: a lambda would evaluate a nested expression
    anew for each element.
    """
    first = free_name(df, f"{runs}_first")
    pieces = F.split(F.coalesce(text, F.lit("")), "\\r?\\n", -1)
    df = df.withColumn(lines, F.transform(pieces, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[ \\t]", "")).alias("level"),
        F.regexp_replace(F.regexp_replace(x, MARKS, ""), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "").alias("line"),
    )))
    at = F.col(lines)
    df = df.withColumn(first, F.filter(
        F.sequence(F.lit(1), F.size(at)),
        lambda i: (i == 1) | (F.element_at(at, i)["level"] != F.element_at(at, F.greatest(i - 1, F.lit(1)))["level"]),
    ))
    starts = F.col(first)
    return df.withColumn(runs, F.transform(
        starts,
        lambda s, k: F.struct(
            F.element_at(at, s)["level"].alias("level"),
            (k + 1).alias("ord"),
            F.transform(F.slice(at, s, F.coalesce(F.get(starts, k + 1), F.size(at) + 1) - s), lambda x: x["line"]).alias("lines"),
        ),
    )).drop(first)


def normal(lines: Column) -> Column:
    """Lines as one string: lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.array_join(lines, " ")), "[\\x20\\x09-\\x0D]+", " "))


def line_hashes(lines: Column) -> Column:
    """A hash of each line that isn't blank, in its normal form."""
    return F.transform(F.filter(F.transform(lines, lambda x: normal(F.array(x))), lambda x: x != ""), lambda x: F.xxhash64(x))


def span_key(hashes: Column, start: Column, size: Column) -> Column:
    """Key of ``size`` consecutive line hashes; no key of a text's md5 looks like it."""
    return F.concat(size.cast("string"), F.lit(":"), F.hex(F.xxhash64(F.slice(hashes, start, size))))


def paragraphs(lines: Column) -> Column:
    """The normal form of each run of lines between blank ones."""
    bare = F.transform(lines, lambda x: F.regexp_replace(x, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""))
    return F.transform(F.split(F.array_join(bare, "\n"), "\n{2,}", -1), lambda x: normal(F.array(x)))


def _resolve(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) -> also root_turn and depth, by pointer doubling:
    as many rounds as the logarithm of the longest chain of replies."""
    spark = links.sparkSession
    now, path = materialize(links.withColumn("root_turn", F.col("reply_to")).withColumn("depth", F.lit(1).cast("long")), "replies")
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root_turn").alias("further"), F.col("depth").alias("more"))
        step = now.join(up, (F.col("conv_id") == F.col("c")) & (F.col("root_turn") == F.col("t")), "left").select(
            "conv_id",
            "turn",
            "reply_to",
            F.coalesce("further", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("further").isNotNull().alias("moved"),
        )
        step, step_path = materialize(step, "replies")
        moved = step.where("moved").limit(1).count()
        drop_path(spark, path)
        now, path = step.drop("moved"), step_path
        if not moved:
            return now


def link_quotations(messages: DataFrame) -> DataFrame:
    """Every row of ``messages``(conv_id, turn, role, text) with

    content (text without quoted lines, trimmed), quotes (number of quoted
    passages), linked (those found in an earlier message), reply_to (turn of
    the original of the first found passage of the lowest level, null if
    none), root_turn and depth in the tree of replies, formatted (role and
    content as a chat turn). Reply order within a conversation is
    (root_turn, turn): a thread's messages together, originals before replies.

    A quoted passage is a run of lines of one quote level. Its normalised form
    (see ``normal``) is looked up by hash among the whole own text, the
    passages, the paragraphs and the lines of the messages of its conversation.
    A passage of two or more lines is also looked up among the runs of as many
    consecutive own lines, anywhere in a message; blank lines don't count. The
    original is the earliest message that has it, if that is before the
    quoting one. A re-wrapped quote of part of a text is found only if it is
    one paragraph or passage.

    Runs of own lines are made only of the lengths that are quoted in the
    conversation, so a message of n lines gives at most n keys for each.
    Originals are aggregated to one row for each conversation and hash before
    the join, so a sentence that everyone writes, or a conversation with a
    third of all rows, adds no pairs. Only quoting messages go through the
    joins by hash. Null text: no content. Null conv_id or turn: never linked.
    Rows that repeat (conv_id, turn) are one message to links, and each is
    returned. Empty table: no rows. Further columns are kept, and result
    columns whose names are taken get underscores.
    """
    spark = messages.sparkSession
    has_quote = F.coalesce(F.col("text").rlike("(?m)^[ \\t]*>"), F.lit(False))
    keyed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "text", has_quote.alias("quoting"))
    quoting = with_passages(keyed.where("quoting"), "text", "lines", "runs")
    # the outer forms of inline and explode: for the others the optimizer adds a filter on
    # the array's size below, with all steps in one expression, quadratic in the lines
    quotes = quoting.select("conv_id", "turn", F.inline_outer("runs")).where("level > 0")
    quotes = quotes.select("conv_id", "turn", "level", "ord", normal(F.col("lines")).alias("norm"), line_hashes(F.col("lines")).alias("hashes")).where("norm <> ''")
    size = F.size("hashes")
    span = F.when(size > 1, span_key(F.col("hashes"), F.lit(1), size))
    quotes = quotes.select("conv_id", "turn", "level", "ord", size.alias("size"), F.array_compact(F.array(F.md5("norm"), span)).alias("keys"))
    quotes, quotes_at = materialize(quotes.withColumn("quote", F.monotonically_increasing_id()), "quotes")

    wanted = quotes.groupBy("conv_id").agg(F.collect_set(F.when(F.col("size") > 1, F.col("size"))).alias("sizes"))
    own = keyed.where("text IS NOT NULL").join(wanted, "conv_id")
    plain = own.where("NOT quoting").select("conv_id", "turn", "sizes", F.split("text", "\\r?\\n", -1).alias("own"))
    plain = plain.withColumn("passages", paragraphs(F.col("own")))
    mixed = with_passages(own.where("quoting"), "text", "lines", "runs").select(
        "conv_id",
        "turn",
        "sizes",
        F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]).alias("own"),
        F.flatten(F.transform(F.filter("runs", lambda x: x["level"] == 0), lambda x: F.concat(F.array(normal(x["lines"])), paragraphs(x["lines"])))).alias("passages"),
    )
    units = F.concat(F.array(normal(F.col("own"))), F.col("passages"), F.transform("own", lambda x: normal(F.array(x))))
    texts = plain.unionByName(mixed).select("conv_id", "turn", "sizes", F.array_distinct(units).alias("units"), line_hashes(F.col("own")).alias("hashes"))
    # a row for the units (size 0) and one for each quoted length that fits
    fitting = F.concat(F.array(F.lit(0)), F.filter("sizes", lambda n: n <= F.size("hashes")))
    texts = texts.select("conv_id", "turn", "units", "hashes", F.explode_outer(fitting).alias("size"))
    starts = F.sequence(F.lit(1), F.size("hashes") - F.col("size") + 1)
    keys = F.when(F.col("size") == 0, F.transform(F.filter("units", lambda x: x != ""), lambda x: F.md5(x))).otherwise(
        F.transform(starts, lambda i: span_key(F.col("hashes"), i, F.col("size")))
    )
    originals = texts.select("conv_id", "turn", F.explode_outer(keys).alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))

    asked = quotes.select("conv_id", "turn", "level", "ord", "quote", F.explode("keys").alias("key"))
    found = asked.join(originals, ["conv_id", "key"]).where("origin < turn")
    found = found.groupBy("conv_id", "turn", "level", "ord", "quote").agg(F.min("origin").alias("origin"))
    links = found.groupBy("conv_id", "turn").agg(
        F.min(F.struct("level", "ord", "origin"))["origin"].alias("reply_to"), F.count("*").alias("linked")
    )
    links, links_at = materialize(links, "links")
    tree = _resolve(links.select("conv_id", "turn", "reply_to")).join(links.select("conv_id", "turn", "linked"), ["conv_id", "turn"])
    drop_path(spark, quotes_at)

    names = {c: free_name(messages, c) for c in ("content", "quotes", "linked", "reply_to", "root_turn", "depth", "formatted")}
    # where nothing is quoted the text is taken as it is, and no line is looked at
    quoted = F.when(has_quote, F.col("text"))
    names |= {c: free_name(messages, c) for c in ("quoted_text", "lines", "runs")}
    out = with_passages(messages.withColumn(names["quoted_text"], quoted), names["quoted_text"], names["lines"], names["runs"])
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "\\r\\n", "\n")
    stripped = F.array_join(F.transform(F.filter(names["lines"], lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    body = F.regexp_replace(F.when(has_quote, stripped).otherwise(plain), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    count = F.size(F.filter(names["runs"], lambda x: (x["level"] > 0) & (normal(x["lines"]) != "")))
    out = out.withColumn(names["content"], body).withColumn(names["quotes"], count.cast("long"))
    out = out.drop(names["quoted_text"], names["lines"], names["runs"])
    t = tree.alias("t")
    m = out.alias("m")
    joined = m.join(t, (F.col("m.conv_id") == F.col("t.conv_id")) & (F.col("m.turn").cast("long") == F.col("t.turn")), "left")
    role = F.coalesce(F.col("m.role"), F.lit("user"))
    return joined.select(
        "m.*",
        F.coalesce("t.linked", F.lit(0)).cast("long").alias(names["linked"]),
        F.col("t.reply_to").alias(names["reply_to"]),
        F.coalesce(F.col("t.root_turn"), F.col("m.turn").cast("long")).alias(names["root_turn"]),
        F.coalesce("t.depth", F.lit(0)).cast("long").alias(names["depth"]),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col(f"m.{names['content']}"), F.lit("<|end|>")).alias(names["formatted"]),
    )


def write_conversations(messages: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the turns so that files hold conversations in reply order: a range
    partitioning splits a very long conversation over several files in order."""
    out = link_quotations(messages)
    keys = ["conv_id", out.columns[-3], "turn"]
    n = partitions or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.parquet(path)
