"""MinHash near-duplicate detection: banding, signature check, full-set links, star components.

1. One pass over the texts makes, per document, a signature of universal-hash
   minima and its band keys (numpy on Arrow batches).
2. Documents of equal text share one representative, so copies never multiply.
3. In a band bucket, signatures are compared with the smallest member's; those
   that agree in ``least_agreement`` places are linked to it. What is left of
   a bucket (far members) is compared with all of the bucket, signature by
   signature, in blocks; a block emits what hangs together. Two members of a
   bucket whose signatures agree are so always connected.
4. Components of these links (alternating large-star/small-star) are groups in
   which pairs are checked on full shingle sets, in blocks of bounded size. In
   a group above ``BLOCK`` documents all are first checked against ``PIVOTS``
   of them; what that connects in one class needs no check among itself, and
   only the rest goes on, in blocks, against the group. A block emits what its
   confirmed links connect.
5. Components of the confirmed links give the classes.

Two documents with similarity at the threshold share no bucket with
probability below ``MISS``, and disagree in too many places of the signature
with probability below ``MISS`` (1e-7 each by default); nothing else is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm._shared import drop_path, free_name, materialize
from maskwell.llm._text import U64, mix, random_u64, row_slices, shingle_sets, shingles, utf8, word_hashes
from maskwell.llm.components import connected_components

ROWS_PER_BAND = 5
MISS = 1e-7
#: Documents and shingles of a block that is held in memory, and documents it is checked against in one task.
BLOCK, BLOCK_SHINGLES, CHUNK = 512, 4_000_000, 8192
PIVOTS = 64
#: A document in more links than HUB, and in more than one of HUBS parts of all links, is a
#: hub: there are at most HUBS of them, so their list may be broadcast.
HUB, HUBS = 1024, 2000
#: Documents of a block of signatures, and those it is compared with in one task.
SIG_BLOCK, SIG_CHUNK = 1024, 65_536


def band_count(threshold: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_agreement(threshold: float, n_hashes: int, miss: float = MISS) -> int:
    """The number of equal minima that a pair at the threshold falls short of with probability at most ``miss``."""
    below, k = 0.0, 0
    while True:
        below += math.comb(n_hashes, k) * threshold**k * (1 - threshold) ** (n_hashes - k)
        if below > miss:
            return k
        k += 1


def signatures(values: np.ndarray, at: np.ndarray, n_hashes: int) -> np.ndarray:
    """Minima of ``n_hashes`` multiply-add hashes for each non-empty run of ``values``."""
    a, b = random_u64(n_hashes, 31) | U64(1), random_u64(n_hashes, 37)
    filled = np.flatnonzero(at[1:] > at[:-1])
    out = np.full((len(at) - 1, n_hashes), np.iinfo(np.uint64).max, U64)
    if len(filled):
        starts, scratch = at[:-1][filled], np.empty_like(values)
        with np.errstate(over="ignore"):
            for i in range(n_hashes):
                np.multiply(values, a[i], out=scratch)
                scratch += b[i]
                out[filled, i] = np.minimum.reduceat(scratch, starts)
    return out >> U64(32)


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    n_bands = minima.shape[1] // rows
    salts = random_u64(n_bands, 41)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(salts, (len(minima), n_bands)).copy()
        for i in range(rows):
            keys = mix(keys * U64(0x9E3779B97F4A7C15) + minima[:, i::rows][:, :n_bands])
    return keys.view(np.int64)


def sketch(docs: DataFrame, k: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash -> n_shingles, keys (null without shingles), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in row_slices(offsets):
                words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                values, at = shingles(words, at, k)
                minima = signatures(values, at, n_bands * rows)
                n = np.array([len(np.unique(values[at[r] : at[r + 1]])) for r in range(j - i)], np.int64)
                keys = band_keys(minima, rows)
                sig = np.ascontiguousarray((mix(minima.ravel()) >> U64(56)).astype(np.uint8).reshape(minima.shape))
                empty = n == 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, n_bands))]), pa.int32()),
                    pa.array(keys[~empty].ravel(), pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        batch.column(1)[i:j],
                        pa.array(n, pa.int64()),
                        lists,
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "keys", "sig"],
                )

    rows_in = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_hash"), "text")
    return rows_in.mapInArrow(run, "doc_id long, text_hash binary, n_shingles long, keys array<long>, sig binary")


def _agreement(pairs: DataFrame, least: int) -> DataFrame:
    """pairs(u, v, sig_u, sig_v) -> u, v, near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            near = (a == b).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["u", "v", "near"])

    return pairs.mapInArrow(run, "u long, v long, near boolean")


def _layout(rows: DataFrame, n: Column, blocks: Column, chunk: int) -> DataFrame:
    """rows(key, u, far, ...) -> copies with g and base, so that each far row of a key meets
    each row of it in one group g: far rows are dealt to ``blocks`` blocks of a key, all its
    ``n`` rows to chunks, and a group is a block (base) with a chunk. Far rows of two blocks
    meet in the lower one's groups. A row that isn't far has a copy for each block."""
    block = F.pmod(F.xxhash64("u", F.lit(1)), blocks).cast("int")
    chunks = F.ceil(n / chunk).cast("int")
    mine = F.pmod(F.xxhash64("u", F.lit(2)), chunks).cast("int")
    as_base = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(block.alias("b"), c.alias("c"), F.lit(True).alias("base")))
    upto = F.when(F.col("far"), block).otherwise(blocks)
    as_other = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0)).cast("int")), F.lit(1), upto.cast("int")), lambda b: F.struct(b.alias("b"), mine.alias("c"), F.lit(False).alias("base")))
    places = F.when(F.col("far"), F.concat(as_base, as_other)).otherwise(as_other)
    rows = rows.withColumn("place", F.explode_outer(places)).where("place IS NOT NULL")
    return rows.withColumn("g", F.xxhash64("key", "place.b", "place.c")).withColumn("base", F.col("place.base")).withColumn("first", F.col("place.c") == 0).drop("place")


class _Union:
    """Union-find over a group's nodes."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def stars(self) -> list[tuple[int, int]]:
        """Each node with the smallest one that it is connected with."""
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def _in_groups(grouped: DataFrame, make_group) -> DataFrame:
    """Sorted (g, base, u, joined, first, data), a group's base rows first -> links (u, v)
    that connect what the group's pairs connect: stars, so that few rounds join them.

    ``make_group`` gives an object with ``add(u, data)`` for base rows, ``close() ->
    pairs`` when they are all there and ``meet(u, data) -> base ids`` for each other
    row. Only the base is held. ``joined`` marks rows known to be connected with each
    other: they count as one node. Pairs within the base are looked for in a block's
    ``first`` group alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, union, open_base, known = None, None, _Union(), False, None
        search = False

        def close() -> None:
            if search:
                for x, y in group.close():
                    union.join(x, y)
            else:
                group.ready()

        for batch in batches:
            out: list[tuple[int, int]] = []
            ids, flags = batch.column(2).to_pylist(), [batch.column(c).to_pylist() for c in (0, 1, 3, 4)]
            for g, base, joined, first, u, data in zip(*flags, ids, batch.column(5), strict=True):
                if g != last:
                    if open_base:
                        close()
                    out += union.stars()
                    last, group, union, open_base, search, known = g, make_group(), _Union(), True, first, None
                if base:
                    group.add(u, data)
                    continue
                if open_base:
                    close()
                    open_base = False
                met = group.meet(u, data)
                if joined and met:
                    known = u if known is None else known
                for x in met:
                    union.join(x, known if joined else u)
            if out:
                yield _links(out)
        if open_base:
            close()
        if out := union.stars():
            yield _links(out)

    return grouped.mapInArrow(run, "u long, v long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in pairs], pa.int64()), "v": pa.array([y for _, y in pairs], pa.int64())})


class _Signatures:
    def __init__(self, least: int) -> None:
        self.least, self.ids, self.rows, self.matrix = least, [], [], None

    def add(self, u: int, data: pa.Scalar) -> None:
        self.ids.append(u)
        self.rows.append(data.as_py())

    def ready(self) -> None:
        self.matrix = np.frombuffer(b"".join(self.rows), np.uint8).reshape(len(self.rows), -1)

    def close(self) -> Iterator[tuple[int, int]]:
        self.ready()
        for i in range(1, len(self.ids)):
            near = (self.matrix[:i] == self.matrix[i]).sum(axis=1) >= self.least
            for j in np.flatnonzero(near).tolist():
                yield self.ids[i], self.ids[j]

    def meet(self, u: int, data: pa.Scalar) -> list[int]:
        mine = np.frombuffer(data.as_py(), np.uint8)
        return [self.ids[j] for j in np.flatnonzero((self.matrix == mine).sum(axis=1) >= self.least).tolist()]


class _Sets:
    def __init__(self, k: int, num: int, den: int) -> None:
        self.k, self.num, self.den, self.ids, self.sets, self.flat = k, num, den, [], [], None

    def _set(self, data: pa.Scalar) -> np.ndarray:
        return next(shingle_sets(pa.array([data.as_py()], pa.large_string()), self.k))

    def add(self, u: int, data: pa.Scalar) -> None:
        self.ids.append(u)
        self.sets.append(self._set(data))

    def ready(self) -> None:
        pass

    def close(self) -> list[tuple[int, int]]:
        return [(self.ids[a], self.ids[b]) for a, b in _forest(self.sets, self.num, self.den)] if len(self.ids) > 1 else []

    def meet(self, u: int, data: pa.Scalar) -> list[int]:
        if self.flat is None:
            sizes = np.array([len(s) for s in self.sets], np.int64)
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.flat, self.owner, self.sizes = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        mine = self._set(data)
        lo, hi = (np.searchsorted(self.flat, mine, side) for side in ("left", "right"))
        count = hi - lo
        at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        inter = np.bincount(self.owner[at], minlength=len(self.sizes))
        near = (inter > 0) & (self.den * inter >= self.num * (self.sizes + len(mine) - inter))
        return [self.ids[j] for j in np.flatnonzero(near).tolist()]


def _grouped(rows: DataFrame, data: str) -> DataFrame:
    """Rows of ``_layout`` dealt by group and sorted as ``_in_groups`` takes them."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("g", "base", "u", "joined", "first", data)
    return rows.repartition(parts, "g").sortWithinPartitions("g", F.desc("base"), "u")


def candidate_links(sketches: DataFrame, least: int) -> DataFrame:
    """Pairs (u, v) of representatives that connect all pairs of a band bucket whose
    signatures agree in at least ``least`` places; linear in the bucket."""
    rows = sketches.where("size(keys) > 0").select(F.col("doc_id").alias("u"), F.explode_outer("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("u").alias("v")).where("n > 1")
    members, members_at = materialize(rows.join(buckets, "key"), "members")
    sigs = sketches.where("size(keys) > 0").groupBy("doc_id").agg(F.min("sig").alias("sig"))
    pairs = members.where("u <> v").select("u", "v").distinct()
    pairs = pairs.join(sigs.select(F.col("doc_id").alias("u"), F.col("sig").alias("sig_u")), "u")
    # a large group's smallest member is in very many pairs: its pairs and its signature are salted
    many = max(HUB, members.count() // HUBS)
    hubs = members.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > many).select("v", F.ceil(F.col("n") / many).cast("int").alias("salts"))
    hubs = F.broadcast(hubs)
    pairs = pairs.join(hubs, "v", "left").withColumn("salt", F.pmod(F.xxhash64("u"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    of_v = sigs.select(F.col("doc_id").alias("v"), F.col("sig").alias("sig_v")).join(hubs, "v", "left")
    of_v = of_v.select("v", "sig_v", F.explode_outer(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    pairs = pairs.join(of_v, ["v", "salt"])
    judged, judged_at = materialize(_agreement(pairs.select("u", "v", "sig_u", "sig_v"), least), "judged")

    # buckets of two are settled; in the others far members meet all members
    crowd = members.where("n > 2").join(judged, ["u", "v"], "left").withColumn("far", F.coalesce(~F.col("near"), F.lit(False)))
    far_count = crowd.where("far").groupBy("key").agg(F.count("*").alias("n_far"))
    crowd = crowd.join(far_count, "key").join(sigs.withColumnRenamed("doc_id", "u"), "u")
    # rows that aren't far hang together by the bucket's smallest member
    crowd = _layout(crowd.withColumn("joined", ~F.col("far")), F.col("n"), F.ceil(F.col("n_far") / SIG_BLOCK), SIG_CHUNK)
    far_links = _in_groups(_grouped(crowd, "sig"), lambda: _Signatures(least))
    links = judged.where("near").select("u", "v").unionByName(far_links).distinct()
    out, _ = materialize(links, "candidates")
    drop_path(sketches.sparkSession, members_at)
    drop_path(sketches.sparkSession, judged_at)
    return out


def _forest(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of all pairs with den*|a&b| >= num*|a|b|."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if inter and den * inter >= num * (sizes[0] + sizes[1] - inter) else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = new[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n_columns, step = int(shared.sum()), max(1, (1 << 23) // m)
    inter = np.zeros((m, m), np.float32)
    for c in range(0, n_columns, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        part = np.zeros((m, min(step, n_columns - c)), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        inter += part @ part.T
    exact = inter.astype(np.int64)
    linked = (den * exact >= num * (sizes[:, None] + sizes[None, :] - exact)) & (exact > 0)
    del inter, exact
    seen, out = np.zeros(m, bool), []
    for root in range(m):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            at = stack.pop()
            fresh = np.flatnonzero(linked[at] & ~seen)
            seen[fresh] = True
            out += [(at, int(x)) for x in fresh]
            stack += fresh.tolist()
    return out


def _confirm(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """rows(key, u, far, joined, text, n_shingles) -> pairs that connect
    what the confirmed links of far rows with all rows of their key connect."""
    sums = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("far"), 1)).alias("n_far"), F.sum(F.when(F.col("far"), F.col("n_shingles"))).alias("weight")
    )
    rows = rows.join(sums.where("n_far > 0"), "key")
    blocks = F.greatest(F.ceil(F.col("n_far") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    return _in_groups(_grouped(_layout(rows, F.col("n"), blocks, CHUNK), "text"), lambda: _Sets(k, num, den))


def _confirmed_links(docs: DataFrame, groups: DataFrame, sizes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs that connect what all confirmed links connect, of docs(doc_id, text) in groups(node, component);
    sizes(node, n_shingles)."""
    spark = docs.sparkSession
    counts = groups.groupBy("component").agg(F.count("*").alias("members"))
    marked = groups.join(counts, "component").join(sizes, "node")
    marked = marked.select(F.col("component").alias("key"), F.col("node").alias("doc_id"), "members", "n_shingles")
    # a merge join at every size: the groups grow with the data, so they are never broadcast
    texts, texts_at = materialize(docs.join(marked.hint("merge"), "doc_id").withColumnRenamed("doc_id", "u"), "texts")
    small = texts.where(F.col("members") <= BLOCK).withColumn("far", F.lit(True)).withColumn("joined", F.lit(False))
    links, links_at = materialize(_confirm(small, k, num, den), "confirmed")
    done = [(links, links_at)]
    large = texts.where(F.col("members") > BLOCK)
    if large.limit(1).count():
        # pivots: the documents of smallest hash, about PIVOTS of each group
        chance = F.pmod(F.xxhash64("u", F.lit(3)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * PIVOTS / F.col("members")
        first = _confirm(large.withColumn("far", chance).withColumn("joined", F.lit(False)), k, num, den)
        done.append(materialize(first, "pivots"))
        part = connected_components(done[-1][0]).withColumnRenamed("node", "u")
        part = large.select("key", "u").distinct().join(part, "u", "left")
        most = part.where("component IS NOT NULL").groupBy("key", "component").agg(F.count("*").alias("c"))
        most = most.groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("biggest"))
        rest = part.join(most, "key", "left").select("key", "u", F.coalesce(F.col("component") != F.col("biggest"), F.lit(True)).alias("far"))
        second = large.join(rest.hint("merge"), ["key", "u"]).withColumn("joined", ~F.col("far"))
        done.append(materialize(_confirm(second, k, num, den), "rest"))
    drop_path(spark, texts_at)
    out = done[0][0]
    for more, _ in done[1:]:
        out = out.unionByName(more)
    links, _ = materialize(out.distinct(), "links")
    for _, path in done:
        drop_path(spark, path)
    return links


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100, rows: int = ROWS_PER_BAND
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``(doc_id, text, ...).

    Documents are linked if den*|A & B| >= num*|A | B| for their sets of
    distinct ``shingle_words``-word shingles (A-Z folded, words as in
    ``_text``). component_id is the smallest doc_id reachable.

    Null or wordless text: n_shingles 0, linked with nothing. Fewer words than
    a shingle: the whole sequence is one. Rows that repeat a doc_id are one
    document and get the same class. Null doc_id: never linked, component_id
    null, kept. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n_bands = band_count(num / den, rows)
    sketches, sketches_at = materialize(sketch(docs, shingle_words, n_bands, rows), "sketches")

    filled = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = filled.groupBy("text_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copies, copies_at = materialize(copies.where("n > 1").select("text_hash", "rep"), "copies")
    copy_links = filled.join(copies, "text_hash").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    copy_links, links_at = materialize(copy_links, "copy_links")
    others = filled.join(copies, (filled.text_hash == copies.text_hash) & (filled.doc_id != copies.rep), "left_anti")

    candidates = candidate_links(others, least_agreement(num / den, n_bands * rows))
    groups, groups_at = materialize(connected_components(candidates), "groups")
    # rows that repeat a doc_id may differ in text; the larger size counts for the blocks
    weights = others.groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n_shingles"))
    links = _confirmed_links(docs, groups, weights, shingle_words, num, den)

    near = connected_components(links)
    # a copy's class is its representative's class
    reps = copy_links.join(near.withColumnRenamed("node", "v"), "v", "left")
    classes = near.unionByName(reps.select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component")))
    classes = classes.groupBy("node").agg(F.min("component").alias("component"))
    classes, _ = materialize(classes, "classes")
    for path in (copies_at, links_at, groups_at):
        drop_path(spark, path)

    out = sketches.select("doc_id", "n_shingles").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: one of each class, all columns. Rows that repeat both
    doc_id and text leave one row; rows of one doc_id with unlike texts all
    stay with it. Rows without doc_id stay, one of each text."""
    kept = near_duplicates(docs, **options).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    digest = free_name(docs, "text_digest")
    marked = docs.withColumn(digest, F.md5(F.coalesce(F.col("text"), F.lit(""))))
    named = marked.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", digest])
    nameless = marked.where("doc_id IS NULL").dropDuplicates([digest])
    return named.select(*docs.columns).unionByName(nameless.select(*docs.columns))
