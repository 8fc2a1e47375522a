"""N-gram Jaccard join: Voronoi regions around pivots, guests across their borders, regions that join recursively.

Jaccard distance is a metric, but unrelated texts are all at distance 1 of each other, so that no pivot tells them
apart. The first regions are therefore the texts that share a shingle: sets of similarity 0.85 or more share one among
the first n - ceil(0.85 n) + 1 of each, in an order of shingles that has those known to be common last (a sample
tells which, and the cost only). Shingles with the same texts make one region.

Before regions are formed, the least shingles of each text elect pivots: of the texts with one of them the first. What
is within the join's distance of its pivots is linked at once, and shingles all of whose texts are linked make no
region, so that groups of copies cost what their texts do. In a round each large region takes pivots and measures its texts against them. Texts within the join's distance of a
pivot are linked. Then each text is at home in the cell of its nearest pivot, or, if none is within CORE, in the
region's far cell; and by the triangle inequality it must also visit
- the cell of each pivot not further than its nearest one by more than twice the join's distance, nor further than
  CORE by more than that distance, and
- the far cell, if its nearest pivot is not nearer than CORE by more than that distance.
Any two texts within the join's distance are then both in the cell that either is at home in. Pivots have met all
texts of their region and leave. Cells are the next round's regions, save those without a text at home and those whose
texts the links so far have all made one component. Regions of few texts, and what is large after the last round, are
solved in blocks of bounded size, where texts of different components meet (those of a region's main component not with
each other): first each text's nearest, and when these links have joined components, all pairs between those that are left.

A distance is bounded from below by the sets' sizes and parities; within blocks only pairs that the bound leaves are
told. They are measured on the full sets, which are read again from the texts of such pairs alone. Links join in connected components.

Defined results: null and empty texts and texts of white space have no shingles and link with nothing, not even each
other (component_id is their own doc_id); texts with equal sets are linked; a null doc_id is no candidate for the
smallest (component_id is null where all ids are null); rows that share an id are judged each by its text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, connected_components, materialize, salted_join, spread_join, table
from .nearcopies import HELD, PIECE, SAMPLE, among, apart, common_shingles, let_through, lists, parities, prefix, screen, set_id, shingle_set

WORDS, PERCENT = 4, 85
#: The join's distance, and the greatest distance of a text at home with a pivot.
NEAR, CORE = 1 - PERCENT / 100, 0.20
#: Least shingles that elect a text's first pivots; pivots of a large region, texts of a small one, and rounds.
LEAST, PIVOTS, LEAF, ROUNDS = 3, 4, 256, 2
#: Candidates of a set in a block's first pass.
BEST = 3
#: Numbers of 64 bits that are compared at once in a block.
AT_ONCE = 1 << 20
#: Sets that a task remembers, so as to tell the prefix of copies once.
SEEN = 100_000
#: Beyond the rounding of distances.
EPS = 1e-9


def marks(docs: DataFrame, sample: int) -> DataFrame:
    """doc_id, h1, rid, sid (the set's hash), n (its size); and of a set's first row in a task prefix, common (how many of
    the prefix, at its end, are known to be common) and bits (its parities)."""
    common, rank = common_shingles(docs, sample, WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in chunks(batches, "text", PIECE):
            out: list[list] = [[], [], [], [], []]
            for text in b.column("text").to_pylist():
                found = shingle_set(text, WORDS)
                sid = set_id(found)
                if sid in seen:
                    row = (sid, len(found), found[:0], 0, None)
                else:
                    first = prefix(found, common, rank, PERCENT)
                    # common ones come last
                    row = (sid, len(found), first, max(0, len(first) - int((~among(found, common)[1]).sum())), parities(found))
                    seen.add(sid)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            if len(seen) > SEEN:
                seen.clear()
            own = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), lists(out[2]), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "h1")), *own], ["doc_id", "h1", "sid", "n", "prefix", "common", "bits"])

    rows = docs.select("doc_id", "h1", "text").mapInArrow(run, "doc_id long, h1 long, sid long, n int, prefix array<long>, common int, bits binary")
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "marks")


def shared_rare(rows: DataFrame) -> DataFrame:
    """(token, sid, n) -> those of tokens that several sets have, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, first, several = None, None, False  # the token that goes on, its only row so far, and whether it has more
        for b in batches:
            if not b.num_rows:
                continue
            t, sid = b.column("token").to_numpy(), b.column("sid").to_numpy()
            new = np.concatenate(([token is None or t[0] != token or sid[0] != last], (t[1:] != t[:-1]) | (sid[1:] != sid[:-1])))
            b = b.filter(pa.array(new))
            if not b.num_rows:
                continue
            t, last = t[new], sid[-1]
            start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            many = np.diff(np.append(start, len(t))) > 1
            if t[0] == token:
                if not several:
                    yield first
                many[0] = True
            yield b.filter(pa.array(np.repeat(many, np.diff(np.append(start, len(t))))))
            token, several, first = t[-1], bool(many[-1]), b.slice(b.num_rows - 1)

    return rows.repartition("token").sortWithinPartitions("token", "sid").mapInArrow(run, "token long, sid long, n int")


def shared_tokens(marked: DataFrame) -> DataFrame:
    """(token, sid, n) of shingles in prefixes that several sets have."""
    rows = marked.select("sid", "n", F.posexplode("prefix").alias("at", "token"), (F.size("prefix") - F.col("common")).alias("rare"))
    # shingles known to be common may be very many sets', and are not brought together
    common = rows.filter("at >= rare").select("token", "sid", "n").distinct()
    return materialize(shared_rare(rows.filter("at < rare").select("token", "sid", "n")).unionByName(common), "shared")


def first_regions(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(region, sid, n): the sets of a shared shingle, of different components; regions of the same sets are one."""
    shared = materialize(rooted(shared, roots), "shared")
    told = shared.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    chosen = told.filter("lo < hi").groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token")
    return spread_join(shared.select("token", "sid", "n"), chosen, ["token"], ["sid"]).select(F.col("token").alias("region"), "sid", "n")


def elected(marked: DataFrame) -> DataFrame:
    """Pairs (a, b): each set and the first set of those that have one of its least shingles."""
    rows = marked.select("sid", F.explode(F.slice("prefix", 1, LEAST)).alias("token"))
    first = rows.groupBy("token").agg(F.min_by("sid", F.struct(F.xxhash64("sid"), "sid")).alias("pivot"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("token", "pivot")
    return spread_join(rows, first, ["token"], ["sid"]).filter("sid <> pivot").select(*pair("sid", "pivot")).distinct()


class Sets:
    """Sizes and parities of all sets, and the full sets of those that were asked for so far."""

    def __init__(self, docs: DataFrame, profiles: DataFrame) -> None:
        self.docs, self.profiles, self.full = docs, profiles, None

    def get(self, needed: DataFrame) -> DataFrame:
        """(sid, s), for sids that are needed at least: texts of others are left out by a screen of bounded size, then by a join."""
        if self.full is not None:
            needed = needed.join(self.full.select("sid"), "sid", "left_anti")
        needed = materialize(needed, "needed")
        bits = screen(self.profiles.join(needed, "sid", "left_semi").select("h1"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text", PIECE):
                found = [shingle_set(x, WORDS) for x in b.filter(pa.array(let_through(bits, b.column("h1")))).column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in found], pa.int64()), lists(found)], ["sid", "s"])

        once = self.docs.select("h1", "text").mapInArrow(run, "sid long, s array<long>").join(needed, "sid", "left_semi")
        new = materialize(once.dropDuplicates(["sid"]), "full-sets")
        self.full = new if self.full is None else self.full.union(new)
        return self.full


def measured(pairs: DataFrame, sets: Sets, reach: float) -> DataFrame:
    """Distinct pairs (a, b) -> a, b, d, linked, of those whose distance is within reach."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n, m = (b.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            gaps = np.array([max(apart(*z[:2]), abs(z[2] - z[3])) for z in zip(x, y, n, m, strict=True)], np.float64)
            both = b.column("n").to_numpy().astype(np.float64) + b.column("m").to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(2 * gaps <= (reach + EPS) * (both + gaps), pa.bool_()))

    # a set may be a pivot of very many
    pairs, profile = materialize(pairs, "pairs"), sets.profiles
    sized = salted_join(pairs, profile.select("sid", "n", F.col("bits").alias("x")), {"a": "sid"}, "b")
    sized = salted_join(materialize(sized, "sized"), profile.select("sid", F.col("n").alias("m"), F.col("bits").alias("y")), {"b": "sid"}, "a")
    return exact(sized.select("a", "b", "n", "m", "x", "y").mapInArrow(bound, "a long, b long"), sets, reach)


def exact(near: DataFrame, sets: Sets, reach: float) -> DataFrame:
    """As measured(), on the full sets at once."""
    near = materialize(near, "pairs")
    full = sets.get(near.select(F.col("a").alias("sid")).union(near.select("b")).distinct())
    both = salted_join(near, full.select("sid", F.col("s").alias("sa")), {"a": "sid"}, "b")
    both = salted_join(both, full.select("sid", F.col("s").alias("sb")), {"b": "sid"}, "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    found = both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u"))
    found = found.select("a", "b", (1 - F.col("i") / F.col("u")).alias("d"), (100 * F.col("i") >= PERCENT * F.col("u")).alias("linked"))
    return materialize(found.filter(F.col("d") <= reach + EPS), "distances")


def pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def against_pivots(members: DataFrame, pivots: int) -> DataFrame:
    """(region, sid, n) -> region, sid, n, pivot, slot: each set of a region with each pivot of it."""
    w = Window.partitionBy("region").orderBy(F.xxhash64("sid"), "sid")  # one order for all regions, so they take the same
    first = members.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= pivots)
    few = first.groupBy("region").agg(F.collect_list(F.struct("slot", "sid")).alias("few"))  # a few by the filter
    rows = spread_join(members.select("region", "sid", "n"), few, ["region"], ["sid"])
    return materialize(rows.select("region", "sid", "n", F.explode("few").alias("p")).select("region", "sid", "n", F.col("p.sid").alias("pivot"), "p.slot"), "against-pivots")


def cells(met: DataFrame, found: DataFrame) -> DataFrame:
    """(region, sid, n, home): the cells that each set is in, but for pivots."""
    own = Window.partitionBy("region", "sid")  # a row a pivot
    rows = met.select("*", *pair("sid", "pivot")).join(found.select("a", "b", "d"), ["a", "b"], "left").fillna(1.0, ["d"])
    rows = rows.withColumns({"near": F.min("d").over(own), "is_pivot": F.max((F.col("sid") == F.col("pivot")).cast("int")).over(own)}).filter("is_pivot = 0")
    rows = rows.withColumn("nearest", F.min_by("slot", F.struct("d", "slot")).over(own))
    visits = F.col("d") <= F.least(F.col("near") + 2 * NEAR, F.lit(CORE + NEAR)) + EPS
    inner = rows.filter(visits).select(F.xxhash64("region", "slot").alias("region"), "sid", "n", ((F.col("slot") == F.col("nearest")) & (F.col("near") <= CORE)).alias("home"))
    far = rows.filter((F.col("slot") == F.col("nearest")) & (F.col("near") > CORE - NEAR - EPS))
    return materialize(inner.union(far.select(F.xxhash64("region", F.lit(0)).alias("region"), "sid", "n", (F.col("near") > CORE).alias("home"))), "cells")


def open_regions(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(region, sid, n, home) -> region, sid, n, root, m, of regions with several components and a set at home."""
    members = members.withColumn("root", F.col("sid")) if roots is None else materialize(rooted(members, roots), "rooted")
    told = members.groupBy("region").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("home").alias("some"))
    told = told.filter("lo < hi and some").select("region", "m")
    return materialize(spread_join(members.select("region", "sid", "n", "root"), told, ["region"], ["sid"]), "open-regions")


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def bits_of(rows: list[bytes], words: int) -> np.ndarray:
    """Parities as rows of 64-bit numbers, folded to so many."""
    out = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
    while out.shape[1] > words:
        out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
    return out


def near_pairs(left: tuple, right: tuple, reach: float, best: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sid, n, root, bits) twice -> pairs of different roots whose sizes and parities leave them within reach; of each
    left set, where best is given, only so many of each class of sizes, the nearest by the bound.

    Parities are as long as the next power of two of a set's size, so sizes that fit are in the same or the next class.
    """
    found = [[np.zeros(0, np.int64)] * 2]
    classes = [{} for _ in range(2)]
    for of, (_, _, _, bits) in zip(classes, (left, right), strict=True):
        for i, x in enumerate(bits):
            of.setdefault(len(x) // 8, []).append(i)
    for c, at in classes[0].items():
        for d in (c // 2, c, 2 * c):
            if d not in classes[1]:
                continue
            other, words = np.array(classes[1][d]), min(c, d)
            y, m, roots = bits_of([right[3][i] for i in other], words), right[1][other], right[2][other]
            step = max(1, AT_ONCE // (len(other) * words))
            for k in range(0, len(at), step):
                own = np.array(at[k : k + step])
                x = bits_of([left[3][i] for i in own], words)
                n = left[1][own]
                apart_ = np.zeros((len(own), len(other)), np.int64)
                for w in range(words):
                    apart_ += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
                gap = np.maximum(apart_, np.abs(n[:, None] - m[None, :]))
                fits = (2 * gap <= (reach + EPS) * (n[:, None] + m[None, :] + gap)) & (left[2][own][:, None] != roots[None, :])
                if best is not None and fits.shape[1] > best:
                    share = np.where(fits, gap / (n[:, None] + m[None, :]), np.inf)
                    nearest = np.argpartition(share, best, axis=1)[:, :best]
                    chosen = np.zeros_like(fits)
                    np.put_along_axis(chosen, nearest, True, axis=1)
                    fits &= chosen
                i, j = np.nonzero(fits)
                found.append([left[0][own[i]], right[0][other[j]]])
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def solved(members: DataFrame, sets: Sets, held: int, best: int | None = None) -> DataFrame:
    """(region, sid, n, root) -> pairs (a, b) of different roots that the bound leaves within the join's distance (with
    best, the nearest of them).

    A region's main root is that of most of its sets. Sets of other roots (the rest) meet all. Both are cut into blocks of about
    held sets, so that no task holds a region; a region whose rest is small costs its own size.
    """
    by_root = members.groupBy("region", "root").agg(F.count("*").alias("c"))
    told = by_root.groupBy("region").agg(F.sum("c").alias("m"), F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    members = materialize(spread_join(members, told, ["region"], ["sid"]).withColumn("rest", F.col("root") != F.col("main")), "members")
    small = members.filter(F.col("m") <= held).select("region", *(F.lit(0).cast("long").alias(x) for x in "ij"), F.lit(1).alias("side"), "sid", "n", "root", "rest")
    members = members.filter(F.col("m") > held)
    rest = members.filter("rest")
    some = rest.groupBy("region").agg(F.count("*").alias("r"))
    blocks = [(F.floor((F.col(x) - 1) / held) + 1).cast("long") for x in ("m", "r")]
    own = [F.pmod(F.xxhash64("sid"), x) for x in blocks]
    every = [F.explode(F.sequence(F.lit(0).cast("long"), x - 1)) for x in blocks]
    left = spread_join(rest, some, ["region"], ["sid"]).withColumn("j", own[1]).withColumn("i", every[0]).withColumn("side", F.lit(0)).select(small.columns)
    right = spread_join(members, some, ["region"], ["sid"]).withColumn("i", own[0]).withColumn("j", every[1]).withColumn("side", F.lit(1)).select(small.columns)
    rows = small.union(left).union(right).join(sets.profiles.select("sid", "bits"), "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def side(parts: list[pa.RecordBatch]) -> tuple:
            t = pa.Table.from_batches(parts)
            return t.column("sid").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("root").to_numpy(), t.column("bits").to_pylist()

        def done() -> Iterator[pa.RecordBatch]:
            left = sides[0] or [b.filter(b.column("rest")) for b in sides[1]]
            if sides[1] and any(b.num_rows for b in left):
                a, b = near_pairs(side(left), side(sides[1]), NEAR, best)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("region", "i", "j")])
            of = b.column("side").to_numpy()
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (of[1:] != of[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if key != (now := tuple(keys[:, lo].tolist())):
                    yield from done()
                    key, sides = now, ([], [])
                sides[of[lo]].append(b.slice(lo, hi - lo))
        yield from done()

    found = rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "side").mapInArrow(run, "a long, b long")
    return found.distinct()


def links(sets: Sets, marked: DataFrame, pivots: int = PIVOTS, leaf: int = LEAF, rounds: int = ROUNDS, held: int = HELD) -> DataFrame:
    """(node, root) of the components of all pairs within the join's distance."""
    edges, few = [], []

    def linked(found: DataFrame) -> DataFrame:
        edges.append(found.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        return connected_components(reduce(DataFrame.union, edges))

    roots = linked(measured(elected(marked), sets, NEAR))
    members = first_regions(shared_tokens(marked), roots)
    members = open_regions(materialize(members.withColumn("home", F.lit(True)), "regions"), roots)
    for left in range(rounds, -1, -1):
        small = members.filter(F.col("m") <= leaf) if left else members
        few.append(small.drop("root", "m"))
        members = members.filter(F.col("m") > leaf)
        if not left or members.isEmpty():
            break
        met = against_pivots(members, pivots)
        found = measured(met.filter("sid <> pivot").select(*pair("sid", "pivot")).distinct(), sets, CORE + NEAR)
        roots = linked(found)
        members = open_regions(cells(met, found), roots)
    # the nearest of each set first, which link nearly all that will be; then whatever is left between components
    rest = reduce(DataFrame.union, few)
    roots = linked(exact(solved(materialize(rooted(rest, roots), "members"), sets, held, BEST), sets, NEAR))
    return linked(exact(solved(materialize(rooted(rest, roots), "members"), sets, held), sets, NEAR))


def join(docs: DataFrame, sample: int = SAMPLE, **how: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    marked = marks(docs, sample)
    some = marked.filter("n > 0")
    profiles = some.groupBy("sid").agg(F.max("n").alias("n"), F.first("bits", True).alias("bits"), F.min("h1").alias("h1"), F.min("doc_id").alias("first"))
    profiles = materialize(profiles, "profiles")
    roots = links(Sets(docs, profiles), some, **how)
    found = materialize(rooted(profiles.select("sid", "first"), roots), "rooted")
    least = found.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(spread_join(found, least, ["root"], ["sid"]).select("sid", "component_id"), "components")
    rows = spread_join(some.select("doc_id", "n", "sid", "rid"), found, ["sid"], ["rid"])
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = marked.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.union(alone)


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '     abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2], ' ', w[i + 3])))) END AS s FROM d
), k AS MATERIALIZED (
  SELECT md5(array_to_string(s, chr(1))) AS sid, any_value(s) AS s, min(doc_id) AS first, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1
), t AS MATERIALIZED (SELECT sid, n, hash(x) AS x FROM (SELECT sid, n, unnest(s) AS x FROM k)), 
p AS MATERIALIZED (
  SELECT a.sid AS u, b.sid AS v FROM t a JOIN t b ON a.x = b.x AND a.sid < b.sid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.sid, b.sid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p), r AS (
  SELECT sid AS u, sid AS v FROM k UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
), c AS (SELECT r.u AS sid, min(k.first) AS component_id FROM r JOIN k ON r.v = k.sid GROUP BY r.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component_id END AS component_id
FROM s LEFT JOIN c ON c.sid = md5(array_to_string(s.s, chr(1)))
"""
