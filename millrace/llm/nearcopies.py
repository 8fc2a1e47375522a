"""Near copies by Jaccard similarity over five-word shingles, all of them, without comparing all pairs.

SimHash comes first: fingerprints over the same shingles, and the links that the vantage-point trees find among
them. Most pairs of similarity 0.8 differ in more bits than trees over 64 bits can prune by, so a prefix filter
finds the rest. Shingles have one total order: those not known to be common first, by hash; then the common ones,
told by a sample, by how common they are. Two sets with a Jaccard similarity of 0.8 or more share a shingle among
the first n - ceil(0.8 n) + 1 of each, whatever the sample was: it tells the cost only. The documents of a shingle
make a bucket. Its first members, which have the fewest shingles before it, are all candidates of each other;
later ones meet the very first (the centres), to which the copies of one text are nearest. Of a candidate the
sizes fit, and what follows the shingle in both (if it is the first they share, they share no more than that).
Once the links so found have made components, members of a large bucket that are not of its first centre's
component meet all its members of other components, in blocks of bounded size.

A set's parities (a bit is the parity of the shingles that hash to it) bound from below how many shingles two sets
don't share; pairs that the bound leaves are verified on the full sets. Links join in connected components, which
are thus those of all pairs at or above the similarity.

Texts are not shuffled, except those that a screen of bounded size (bits by row hash, of which some are set by
chance) lets through: about those with a candidate, and at the end one of each group of several rows. Beyond what
a screen can tell apart more go through, and the join after it decides.

Defined results: rows are judged by their texts, whatever their ids; texts with equal sets (null and empty
ones too) are one group; a text of fewer words than a shingle is one shingle; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, connected_components, materialize, spread_join
from .simhash import fingerprint_links, majority_bits, shingle_hashes

WORDS = 5
#: Documents that common shingles are counted in, rows of the sample that make one common, and common ones kept.
SAMPLE, COMMON, KNOWN = 10_000, 4, 200_000
#: First members of a bucket whose pairs are all candidates at once; centres that later ones meet.
SMALL, CENTRES = 64, 8
#: Members of a large bucket that are held at once.
HELD = 8192
#: Bytes of text whose shingles are held at once.
PIECE = 1 << 20
#: Differing bits at which fingerprints link.
REACH = 3
#: Bits of a screen: 1 MB, whatever the rows.
SCREEN = 1 << 23


def as_set(digests: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)).view(np.int64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return as_set(shingle_hashes(text, words))


def set_id(found: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(found.tobytes())
    return n - (1 << 64) if n >> 63 else n


def parities(found: np.ndarray) -> bytes:
    """A bit for each shingle or more (a power of two, 64 at least): the parity of the shingles at it."""
    size = 1 << max(6, (len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (size - 1), minlength=size) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Shingles that only one of two sets has, at least: the longer parities fold to the shorter."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    n, m = 8 * len(x), 8 * len(y)
    while n > m:
        n //= 2
        a = (a ^ a >> n) & ((1 << n) - 1)
    while m > n:
        m //= 2
        b = (b ^ b >> m) & ((1 << m) - 1)
    return (a ^ b).bit_count()


def among(found: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each shingle would stand among the common ones, which are in order, and whether it is one."""
    at = np.minimum(np.searchsorted(common, found), max(len(common) - 1, 0))
    return at, common[at] == found if len(common) else np.zeros(len(found), bool)


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray, percent: int = 80) -> np.ndarray:
    """The first shingles in the total order: enough of them to meet any set of that similarity."""
    n = len(found)
    if not n:
        return found
    at, known = among(found, common)
    ordered = np.concatenate([found[~known], found[known][np.argsort(rank[at[known]])]])
    return ordered[: n - (percent * n + 99) // 100 + 1]


def lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))


def common_shingles(docs: DataFrame, sample: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many rows of a sample have, in order of value; and their ranks, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            found = np.concatenate([shingle_set(x, words) for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["shingle"])

    share = 2**20 * sample // max(docs.count(), 1)
    some = docs.filter(F.pmod(F.xxhash64("h2"), F.lit(2**20)) < share).select("text").mapInArrow(run, "shingle long")
    counted = some.groupBy("shingle").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(KNOWN).toArrow()
    values = counted.column("shingle").to_numpy()
    order = np.argsort(values)
    return values[order], -order


def screen(keys: DataFrame) -> np.ndarray:
    """Bits that are set at the keys (h1): SCREEN bits, put together on executors in pieces of 4 KB."""
    at = F.pmod("h1", F.lit(SCREEN)) + 1  # Spark's places, and its pieces, begin at 1
    pieces = keys.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    out = np.zeros(SCREEN // 8, np.uint8)
    for piece, bits in zip(pieces.column("piece").to_pylist(), pieces.column("bits").to_pylist(), strict=True):
        out[4096 * (piece - 1) : 4096 * piece] = np.frombuffer(bits, np.uint8)
    return out


def let_through(bits: np.ndarray, h1: pa.Array) -> np.ndarray:
    at = h1.to_numpy() % (8 * len(bits))
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def marks(docs: DataFrame, sample: int) -> DataFrame:
    """doc_id, h1, h2, sid (the set's hash), n (its size), prefix, bits (its parities), fp, for every row."""
    common, rank = common_shingles(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", PIECE):
            digests = [shingle_hashes(x, WORDS) for x in b.column("text").to_pylist()]
            found, fp = [as_set(x) for x in digests], majority_bits(digests).view(np.int64)
            own = [pa.array([set_id(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), lists([prefix(x, common, rank) for x in found]), pa.array([parities(x) for x in found], pa.binary()), pa.array(fp)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "h1", "h2")), *own], ["doc_id", "h1", "h2", "sid", "n", "prefix", "bits", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), "h1", "h2", F.col("text").cast("string"))
    return materialize(rows.mapInArrow(run, "doc_id long, h1 long, h2 long, sid long, n int, prefix array<long>, bits binary, fp long"), "marks")


def fingerprint_pairs(sets: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b): sets of one fingerprint, each with the smallest of them; and those of linked fingerprints."""
    first = materialize(sets.groupBy("fp").agg(F.min("sid").alias("first")), "distinct")
    same = spread_join(sets.select("fp", "sid"), first, ["fp"], ["sid"]).filter("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    links = fingerprint_links(first.select("fp"), reach)
    ends = links.join(first.select(F.col("fp").alias("u"), F.col("first").alias("x")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("y")), "v")
    return same.union(ends.select("x", "y"))


def fit(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m whose first common shingle is at i and j can be of similarity 0.8."""
    return 9 * np.minimum(n - i, m - j) >= 4 * (n + m)


def candidates(sets: DataFrame, small: int, centres: int) -> DataFrame:
    """(a, b) candidate pairs; and with b null, (token, a, n, at) the members of large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(token: np.ndarray | None, a: np.ndarray, n: np.ndarray | None, at: np.ndarray | None, b: np.ndarray | None) -> pa.RecordBatch:
            columns = [pa.nulls(len(a), t) if x is None else pa.array(x, t) for x, t in ((token, pa.int64()), (a, pa.int64()), (n, pa.int32()), (at, pa.int32()), (b, pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["token", "a", "n", "at", "b"])

        # of the bucket that goes on: its first members, and how many there were in all
        held, count = [np.zeros(0, x) for x in (np.int64, np.int64, np.int32, np.int32)], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if not len(held[0]) or held[0][0] != columns[0][0]:
                held, count = [x[:0] for x in held], 0
            old = len(held[0])
            token, sid, n, pos = (np.concatenate(x) for x in zip(held, columns, strict=True))
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(first, len(token)))
            start, place = np.repeat(first, size), np.arange(len(token)) - np.repeat(first, size)
            new = place >= 0
            new[:old] = False
            place[old : size[0]] += count - old
            large = np.repeat(place[np.append(first[1:], len(token)) - 1] >= small, size)
            a, b = [sid[:0]], [sid[:0]]  # one batch a chunk: many small ones take much memory
            for lag in range(1, min(small, int(size.max()))):
                at = np.flatnonzero((token[lag:] == token[:-lag]) & new[lag:] & (place[lag:] < small) & fit(n[lag:], pos[lag:], n[:-lag], pos[:-lag]))
                a.append(sid[at])
                b.append(sid[at + lag])
            for c in range(min(centres, small)):
                at = np.flatnonzero(new & (place >= small))
                centre = start[at] + c
                keep = fit(n[at], pos[at], n[centre], pos[centre])
                a.append(sid[centre[keep]])
                b.append(sid[at[keep]])
            if large.any():
                told = large & (new | (count <= small))  # those held were told with the first one beyond them
                yield out(token[told], sid[told], n[told], pos[told], None)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield out(None, pairs[0], None, None, pairs[1])
            last = slice(first[-1], first[-1] + small)
            held, count = [x[last].copy() for x in (token, sid, n, pos)], int(place[-1]) + 1

    # a row of the sets gives prefix rows; the first of a bucket have the fewest shingles before it
    rows = sets.select("sid", "n", F.posexplode("prefix").alias("at", "token")).select("token", "sid", "n", "at")
    found = rows.repartition("token").sortWithinPartitions("token", "at", "sid").mapInArrow(run, "token long, a long, n int, at int, b long")
    return materialize(found, "candidates")


def across(members: DataFrame, held: int = HELD) -> DataFrame:
    """(token, sid, n, at, root) of large buckets -> (a, b): their pairs of different roots.

    Members that are not of the first centre's root (the rest) meet all. Both are cut into blocks of about held
    members, so that no task holds a bucket; a bucket of one root, or whose rest is small, costs its own size.
    """
    main = F.min_by("root", F.struct("at", "sid"))
    told = members.groupBy("token").agg(main.alias("main"), F.count("*").alias("m"))
    members = spread_join(members, told, ["token"], ["sid"])
    rest = members.filter("root <> main")
    some = rest.groupBy("token").agg(F.count("*").alias("r"))
    blocks = [(F.floor((F.col(x) - 1) / held) + 1).cast("long") for x in ("m", "r")]
    own = [F.pmod(F.xxhash64("sid"), x) for x in blocks]
    every = [F.explode(F.sequence(F.lit(0).cast("long"), x - 1)) for x in blocks]
    columns = ["token", "i", "j", "sid", "n", "at", "root", "rests"]
    left = spread_join(rest, some, ["token"], ["sid"]).withColumn("j", own[1]).withColumn("i", every[0]).withColumn("rests", F.lit(0)).select(columns)
    right = spread_join(members, some, ["token"], ["sid"]).withColumn("i", own[0]).withColumn("j", every[1]).withColumn("rests", F.lit(1)).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            if not b.num_rows:
                continue
            keys = np.stack(columns[:3])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (columns[7][1:] != columns[7][:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if key != tuple(keys[:, lo].tolist()):
                    key, block = tuple(keys[:, lo].tolist()), []
                sid, n, at, root = (x[lo:hi] for x in columns[3:7])
                if not columns[7][lo]:
                    block += zip(sid.tolist(), n.tolist(), at.tolist(), root.tolist(), strict=True)
                    continue
                found = [(x, sid[(root != r) & (9 * np.minimum(n - at, m - p) >= 4 * (n + m))]) for x, m, p, r in block]
                x = np.repeat([y for y, _ in found], [len(z) for _, z in found]).astype(np.int64)
                if len(x):
                    y = np.concatenate([z for _, z in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return left.union(right).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "rests").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is 0.8 or more."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n, m = (b.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            yield b.select(["a", "b"]).filter(pa.array([9 * apart(*z[:2]) <= z[2] + z[3] for z in zip(x, y, n, m, strict=True)], pa.bool_()))

    # a set may be a centre of very many
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sized = spread_join(pairs, sets.select(F.col("sid").alias("a"), "n", F.col("bits").alias("x")), ["a"], ["b"])
    sized = spread_join(sized, sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), ["b"], ["a"])
    pairs = materialize(sized.select("a", "b", "n", "m", "x", "y").mapInArrow(bound, "a long, b long"), "pairs")
    needed = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    bits = screen(sets.join(needed, "sid", "left_semi").select("h1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", PIECE):
            found = [shingle_set(x) for x in b.filter(pa.array(let_through(bits, b.column("h1")))).column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in found], pa.int64()), lists(found)], ["sid", "s"])

    full = docs.select("h1", F.col("text").cast("string")).mapInArrow(run, "sid long, s array<long>")
    full = materialize(full.dropDuplicates(["sid"]).join(needed, "sid", "left_semi"), "sets")
    both = spread_join(pairs, full.select(F.col("sid").alias("a"), F.col("s").alias("sa")), ["a"], ["b"])
    both = spread_join(both, full.select(F.col("sid").alias("b"), F.col("s").alias("sb")), ["b"], ["a"])
    # i / (x + y - i) >= 4 / 5
    near = both.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb")))
    return materialize(near.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def one_each(docs: DataFrame, small: int = SMALL, centres: int = CENTRES, sample: int = SAMPLE, held: int = HELD) -> DataFrame:
    """docs (doc_id, text and others) with one row of each group: of smallest doc_id, null last, then of smallest hash."""
    columns = docs.columns
    keyed = docs.withColumns({"h1": F.xxhash64(*columns), "h2": F.xxhash64(F.lit(1), *columns)})
    marked = marks(keyed, sample)
    # a set's row hash is that of one of its rows, whose text is read again
    sets = marked.groupBy("sid").agg(*(F.first(x).alias(x) for x in ("n", "prefix", "bits", "fp")), F.min("h1").alias("h1"))
    sets = materialize(sets, "sets")
    found = candidates(sets.select("sid", "n", "prefix"), small, centres)
    links = verified(keyed, sets, found.filter("b is not null").select("a", "b").union(fingerprint_pairs(sets)))
    roots = connected_components(links)
    large = found.filter("b is null").select("token", F.col("a").alias("sid"), "n", "at")
    if not large.isEmpty():
        one = roots.select(F.col("node").alias("sid"), "root")
        large = materialize(spread_join(large, one, ["sid"], ["token"], "left").select("token", "sid", "n", "at", F.coalesce("root", "sid").alias("root")), "members")
        more = verified(keyed, sets, across(large, held))
        if not more.isEmpty():
            roots = connected_components(links.union(more))
    rows = spread_join(marked.select("doc_id", "h1", "h2", "sid"), roots.select(F.col("node").alias("sid"), "root"), ["sid"], ["h1"], "left")
    rows = materialize(rows.select("doc_id", "h1", "h2", F.coalesce("root", "sid").alias("root")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h2", "h1")).alias("first")
    kept = rows.groupBy("root").agg(first, F.count("*").alias("rows"))
    kept = materialize(kept.select("root", "rows", F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2")), "kept")
    several = screen(spread_join(rows, kept.filter("rows > 1").select("root"), ["root"], ["h1"]))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~let_through(several, b.column("h1"))))

    def first_of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(let_through(several, b.column("h1")) & let_through(firsts, b.column("h1"))))

    def asked_about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(let_through(several, b.column("h1"))))

    # rows outside the first screen are alone in their groups; of those inside, kept ones are inside the second
    firsts = screen(kept.select("h1").mapInArrow(asked_about, "h1 long"))
    asked = keyed.mapInArrow(first_of_several, keyed.schema)
    asked = asked.dropDuplicates(["h1", "h2"]).join(kept.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return keyed.mapInArrow(alone, keyed.schema).unionByName(asked).select(*columns)
