"""Near-duplicate records by a parity-sketch join.

Each distinct word of a record is hashed to one bit of one of m bands; a band is
the XOR of its words' bits. Two records whose word sets differ by d words differ
in at most d bits: the Hamming distance of the sketches is a lower bound of the
symmetric difference. Sketches are kept sparse, as their non-zero bands.

Pigeonhole: sets A and B of Jaccard similarity t share at least t|A| words, so at
most x = |A| - t|A| words of A are not in B. A band of A that B does not repeat
holds one of them, or B has a second word in it; if no record has more than c
bands of several words, A and B have all but x+c of A's bands in common. Under
one order of all band values, rarest first, the first x+c+l bands of A and of B
therefore both hold the l first common ones, for each l up to what A and B must
share at least. There are so many bands (they cost nothing, as sketches are
sparse) that c is 0 but for very long records.

Of two similar records one is near: A and B together have at most (1-t)/(1+t)
(|A| + |B|) words that the other lacks, so one of them has passed over at most
h = (1-t)/(1+t) times its own words (and c) when it reaches the l-th common value.
A value that no record holds within its first h+l is given up however many hold
it: no similar pair has its first l common values there. Such are the words of
everyday titles, which come last in the order.

The join goes by levels. At level 1 records meet by one band value of their
first x+c+1; a value that more than FEW records have is hot and is not joined
but extended: at level l+1 its records meet by it and a further band value of
their first x+c+l+1, and so on. A pair that has a common value that is not hot
has met; one whose common values are all hot meets at a later level. So no group
that is joined is larger than FEW and no pair is lost. Records whose guaranteed
overlap ends at a level, and all at the last one, are compared there within their
hot group, cut into blocks that are spread over tasks. The last level is the one
whose hot groups have no more pairs than FEW for each record: extending them would
cost more jobs than comparisons.

Disk and the driver hold one level at a time: a level's pairs are checkpointed
before the next begins, rows with their band values are derived anew where they
are needed, and what a level leaves behind is released.

Joined pairs must pass the folded sketch's Hamming distance and then the exact
similarity. Records of equal word sets are one representative before the join,
so a group of copies of any size costs one row; copies come back as links to it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.graph import components
from citeflow.runtime import cut, release

#: Least binary logarithm of the number of bands; with very long records there
#: are more, so that few records have two words in a band.
BANDS = 40
#: Records that may meet by one (composite) band value; more make it hot.
FEW = 32
#: Band values that are combined at most.
LEVELS = 8
#: Words that a task sketches at a time.
WORDS = 1 << 20
#: Cells of the histogram that gives the order: its size, half a MB, does not
#: depend on the data.
CELLS = 1 << 17


def size_bands(threshold: float, longest: int) -> list[int]:
    """Upper ends of size bands, each at least 1/threshold times the one before:
    sets as similar as the threshold are in one band or in neighbours."""
    ends = [1]
    while ends[-1] < longest:
        ends.append(max(ends[-1] + 1, math.floor((ends[-1] + 1) / threshold)))
    return ends


def representatives(docs: DataFrame, key: str, tokens: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(reps, links): one row for each distinct word set of records of at least
    ``least`` words, repeats counted: rid (its least key), n, toks (sorted
    hashes); and (key, rid) of every record."""
    long = docs.where((F.size(tokens) >= least) & F.col(key).isNotNull())
    hashed = long.select(F.col(key).alias("k"), F.array_sort(F.transform(F.array_distinct(tokens), lambda w: F.xxhash64(w))).alias("toks"))
    # Two hashes of the whole set, of 96 bits together, stand for it as a group key.
    hashed = hashed.select("k", "toks", F.xxhash64("toks").alias("h1"), F.hash("toks", F.lit(7)).alias("h2"))
    reps = cut(hashed.groupBy("h1", "h2").agg(F.min("k").alias("rid"), F.min_by("toks", "k").alias("toks")))
    links = hashed.select("k", "h1", "h2").distinct().join(reps.select("h1", "h2", "rid"), ["h1", "h2"]).select("k", "rid")
    return reps.select("rid", F.size("toks").alias("n"), "toks", "h1", "h2"), links


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sketched(words: np.ndarray, starts: np.ndarray, m: int, freq: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each record (its words begin at ``starts``): non-zero bands, the two
    halves of the folded sketch, and the first ``most`` band values in the common
    order as (values, how many). Bands of several words come last in the order,
    as their value is not that of a word."""
    n, owner = len(starts), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    band, bit = words & np.uint64(m - 1), np.uint64(1) << ((words >> np.uint64(40)) % np.uint64(63))
    by_band = np.lexsort((band, owner))
    heads = np.flatnonzero(np.append(True, (np.diff(owner[by_band]) != 0) | (np.diff(band[by_band]) != 0)))
    value, size = np.bitwise_xor.reduceat(bit[by_band], heads), np.diff(np.append(heads, len(words)))
    owner, band, first = owner[by_band][heads], band[by_band][heads], by_band[heads]
    rank = np.where(size > 1, 1 << 40, freq[first])
    half = band % np.uint64(2)
    s = []
    for h in (0, 1):
        fold = np.zeros(n, dtype=np.uint64)
        np.bitwise_xor.at(fold, owner, np.where(half == h, value, np.uint64(0)))
        s.append(fold.view(np.int64))
    key = _mixed(_mixed(band) ^ value)
    held = np.flatnonzero(value != 0)
    held = held[np.lexsort((key[held], rank[held], owner[held]))]
    counts = np.bincount(owner[held], minlength=n)
    place = np.arange(len(held)) - np.repeat(np.cumsum(counts) - counts, counts)
    used = held[place < most[owner[held]]]
    return counts.astype(np.int32), *s, key[used].view(np.int64), np.minimum(counts, most)


def sketches(reps: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(rid, n, spare, close, sure, keys, s0, s1) of each record: how many of its
    band values a similar record may lack (x+c), how many a near record may have
    passed over (h+c), how many both have for certain, the first band values in
    the common order, and the sketch folded to 128 bits; and c, 0 if no record has
    two words in a band. Not checkpointed: the sketches are
    larger than the words and cheap to derive."""
    longest = reps.agg(F.max("n")).head()[0] or 1
    m = 1 << min(63, max(BANDS, math.ceil(math.log2(64 * longest * longest))))
    # Words beyond the first of their band are at least as many as bands of several words.
    bands = F.array_distinct(F.transform("toks", lambda w: w.bitwiseAND(F.lit(m - 1))))
    several = reps.agg(F.max(F.col("n") - F.size(bands))).head()[0] or 0
    cells = reps.select(F.explode("toks").alias("w")).groupBy(F.pmod("w", F.lit(CELLS)).alias("cell")).agg(F.count("*").alias("freq")).toArrow()
    freq = np.zeros(CELLS, dtype=np.int64)
    freq[cells["cell"].to_numpy()] = cells["freq"].to_numpy()
    sc = reps.sparkSession.sparkContext
    shared = sc.broadcast(np.minimum(freq, (1 << 31) - 1).astype(np.int32))
    kind = reps.schema["rid"].dataType.simpleString()

    def part(rid: pa.Array, toks: pa.ListArray) -> pa.RecordBatch:
        lengths = np.diff(toks.offsets.to_numpy())
        words = toks.flatten().to_numpy().view(np.uint64)
        starts = np.cumsum(lengths) - lengths
        weight = shared.value[(words.view(np.int64) % CELLS)]
        spare = lengths - np.ceil(threshold * lengths - 1e-9).astype(np.int64) + several
        close = np.floor((1 - threshold) / (1 + threshold) * lengths + 1e-9).astype(np.int64) + several
        held, s0, s1, keys, sizes = _sketched(words, starts, m, weight, spare + LEVELS)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(keys))
        return pa.RecordBatch.from_arrays(
            [rid, pa.array(lengths.astype(np.int32)), pa.array(spare.astype(np.int32)), pa.array(close.astype(np.int32)), pa.array((held - spare).astype(np.int32)), lists, pa.array(s0), pa.array(s1)],
            ["rid", "n", "spare", "close", "sure", "keys", "s0", "s1"],
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rid, toks = batch.column(0), batch.column(1)
            ends_at = toks.offsets.to_numpy()
            lo = 0
            while lo < len(rid):  # as many records at a time as have about WORDS words
                hi = max(lo + 1, int(np.searchsorted(ends_at, ends_at[lo] + WORDS, side="right")) - 1)
                rows = batch.slice(lo, hi - lo)
                yield part(rows.column(0), pa.array(rows.column(1).to_pylist(), toks.type) if rows.column(1).null_count else pa.concat_arrays([rows.column(1)]))
                lo = hi

    return reps.select("rid", "toks").mapInArrow(run, f"rid {kind}, n int, spare int, close int, sure int, keys array<bigint>, s0 bigint, s1 bigint"), several


_SIDE = ("rid", "n", "s0", "s1")


def _near(threshold: float) -> Column:
    """What a pair (a, b) must pass before it is compared: sizes and sketches
    near enough."""
    total = F.col("n_a") + F.col("n_b")
    apart = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
    sizes = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    return (F.col("rid_a") < F.col("rid_b")) & sizes & (apart <= (1 - threshold) / (1 + threshold) * total + 1e-9)


def _blocked(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs within hot groups of which at least one record ends here: the group
    is cut into blocks of about FEW and each two blocks meet in a group of their
    own, so no task has the group alone."""
    blocks = F.ceil(F.col("freq") / FEW).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    a, b = (rows.select("path", "low", "high", *[F.col(c).alias(f"{c}_{x}") for c in (*_SIDE, "block", "ends")]) for x in "ab")
    once = (F.col("block_a") != F.col("block_b")) | (F.col("low") == F.col("high"))
    return a.hint("merge").join(b.hint("merge"), ["path", "low", "high"]).where((F.col("ends_a") | F.col("ends_b")) & once & _near(threshold)).select("rid_a", "rid_b").distinct()


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(rid_a, rid_b), rid_a < rid_b, of pairs to compare, some of them twice:
    all that are similar, and others."""
    recs, several = sketches(reps, threshold)
    loose = several > 0 and recs.where("sure <= 0").limit(1).count() > 0  # no band value for certain: these meet all of about their size
    fixed = ["rid", "n", "spare", "close", "sure", "keys", "s0", "s1"]
    nothing = F.struct(F.lit(0).cast("long").alias("path"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("freq"))
    total = reps.count()
    open_ = recs.select(*fixed, F.array(nothing).alias("hot"))
    found: list[DataFrame] = []
    for level in range(0 if loose else 1, LEVELS + 1):
        rows = open_.select(*fixed, F.explode("hot").alias("h"))
        if level == 0:
            size = sum(((F.col("n") > e).cast("int") for e in size_bands(threshold, reps.agg(F.max("n")).head()[0] or 1)), F.lit(0))
            rows = rows.select(*_SIDE, F.lit(-1).alias("at"), F.lit(True).alias("near"), F.explode(F.array(F.xxhash64(size), F.xxhash64(size + 1))).alias("path"))
        else:
            tail = F.slice("keys", F.col("h.at") + 2, F.greatest(F.lit(0), F.col("spare") + level - 1 - F.col("h.at")))
            rows = rows.select(*_SIDE, "close", F.col("h").alias("h"), F.posexplode(tail).alias("step", "value"))
            at = F.col("h.at") + 1 + F.col("step")
            rows = rows.select(*_SIDE, at.alias("at"), (at + 1 - level <= F.col("close")).alias("near"), F.xxhash64("h.path", "value").alias("path"))
        many = cut(rows.groupBy("path").agg(F.count("*").alias("freq"), F.bool_or("near").alias("any")).where(F.col("freq") > FEW))
        few = rows.join(many, "path", "left_anti")
        a, b = (few.select("path", *[F.col(c).alias(f"{c}_{x}") for c in (*_SIDE, "near")]) for x in "ab")
        # The sides are one table, divided by the same key; as large as each other, so none is broadcast.
        pairs = a.hint("merge").join(b.hint("merge"), "path").where((F.col("near_a") | F.col("near_b")) & _near(threshold))
        found.append(cut(pairs.select("rid_a", "rid_b").distinct()))
        release(reps.sparkSession)
        hot = many.where("any").select("path", "freq")
        compared = hot.agg(F.sum(F.col("freq") * F.col("freq"))).head()[0] or 0
        last = level == LEVELS or compared <= FEW * total
        if compared and last:
            found.append(cut(_blocked(rows.join(hot, "path").withColumn("ends", F.lit(True)), threshold)))
        elif compared:
            hot = rows.select("rid", "at", "path").join(hot, "path").groupBy("rid").agg(F.collect_list(F.struct("path", "at", "freq")).alias("hot"))
            open_ = cut(open_.select(*fixed).join(hot, "rid"))
            ends = F.col("sure") <= level
            left, ending = open_.agg(F.count("*"), F.count_if(ends)).head()
            if ending:
                over = open_.select(*_SIDE, F.explode("hot").alias("h"), ends.alias("ends")).select(*_SIDE, "ends", F.col("h.path").alias("path"), F.col("h.freq").alias("freq"))
                over = over.join(over.where("ends").select("path").distinct(), "path", "left_semi")
                found.append(cut(_blocked(over, threshold)))
            last = ending == left
        del rows, many, few, a, b, pairs, hot
        release(reps.sparkSession)
        if last:
            break
        open_ = open_.where(F.col("sure") > level)
    spark, kind = reps.sparkSession, reps.schema["rid"].dataType.simpleString()
    out = spark.createDataFrame(spark.sparkContext.emptyRDD(), f"rid_a {kind}, rid_b {kind}")
    for more in found:
        out = out.unionByName(more)
    return out


def similar(reps: DataFrame, threshold: float) -> DataFrame:
    """(rid_a, rid_b, similarity) of all representatives of at least that
    Jaccard similarity, rid_a < rid_b."""
    pairs = candidates(reps, threshold).distinct()
    left, right = (reps.select(F.col("rid").alias(f"rid_{x}"), F.col("toks").alias(f"toks_{x}")) for x in "ab")
    both = F.size(F.array_intersect("toks_a", "toks_b"))
    return (
        pairs.join(left, "rid_a").join(right, "rid_b")
        .select("rid_a", "rid_b", (both / (F.size("toks_a") + F.size("toks_b") - both)).alias("similarity"))
        .where(F.col("similarity") >= threshold - 1e-9)
    )


def groups(docs: DataFrame, key: str, tokens: str, threshold: float, least: int, same: DataFrame | None = None) -> DataFrame:
    """(key, component) of each record that has a near-duplicate.

    docs: key (long; rows of one key are one record), tokens (array of words in
    order, repeats too; null counts as empty; fewer than ``least`` words: no
    case). same:
    further links (a, b) between keys, such as equal identifiers. Empty input
    gives an empty result; records alone in their group have no row."""
    reps, links = representatives(docs, key, tokens, least)
    edges = similar(reps, threshold).select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))
    edges = edges.unionByName(links.where("k <> rid").select(F.col("k").alias("a"), F.col("rid").alias("b")))
    if same is not None:
        edges = edges.unionByName(same.select("a", "b"))
    return components(edges, "a", "b").withColumnRenamed("node", key)


def equal_links(docs: DataFrame, key: str, value: str) -> DataFrame:
    """Links (a, b) of each record to the least key with the same value; null
    values link nothing. A value of any number of records gives one star."""
    rows = docs.where(F.col(value).isNotNull()).select(F.col(key).alias("a"), F.col(value).alias("v")).distinct()
    return rows.join(rows.groupBy("v").agg(F.min("a").alias("b")), "v").where("a <> b").select("a", "b")
