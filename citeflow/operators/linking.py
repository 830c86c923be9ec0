"""Joins between records by words: similarity within blocks, suggestions,
shared terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.functions import records as R
from citeflow.operators import ranking
from citeflow.runtime import cut, spread


def near_duplicates(entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Directed pairs (old, new, similarity) of entries whose first author's
    family is equal, whose years differ by at most one where both are known, and
    whose titles are more similar than the threshold.

    entries: doi, title, authors, year, journal, one row for each DOI. The block
    is family and year; a record without a year meets all years of its family
    through the family block of its own. Within a block, pairs are found by an
    equi-join on the rarest of the words that a similar pair must share (prefix
    filter), so a family with a third of all rows is not paired with itself."""
    rows = entries.select(
        "doi", R.word_set(F.col("title")).alias("w"), F.lower(F.trim(F.split_part(F.try_element_at("authors", F.lit(1)), F.lit(","), F.lit(1)))).alias("fam"),
        F.col("year").cast("int").alias("year"), R.is_preprint(F.col("doi"), F.col("journal")).alias("pre"),
    ).where("fam <> ''")
    words = rows.select("doi", F.explode("w").alias("t"))
    order = words.groupBy("t").agg(F.count("*").alias("df"))
    sorted_words = words.join(order, "t").groupBy("doi").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("s"))
    keep = (F.size("s") - F.ceil(threshold * F.size("s")) + 1).cast("int")
    prefixed = rows.join(sorted_words, "doi").withColumn("p", F.explode(F.slice("s", F.lit(1), keep)))
    a, b = (prefixed.select("fam", "p", *[F.col(c).alias(f"{c}_{x}") for c in ("doi", "w", "year", "pre")]) for x in "ab")
    near = a.join(b, ["fam", "p"]).where((F.col("doi_a") < F.col("doi_b")) & (F.col("year_a").isNull() | F.col("year_b").isNull() | (F.abs(F.col("year_a") - F.col("year_b")) <= 1)))
    near = near.dropDuplicates(["doi_a", "doi_b"]).withColumn("similarity", R.jaccard(F.col("w_a"), F.col("w_b"))).where(F.col("similarity") > threshold)
    ya, yb = F.coalesce("year_a", F.lit(0)), F.coalesce("year_b", F.lit(0))
    a_old = F.when(F.col("pre_a") & ~F.col("pre_b"), True).when(F.col("pre_b") & ~F.col("pre_a"), False).when(ya != yb, ya < yb).otherwise(True)
    return near.select(F.when(a_old, F.col("doi_a")).otherwise(F.col("doi_b")).alias("old"), F.when(a_old, F.col("doi_b")).otherwise(F.col("doi_a")).alias("new"), "similarity")


def suggestions(queries: DataFrame, catalogue: DataFrame, k: int = 3, least: float = 0.4, frequent: int = 128) -> DataFrame:
    """For each query (qid, title) the k catalogue titles (cid, title) of highest
    Jaccard similarity, at least ``least``, with whether it reaches 0.6 (ties:
    least cid).

    The most frequent words of the catalogue (``frequent``, at most 128) are bits
    of two longs, the rarest first; all others are rare. Titles with a rare word
    in common meet at the first of them, among the words that a pair of that
    similarity must share. For the rest the similarity depends only on the
    frequent words and the size of either title, so not titles but these patterns
    meet, with the k least cids of each. A title left out there has k of its own
    pattern before it, even where some of those share a rare word, as that only
    makes them more similar."""
    hashes = F.array_distinct(F.transform(R.word_set(F.col("title")), lambda w: F.xxhash64(w)))
    q = queries.select("qid", hashes.alias("w")).where(F.size("w") > 0)
    c = catalogue.select("cid", hashes.alias("w")).where(F.size("w") > 0)
    words = c.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    top = words.orderBy(F.desc("df"), F.desc("t")).limit(frequent).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("s"))
    words = cut(words.join(F.broadcast(top.select(F.posexplode("s").alias("bit", "x")).select("x.t", "bit")), "t", "left"))
    sides = [cut(_ordered(q, words, "qid")), cut(_ordered(c, words, "cid"))]  # read twice
    pairs = _sharing_rare(*sides, least).unionByName(_of_like_patterns(*sides, k, least)).groupBy("qid", "cid").agg(F.max("similarity").alias("similarity"))
    best = ranking.top(pairs, ["qid"], [F.desc("similarity"), F.col("cid")], k)
    return best.select("qid", "cid", "similarity", "rank", (F.col("similarity") >= 0.6).alias("match"))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _shifted(value: int, bits: Column) -> Column:
    return F.call_function("shiftleft", _long(value), bits)


def _ordered(rows: DataFrame, words: DataFrame, ident: str) -> DataFrame:
    """(ident, n, w, rare, lo, hi): the number of words of each title, its words
    in the common order, the rarest first, how many are rare, the others' bits."""
    word = F.struct(F.coalesce("df", _long(0)).alias("df"), "t", "bit")
    s = rows.select(ident, F.explode("w").alias("t")).join(words, "t", "left").groupBy(ident).agg(F.array_sort(F.collect_list(word)).alias("s"))

    def bits(low: int) -> Column:
        return F.aggregate(F.filter("s", lambda x: (x["bit"] >= low) & (x["bit"] < low + 64)), _long(0), lambda a, x: a.bitwiseOR(_shifted(1, x["bit"] - low)))

    rare = F.size(F.filter("s", lambda x: x["bit"].isNull()))
    return s.select(ident, F.size("s").alias("n"), F.transform("s", lambda x: x["t"]).alias("w"), rare.alias("rare"), bits(0).alias("lo"), bits(64).alias("hi"))


def _needed(n: Column, least: float) -> Column:
    """Words that a title of n words has in common with any that is so similar."""
    return F.ceil(least * n - 1e-9).cast("int")


def _sharing_rare(q: DataFrame, c: DataFrame, least: float) -> DataFrame:
    """(qid, cid, similarity) of the titles that share a rare word. A pair counts
    at its first common word alone, where it is scored."""

    def prefixed(rows: DataFrame, ident: str, w: str) -> DataFrame:
        keep = F.least(F.col("rare"), F.col("n") - _needed(F.col("n"), least) + 1)
        return rows.select(ident, F.col("n").alias(f"{ident}_n"), F.col("w").alias(w), F.posexplode(F.slice("w", F.lit(1), keep)).alias(f"{ident}_at", "p"))

    # At their first common word two titles can have at most one word and what follows it in common.
    m = prefixed(q, "qid", "qw").join(prefixed(c, "cid", "cw"), "p")
    sizes = F.least("qid_n", "cid_n") >= least * F.greatest("qid_n", "cid_n") - 1e-9
    rest = 1 + F.least(F.col("qid_n") - F.col("qid_at"), F.col("cid_n") - F.col("cid_at")) - 1
    enough = rest >= least / (1 + least) * (F.col("qid_n") + F.col("cid_n")) - 1e-9
    first = ~F.arrays_overlap(F.slice("qw", F.lit(1), F.col("qid_at")), F.slice("cw", F.lit(1), F.col("cid_at")))
    scored = m.where(sizes & enough & first).select("qid", "cid", R.jaccard(F.col("qw"), F.col("cw")).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def _of_like_patterns(q: DataFrame, c: DataFrame, k: int, least: float) -> DataFrame:
    """(qid, cid, similarity) by frequent words alone: for each query the best k
    of the titles that are among the k least cids of their pattern. Patterns meet
    at the first bit that both have, among those that a pair must share."""
    have = F.bit_count("lo") + F.bit_count("hi")

    def prefixed(rows: DataFrame) -> DataFrame:
        """p: the first bits of each. The bits before p are lo_p and hi_p."""
        has = F.filter(F.sequence(F.lit(0), F.lit(127)), lambda x: F.when(x < 64, F.col("lo")).otherwise(F.col("hi")).bitwiseAND(_shifted(1, x % 64)) != 0)
        r = rows.select("*", F.explode(F.slice(has, F.lit(1), have - _needed(F.col("n"), least) + 1)).alias("p"))
        before, low = F.bitwise_not(_shifted(-1, F.col("p") % 64)), F.col("p") < 64
        lo, hi = F.col("lo"), F.col("hi")
        return spread(r.withColumns({"lo_p": F.when(low, lo.bitwiseAND(before)).otherwise(lo), "hi_p": F.when(low, _long(0)).otherwise(hi.bitwiseAND(before))}), "p")

    key = ["n", "lo", "hi"]
    qs, cs = (x.where(have >= _needed(F.col("n"), least)).select(ident, *key) for x, ident in ((q, "qid"), (c, "cid")))
    a = prefixed(qs.select(*key).distinct())
    b = prefixed(ranking.top(cs, key, [F.col("cid")], k).groupBy(*key).agg(F.array_sort(F.collect_list("cid")).alias("cids"))).drop("lo_p", "hi_p")
    b = b.withColumnsRenamed({x: f"c_{x}" for x in key})
    common = F.bit_count(F.col("lo").bitwiseAND(F.col("c_lo"))) + F.bit_count(F.col("hi").bitwiseAND(F.col("c_hi")))
    similarity = common / (F.col("n") + F.col("c_n") - common)
    first = (F.col("lo_p").bitwiseAND(F.col("c_lo")) == 0) & (F.col("hi_p").bitwiseAND(F.col("c_hi")) == 0)
    met = a.join(b, "p").where((similarity >= least) & first).select(*key, "cids", similarity.alias("similarity"))
    # The best k titles are of the best k patterns, these taken by their least cid.
    met = ranking.top(met, key, [F.desc("similarity"), F.col("cids")[0]], k).drop("rank")
    best = ranking.top(met.select(*key, "similarity", F.explode("cids").alias("cid")), key, [F.desc("similarity"), F.col("cid")], k)
    return qs.join(best, key).select("qid", "cid", "similarity")


def most_shared(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """For each left (lid, terms) the right (rid, terms) with most terms in
    common, at least ``least`` (ties: least rid): an equi-join on terms and an
    aggregation, no cross join."""
    a = left.select("lid", F.explode(F.array_distinct("terms")).alias("t"))
    b = right.select("rid", F.explode(F.array_distinct("terms")).alias("t"))
    shared = a.join(b, "t").groupBy("lid", "rid").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    best = shared.groupBy("lid").agg(F.min(F.struct((-F.col("shared")).alias("n"), "rid")).alias("m"))
    return best.select("lid", "m.rid", (-F.col("m.n")).alias("shared"))


def keyword_score(title: Column, journal: Column, keywords: list[str]) -> Column:
    """Occurrences of the keywords in the title, and half as much for those in
    the journal's name."""
    def count(text: Column, k: str) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return ((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("double")
    total = F.lit(0.0)
    for k in keywords:
        total = total + count(title, k) + 0.5 * count(journal, k)
    return total
