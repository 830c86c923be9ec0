"""Operators of the core on small fixtures, and against brute force."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeflow.functions import numbers as N
from citeflow.functions import records as R
from citeflow.functions.text import doi_key, loose_key, words
from citeflow.graph import components
from citeflow.operators import linking, prose, ranking, store
from citeflow.operators.orphans import orphans, targets


def one(spark, column, **values):
    """The value of a column expression over one row."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values))))
    return row.select(column.alias("x")).head()[0]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("10.1/AbC", "10.1/abc"), (" doi:10.1/a ", "10.1/a"), ("DOI 10.1/a", "10.1/a"), ("https://doi.org/10.1/a.", "10.1/a"), ("10.1%2Fa;", "10.1/a"),
        ("https://resolver.example/10.1/a", "10.1/a"), ("nct:NCT01", None), ("", None), (None, None), ("10.1/", None),
    ],
)
def test_doi_key(spark, raw, want):
    assert one(spark, doi_key(F.col("a")), a=raw) == want


def test_loose_key_and_words(spark):
    assert one(spark, loose_key(F.col("a")), a="\t Smith2020 \n") == "smith2020"
    assert one(spark, loose_key(F.col("a")), a=" \t") is None
    assert one(spark, words(F.col("a")), a="The <i>Cat</i>, the cat-flap & hat") == ["the", "cat", "flap", "hat"]
    assert one(spark, words(F.col("a")), a=None) == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("n=1,234,567 and 74 291", ["1234567", "74291"]), ("RR 0.27 95% CI .85", ["0.27", "95", "0.85"]), ("HbA1c, 5-HT and CoQ10", []),
        ("in (2022) 12 men", ["12"]), ("２０２２年４５％", ["45"]), ("1.2–3.4", ["1.2", "3.4"]), ("x_1 = 15{,}226", ["15226"]), ("1,18,171", ["118171"]), ("", []), (None, []),
        ("x_{12} is 3", ["3"]), ("p=0.05; n = 12 345,5 or 1234 567", ["0.05", "12345", "5", "1234", "567"]), ("IL-6 30mg 12,5", ["30", "12", "5"]), ("2019年龄 2019 年", ["2019"]), ("1 000.5 and 10\\,200", ["1000.5", "10200"]), ("1990s 1,23,45", ["1990", "1", "23", "45"]),
    ],
)
def test_numbers(spark, text, want):
    assert one(spark, N.numbers(F.col("a")), a=text) == want


def test_missing_numbers_compare_as_decimals(spark):
    df = spark.createDataFrame([(["0.80", "3", "7"], ["0.8", "3.0"])], "a array<string>, b array<string>")
    assert df.select(N.missing(F.col("a"), F.col("b"))).head()[0] == ["7"]


def test_record_strings(spark):
    df = spark.createDataFrame([(["van der Berg, P.", "Li, X.", "Ali, B."], 2020, "T", "J", "10.1/x"), ([], None, "T", "", "10.1/y"), (["A, B."] * 21, 2001, "T", None, "10.1/z")], "a array<string>, y int, t string, j string, d string")
    got = [r[0] for r in df.select(R.apa(F.col("a"), F.col("y"), F.col("t"), F.col("j"), F.col("d"))).collect()]
    assert got[0] == "van der Berg, P., Li, X., & Ali, B. (2020). T. *J*. https://doi.org/10.1/x"
    assert got[1] == "Anon. (n.d.). T. https://doi.org/10.1/y"
    assert got[2].startswith("A, B., A, B.") and ", ... A, B. (2001)" in got[2]
    assert [r[0] for r in df.select(R.in_text(F.col("a"))).collect()] == ["van der Berg et al.", None, "A et al."]
    assert df.select(R.bare_family(F.try_element_at("a", F.lit(1)))).head()[0] == "berg"
    assert [r[0] for r in df.select(R.key_base(F.col("a"), F.col("y"))).collect()] == ["vanderberg2020", "anonna", "a2001"]


def test_hashed_key_is_base32_of_sha1(spark):
    import base64
    import hashlib

    want = "b" + base64.b32encode(hashlib.sha1(b"10.1/x").digest()).decode()[:4].lower()
    assert one(spark, R.hashed_key(F.col("a"), F.col("b")), a="b", b="10.1/X") == want
    assert one(spark, R.hashed_key(F.col("a"), F.col("b")), a="b", b="") == "b"


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(1, 400)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = spark.createDataFrame(edges + [(7, 7)], "a long, b long").unionByName(spark.createDataFrame([(None, 1)], "a long, b long")).repartition(7)
    got = {r.node: r.component for r in components(rows, "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


class TestOrphans:
    REFS = [(1, "t", "A"), (2, "t", "b"), (3, None, "a"), (4, "t", None), (5, "u", "a"), (6, "t", "gone"), (7, "t", "late"), (8, None, None)]
    FOUND = [("t", "a", 1, False), ("t", "gone", 1, True), ("t", "late", 9, False)]

    def run(self, spark, match, required=None):
        at = lambda n: datetime(2025, 1, n)
        refs = spark.createDataFrame([(i, t, k and k.lower(), at(5)) for i, t, k in self.REFS], "id long, topic string, key string, at timestamp")
        found = targets(spark.createDataFrame([(t, k, at(n), d) for t, k, n, d in self.FOUND], "topic string, key string, arrived_at timestamp, deleted boolean"), ["topic", "key"], "arrived_at", "deleted")
        return {r.id: r.why for r in orphans(refs, found, ["topic", "key"], at="at", match=match, required=required).collect()}

    def test_partial(self, spark):
        assert self.run(spark, "partial") == {2: "missing", 5: "missing", 6: "deleted", 7: "later"}

    def test_simple(self, spark):
        assert self.run(spark, "simple") == {2: "missing", 5: "missing", 6: "deleted", 7: "later"}

    def test_full(self, spark):
        assert self.run(spark, "full") == {2: "missing", 3: "missing", 4: "missing", 5: "missing", 6: "deleted", 7: "later"}

    def test_required(self, spark):
        assert self.run(spark, "partial", ["key"]) == {2: "missing", 5: "missing", 6: "deleted", 7: "later"}

    def test_required_alone(self, spark):
        """A reference without a topic whose key is required is still one."""
        refs = spark.createDataFrame([(1, None, "a"), (2, None, "nowhere"), (3, None, None)], "id long, topic string, key string")
        found = targets(spark.createDataFrame([("t", "a")], "topic string, key string"), ["topic", "key"])
        got = {m: {r.id: r.why for r in orphans(refs, found, ["topic", "key"], match=m, required=["key"]).collect()} for m in ("simple", "partial", "full")}
        assert got == {"simple": {}, "partial": {2: "missing"}, "full": {1: "missing", 2: "missing"}}

    def test_unknown_semantics(self, spark):
        with pytest.raises(ValueError):
            self.run(spark, "none")

    def test_empty_and_clashing_columns(self, spark):
        refs = spark.createDataFrame([("k", "x", "y")], "key string, first_at string, gone string")
        none = targets(spark.createDataFrame([], "key string"), ["key"])
        got = orphans(refs, none, ["key"]).collect()
        assert [(r.key, r.first_at, r.gone, r.why) for r in got] == [("k", "x", "y", "missing")]
        assert orphans(refs.limit(0), none, ["key"]).count() == 0

    def test_repeated_rows_and_ties(self, spark):
        refs = spark.createDataFrame([("k",), ("k",), ("m",)], "key string")
        found = targets(spark.createDataFrame([("k",), ("k",)], "key string"), ["key"])
        assert [r.key for r in orphans(refs, found, ["key"]).collect()] == ["m"]


def test_store_merge_and_current(spark):
    rows = spark.createDataFrame(
        [("k", 1, "g1", "verified", "old", False), ("k", 2, "g2", "pending", None, False), ("m", 3, None, "pending", "t", False), ("m", 4, "g3", "failed", "u", True)],
        "key string, seq long, gap string, status string, title string, deleted boolean",
    )
    got = {r.key: r for r in store.merged(rows, ["key"], "seq", ["gap"], ["title"], {"status": "verified"}).collect()}
    assert (got["k"].gap, got["k"].title, got["k"].status, got["k"].versions) == ("g1", "old", "verified", 2)
    assert (got["m"].gap, got["m"].title, got["m"].status) == ("g3", "u", "failed")
    assert [r.key for r in store.current(rows, ["key"], ["seq"]).collect()] == ["k"]
    assert store.put(rows, rows.where("seq = 4"), ["key"]).count() == 3
    assert store.without(rows, rows.where("seq = 4"), ["key"]).count() == 2
    v = spark.createDataFrame([("a", "keep", 1), ("a", "exclude", 2)], "k string, verdict string, o int")
    assert store.ordered_verdicts(v, "k", "o").head()[:3] == ("a", "exclude", 2)


def test_supersession(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.95), ("d", "c", 0.9), ("e", "b", 0.9), ("e", "a", 0.9)], "old string, new string, similarity double")
    got = {r.doi: (r.superseded_by, r.supersedes) for r in store.supersession(pairs).collect()}
    assert got == {"a": ("c", ["e"]), "c": (None, ["a", "d"]), "d": ("c", None), "e": ("a", None)}


def test_admission_with_look_ahead(spark):
    rows = spark.createDataFrame([("q", i, i not in (1, 2)) for i in range(40)] + [("r", 0, True), ("r", 1, False)], "q string, p int, ok boolean")
    got = {r.q: (r.admitted, r.rejected, r.more) for r in ranking.admitted(rows, ["q"], F.col("p"), F.col("ok"), 5).collect()}
    assert got == {"q": (5, 2, True), "r": (1, 1, False)}


def test_numbered_splits_a_group(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("g"), ((F.col("id") * 7919) % 2003).alias("v"))
    got = ranking.numbered(rows.where("g = 'hot' OR v % 5 = 0"), ["g"], ["v"], "place").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.g or "", r.v)):
        by[r.g] = by.get(r.g, 0) + 1
        assert r.place == by[r.g]
    assert by["hot"] == 667 and None in by


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", 7)], "g string, v int")
    assert {r.g: r.upper_median for r in ranking.upper_median(rows, ["g"], "v").collect()} == {"a": 3, "b": 7}


def test_near_duplicates_match_brute_force(spark):
    import re

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(160):
        title = rng.sample(vocabulary, 9) if i % 3 or not rows else [w if rng.random() > 0.1 else rng.choice(vocabulary) for w in rows[rng.randrange(len(rows))][1].split()]
        rows.append((f"10.1/{i:03}", " ".join(title), [f"{rng.choice('ab')}, X."], rng.choice([None, 2000, 2001, 2003]), rng.choice(["", "J", "medRxiv"])))
    got = {tuple(sorted((r.old, r.new))) for r in linking.near_duplicates(spark.createDataFrame(rows, "doi string, title string, authors array<string>, year int, journal string"), 0.6).collect()}
    want = set()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            x, y = set(re.findall(r"\w+", a[1])), set(re.findall(r"\w+", b[1]))
            if a[2][0][0] == b[2][0][0] and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 1) and len(x & y) / len(x | y) > 0.6:
                want.add(tuple(sorted((a[0], b[0]))))
    assert got == want and len(want) > 5


def test_prose(spark):
    text = "## One\nAlpha is 3 [@a2001]; beta [@b2002].\n## Two\nGamma [@a2001]"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.cited, r.section) for r in prose.under_headings(docs, "doc_id", "text").orderBy("part", "nth").collect()] == [("a2001", "One"), ("b2002", "One"), ("a2001", "Two")]
    assert [r.sentence for r in prose.cited_sentences(docs, "doc_id", "text").orderBy("line", "nth").collect()] == ["Alpha is 3", "beta", "Gamma"]
    assert {(r.section, r.size) for r in prose.sections(docs, "doc_id", "text").collect()} == {("One", 35), ("Two", 14)}
    rows = spark.createDataFrame([(1, "1 | Include | drug | why | x\nno\n2|exclude|d")], "doc_id long, text string")
    assert [(r.verdict, r.item, r.reason) for r in prose.pipe_rows(rows, "doc_id", "text").collect()] == [("include", "drug", "why")]
    assert one(spark, prose.content_terms(F.col("a")), a="Deep 血糖水 x deep") == ["deep", "血糖", "糖水"]


def test_files_round_trip(spark, tmp_path):
    from citeflow.sources import files, payloads

    d = tmp_path / "reviews" / "t1" / "references"
    d.mkdir(parents=True)
    (d / "a.json").write_text(json.dumps({"doi": "10.1/a", "title": "T", "authors": ["A, B."], "year": 2001}))
    (d / "b.json").write_text(json.dumps({"doi": "10.1/b", "year": "soon"}))
    (d / "c.json").write_text("{ broken")
    got = {r.doi: (r.topic, r.year, r.file) for r in files.read_entries(spark, str(tmp_path / "reviews")).collect()}
    assert got == {"10.1/a": ("t1", 2001, "a.json"), "10.1/b": ("t1", None, "b.json")}
    batch = tmp_path / "batch.tsv"
    batch.write_text("# note\n\n10.1/X\tTitle\t2001\tA, B.; C, D.\tgap-1\n10.1/y\tt\t1999\n10.1/z\tt\tno\tA\n")
    good, bad = files.read_batch(spark, str(batch))
    assert [tuple(r) for r in good.collect()] == [("10.1/x", "Title", 2001, ["A, B.", "C, D."], "gap-1")]
    assert sorted(r.why for r in bad.collect()) == ["too few fields", "year is no number"]
    q = tmp_path / "q.jsonl"
    q.write_text('{"doi": "10.1/a", "round": 1}\nnot json\n')
    assert [r.doi for r in files.read_quarantine(spark, str(q)).collect()] == ["10.1/a"]
    (tmp_path / "api" / "crossref").mkdir(parents=True)
    (tmp_path / "api" / "semantic").mkdir()
    item = {"DOI": "10.1/A", "title": ["T"], "author": [{"family": "Li", "given": "Xue-Yan"}], "issued": {"date-parts": [[None]]}, "created": {"date-parts": [[2003]]}}
    (tmp_path / "api" / "crossref" / "q1.json").write_text(json.dumps({"message": {"items": [item]}}))
    (tmp_path / "api" / "crossref" / "q2.json").write_text("broken")
    (tmp_path / "api" / "semantic" / "q1.json").write_text(json.dumps({"data": [{"title": "S", "authors": [{"name": "Ann B. Smith"}], "year": 1999}]}))
    payloads.register(spark)
    hits = spark.read.format("search_payloads").load(str(tmp_path / "api"))
    assert {(r.query_id, r.source, r.doi, r.year, tuple(r.authors)) for r in hits.collect()} == {("q1", "crossref", "10.1/a", 2003, ("Li, X. Y.",)), ("q1", "semantic", "", 1999, ("Smith, A. B.",))}
    assert hits.where("source = 'semantic'").count() == 1


def test_streamed_merge_is_order_free(spark, tmp_path):
    from citeflow.streaming import versions as V

    src = tmp_path / "in"
    src.mkdir()
    rows = [("k", 3, "g3", "pending"), ("k", 1, "g1", "verified"), ("k", 2, None, "failed"), ("m", 1, "x", "pending"), ("k", 1, "g1", "verified")]
    for i, (k, o, g, st) in enumerate(rows):
        (src / f"{i}.json").write_text(json.dumps({"key": k, "seq": o, "gap": g, "status": st, "title": f"t{o}"}))
    stream = V.versions(spark, str(src), "key string, seq long, gap string, status string, title string", files=1)
    V.merge_into(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["key"], "seq", ["gap"], ["title"], {"status": "verified"}).awaitTermination()
    got = {r.key: (r.gap, r.title, r.status) for r in V.current(spark, str(tmp_path / "out"), ["key"], ["gap", "title"], {"status": "verified"}).collect()}
    assert got == {"k": ("g1", "t3", "verified"), "m": ("x", "t1", "pending")}


def test_spread_shuffles_only_scans_of_few_splits(spark, tmp_path):
    from citeflow.runtime import spread

    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(1000).repartition(8).write.parquet(many)
    spark.range(1000).coalesce(1).write.parquet(few)
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        plan = lambda p: spread(spark.read.parquet(p))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(many) and "Exchange" in plan(few)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from citeflow.runtime import checkpoints

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))


def test_suggestions_keep_no_table_of_pairs(spark):
    """Pairs are scored in the join in which they meet: two joins order the words
    of either side, one lets titles meet; pairs come once without a distinct."""
    titles = [(i, f"common shared usual plain a{i} b{i % 3}") for i in range(12)]
    q, c = (spark.createDataFrame(titles, f"{x} long, title string") for x in ("qid", "cid"))
    df = linking.suggestions(q, c, 12, 0.4)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    rows = df.collect()
    assert len(rows) == len({(r.qid, r.cid) for r in rows}) == 144 and all(r.rank == 1 for r in rows if r.qid == r.cid)


def rows_made(plan) -> int:
    """The most rows that any node of a plan that has run put out."""
    stages = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(rows_made, stages)])


@pytest.mark.parametrize("frequent", [0, 3, 8, 128])
def test_suggestions_match_brute_force(spark, frequent):
    """Whichever words are bits, the few (with 128, all) or none."""
    rng = random.Random(frequent)
    usual = [f"u{i}" for i in range(10)]
    title = lambda: " ".join([*rng.sample(usual, rng.randint(0, 7)), *(f"r{rng.randint(0, 300)}" for _ in range(rng.randint(0, 5)))])
    q, c = [(i, title()) for i in range(90)], [(i, title()) for i in range(300)] + [(300, None), (301, "")]
    frames = (spark.createDataFrame(rows, f"{x} long, title string") for x, rows in (("qid", q), ("cid", c)))
    got = {(r.qid, r.rank): (r.cid, r.similarity, r.match) for r in linking.suggestions(*frames, 3, 0.4, frequent).collect()}
    want = {}
    for i, t in q:
        a = set(t.split())
        pairs = ((len(a & b) / len(a | b), j) for j, x in c if a and (b := set((x or "").split())))
        best = sorted((-s, j) for s, j in pairs if s >= 0.4)[:3]
        want |= {(i, n): (j, -s, -s >= 0.6) for n, (s, j) in enumerate(best, 1)}
    assert len(want) > 100 and got == want


def test_suggestions_of_titles_alike_in_frequent_words_meet_as_patterns(spark):
    """A thousand titles and a hundred queries of one pattern, each with a word
    of its own: all 100,000 pairs are similar enough, but none is made."""
    q, c = (spark.createDataFrame([(i, f"dose of a treatment in adults {x}{i}") for i in range(n)], f"{x} long, title string") for x, n in (("qid", 100), ("cid", 1000)))
    df = linking.suggestions(q, c, 3, 0.4, 6)
    rows = df.collect()
    assert {(r.qid, r.cid, r.rank, r.match) for r in rows} == {(i, j, j + 1, True) for i in range(100) for j in range(3)} and {r.similarity for r in rows} == {6 / 8}
    assert rows_made(df._jdf.queryExecution().executedPlan()) < 10_000
