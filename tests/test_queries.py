"""Every query of the core with SQL against DuckDB on the smallest tables, and
the layout rules of the repository."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from citeflow.plans import audits, curation, prose, records, references, reviews, searches

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
CORE = [(n, m) for m in (references, records, searches, reviews, prose, curation, audits) for n in m.QUERIES]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name,module", CORE, ids=[n for n, _ in CORE])
def test_query_matches_sql(spark, con, name, module):
    df = module.QUERIES[name](spark, str(DATA))
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in module.SQL:
        return
    found = con.execute(module.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()]
    assert Counter(rows) == Counter(want)


def test_entry_and_registration(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if DATA.exists():
        assert __spark_entry__.entry(spark).columns == ["ref_table", "topic", "ref_id", "ref_key"]


def test_core_does_not_import_the_subpackage():
    for path in (ROOT / "citeflow").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("citeflow.llm") for n in names), path


def test_core_queries_remain_without_a_library_of_the_subpackage(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("citeflow.llm") or n == "zstandard"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.warns(UserWarning, match="left out"):
        names = set(__spark_entry__.queries())
    assert names == {n for n, _ in CORE}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_references_without_a_topic_match_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in ("entries", "gaps", "claims"):
        con.execute(f"COPY (SELECT * REPLACE (CASE WHEN row_number() OVER () % 3 > 0 THEN topic END AS topic) FROM '{DATA}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("p5_found", "p5_by_round"):
        df = references.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({references.SQL[name]})").fetchall()
        assert Counter(map(tuple, df.collect())) == Counter(want)
        assert name != "p5_found" or sum(r[1] is None for r in want) > 10
