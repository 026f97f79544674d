"""Every registered query of the library against its SQL in DuckDB on the smallest tables."""

import datetime
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from kinweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = db.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def test_components_of_all_signups(spark, db):
    """Against a search over every signup edge in plain Python, at any value."""
    near = {}
    edges = db.execute("select user_id, 1000000 + cast(json_extract_string(props, '$.k') as bigint) from events where event_type = 'signup'").fetchall()
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [] if node in want else [node]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    assert {r.node: r.component for r in catalogue.queries()["components"](spark, SF).collect()} == want


def test_citations_of_few_words(spark, tmp_path):
    texts = ["One two  three four five six seven eight nine", "two three", "three", "", None, "a two three b", "twotwo three", "three FOUR five six seven", "nine"]
    quotes = ["two three", "Three", "four five six seven", "one two three four five six seven eight nine", "two three four five six seven eight nine ten", "", None, "wo three", "nine"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = sorted((r.item_id, r.doc_id) for r in catalogue.queries()["citation_guard"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(catalogue.oracle_sql()["citation_guard"]).fetchall()) and (0, 1) in got and (2, 7) in got


def test_deinvert_within_the_row(spark, tmp_path):
    """Nothing is shuffled, and texts that are odd come back as SQL reads them."""
    texts = [None, "", " ", "b a b", "a\x0bb c\x0bd", "x\x1cy \x85 z", "q" * 60_000 + ' "b" \\ \\" {"a": [1]} ' + '"\\' * 30_000, " lead  tail \n\r\f\t", " ".join(f"t{i % 977}" for i in range(20_000))]
    spark.createDataFrame([*enumerate(texts), (3, "twice b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.queries()["deinvert"](spark, str(tmp_path))
    want = duckdb.connect().execute(f"with documents as (select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')) {catalogue.oracle_sql()['deinvert']}").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and len(want) == len(texts) + 1
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("kinweave/llm",), ("kinweave/llm", "corpus_pipeline.py")])
def test_entry_in_a_tree_without_the_corpus_operators(tmp_path, gone):
    """A copy of the tree without the subpackage, with and without the pipeline's file: both functions still answer."""
    root, tree = Path(__file__).resolve().parent.parent, tmp_path / "tree"
    shutil.copytree(root / "kinweave", tree / "kinweave", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tree)
    for name in gone:
        shutil.rmtree(tree / name, ignore_errors=True)
        (tree / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n == 'pipeline' or n.startswith('op1_')]"
    subprocess.run([sys.executable, "-c", code], cwd=tree, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tree)})
