"""The pipeline's stages, the registered queries, and what the repository is without this subpackage."""

import os
import subprocess
import sys
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from marlstone.llm import common, lines, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark, odd):
    docs, out = odd, [odd]
    for name, stage in pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, ""), name)
        out.append(docs)
    return out


def test_stages(stages, odd):
    assert len(pipeline.STAGES) in (4, 5) and pipeline.ORACLE_SQL is None
    for df in stages[:-1]:
        assert df.columns == odd.columns
    kept, deduped, near, mixed, packed = stages[1:]
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect())[30] == 0
    texts = [r["text"] for r in deduped.select("text").collect()]
    seen = Counter(frozenset(w for w in line.lower().split()) for t in texts for line in t.split("\n") if line.strip())
    assert max(seen.values()) == 1  # no line's words twice
    assert near.count() <= deduped.count() and near.select("doc_id").distinct().count() == near.count()
    assert mixed.count() > 0 and packed.columns[:3] == ["doc_id", "start", "length"]
    words = lambda df: df.select(common.F.sum(common.F.size(common.F.split("text", "\\s+")))).first()[0]
    assert abs(words(mixed) - 1.5 * words(near)) < 0.1 * words(near)


def test_stages_over_an_empty_table(spark, none):
    docs = none
    for name, stage in pipeline.STAGES:
        before = docs.columns
        docs = common.materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0
        assert name == "packing" or docs.columns == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_run_over_a_table(spark):
    assert pipeline.run(spark, SF).count() > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(result.fetchall())


def test_the_rest_imports_without_this_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_line_stage_is_the_operator(spark, odd):
    out = pipeline.dedup_lines(spark, odd, "")
    assert sorted(r["text"] or "" for r in out.select("text").collect()) == sorted(r["text"] or "" for r in lines.drop_lines(odd, lines.mark_lines(odd)).select("text").collect())
