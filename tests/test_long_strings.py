"""Long strings of any amount: files are written a part at a time, and no task takes a whole table."""

import tracemalloc

import pyarrow as pa
import pytest

from marlstone.operators import open_dta
from marlstone.plans import encode, queries
from marlstone.plans.encode import Column, Table, build
from marlstone.sources.codec import long_strings, replaced
from marlstone.sources.files import Source
from marlstone.sources.header import read_info


@pytest.fixture
def parts(spark, tmp_path, monkeypatch):
    """A folder whose documents come in three partitions, and the list that gets the folders encoded from it."""
    rows = [(i, "" if i % 10 == 0 else f"text {i % 80} é") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    made, whole = [], queries.encode_frame
    monkeypatch.setattr(queries, "encode_frame", lambda *a, **b: made.append(whole(*a, **b)) or made[-1])
    return str(tmp_path), rows, made


def test_a_file_is_written_in_bounded_memory(tmp_path):
    text, n = "ä" * 50_000, 1000  # 100 MB

    def batches():
        for i in range(0, n, 20):
            yield pa.RecordBatch.from_pydict({"id": list(range(i, i + 20)), "t": [f"{k} {text}" for k in range(i, i + 20)]})

    path = str(tmp_path / "a" / "big.dta")
    tracemalloc.start()
    try:
        assert encode.write_file(path, batches(), Table([Column("id", "long", []), Column("t", "strL", [])]), 118, "<") == n
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    with Source(path) as source:
        info = read_info(source)
        assert info.nobs == n and replaced(source, info) is None
        assert all((v, o, x) == (2, i + 1, f"{i} {text}\0".encode()) for i, (v, o, _, x) in enumerate(long_strings(source, info)))


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("version", [113, 117, 118, 119])
def test_a_file_written_in_parts_has_the_same_bytes(tmp_path, monkeypatch, version, order):
    cells = {"id": list(range(500)), "x": [i / 7 for i in range(500)], "s": [f"s{i}é" for i in range(500)]}
    kinds = {"id": "long", "x": "double", "s": "str9"}
    if version > 116:
        cells |= {t: ["" if i % k == 0 else f"{t}{i}" * (i % 9) for i in range(500)] for k, t in ((3, "t"), (7, "u"))}
        kinds |= {"t": "strL", "u": "strL"}
    made = [Table([Column(k, s, cells[k] if full else []) for k, s in kinds.items()], "Title", tables={"codes": {1: "a"}}) for full in (True, False)]
    monkeypatch.setattr(encode, "PART_BYTES", 1000)
    monkeypatch.setattr(encode, "SPOOL_BYTES", 3000)
    encode.write_file(str(tmp_path / "x.dta"), pa.table(cells).to_batches(max_chunksize=170), made[1], version, order)
    assert (tmp_path / "x.dta").read_bytes() == build(made[0], version, order)


def test_of_records_with_one_key_the_last_counts(spark, tmp_path):
    gso = [(v, o, 130, f"{v} {o} {k}".encode() + b"\0") for k, (v, o) in enumerate([(1, 3), (2, 1), (1, 3), (1, 1), (2, 1), (2, 3), (2, 1)])]
    table = Table([Column("t", "strL", ["a", "", "b"]), Column("u", "strL", ["a", "", "b"])], gso=gso)
    (tmp_path / "x.dta").write_bytes(build(table))
    df = open_dta(spark, str(tmp_path / "x.dta")).long_strings()
    assert {(r["v"], r["o"]): r["text"] for r in df.collect()} == {(1, 1): "1 1 3", (1, 3): "1 3 2", (2, 1): "2 1 6", (2, 3): "2 3 5"} and df.count() == 4
    with Source(str(tmp_path / "x.dta")) as source:
        info = read_info(source)
        keys = [g[:2] for g in long_strings(source, info)]
        want = [k in keys[i + 1 :] for i, k in enumerate(keys)]
        assert all(replaced(source, info, at_once).tolist() == want for at_once in (1, 2, 3, 100)) and sum(want) == 3
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()  # texts aren't shuffled for it


def test_long_strings_come_from_a_file_per_partition(spark, parts):
    folder, rows, made = parts
    got = queries.QUERIES["long_strings_frame"](spark, folder).first()
    texts = [t for _, t in rows if t]
    assert tuple(got) == (len(texts), len(set(texts)), sum(len(t.encode()) + 1 for t in texts))
    assert len(open_dta(spark, made[0]).files) == 3


def test_documents_are_joined_from_a_file_per_partition(spark, parts):
    folder, rows, made = parts
    df = queries.QUERIES["strl_documents_joined"](spark, folder)
    assert df.columns == ["doc_id", "text"] and sorted(map(tuple, df.collect())) == sorted(rows)
    assert len(open_dta(spark, made[0]).files) == 3


def test_texts_are_never_broadcast(spark, parts):
    """Their size is taken for that of the list of files."""
    folder, rows, _ = parts
    for name in ("strl_documents_joined", "strl_documents_many_files"):
        df = queries.QUERIES[name](spark, folder)
        assert df.count() == len(rows) and df.collect()  # the plan that is shown is the last one, by real sizes
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
