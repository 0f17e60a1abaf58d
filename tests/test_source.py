"""The data source and the facade: windows, columns, splits, labels, long strings, streams."""

import numpy as np
import pytest

from marlstone.operators import open_dta, resolve_long_strings
from marlstone.plans.encode import Column, Table, build
from marlstone.sources.buffers import binary_frame
from marlstone.streaming import stream_dta


@pytest.fixture
def folder(tmp_path):
    n = np.arange(100)
    for part in range(3):
        table = Table(
            [Column("id", "long", n + 100 * part, "%12.0g", "Id"), Column("x", "byte", n % 7 + 98, value_label="codes"), Column("y", "double", n / 4, "%9.2f"), Column("s", "str9", [f"s{i}" for i in n]), Column("t", "strL", [f"text {i + 100 * part}" if i % 3 else "" for i in n])],
            "Parts", tables={"codes": {98: "low", 2147483621: "sys", 2147483623: "b"}},
        )
        (tmp_path / f"p{part}.dta").write_bytes(build(table))
    return tmp_path


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_whole_folder_in_splits(spark, folder):
    for chunk, split in ((7, 300), (65536, 1 << 20), ("NaN", 1), (-5, 999), (2.5, 64)):
        df = open_dta(spark, str(folder)).frame(chunk_rows=chunk, split_bytes=split, row_index=True, file=True)
        rows = df.collect()
        assert sorted(r["id"] for r in rows) == list(range(300)) and all(r["_row_index"] == r["id"] for r in rows)
        assert {r["t"] for r in rows if r["id"] % 100 % 3} == {f"text {i}" for i in range(300) if i % 100 % 3}
        assert len({r["_file"] for r in rows}) == 3


def test_windows_and_columns(spark, folder):
    ds = open_dta(spark, str(folder))
    assert (ds.nobs, ds.nvar, ds.label) == (300, 5, "Parts")
    assert ids(ds.rows(95, 10)) == list(range(95, 105)) and ids(ds.rows(298, 50)) == [298, 299]
    for bad in (ds.rows(300, 5), ds.rows(-1, 5), ds.rows(0, 0), ds.rows(0, 5, 3, 3)):
        assert bad.count() == 0
    assert ds.rows(0, 2, -3, 2).columns == ["id", "x"] and ds.rows(0, 1, 3, 99).columns == ["s", "t"]
    assert ds.columns([2, 0, 2]).columns == ["y", "id"] and ds.columns([2, 0]).count() == 300 and ds.columns([]).columns == []
    with pytest.raises(ValueError, match="Column index 1.5 must be an integer"):
        ds.columns([1.5])
    with pytest.raises(ValueError, match="Column index -1 is out of bounds for 5 columns"):
        ds.columns([-1])
    assert ds.frame(columns="y,3").columns == ["y", "s"]


def test_missing_modes_and_metadata(spark, folder):
    ds = open_dta(spark, str(folder / "p0.dta"))
    plain, tagged, struct = (ds.frame(missing=m, columns="x") for m in ("null", "tagged", "struct"))
    assert plain.filter("x IS NULL").count() == sum(i % 7 >= 3 for i in range(100))
    assert {r[0] for r in tagged.filter("x IS NULL").select("x__missing").collect()} == {".", ".a", ".b", ".c"}
    assert struct.filter("x.missing = '.a'").count() == tagged.filter("x__missing = '.a'").count() > 0
    field = ds.frame().filter("id > 3").schema["id"]
    assert field.metadata == {"label": "Id", "format": "%12.0g", "value_label": "", "storage_type": "long", "position": 0}
    with pytest.raises(Exception, match="must be one of"):
        ds.frame(missing="other").collect()


def test_labels_and_display(spark, folder):
    ds = open_dta(spark, str(folder / "p0.dta"))
    rows = ds.with_labels(ds.frame(missing="tagged"), ["x"]).select("x", "x__missing", "x_label").distinct().collect()
    found = {(r["x"], r["x__missing"]): r["x_label"] for r in rows}
    assert found == {(98, None): "low", (99, None): None, (100, None): None, (None, "."): "sys", (None, ".a"): None, (None, ".b"): "b", (None, ".c"): None}
    doubles = ds.frame(columns="y").selectExpr("y AS x").withColumnRenamed("x", "x")
    from marlstone.operators import add_label

    got = {r["x"]: r["l"] for r in add_label(doubles, "x", {1: "one", 2: "two"}, "l").filter("x <= 2").collect()}
    assert got[1.0] == "one" and got[1.5] is None and got[2.0] == "two"
    big = {i: f"v{i}" for i in range(3000)}
    assert {r["x"]: r["l"] for r in add_label(doubles, "x", big, "l").filter("x <= 2").collect()}[2.0] == "v2"
    shown = ds.displayed(["y", "x"]).collect()
    assert shown[5]["y"] == "1.25" and shown[3]["x"] == "."
    assert ds.value_labels().count() == 3 and ds.variables().count() == 5 and ds.dataset_info().first()["nobs"] == 100


def test_long_strings_by_join_equal_lookup(spark, folder):
    path = str(folder / "p1.dta")
    looked = {r["id"]: r["t"] for r in open_dta(spark, path).frame().collect()}
    ds = open_dta(spark, path, strl="pointer")
    joined = {r["id"]: r["t"] for r in resolve_long_strings(ds.frame(), ds.long_strings(), ["t"]).collect()}
    assert joined == looked
    assert {r["t"] for r in open_dta(spark, path, resolve_strl=False).frame().collect()} == {"__strl__"}


def test_long_string_section_is_read_only_when_asked(spark, folder, tmp_path):
    data = bytearray((folder / "p0.dta").read_bytes())
    at = data.index(b"<strls>") + 7
    data[at + 3 + 4 : at + 3 + 12] = b"\xff" * 8  # a record number beyond 32 bits
    (tmp_path / "bad.dta").write_bytes(bytes(data))
    ds = open_dta(spark, str(tmp_path / "bad.dta"))
    assert ds.columns([0, 3]).count() == 100
    with pytest.raises(Exception, match="strL observation number exceeds 32-bit range"):
        ds.columns([4]).collect()


def test_empty_and_mismatched(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "e.dta").write_bytes(build(Table([Column("price", "double", [], label="Price in USD"), Column("make", "str20", [])])))
    ds = open_dta(spark, str(tmp_path / "a"))
    assert ds.frame().count() == 0 and ds.frame().columns == ["price", "make"] and ds.rows(0, 5).count() == 0
    (tmp_path / "a" / "f.dta").write_bytes(build(Table([Column("other", "double", [1.0])])))
    with pytest.raises(Exception, match="other columns"):
        open_dta(spark, str(tmp_path / "a")).frame().collect()
    with pytest.raises(FileNotFoundError):
        open_dta(spark, str(tmp_path / "none.dta"))


def test_sql_over_the_source(spark, folder):
    open_dta(spark, str(folder)).frame().createOrReplaceTempView("parts")
    row = spark.sql("SELECT count(*) n, sum(id) s FROM parts WHERE y >= 5").first()
    assert (row["n"], row["s"]) == (240, sum(i for i in range(300) if i % 100 >= 20))


def test_binary_files_and_stream(spark, folder, tmp_path):
    assert ids(binary_frame(spark, str(folder), columns="id,t")) == list(range(300))
    stream = stream_dta(spark, str(folder), str(folder / "p0.dta"), columns="id", max_files_per_trigger=1)
    q = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    assert ids(spark.table("arrived")) == list(range(300))


def test_cancelled_read_gives_nothing(spark, folder):
    import threading

    ds = open_dta(spark, str(folder))
    done = threading.Event()

    def stop():
        while not done.wait(0.3):  # a tag cancels the jobs that run when it is called
            ds.cancel("stop-me")

    thread = threading.Thread(target=stop)
    thread.start()
    try:
        with pytest.raises(Exception, match="(?i)cancel"):
            ds.run_tagged(spark.range(10**11), "stop-me", lambda df: df.selectExpr("sum(id % 7)").collect())
    finally:
        done.set()
        thread.join()
    assert ds.run_tagged(ds.frame(), "go-on", lambda df: df.count()) == 300


def test_files_with_labels_and_long_strings_of_their_own(spark, tmp_path):
    """Keys and label tables hold in their own file."""
    import shutil

    from marlstone.operators import open_dta, resolve_long_strings
    from marlstone.plans.encode import encode_frame

    (tmp_path / "all").mkdir()
    want = set()
    for i in range(2):
        rows = spark.createDataFrame([(10 * i + k, k, f"text {i} {k}", k) for k in (1, 2)], "id long, lab int, t string, _key int").coalesce(1)
        kinds = {"id": "long", "lab": "byte", "t": "strL", "_key": "byte"}
        made = encode_frame(rows, kinds, tables={"names": {1: f"one {i}", 2: f"two {i}"}}, value_labels={"lab": "names"})
        files = open_dta(spark, made).files
        assert len(files) == 1
        shutil.copy(files[0].removeprefix("file://"), tmp_path / "all" / f"{i}.dta")
        want |= {(10 * i + k, f"text {i} {k}", f"{name} {i}", k) for k, name in ((1, "one"), (2, "two"))}
    ds = open_dta(spark, str(tmp_path / "all"))
    df = resolve_long_strings(ds.frame(strl="pointer", file=True), ds.long_strings(), ["t"])
    assert {(r["id"], r["t"], r["lab_label"], r["_key"]) for r in ds.with_labels(df, ["lab"]).collect()} == want
    with pytest.raises(ValueError):
        ds.with_labels(ds.frame(), ["lab"])
    with pytest.raises(ValueError):
        resolve_long_strings(ds.frame(strl="pointer"), ds.long_strings(), ["t"])


def test_a_section_tag_is_found_however_far():
    from marlstone.sources.header import find
    from marlstone.sources.files import Bytes

    assert find(Bytes(b"x" * 200_000 + b"<names>abc"), b"<names>", 3) == 200_000
    assert find(Bytes(b"x" * 65_535 + b"<names>"), b"<names>", 0) == 65_535 and find(Bytes(b"xyz"), b"<names>", 0) == -1
