"""Headers, records, missing values, long strings and labels of built files, in every version and byte order."""

import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.plans.encode import Column, Table, build
from marlstone.sources.buffers import (
    is_legacy_format, legacy_prefix_size, long_string_index, parse_legacy_metadata, parse_metadata, read_rows, read_rows_from_records, resolve_pointer, value_label_tables,
)
from marlstone.sources.codec import Decoder, missing_offsets
from marlstone.sources.files import Bytes
from marlstone.sources.header import clean, read_info
from marlstone.sources.labels import parse_payload
from marlstone.sources.layout import NUMERIC, TAGS, DtaError

VERSIONS = (113, 114, 115, 117, 118, 119)
TAGGED = (117, 118, 119)
EVERY = [(v, o) for v in VERSIONS for o in "<>"]


def all_types(version):
    n = np.arange(1, 6)
    columns = [
        Column("v_byte", "byte", n), Column("v_int", "int", 100 * n), Column("v_long", "long", 100000 * n), Column("v_float", "float", 1.1 * n), Column("v_double", "double", 1.111111111 * n),
        Column("v_str5", "str5", [f"s{i}" for i in n]), Column("v_str20", "str20", [f"longer_string_{i}" for i in n]),
    ]
    if version in TAGGED:
        columns.append(Column("v_strL", "strL", [f"This is a strL value for obs {i}" for i in n]))
    return Table(columns, "All Stata storage types")


def rows_of(data, **options):
    source = Bytes(data)
    info = read_info(source)
    out = {}
    for part in Decoder(source, info, list(range(info.nvar)), **options).batches(0, info.nobs, 2):
        for k, x in part.items():
            out.setdefault(k, []).extend(x.to_pylist())
    return info, out


@pytest.mark.parametrize("version,order", EVERY)
def test_all_types(version, order):
    info, rows = rows_of(build(all_types(version), version, order))
    assert (info.version, info.byteorder, info.nobs, info.label) == (version, order, 5, "All Stata storage types")
    assert [v.storage for v in info.variables][:5] == list(NUMERIC)
    assert [v.offset for v in info.variables][:7] == [0, 1, 3, 7, 11, 19, 24]
    assert rows["v_byte"] == [1, 2, 3, 4, 5] and rows["v_int"][4] == 500 and rows["v_long"][4] == 500000
    assert rows["v_float"][0] == np.float32(1.1) and rows["v_double"][1] == pytest.approx(2.222222222)
    assert rows["v_str5"][0] == "s1" and rows["v_str20"][4] == "longer_string_5"
    if version in TAGGED:
        assert rows["v_strL"][2] == "This is a strL value for obs 3"
    assert rows["_row_index"] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("version", [114, 117, 118, 119])
def test_files_of_an_independent_writer(version, tmp_path):
    frame = pd.DataFrame({"a": np.arange(7, dtype=np.int32), "b": np.linspace(0, 1, 7), "c": [f"x{i}" for i in range(7)]})
    how = {"convert_strl": ["c"]} if version > 114 else {}
    frame.to_stata(tmp_path / "f.dta", write_index=False, version=version, data_label="own", variable_labels={"a": "A"}, **how)
    info, rows = rows_of((tmp_path / "f.dta").read_bytes())
    assert info.label == "own" and info.variables[0].label == "A"
    assert rows["a"] == list(range(7)) and rows["b"] == frame["b"].tolist() and rows["c"] == frame["c"].tolist()


@pytest.mark.parametrize("version", [114, 115, 117, 118, 119])
def test_an_independent_reader_agrees(version, tmp_path):
    table = all_types(version)
    table.columns[0].values = np.array([1, 101, 102, 127, 100])
    (tmp_path / "f.dta").write_bytes(build(table, version))
    theirs = pd.read_stata(tmp_path / "f.dta", convert_missing=True, convert_categoricals=False)
    _, rows = rows_of((tmp_path / "f.dta").read_bytes(), missing="tagged")
    tags = [str(x) if not isinstance(x, (int, float, np.number)) else None for x in theirs["v_byte"]]
    assert rows["v_byte__missing"] == tags == [None, ".", ".a", ".z", None]
    assert rows["v_str20"] == theirs["v_str20"].tolist()


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("version", VERSIONS)
def test_every_missing_code_of_every_type(version, order):
    columns = []
    for kind, (_, raw, _, first, step) in NUMERIC.items():
        columns.append(Column(kind, kind, np.array([first + i * step for i in range(27)], raw if raw[0] == "u" else "i8"), raw=True))
    _, rows = rows_of(build(Table(columns), version, order), missing="tagged")
    for kind in NUMERIC:
        assert rows[f"{kind}__missing"] == TAGS and rows[kind] == [None] * 27


def test_odd_floats_are_values():
    bits = np.array([0x7F800000, 0xFF800000, 0x7FC00000, 0x7F000001, 0x7F00D800, 0x7EFFFFFF], np.uint32)
    assert missing_offsets(bits, "float").tolist() == [-1] * 6
    wide = np.array([0x7FF0 << 48, 0x7FF8 << 48, (0x7FE0 << 48) + 1, (0x7FE0 << 48) + (27 << 40), 0], np.uint64)
    assert missing_offsets(wide, "double").tolist() == [-1] * 5
    _, rows = rows_of(build(Table([Column("x", "float", bits, raw=True)])))
    assert rows["x"][0] == float("inf") and rows["x"][2] != rows["x"][2] and None not in rows["x"]


@given(st.lists(st.integers(-128, 127), min_size=1, max_size=40))
@settings(max_examples=30, deadline=None)
def test_bytes_round_trip(values):
    _, rows = rows_of(build(Table([Column("x", "byte", np.array(values))])), missing="tagged")
    assert rows["x"] == [None if v > 100 else v for v in values]
    assert rows["x__missing"] == [TAGS[v - 101] if v > 100 else None for v in values]


def test_legacy_headers():
    two = Table([Column("price", "double", [1.0] * 10), Column("mpg", "int", [1] * 10), Column("make", "str5", ["a"] * 10)], "Test dataset")
    info = parse_legacy_metadata(build(two, 115))
    assert info.record_width == 15 and info.label == "Test dataset" and info.nobs == 10
    none = parse_legacy_metadata(build(Table([Column("a", "double", []), Column("b", "int", [])]), 115))
    assert none.sections["data"] == none.sections["value_labels"]
    assert parse_legacy_metadata(build(Table([Column("z", "float", [0, 0, 0], "%9.0g")]), 113)).variables[0].format == "%9.0g"
    assert is_legacy_format(114) and not is_legacy_format(117)
    assert legacy_prefix_size(2, 115) == 109 + 2 * (1 + 33 + 49 + 33 + 81) + 6
    data = bytearray(build(two, 115))
    data[0] = 112
    with pytest.raises(DtaError, match="Not a legacy .dta file: version byte 112"):
        parse_legacy_metadata(bytes(data))
    with pytest.raises(DtaError, match="Unsupported .dta format"):
        read_info(Bytes(bytes(data)))
    data[0], data[1] = 115, 3
    with pytest.raises(DtaError, match="Invalid byte order code: 3"):
        read_info(Bytes(bytes(data)))
    data[1], data[6:10] = 2, struct.pack("<i", -1)
    with pytest.raises(DtaError, match="Invalid observation count: -1"):
        read_info(Bytes(bytes(data)))


def test_expansion_fields_of_any_size_are_passed_over():
    big = struct.pack("<Bi", 1, 200_000) + b"x" * 200_000
    table = Table([Column("a", "int", [7])], expansion=big)
    assert rows_of(build(table, 114))[1]["a"] == [7]
    table.expansion = struct.pack("<Bi", 1, -5)
    with pytest.raises(DtaError, match="expansion field"):
        read_info(Bytes(build(table, 114)))


def test_damaged_files():
    with pytest.raises(DtaError, match="file is empty"):
        read_info(Bytes(b""))
    with pytest.raises(DtaError, match="too small for legacy header"):
        read_info(Bytes(bytes([114]) + b"\0" * 50))
    with pytest.raises(DtaError, match="Unsupported"):
        read_info(Bytes(b"garbage" * 50))
    with pytest.raises(DtaError, match="unrecognized format signature"):
        parse_metadata(b"garbage" * 50)
    good = build(all_types(118))
    with pytest.raises(DtaError, match="Invalid byte order"):
        read_info(Bytes(good.replace(b"LSF", b"XSF", 1)))
    with pytest.raises(DtaError, match="Missing <K> tag"):
        read_info(Bytes(good.replace(b"<K>", b"<Q>", 1)))
    info = read_info(Bytes(good))
    with pytest.raises(DtaError):
        read_info(Bytes(good[: info.sections["variable_types"] + 10]))
    cut = Bytes(good[: info.data_offset + 20])
    with pytest.raises(DtaError, match="Unexpected EOF"):
        list(Decoder(cut, info, [0]).batches(0, 5, 5))
    for end in range(0, info.sections["formats"], 37):  # no cut may pass for a whole header
        with pytest.raises(DtaError):
            read_info(Bytes(good[:end]))


def test_type_codes_of_117():
    table = Table([Column("a", "byte", [1]), Column("b", "str251", ["x"])])
    assert [v.storage for v in read_info(Bytes(build(table, 117))).variables] == ["byte", "str"]
    old = build(Table([Column("a", "byte", [5])]), 117, old_codes=True)
    assert read_info(Bytes(old), numeric_117=True).variables[0].storage == "byte"
    with pytest.raises(DtaError, match="Unknown type code 3000 for format v118"):
        read_info(Bytes(build(Table([Column("a", "str3000", ["x"])]))))


def test_text_rules():
    assert clean(b"ab\0cd") == "ab" and clean(b"a\x80b") == "a�b" and clean(b"\xef\xbb\xbfx") == "x" and clean(b" a ") == " a "
    assert clean(b"\x80\x81caf\xe9", "cp1252") == "€\x81caf\xe9"
    table = Table([Column("x", "str8", ["hé", b"a\x80", b"\xef\xbb\xbfq", "", b"ab\0zz"])], "")
    assert rows_of(build(table))[1]["x"] == ["hé", "a�", "q", "", "ab"]
    latin = Table([Column("x", "str8", [b"caf\xe9"])], b"\xe9tat")
    info, rows = rows_of(build(latin, 115), encoding="cp1252")
    assert info.label == "état" and rows["x"] == ["café"]


@pytest.mark.parametrize("version,order", [(v, o) for v in TAGGED for o in "<>"])
def test_long_strings(version, order):
    gso = [(1, 1, 130, b"first\0"), (1, 2, 129, b"raw\xff"), (1, 1, 130, b"later wins\0")]
    table = Table([Column("x", "strL", [None] * 4, pointers=[(1, 1), (1, 2), (0, 0), (1, 9)])], gso=gso)
    data = build(table, version, order)
    info, rows = rows_of(data)
    assert rows["x"] == ["later wins", "raw�", "", ""]
    assert rows_of(data, strl_dangling="null")[1]["x"][3] is None
    assert rows_of(data, strl="placeholder")[1]["x"] == ["__strl__"] * 4
    assert rows_of(data, strl="pointer")[1]["x"] == [{"v": 1, "o": 1}, {"v": 1, "o": 2}, None, {"v": 1, "o": 9}]
    index = long_string_index(data, info)
    assert set(index) == {(1, 1), (1, 2)} and resolve_pointer(b"\0" * 8, info, index) == ""
    cell = lambda i: data[info.data_offset + 8 * i : info.data_offset + 8 * i + 8]
    assert resolve_pointer(cell(0), info, index) == "later wins" and resolve_pointer(cell(3), info, index) is None


def test_no_long_strings_no_index():
    data = build(Table([Column("a", "int", [1])]))
    assert long_string_index(data, read_info(Bytes(data))) == {}


@pytest.mark.parametrize("version,order", EVERY)
def test_value_labels(version, order):
    tables = {"origin": {0: "Domestic", 1: "Foreign"}, "rep": {i: t for i, t in enumerate(("Poor", "Fair", "Average", "Good", "Excellent"), 1)}, "miss": {2147483621: "unknown", -5: "minus"}}
    data = build(Table([Column("f", "byte", [0], value_label="origin")], tables=tables), version, order)
    assert value_label_tables(data, read_info(Bytes(data))) == tables
    none = build(Table([Column("f", "byte", [0])]), version, order)
    assert value_label_tables(none, read_info(Bytes(none))) == {}


def test_damaged_value_labels():
    with pytest.raises(DtaError, match="truncated header"):
        parse_payload(b"1234", "<")
    with pytest.raises(DtaError, match=r"negative count or text length \(n=-1, txt_len=4\)"):
        parse_payload(struct.pack("<ii", -1, 4), "<")
    with pytest.raises(DtaError, match="exceeds entry bounds"):
        parse_payload(struct.pack("<ii", 10, 4) + b"abc", "<")
    body = struct.pack("<ii6i", 3, 4, 0, 99, 2, 1, 2, 1) + b"a\0b\0"
    assert parse_payload(body, "<") == {1: "b"}  # an offset outside is passed over, the last entry of a value counts


def test_row_and_column_windows():
    data = build(all_types(118))
    info = read_info(Bytes(data))
    assert [r[0] for r in read_rows(data, info, 1, 2)] == [2, 3]
    assert read_rows(data, info, 3, 99)[-1][7] == "__strl__" and len(read_rows(data, info, 3, 99)) == 2
    for bad in ((5, 1), (0, 0), (-1, 2), (0, -3)):
        assert read_rows(data, info, *bad) == []
    assert read_rows(data, info, 0, 1, 3, 3) == [] and read_rows(data, info, 0, 1, -4, 2) == [(1, 100)]
    records = data[info.data_offset + info.record_width : info.data_offset + 5 * info.record_width]
    assert read_rows_from_records(records, info, 1, 99, 0, 1) == [(2,), (3,), (4,), (5,)]
    codes = build(Table([Column("x", "byte", [101, 3, 127])]))
    assert read_rows(codes, read_info(Bytes(codes)), 0, 3) == [(("missing", "."),), (3,), (("missing", ".z"),)]
