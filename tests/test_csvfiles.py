"""CSV files cut at any byte against Python's csv module and Spark's own reader."""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pytest

from doclake.sources import csvfiles, files

CELLS = ["a", "", "word", '"q"', 'say ""', "x,y", "line\nbreak", "two\n\nbreaks", "\r\n", ",", '"', "ñ €", '\n"', 'in"side', " lead", "end ", ',"\n', '""\n""']


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def random_rows(seed, n, width=3):
    r = np.random.default_rng(seed)
    return [[f"{seed}-{i}", *(CELLS[k] for k in r.integers(0, len(CELLS), width - 1))] for i in range(n)]


@pytest.fixture
def small_splits(spark):
    def use(size):
        other = spark.newSession()
        other.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        other.conf.set("spark.sql.files.openCostInBytes", "1")
        other.conf.set("spark.sql.files.minPartitionNum", "1")
        return other

    return use


@pytest.mark.parametrize("line,inside,ends", [
    ("", False, False), ("", True, True), ('"', False, True), ('"', True, False), ('a,"b', False, True), ('a"b,c', False, False),
    ('a""b', False, False), ('""', False, False), ('"""', False, True), ('""""', False, False), ('x"', True, False), ('x"",y', True, True),
    ('x",",y', True, True), ('x"y"z,a', True, False), ('x"y,"', True, True), ('"a"b"c,d', False, False), (' "a', False, False), (',"",""', False, False),
])
def test_state_at_the_end_of_a_line(line, inside, ends):
    assert csvfiles.ends_inside(line, inside) is ends


@pytest.mark.parametrize("size", [7, 16, 61, 400, 1 << 20])
def test_records_equal_the_csv_module(small_splits, tmp_path, size):
    session = small_splits(size)
    want = []
    for k in range(4):
        rows = random_rows(k, [40, 1, 0, 25][k])
        (tmp_path / f"{k}.csv").write_text(written([["k", "x", "y"], *rows], "\r\n" if k == 3 else "\n"), newline="")
        want += rows
    df = csvfiles.csv_records(session, str(tmp_path))
    got = [next(csv.reader([r.value], strict=False)) if "\n" not in r.value and "\r" not in r.value else list(csv.reader(io.StringIO(r.value, newline="")))[0]
           for r in df.collect()]
    assert sorted(got) == sorted(want)
    if size < 100:
        assert csvfiles._lines(session, str(tmp_path)).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("size", [13, 200])
def test_rows_equal_the_reader_of_whole_files(spark, small_splits, tmp_path, size):
    for k in range(3):
        rows = random_rows(10 + k, 30) + [["short"], ["1", "2", "3", "4"], ["", "", ""]]
        (tmp_path / f"{k}.csv").write_text(written([["k", "x", "y"], *rows]) + "\n\n", newline="")
    whole = spark.read.schema(files.csv_schema(["k", "x", "y"])).option("header", True).option("multiLine", True).option("escape", '"').option(
        "columnNameOfCorruptRecord", "_ragged").option("enforceSchema", True).csv(str(tmp_path))
    key = lambda rows: sorted((str(r.k), str(r.x), str(r.y), r._ragged is not None) for r in rows)
    assert key(files.scan_csv(small_splits(size), str(tmp_path), ["k", "x", "y"]).collect()) == key(whole.collect())


def test_header_over_ends_of_splits_and_open_quote_at_the_end(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('"a long\nheader\nof many lines","b"\n1,2\n"never\nclosed,\n3\n', newline="")
    (tmp_path / "b.csv").write_text("a,b\n5,6", newline="")
    for size in (4, 9, 1000):
        got = sorted(r.value for r in csvfiles.csv_records(small_splits(size), str(tmp_path)).collect())
        assert got == ['"never\nclosed,\n3', "1,2", "5,6"]
    with_header = csvfiles.csv_records(small_splits(5), str(tmp_path), header=False)
    assert with_header.count() == 5


def test_a_cell_larger_than_many_splits(small_splits, tmp_path):
    cell = "\n".join(f"row {i}, with a comma and \"\"quotes\"\"" for i in range(300))
    (tmp_path / "a.csv").write_text(f'h,i\n1,"{cell}"\n2,x\n', newline="")
    rows = files.scan_csv(small_splits(100), str(tmp_path), ["h", "i"]).collect()
    assert {r.h: r.i for r in rows} == {"1": cell.replace('""', '"'), "2": "x"}


def test_empty_file_and_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "b.csv").write_bytes(b'h\n\xff"x\n"\xfe\ny"\n')
    assert sorted(r.value for r in csvfiles.csv_records(spark, str(tmp_path)).collect()) == ['"�\ny"', '�"x']


def test_ends_of_many_lines_equal_those_of_one():
    r = np.random.default_rng(5)
    lines = ["".join(r.choice(list('",a\ré'), k)) for k in range(12) for _ in range(1500)] + ["", '"' * 9, 'x"' * 50_000, ',"a""b"' * 20_000]
    outside, inside = csvfiles.line_ends(pa.array(lines))
    assert outside.tolist() == [csvfiles.ends_inside(x, False) for x in lines] and inside.tolist() == [csvfiles.ends_inside(x, True) for x in lines]
    for begins in (False, True):
        state, want = begins, [begins]
        for line in lines[:5000]:
            state = csvfiles.ends_inside(line, state)
            want.append(state)
        assert csvfiles.states(outside[:5000], inside[:5000], begins).tolist() == want
    assert csvfiles.states(outside[:0], inside[:0], True).tolist() == [True]


def test_rows_carry_no_paths_to_python(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n")
    assert dict(csvfiles._lines(spark, str(tmp_path)).dtypes) == {"value": "string", "file": "bigint", "start": "bigint", "split": "bigint"}
