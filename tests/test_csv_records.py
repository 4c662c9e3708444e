"""Records of CSV files cut into splits, against Spark's reader of whole files."""

import random

import pytest

from tallyloom.sources import csv_records, readers
from tallyloom.sources.schema_check import DatasetError


@pytest.fixture
def splits_of(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def cell(rng):
    word = lambda: "".join(rng.choice("ab é x,"[: rng.choice([5, 6])]) for _ in range(rng.randint(0, 12)))
    return rng.choice([
        word, word, word, lambda: "", lambda: '""', lambda: '5" pipe', lambda: 'in "quotes" here', lambda: '"closed" early',
        lambda: f'"{word()}\n{word()}"', lambda: f'"{word()}""{word()}"', lambda: f'"{word()},\n\n"",""\n{word()}"',
        lambda: '"' + "\n".join(word() for _ in range(8)) + '"',
    ])()


def content(rng, n, header='"A ""q""",B,"C\nc"'):
    lines = [header]
    for i in range(n):
        cells = [str(i), cell(rng), cell(rng)]
        lines.append(",".join(cells[: rng.choice([3, 3, 3, 2])] + ["more"] * (rng.random() < 0.05)))
        lines += [""] * (rng.random() < 0.1)
    return "\n".join(lines) + "\n"


def read_rows(df, row_id="row_id"):
    columns = [f"`{c}`" for c in sorted(df.columns) if c != row_id]
    return sorted(tuple(r) for r in df.select(row_id, *columns).collect())


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("tail", ["", '99,"never closed\nat all', "1,no line end"])
def test_rows_and_order_equal_the_reader_of_whole_files(spark, splits_of, tmp_path, line_end, tail):
    path = str(tmp_path / "one.csv")
    text = content(random.Random(len(tail)), 200) + tail
    (tmp_path / "one.csv").write_bytes(text.replace("\n", line_end).encode())
    expected = read_rows(readers._read_whole_files(spark, path, "UTF-8", True))
    assert len(expected) >= 200
    for size, least in (("64", 60), ("700", 8), ("1m", 1)):
        splits_of(size)
        files = csv_records.survey(spark, path)
        assert len(files.splits) >= least
        found = readers.read_csv(spark, path)
        assert read_rows(found) == expected
        assert [r[0] for r in read_rows(found)] == list(range(len(expected)))


def test_files_of_several_headers_and_encodings(spark, splits_of, tmp_path):
    rng = random.Random(7)
    for name, header, encoding in (("b one.csv", "A,B,C", "latin-1"), ("a+%.csv", "C,A", "utf-8"), ("c.csv", "A,B,C", "utf-8-sig"), ("d.csv", "B,A,A", "utf-8")):
        (tmp_path / name).write_bytes(content(rng, 40, header).encode(encoding))
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "f.csv").write_bytes(b"\nA,B\n")
    expected = read_rows(readers._read_whole_files(spark, str(tmp_path), None, True))
    for size in ("90", "1m"):
        splits_of(size)
        assert read_rows(readers.read_csv(spark, str(tmp_path))) == expected


def test_one_record_over_many_splits(spark, splits_of, tmp_path):
    text = "\n".join(f"line {i}" for i in range(500))
    (tmp_path / "long.csv").write_text(f'A,B\n1,"{text}"\n2,x\n3,"{text}"\n4,"y"\n')
    splits_of("100")
    found = readers.read_csv(spark, str(tmp_path / "long.csv")).orderBy("row_id").collect()
    assert [(r.A, r.B) for r in found] == [("1", text), ("2", "x"), ("3", text), ("4", "y")]
    assert [r.row_id for r in found] == [0, 1, 2, 3]


def test_carriage_returns_and_other_encodings_are_read_whole(spark, tmp_path):
    (tmp_path / "mac.csv").write_bytes(b'A,B\r1,"x\ry"\r2,z\r')
    assert [r.A for r in readers.read_csv(spark, str(tmp_path / "mac.csv")).orderBy("row_id").collect()] == ["1", "2"]
    (tmp_path / "wide.csv").write_bytes("A,B\n1,é\n".encode("utf-16"))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "wide.csv"), "UTF-16", numbered=False).collect()] == [("1", "é")]


def test_changed_splits_fail_and_empty_folders_are_refused(spark, splits_of, tmp_path):
    (tmp_path / "one.csv").write_text(content(random.Random(1), 100))
    splits_of("300")
    found = readers.read_csv(spark, str(tmp_path / "one.csv"))
    splits_of("200")
    with pytest.raises(Exception, match="splits have changed"):
        found.select("B").collect()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("\n\n")
    with pytest.raises(DatasetError):
        readers.read_csv(spark, str(tmp_path / "empty"))


def test_state_of_lines():
    cases = {
        b"": (False, True), b"a,b": (False, True), b'a,"b': (True, False), b'"a""b': (True, True), b'"a"",b': (True, True), b'a"b': (False, False),
        b'"a",b"': (False, True), b'","': (False, True), b'"a"b,"c': (True, True), b'x "" y': (False, True), b'""': (False, True),
        b'a","b': (True, True), b'","",': (True, False),
    }
    for line, (outside, inside) in cases.items():
        assert csv_records.ends_inside(line, False) == outside, line
    assert csv_records.ends_inside(b'b",c', True) is False and csv_records.ends_inside(b'b"",c', True) is True
    assert csv_records.ends_inside(b'b","c', True) is True and csv_records.ends_inside(b"no quotes", True) is True
