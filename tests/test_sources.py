import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.names import SOURCE_COLUMNS
from tallyloom.sources import readers, schema_check, sinks
from tallyloom.sources.schema_check import DatasetError

HEADER = ",Clothing ID,Age,Title,Review Text,Rating,Recommended IND,Positive Feedback Count,Division Name,Department Name,Class Name"


def record(i, title="t", text="x", rating="5", age="30"):
    return f"{i},7,{age},{title},{text},{rating},1,2,General,Tops,Knits"


def write(path, lines, encoding="utf-8"):
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


def rows(df):
    return df.orderBy("row_id").collect()


def test_csv_cells(spark, tmp_path):
    path = write(tmp_path / "reviews.csv", [
        HEADER,
        record(0, title='"quoted\nnewline"', text='"said ""hi"", twice"'),
        record(1, title="NA", text=" None ", rating="5d"),
        record(2, title="null", text=" 　", rating="4.5", age="NaN"),
        record(3, title='"NA"', text="  padded  ", rating="inf"),
    ])
    found = rows(readers.load_reviews(spark, path))
    assert [r.title for r in found] == ["quoted\nnewline", None, None, None]
    assert [r.review_text for r in found] == ['said "hi", twice', "None", None, "padded"]
    assert [r.rating for r in found] == [5.0, None, 4.5, None]
    assert [r.age for r in found] == [30.0, 30.0, None, 30.0]


def test_byte_order_mark_and_index_column(spark, tmp_path):
    path = write(tmp_path / "bom.csv", [HEADER, record(0)], "utf-8-sig")
    loaded = readers.load_reviews(spark, path)
    assert schema_check.describe_schema(loaded).is_usable
    assert schema_check.describe_schema(loaded).has_index_column


def test_each_file_has_its_encoding_and_rows_keep_file_order(spark, tmp_path):
    write(tmp_path / "b one.csv", [HEADER, *[record(i, title=f"b{i}é") for i in range(3)]], "latin-1")
    write(tmp_path / "a+%.csv", [HEADER, *[record(i, title=f"a{i}é�") for i in range(3)]], "utf-8")
    write(tmp_path / "c.csv", [HEADER, record(0, title="cé")], "latin-1")
    found = rows(readers.load_reviews(spark, str(tmp_path), "csv"))
    assert [r.title for r in found] == [
        "a0é�", "a1é�", "a2é�", "b0é", "b1é", "b2é", "cé",
    ]
    assert len({r.row_id for r in found}) == 7
    assert found[0].row_id == 0 and found[3].row_id == 1 << 33


def test_unknown_formats_and_missing_paths(spark, tmp_path):
    with pytest.raises(DatasetError):
        readers.load_reviews(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "reviews.xls").write_text("x")
    with pytest.raises(DatasetError):
        readers.load_reviews(spark, str(tmp_path / "reviews.xls"))
    with pytest.raises(DatasetError):
        sinks.export(spark.range(1), str(tmp_path / "out"), "xml")


def test_default_file(spark, tmp_path):
    with pytest.raises(DatasetError):
        readers.find_default(spark, str(tmp_path))
    write(tmp_path / "b.csv", [HEADER])
    write(tmp_path / "a.csv", [HEADER, record(0)])
    write(tmp_path / "a.txt", [HEADER])
    assert readers.load_default_reviews(spark, str(tmp_path))[1] == "a.csv"
    write(tmp_path / readers.DEFAULT_FILE, [HEADER, record(0), record(1)])
    table, name = readers.load_default_reviews(spark, str(tmp_path))
    assert name == readers.DEFAULT_FILE and table.count() == 2


def test_parquet_needs_a_key(spark, raw, tmp_path):
    raw({}, {}).drop("row_id").withColumn("id", F.col("rating")).write.parquet(str(tmp_path / "t.parquet"))
    with pytest.raises(DatasetError):
        readers.load_reviews(spark, str(tmp_path / "t.parquet"))
    assert readers.load_reviews(spark, str(tmp_path / "t.parquet"), key="id").first().row_id == 5


def test_schema_report(raw):
    table = raw({}).withColumn("extra", F.lit(1)).drop("age")
    report = schema_check.describe_schema(table)
    assert report.missing_required == ("age",) and report.unexpected == ("extra",)
    assert not report.is_usable and len(report.messages()) == 2
    assert schema_check.replace_if_usable(raw({}), table)[0].columns == raw({}).columns
    wider = raw({}).withColumn("extra", F.lit(1))
    assert schema_check.replace_if_usable(raw({}), wider)[0].columns == wider.columns
    sheet = dict(schema_check.property_sheet(table, "it's a file").collect())
    assert sheet["Source"] == "it's a file" and sheet["Rows"] == "1"
    assert sheet["Missing required columns"] == "age" and sheet["Matches expected schema"] == "No"


def test_csv_export_round_trip(spark, raw, tmp_path):
    texts = ['quote " and, comma', "line\nbreak", "back\\slash", 'ends with "', None, "plain"]
    table = raw(*[{"review_text": t, "age": None if t is None else 30.5} for t in texts])
    headers = {v: k for k, v in SOURCE_COLUMNS.items()}
    sinks.export(table.withColumnsRenamed(headers).withColumnRenamed("row_id", "Key"), str(tmp_path / "out"))
    back = readers.load_reviews(spark, str(tmp_path / "out"), "csv", key="Key")
    expected = [r.asDict() for r in rows(table)]
    assert [r.asDict() for r in rows(back.select(*table.columns))] == expected


def test_raw_layer_keeps_rows_and_digest(spark, raw, tmp_path):
    stored = readers.write_raw_layer(raw({}, {"review_text": None}), str(tmp_path / "raw"))
    found = rows(stored)
    assert found[0].review_text_key is not None and found[1].review_text_key is None


def workbook(sheets):
    """A minimal workbook: shared strings, inline strings and numbers."""
    shared, buffer = [], io.BytesIO()
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def cell(value, at):
        ref = f'r="{chr(65 + at[1])}{at[0]}"'
        if value is None:
            return ""
        if isinstance(value, (int, float)):
            return f"<c {ref}><v>{value}</v></c>"
        if value.startswith("inline:"):
            return f'<c {ref} t="inlineStr"><is><t>{value[7:]}</t></is></c>'
        shared.append(value)
        return f'<c {ref} t="s"><v>{len(shared) - 1}</v></c>'

    with zipfile.ZipFile(buffer, "w") as book:
        for n, content in enumerate(sheets.values(), start=1):
            body = "".join(
                f'<row r="{i}">' + "".join(cell(v, (i, j)) for j, v in enumerate(r)) + "</row>"
                for i, r in enumerate(content, start=1)
            )
            book.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        entries = "".join(f'<sheet name="{s}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, start=1))
        book.writestr("xl/workbook.xml", f"<workbook {space} {links}><sheets>{entries}</sheets></workbook>")
        targets = "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
        items = "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>{items}</sst>")
    return buffer.getvalue()


def test_workbooks(spark, tmp_path):
    header = ["Unnamed: 0", *SOURCE_COLUMNS]
    body = lambda i, text: [i, 7, 31, f"title {i}", text, 4, 1, None, "General", "inline:Tops", "NA"]
    for name, start in (("b.xlsx", 10), ("a.xlsx", 0)):
        sheets = {
            "Notes": [["About", "this"], ["x", "y"]],
            "Data": [header, body(start, "first text"), [None] * 11, body(start + 1, "  ")],
        }
        (tmp_path / name).write_bytes(workbook(sheets))
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    found = rows(readers.load_reviews(spark, str(tmp_path), "xlsx"))
    assert [r.title for r in found] == ["title 0", "title 1", "title 10", "title 11"]
    assert [r.review_text for r in found] == ["first text", None] * 2
    assert {(r.age, r.rating, r.positive_feedback_count, r.department_name, r.class_name) for r in found} == {
        (31.0, 4.0, None, "Tops", None)
    }


def test_workbook_without_review_sheet_gives_its_first_sheet(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook({"One": [["A", None, "C"], ["x", None, 1.5]], "Two": [["B"], ["y"]]}))
    found = readers.read_any(spark, str(tmp_path / "w.xlsx"))
    assert {"A", "C"} <= set(found.columns) and "B" not in found.columns
    assert found.select("A", "C").first() == ("x", "1.5")


def rows_of(df):
    return sorted((r.clothing_id, r.rating) for r in df.select("clothing_id", "rating").collect())


def test_no_file_of_a_folder_is_lost(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("Clothing ID,Rating\n1,5\n")
    (tmp_path / "b.CSV").write_text("Rating,Clothing ID\n4,2\n")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"Clothing ID,Rating,Title\n3,3,x\n"))
    (tmp_path / "d.txt").write_bytes("Clothing ID,Rating,Title\n4,2,café\n".encode("latin-1"))
    loaded = readers.load_reviews(spark, str(tmp_path), "csv")
    assert rows_of(loaded) == [(1, 5), (2, 4), (3, 3), (4, 2)]
    assert {r.title for r in loaded.collect()} == {None, "x", "café"}
    assert [r.clothing_id for r in loaded.orderBy("row_id").collect()] == [1, 2, 3, 4]
    assert rows_of(readers.load_reviews(spark, str(tmp_path), "csv", key="Clothing ID")) == rows_of(loaded)


def test_one_file_in_capitals(spark, tmp_path):
    (tmp_path / "r.CSV").write_text("Clothing ID,Rating\n1,5\n")
    assert rows_of(readers.load_reviews(spark, str(tmp_path / "r.CSV"))) == [(1, 5)]


def test_files_without_common_columns_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Clothing ID,Rating\n1,5\n2,4\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(DatasetError, match="none of the columns"):
        readers.load_reviews(spark, str(tmp_path), "csv")


def test_parquet_keeps_texts_that_spell_missing_values(spark, tmp_path):
    spark.createDataFrame([(1, "None", 5.0)], "row_id long, title string, rating double").write.parquet(str(tmp_path / "t"))
    assert readers.load_reviews(spark, str(tmp_path / "t"), "parquet").first().title == "None"


def test_compressed_export_is_small_and_reads_back_as_the_plain_one(spark, raw, tmp_path):
    rows = raw(*({"row_id": i, "review_text": f'said "so",\n{"again " * 300}#{i}', "title": f"t{i}"} for i in range(200)))
    headers = {name: header for header, name in SOURCE_COLUMNS.items()}
    named = rows.withColumnsRenamed(headers).withColumnRenamed("row_id", "Key")
    sizes, found = [], []
    for compression in (None, "gzip"):
        folder = tmp_path / str(compression)
        sinks.export(named, str(folder), compression=compression)
        sizes.append(sum(f.stat().st_size for f in folder.iterdir()))
        found.append(readers.load_reviews(spark, str(folder), "csv", key="Key"))
    assert sizes[1] * 10 < sizes[0]
    assert found[0].count() == 200 and found[0].exceptAll(found[1]).count() == found[1].exceptAll(found[0]).count() == 0


def test_csv_queries_write_most_texts_compressed(spark, tables, monkeypatch, tmp_path):
    from tallyloom.plans import queries

    for name in ("csv_round_trip", "csv_quoted_records"):
        folder = tmp_path / name
        monkeypatch.setattr(queries, "shared_folder", lambda *_: str(folder))
        assert queries.QUERIES[name](tables).count() == tables.raw.count()
        files = list(folder.glob("csv/part-*"))
        packed = [f for f in files if f.suffix == ".gz"]
        assert packed and sum(f.stat().st_size for f in files) * 2 < tables.raw.selectExpr("sum(octet_length(review_text))").first()[0]
        assert (len(packed) < len(files)) == (name == "csv_quoted_records")
