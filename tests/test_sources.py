import zipfile

from sitegrain.operators import importing
from sitegrain.operators.state import fold_scores
from sitegrain.sources import site_lists
from sitegrain.streaming.learning import learn


def test_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("kiln.de\n\n oak.de \n")
    (tmp_path / "b.csv").write_bytes("﻿name,website\r\n\"x\r\ny\",pine.de\r\n".encode())
    (tmp_path / "c.log").write_text("no")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Website</t></si><si><t>elm.de</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="s"><v>0</v></c></row><row><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    sheets = site_lists.read_sheets(site_lists.list_files(spark, str(tmp_path)))
    assert [r["website"] for r in importing.load_sheet(sheets).orderBy("input_index").collect()] == ["https://kiln.de", "https://oak.de", "https://pine.de", "https://elm.de"]


def test_delivery_file(spark, tmp_path):
    rows = spark.createDataFrame([("Kiln", "", "a@b.de; c@d.de", None, "https://kiln.de")], "company_name string, representative string, emails string, phones string, website string")
    site_lists.write_delivery(rows, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == b"\xef\xbb\xbfcompany_name,representative,emails,phones,website\r\nKiln,,a@b.de; c@d.de,,https://kiln.de\r\n"

    odd = spark.createDataFrame([('a "b", c', "x\ny", " d ", "", "e")], rows.schema)
    site_lists.write_delivery(odd.union(rows), str(tmp_path / "out.csv"))  # in place of the first
    want = '\ufeffcompany_name,representative,emails,phones,website\r\n"a ""b"", c","x\ny", d ,,e\r\nKiln,,a@b.de; c@d.de,,https://kiln.de\r\n'
    assert (tmp_path / "out.csv").read_bytes() == want.encode()
    site_lists.write_delivery(rows.limit(0), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_bytes() == "\ufeffcompany_name,representative,emails,phones,website\r\n".encode()
    assert sorted(f.name for f in tmp_path.iterdir()) == ["none.csv", "out.csv"]


def test_rows_are_numbered_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(importing, "BLOCK_ROWS", 3)
    at = [("b", i) for i in range(0, 14, 2)] + [("a", i) for i in range(8)] + [("c", 5)]
    got = importing.numbered(spark.createDataFrame(at, "sheet string, row_idx int")).orderBy("input_index").collect()
    assert [(r["sheet"], r["row_idx"], r["input_index"]) for r in got] == [(*x, n + 1) for n, x in enumerate(sorted(at))]


def test_stream_is_the_batch(spark, tmp_path):
    schema = "kind string, feature string, seq long, delta int"
    rows = [("email", f"w{i % 3}", i, 3 if i % 4 else -9) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    learn(spark, stream, str(tmp_path / "scores"), str(tmp_path / "log")).awaitTermination()
    got = {r["feature"]: r["score"] for r in spark.read.parquet(str(tmp_path / "scores" / "v2")).collect()}
    assert got == {r["feature"]: r["score"] for r in fold_scores(spark.createDataFrame(rows, schema)).collect()}
