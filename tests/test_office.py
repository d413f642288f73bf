"""Office documents from files, as a batch and as a stream."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.sources import files, office

W, A, S = office.WORD, office.DRAWING, office.SHEET


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


DOCX = packed(
    {
        "word/document.xml": f"""<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Ti</w:t></w:r><w:r><w:t>tle</w:t></w:r></w:p><w:p/>
            <w:p><w:r><w:t xml:space="preserve">a &amp; b </w:t><w:tab/><w:t>c</w:t><w:br/><w:t>d</w:t></w:r></w:p>
            <w:tbl><w:tr><w:tc><w:p><w:r><w:t>x|y</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>""",
        "word/media/image1.png": "x",
    }
)
SLIDE = f'<p:sld xmlns:p="p" xmlns:a="{A}"><a:p><a:r><a:t>{{}}</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>cell</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:sld>'
PPTX = packed({f"ppt/slides/slide{n}.xml": SLIDE.format(f"slide {n}") for n in (1, 2, 10)})
XLSX = packed(
    {
        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.5</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="C2"/></row></sheetData></worksheet>',
    }
)
BOMB = packed({"word/document.xml": f'<!DOCTYPE x [<!ENTITY a "aaaa">]><w:document xmlns:w="{W}"><w:body/></w:document>'})


def rows_of(df):
    made = df.select("*", office.markdown_of(F.col("blocks")).alias("md"), office.paragraphs(F.col("blocks")).alias("p"))
    return {r.path.rpartition("/")[2]: r for r in made.collect()}


def check(got):
    assert len(got) == 6
    word = got["a.docx"]
    assert word.md == "## Title\n\na & b \tc\nd\n\n| x y |  |\n| 1 | 2 |" and word.n_images == 1 and word.p == ["Title", "", "a & b \tc\nd", "x|y\t", "1\t2"]
    assert got["b.pptx"].md == "\n\n".join(f"## {i}\n\n| cell |\n\nslide {n}" for i, n in enumerate((1, 2, 10), 1))
    assert got["c.XLSX"].md == "| name |  | 3.5 |\n| ab | in |  |"
    assert got["d.docx"].error.startswith("BadZipFile") and got["e.docx"].error.startswith("KeyError") and "document type" in got["f.docx"].error
    assert all(got[n].blocks == [] and got[n].md == "" for n in ("d.docx", "e.docx", "f.docx")) and got["a.docx"].error is None


def test_files_and_streams(spark, tmp_path):
    content = {"a.docx": DOCX, "b.pptx": PPTX, "c.XLSX": XLSX, "d.docx": b"no zip", "e.docx": packed({"x": "y"}), "f.docx": BOMB}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "other.txt").write_text("not read")
    given = spark.createDataFrame([(f"/x/{n}", bytearray(d)) for n, d in content.items()], "path string, content binary")
    check(rows_of(office.blocks_of(given)))
    (tmp_path / "c.XLSX").rename(tmp_path / "c.xlsx")
    read = rows_of(files.read(spark, "office", path=str(tmp_path)))
    check({"c.XLSX" if n == "c.xlsx" else n: r for n, r in read.items()})
    stream = files.read(spark, "office", path=str(tmp_path), stream=True)
    assert stream.isStreaming
    job = stream.writeStream.format("memory").queryName("office_rows").trigger(availableNow=True).start()
    job.awaitTermination()
    check({"c.XLSX" if n == "c.xlsx" else n: r for n, r in rows_of(spark.table("office_rows")).items()})


def test_round_trip(spark):
    rows = spark.createDataFrame([("x.docx", [(1, "T <1>"), (None, "a\nb\x00\x1f"), (None, " ]]> & 漢 \r\t")]), ("y.docx", None)], "path string, blocks array<struct<level:int,text:string>>")
    got = rows_of(office.blocks_of(office.docx_files(rows, "path", "blocks")))
    assert got["x.docx"].p == ["T <1>", "a\nb", " ]]> & 漢 \r\t"] and got["x.docx"].error is None
    assert got["y.docx"].p == [] and got["y.docx"].error is None
