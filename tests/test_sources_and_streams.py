"""Office formats from archives built here; streams over small tables."""

import io
import tempfile
import zipfile

from pyspark.sql import functions as F

from sievework.sources import files
from sievework.streaming import changes


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_xlsx():
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = archive({
        "xl/workbook.xml": f'<workbook {r}><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Type="t/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="t/worksheet" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/worksheets/s1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><f>1+1</f><v>2</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": '<worksheet><sheetData><row><c t="s"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    })
    assert files.xlsx_text(book) == "B\nrich\tin\nA\nshared\t2"


def test_presentations_and_documents():
    r = 'xmlns:r="http://x/relationships"'
    deck = archive({
        "ppt/presentation.xml": f'<p {r}><sldIdLst><sldId id="1" r:id="b"/><sldId id="2" r:id="a"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="a" Type="t/slide" Target="slides/s1.xml"/><Relationship Id="b" Type="t/slide" Target="slides/s2.xml"/></R>',
        "ppt/slides/s1.xml": "<s><p><r><t>One</t></r></p></s>",
        "ppt/slides/s2.xml": "<s><p><r><t>Two</t></r><fld><t>7</t></fld></p></s>",
        "ppt/slides/_rels/s2.xml.rels": '<R><Relationship Id="n" Type="t/notesSlide" Target="../notes/n2.xml"/></R>',
        "ppt/notes/n2.xml": "<s><p><r><t>Say hello</t></r></p></s>",
    })
    assert files.pptx_text(deck) == "Two\nSay hello\nOne"
    sheet = archive({"content.xml": '<d xmlns:t="t" xmlns:x="x"><spreadsheet><t:table t:name="S"><table-row><table-cell><p>a</p></table-cell><table-cell><annotation><p>no</p></annotation><p>b</p></table-cell></table-row></t:table></spreadsheet></d>'})
    assert files.open_document_text(sheet) == "S\na\tb"
    text = archive({"word/document.xml": "<d><body><p><r><t>Hello</t><tab/><t>you</t></r></p><p><r><t>Bye</t></r></p></body></d>"})
    assert files.docx_text(text) == "Hello\tyou\nBye"
    rtf = rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9 costs 3 \u8364?.\par more\tab x}"
    assert files.rtf_text(rtf) == "Café costs 3 €.\nmore\tx"


def test_errors_stay_with_their_row(spark):
    rows = [("/a.docx", b"no zip"), ("/b.docx", files.OLE + b"x"), ("/c.txt", "é".encode("latin-1")), ("/d.txt", b"  ")]
    got = {r["path"]: (r["text"], r["error"]) for r in files.texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"/a.docx": (None, "unreadable"), "/b.docx": (None, "locked"), "/c.txt": ("é", None), "/d.txt": (None, "empty")}


def test_crawl(spark):
    root = tempfile.mkdtemp()
    for name in ("a.txt", "b.py", "c.zip"):
        with open(f"{root}/{name}", "w") as f:
            f.write("x")
    got = {r["path"].rpartition("/")[2]: r["action"] for r in files.crawl(spark, root).collect()}
    assert got == {"a.txt": "index", "b.py": "skip", "c.zip": "ignore"}


def test_bursts():
    assert changes.bursts([0, 1, 2, 10], 2, 100) == [(0, 4, 3), (10, 12, 1)]
    assert changes.bursts([0, 1, 2, 3, 4, 5, 6], 2, 5) == [(0, 5, 6), (6, 8, 1)]


def test_debounced_stream(spark):
    rows = [("a", t) for t in (0, 1, 2, 10)] + [("b", 100)]
    data = spark.createDataFrame(rows, "key string, t long").select("key", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"))
    folder = tempfile.mkdtemp()
    data.coalesce(1).write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{folder}/in").withWatermark("ts", "0 seconds")
    q = changes.debounced(stream, "key", "ts", 2, 600).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", f"{folder}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["key"], r["first"] - 1_700_000_000, r["fires"] - 1_700_000_000, r["n"]) for r in spark.sql("select * from fired").collect()}
    assert ("a", 0.0, 4.0, 3) in got


def test_tally_stream(spark):
    rows = [("image", 10.0, 5.0), ("image", 10.0, 1.0), ("image", 0.0, 9.0)]
    folder = tempfile.mkdtemp()
    spark.createDataFrame(rows, "name string, units double, seconds double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema("name string, units double, seconds double").parquet(f"{folder}/in")
    q = changes.running_tallies(stream).writeStream.format("memory").queryName("tally").outputMode("update").option("checkpointLocation", f"{folder}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from tally").collect()][-1] == ("image", 6.0, 20.0)


def test_lost_events_ask_for_a_full_sync(spark, tmp_path):
    got, whole = [], []
    for name, paths in (("one", ["/a", "/b", "/a"]), ("two", ["/c", None])):
        source = tmp_path / name
        spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.json(str(source))
        stream = spark.readStream.schema("path string").json(str(source))
        query = changes.incremental(stream, lambda batch: got.append(sorted(r["path"] for r in batch.collect())), str(tmp_path / f"{name}-state"), lambda: whole.append(1))
        query.awaitTermination(60)
    assert got == [["/a", "/b"]] and whole == [1]


def test_newest_query_of_a_pause(spark):
    rows = [(1, "2024-01-01 00:00:00.000", "r"), (1, "2024-01-01 00:00:00.050", "ri"), (1, "2024-01-01 00:00:00.900", "river"), (2, "2024-01-01 00:00:00.000", "x")]
    d = spark.createDataFrame(rows, "key long, at string, query string").select("key", F.col("at").cast("timestamp").alias("ts"), "query")
    assert sorted(map(tuple, changes.latest_queries(d, "key", "ts", "query").collect())) == [(1, "ri"), (1, "river"), (2, "x")]
