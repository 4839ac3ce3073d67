import hashlib
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.settings import Settings
from lodestrata.operators import order
from lodestrata.sources import convert, files, readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, main="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(main, f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def paragraph(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def pdf(content, extra=b"", compress=True):
    data = zlib.compress(content) if compress else content
    kind = b"/Filter /FlateDecode " if compress else b""
    return b"%PDF-1.4\n1 0 obj << /Type /Pages /Count 1 >> endobj\n2 0 obj << /Type /Page /Parent 1 0 R >> endobj\n3 0 obj << " + kind + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream endobj\ntrailer << " + extra + b" >>\n%%EOF\n"


def test_scan_keeps_every_file(spark, tmp_path):
    for name, data in {"a.txt": b"abc", "_b.md": b"x" * 3_000_000, ".c.md": b"", "d.xlsx": b"1", "E.PDF": b"%", "noext": b""}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "folder.md").mkdir()
    (tmp_path / "folder.md" / "inner.txt").write_text("not seen")
    rows = {r.file_name: r for r in files.scan_folder(spark, str(tmp_path), Settings(hash_block_bytes=1000)).collect()}
    assert [r.file_name for r in sorted(rows.values(), key=lambda r: r.ord)] == [".c.md", "E.PDF", "_b.md", "a.txt", "d.xlsx", "noext"]
    for name in ("a.txt", "_b.md", ".c.md", "E.PDF"):
        data = (tmp_path / name).read_bytes()
        assert (rows[name].scan_state, rows[name].digest, rows[name].size_bytes) == ("ok", hashlib.sha256(data).hexdigest(), len(data))
    assert {rows[n].scan_state for n in ("d.xlsx", "noext")} == {"unsupported"} and rows["d.xlsx"].reason == files.UNSUPPORTED_REASON


def test_a_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)

    def opener(path):
        if path.endswith("b.txt"):
            raise PermissionError(13, "no entry")
        return files.open_stream(path)

    rows = {r.file_name: (r.scan_state, r.reason) for r in files.scan_folder(spark, str(tmp_path), opener=opener).collect()}
    assert rows == {"a.txt": ("ok", None), "b.txt": ("unreadable", "no entry")}


def test_a_million_names_pass_no_driver_table(spark, tmp_path):
    def many(folder):
        yield from ((f"{i:07}.txt" if i % 2 else f"{i:07}.bin", f"file:/{i}", i) for i in range(1_000_000))

    source = type("ManyFiles", (files.FolderFiles,), {"entries": staticmethod(many), "name": classmethod(lambda cls: "many_files")})
    rows = files.folder_files(spark, str(tmp_path), source=source, shards=8).withColumn("task", F.spark_partition_id())
    r = rows.agg(F.count("*").alias("n"), F.countDistinct("file_name").alias("names"), F.sum("listed_bytes").alias("bytes"), F.countDistinct("task").alias("tasks")).first()
    assert (r.n, r.names, r.bytes, r.tasks) == (1_000_000, 1_000_000, 499_999_500_000, 8)


def test_names_that_are_no_text_and_links_to_nothing_are_rows(spark, tmp_path):
    import os

    with open(os.fsencode(tmp_path) + b"/bad\xff.txt", "wb") as f:
        f.write(b"x")
    (tmp_path / "to.txt").symlink_to(tmp_path / "nothing.txt")
    (tmp_path / "good.txt").write_text("x")
    rows = {r.file_name: (r.scan_state, r.reason) for r in files.scan_folder(spark, f"file:{tmp_path}").collect()}
    assert rows == {"bad\ufffd.txt": ("unreadable", files.NAME_REASON), "good.txt": ("ok", None)}


def test_places_by_ranges_are_those_of_one_sort(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("scope"), *[F.lit("x").alias(c) for c in ("_at", "_PART", "_first", "_n", "_run")])
    got = [tuple(r) for r in order.placed(rows, ("v",), ("scope",), "place").select("scope", "v", "place").collect()]
    by = {}
    for scope, v, _ in got:
        by.setdefault(scope, []).append(v)
    assert len(got) == 5000 and sorted(got, key=str) == sorted(((s, v, i) for s, vs in by.items() for i, v in enumerate(sorted(vs))), key=str)
    assert order.placed(rows.limit(0), ("v",)).count() == 0
    assert {(r.v, r.ord) for r in order.placed(rows, ("v",)).collect()} == {(v, i) for i, v in enumerate(sorted(v for _, v, _ in got))}


def test_pages_follow_each_other(spark):
    rows = spark.range(257).select((F.col("id") % 5).alias("a"), F.col("id").alias("b"))
    seen, after = [], None
    while page := [tuple(r) for r in order.pages(rows, ("a", "b"), 50, after).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == sorted((i % 5, i) for i in range(257))


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(files.FolderNotFound):
        files.scan_folder(spark, str(tmp_path / "none"))
    assert files.scan_folder(spark, str(tmp_path)).count() == 0


def test_conversion_of_a_hostile_folder(spark, tmp_path):
    content = {
        "a.txt": "﻿one\r\ntwo\rthree".encode(), "b.md": "# T\n\nété".encode(), "latin.txt": "congés".encode("latin-1"), "blank.md": b" \n\xc2\xa0", "zero.txt": b"",
        "w.docx": docx(paragraph("Head", "Heading1") + paragraph("Body") + "<w:tbl><w:tr><w:tc>" + paragraph("c1") + "</w:tc><w:tc>" + paragraph("c2") + "</w:tc></w:tr></w:tbl>"), "broken.docx": b"PK\x03\x04garbage",
        "zip.docx": docx("", "other.xml"), "empty.docx": docx(paragraph("")), "ok.pdf": pdf(b"BT (Hello \\(world\\)) Tj T* [(spl) -20 (it)] TJ ET"), "locked.pdf": pdf(b"BT (x) Tj ET", b"/Encrypt 5 0 R"), "bad.pdf": b"not a pdf", "zero.pdf": b"",
        "scan.pdf": pdf(b"q 1 0 0 1 0 0 cm /Im0 Do Q"), "x.xlsx": b"1",
    }
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    listed = files.list_folder(spark, str(tmp_path)).withColumn("ord", F.monotonically_increasing_id())
    gone = spark.createDataFrame([("gone.txt", f"file:{tmp_path}/gone.txt", 1, 99)], listed.schema)
    rows = {r.file_name: r for r in convert.convert_files(listed.union(gone)).collect()}
    assert all((r.markdown is None) == (r.outcome != "converted") and (r.reason is None) == (r.outcome == "converted") for r in rows.values())
    assert rows["a.txt"].markdown == "one\ntwo\nthree" and rows["b.md"].markdown == "# T\n\nété"
    assert rows["w.docx"].markdown == "# Head\n\nBody\n\n| c1 | c2 |\n| --- | --- |" and rows["w.docx"].page_count is None
    assert (rows["ok.pdf"].markdown, rows["ok.pdf"].page_count) == ("Hello (world)\nsplit", 1)
    want = {"latin.txt": readers.NOT_UTF8, "broken.docx": readers.DOCX_DAMAGED, "zip.docx": readers.DOCX_DAMAGED, "locked.pdf": readers.PDF_LOCKED, "bad.pdf": readers.PDF_DAMAGED, "zero.pdf": readers.PDF_DAMAGED}
    for name, reason in want.items():
        assert (rows[name].outcome, rows[name].reason) == ("failed", reason)
    for name, reason in {"blank.md": readers.EMPTY, "zero.txt": readers.EMPTY, "empty.docx": readers.EMPTY, "scan.pdf": readers.PDF_NO_TEXT, "x.xlsx": files.UNSUPPORTED_REASON}.items():
        assert (rows[name].outcome, rows[name].reason) == ("skipped", reason)
    assert rows["gone.txt"].outcome == "failed" and rows["gone.txt"].reason.startswith("this file could not be read")


def test_a_reader_that_breaks_costs_one_file():
    def broken(data):
        raise KeyError("x")

    assert convert.convert_bytes("md", b"x", readers={"md": broken}) == ("failed", None, None, "this file could not be read: KeyError: 'x'")
    assert set(readers.READERS) == set(Settings().supported_types)


def test_text_columns_convert_alike(spark):
    data = [b"\xef\xbb\xbfa\r\nb", b"\xff", b" \xc2\xa0", b"x", b""]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, c binary").select("i", convert.convert_text(F.lit("txt"), F.col("c")).alias("r")).collect()
    for r in rows:
        outcome, markdown, _, reason = convert.convert_bytes("txt", data[r.i])
        assert tuple(r.r) == (outcome, markdown, reason)


def objects(parts, root=1, extra=b""):
    """A file of numbered objects: bytes, or (dictionary, stream)."""
    out = [b"%PDF-1.7"]
    for n, x in parts.items():
        out.append(b"%d 0 obj " % n + (x if isinstance(x, bytes) else b"<< " + x[0] + b" /Length %d >> stream\n" % len(x[1]) + x[1] + b"\nendstream") + b" endobj")
    return b"\n".join(out) + (b"\ntrailer << /Root %d 0 R " % root if root else b"\n") + extra + (b">>" if root else b"") + b"\n%%EOF\n"


def page(text, sizes=((24, "Title"), (12, "body one")), more=b""):
    shown = b"BT " + b" ".join(b"/F1 %d Tf 1 0 0 1 72 %d Tm (%s) Tj" % (size, 700 - 60 * k, t.encode("cp1252")) for k, (size, t) in enumerate(sizes)) + b" ET"
    return (more, shown)


def test_pdf_headings_follow_sizes_and_pages_their_tree():
    parts = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [5 0 R 3 0 R] /Count 2 >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: page("", ((18, "Second"), (12, "the second page's text is body"), (12, "(nested \\(paren\\)) \\351"))),
        5: b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R 7 0 R] >>", 6: page("", ((24, "The Title"), (12, "some body text here"))), 7: page("", ((15, "Third level"), (12, "more of it"))),
    }
    found = readers.read_pdf(objects(parts))
    assert found.pages == 2
    assert found.text == "# The Title\n\nsome body text here\n\n### Third level\n\nmore of it\n\n## Second\n\nthe second page's text is body\n\n(nested (paren)) é"


def test_pdf_object_streams_fonts_and_kerning():
    chart = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <0059005A>] endbfrange"
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 8 0 R >> >> >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>"), (8, b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>")]
    body, table = b"", b""
    for n, x in inner:
        table += b"%d %d " % (n, len(body))
        body += x + b" "
    packed = zlib.compress(table + body)
    content = b"BT /F1 10 Tf 0 -12 Td [<0001> -300 <00100011> -20 <0012>] TJ 0 -12 Td <000200200021> Tj ET"
    parts = {20: (b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(table), packed), 9: (b"/Filter [/ASCIIHexDecode /FlateDecode]", zlib.compress(content).hex().encode() + b">"), 10: (b"", chart), 30: (b"/Type /XRef /Root 1 0 R", b"x")}
    found = readers.read_pdf(objects(parts, root=0))
    assert (found.text, found.pages) == ("H abc\n\U0001f600XYZ", 1)


def test_pdf_that_is_locked_damaged_or_circular():
    tree = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: page("")}
    assert readers.read_pdf(objects(tree)).pages == 1
    for data, reason in (
        (objects(tree, extra=b"/Encrypt 9 0 R"), readers.PDF_LOCKED), (b"", readers.PDF_DAMAGED), (objects(tree)[:200], readers.PDF_DAMAGED),
        (objects({**tree, 4: (b"/Filter /FlateDecode", b"not deflated")}), readers.PDF_DAMAGED), (b"%PDF-1.4\nnothing\n%%EOF", readers.PDF_DAMAGED),
    ):
        with pytest.raises(readers.Unreadable) as e:
            readers.read_pdf(data)
        assert e.value.reason == reason
    picture = objects({**tree, 4: (b"/Filter /DCTDecode", b"jpeg")})
    assert convert.convert_bytes("pdf", picture) == ("skipped", None, None, readers.PDF_NO_TEXT)


def test_any_bytes_give_a_row():
    import random

    rng = random.Random(0)
    whole = objects({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: page("")})
    for _ in range(300):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        assert convert.convert_bytes("pdf", bytes(data))[0] in ("converted", "failed", "skipped")


def test_contents_at_hand_convert_alike(spark):
    whole = pdf(b"BT (Hello) Tj ET")
    rows = [(0, "a.PDF", whole), (1, "b.txt", b"\xef\xbb\xbfx\r\ny"), (2, "c.md", None), (3, "d.xlsx", b"1"), (4, "w.docx", docx(paragraph("Head", "Heading2") + paragraph("Body")))]
    df = spark.createDataFrame([(i, n, None if c is None else bytearray(c)) for i, n, c in rows], "ord bigint, file_name string, content binary")
    got = sorted(tuple(r) for r in convert.convert_contents(df).collect())
    for (i, name, content), row in zip(rows, got, strict=True):
        kind = name.rpartition(".")[2].lower()
        assert row == (i, name, *convert.convert_bytes(kind, content or b""))
    assert got[4][3] == "## Head\n\nBody"
