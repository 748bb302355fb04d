"""Sanitizing of DOCX packages on DataFrames: nothing personal stays in any part, everything else stays as it was."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators import engine
from veilspark.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="w14"'


def run(text, bold=False):
    return f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t xml:space=\"preserve\">{text}</w:t></w:r>"


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
        z.writestr("word/media/image1.bin", b"\x00\x01 mario@example.com")
    return out.getvalue()


def document(body):
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document {NS}><w:body>{body}</w:body></w:document>'


def texts(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n).decode() for n in z.namelist() if n.endswith(".xml")}


def sanitized(spark, data, mode="standard", **options):
    files = spark.createDataFrame([("/in/a.docx", bytearray(data)), ("/in/b.docx", bytearray(b"broken")), ("/in/c.docx", None)], "path string, content binary")
    out, mapping = docx.sanitize(files, mode, **options)
    rows = {r.path: r for r in out.collect()}
    assert rows["/in/b.docx"].content is None and "unreadable" in rows["/in/b.docx"].error and rows["/in/c.docx"].content is None
    assert rows["/in/a.docx"].error is None
    return bytes(rows["/in/a.docx"].content), mapping


def pairs(spark, *rows):
    return spark.createDataFrame([("/in/a.docx", *r) for r in rows], "path string, entity_type string, value string")


def test_values_across_runs_and_structure(spark):
    body = document(f"<w:p>{run('scrivi a ma', True)}{run('rio@x')}{run('.it ora &amp; sempre')}</w:p><w:p/><w:p>{run('a &lt; b')}</w:p>")
    data, _ = sanitized(spark, package(word__document=body), "maximum")
    made = texts(data)["word/document.xml"]
    assert docx.docx_text(data) == "scrivi a <EMAIL> ora & sempre\na < b"
    assert made == body.replace("scrivi a ma", "scrivi a &lt;EMAIL&gt;").replace(">rio@x<", "><").replace(">.it ora", "> ora")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read("word/media/image1.bin") == b"\x00\x01 mario@example.com"


def test_hidden_content_and_metadata(spark):
    body = document(
        f"<w:p><w:ins w:author=\"Mario Rossi\" w:id='1'>{run('Testo.')}</w:ins><w:del w:author='Maria Bianchi'><w:r><w:delText>tel 06/12345678</w:delText></w:r></w:del>"
        "<w:r><w:instrText> HYPERLINK mailto:mario@example.com </w:instrText></w:r></w:p>"
    )
    data, _ = sanitized(
        spark,
        package(
            word__document=body,
            word__comments=f"<w:comments {NS}><w:comment w:author='Mario Rossi' w:initials='MR'><w:p>{run('Il sig. Mario Rossi chiama')}</w:p></w:comment></w:comments>",
            word__footnotes=f"<w:footnotes {NS}><w:footnote><w:p>{run('email luca@example.com')}</w:p></w:footnote></w:footnotes>",
            word__glossary__document=document(f"<w:p>{run('email anna@example.com')}</w:p>"),
            customXml__item1="<root><t><![CDATA[posta carla@example.com]]></t></root>",
            docProps__core="<c xmlns:dc='d'><dc:creator>Mario Rossi</dc:creator><lastModifiedBy>Mario Rossi</lastModifiedBy></c>",
            docProps__custom="<p><property name='Cliente Mario Rossi' linkTarget='Rossi'><v>Mario Rossi</v></property></p>",
        ),
    )
    whole = "".join(texts(data).values())
    for gone in ("Mario Rossi", "Maria Bianchi", "06/12345678", "@example.com", "initials='MR'", "Rossi"):
        assert gone not in whole
    assert "M. R." in whole and "&lt;TELEFONO&gt;" in whole and whole.count("&lt;EMAIL&gt;") == 4 and "name=\"Anonymized\"" in whole
    assert "mc:Ignorable=\"w14\"" in whole and "xmlns:w14" in whole


def test_a_table_row_is_context_for_its_cells(spark):
    cell = lambda *runs: f"<w:tc><w:p>{''.join(runs)}</w:p></w:tc>"
    body = document(f"<w:tbl><w:tr>{cell(run('IT60 X054 2811 1010'))}{cell(run(' 0000 0123 456'))}</w:tr></w:tbl><w:p>{run('IT60 X054 2811 1010')}</w:p>")
    data, _ = sanitized(spark, package(word__document=body), "maximum")
    assert docx.docx_text(data) == "<IBAN>\nIT60 X054 2811 1010"


def test_exclusions_and_manual_values(spark):
    mail = "mario@example.com"
    body = document(f"<w:p>{run('Il sottoscritto ')}{run('Mario Rossi', True)}{run(f' con recapito {mail}, progetto Aurora')}</w:p>")
    header = f"<w:hdr {NS}><w:p>{run(f'Il sottoscritto Mario Rossi, email {mail}')}</w:p></w:hdr>"
    options = {"excluded": pairs(spark, ("EMAIL_ADDRESS", mail)), "extra": pairs(spark, ("ORGANIZATION", "AURORA"), ("PERSON", "assente"))}
    data, _ = sanitized(spark, package(word__document=body, word__header1=header), "maximum", **options)
    assert docx.docx_text(data) == f"Il sottoscritto <PERSONA> con recapito {mail}, progetto <ORGANIZZAZIONE>\nIl sottoscritto <PERSONA>, email {mail}"
    assert re.search(r"<w:b/></w:rPr><w:t[^>]*>&lt;PERSONA&gt;</w:t>", texts(data)["word/document.xml"])


def test_reversible_mapping_is_one_for_all_parts(spark):
    body = document(f"<w:p>{run('da b@x.it a a@x.it')}</w:p><w:p>{run('copia b@x.it, già &lt;EMAIL_2&gt;')}</w:p>")
    header = f"<w:hdr {NS}><w:p>{run('a@x.it')}</w:p></w:hdr>"
    data, mapping = sanitized(spark, package(word__document=body, word__header1=header), "reversible", extra=pairs(spark, ("PERSON", "copia")))
    assert docx.docx_text(data) == "da <EMAIL_3> a <EMAIL_4>\n<PERSONA_1> <EMAIL_3>, già <EMAIL_2>\n<EMAIL_4>"
    assert {(r.placeholder, r.value) for r in mapping.collect()} == {("<EMAIL_3>", "b@x.it"), ("<EMAIL_4>", "a@x.it"), ("<PERSONA_1>", "copia")}


@pytest.mark.parametrize("encoding", ["utf-16", "iso-8859-1"])
def test_other_encodings(spark, encoding):
    body = document(f"<w:p>{run('perché a@x.it è qui')}</w:p>").replace("UTF-8", encoding)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body.encode(encoding))
    data, _ = sanitized(spark, out.getvalue(), "maximum")
    assert docx.docx_text(data) == "perché <EMAIL> è qui"


def test_edits_at_node_borders():
    assert docx.node_edits([3, 0, 4, 2], [(1, 5, "x"), (7, 9, "y")]) == [[(1, 3, "x")], [], [(0, 2, "")], [(0, 2, "y")]]
    assert docx.node_edits([4], [(2, 3, "b"), (0, 3, "a")]) == [[(0, 3, "a")]]
    assert docx.edited("abcdef", [(0, 1, "X"), (3, 5, "")]) == "Xbcf"


def test_cancellable_jobs(spark):
    with engine.cancellable(spark, "test-group") as cancel:
        assert spark.range(3).agg(F.sum("id")).first()[0] == 3
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("test-group")
        cancel()
