"""The log as a sink, progress, manual marks, links of packages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators import engine, resolve
from veilspark.sources import activity_log, docx
from veilspark.sources.activity_log import Settings
from veilspark.streaming import detect_stream, log_sink

OPTIONS = {"only": {"emails"}, "coreference": False}


def test_log_of_a_stream(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "state"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).selectExpr("id as doc_id", "concat('a', id, '@b.it') as text", "'it' as lang", "'s' as source", "1L as n_chars").coalesce(1).write.mode("append").parquet(source)

    def run():
        detected = engine.detect(detect_stream.document_stream(spark, source), "maximum", **OPTIONS)
        rows = activity_log.entries(detected, "analysis", "document", "maximum", "1")
        query = rows.writeStream.foreachBatch(log_sink.sink(log, Settings(True, 1000), compact_every=2)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None

    run()
    assert log_sink.read(spark, log).count() == 30 and log_sink.read(spark, log, last=4).count() == 4
    run()  # nothing new
    assert log_sink.read(spark, log).count() == 30 and {r.total_findings for r in log_sink.read(spark, log).collect()} == {1}


def rows_of(spark, stamps):
    return spark.createDataFrame([(s, "analysis") for s in stamps], "timestamp string, action string")


def test_replayed_batches_count_once(spark, tmp_path):
    log = str(tmp_path / "log")
    write = log_sink.sink(log, Settings(True, 5), compact_every=3)
    stamps = lambda: sorted(r.timestamp for r in log_sink.read(spark, log).collect())
    assert stamps() == []
    write(rows_of(spark, ["a", "b"]), 0)
    write(rows_of(spark, ["c"]), 1)
    write(rows_of(spark, ["c"]), 1)
    assert stamps() == ["a", "b", "c"]
    # a batch that was torn has no mark of success and does not count until it runs again
    (tmp_path / "log" / f"batch-{2:020d}").mkdir()
    assert stamps() == ["a", "b", "c"]
    write(rows_of(spark, ["d"]), 2)
    write(rows_of(spark, ["e", "f"]), 3)
    assert stamps() == ["b", "c", "d", "e", "f"]  # compacted to five
    write(rows_of(spark, ["a", "b"]), 0)
    assert stamps() == ["b", "c", "d", "e", "f"]
    write(rows_of(spark, ["g"]), 4)
    log_sink.compact(spark, log, Settings(True, 5))
    log_sink.compact(spark, log, Settings(True, 5))
    assert stamps() == ["c", "d", "e", "f", "g"]
    log_sink.sink(log, Settings(False, 5))(rows_of(spark, ["h"]), 5)
    assert stamps() == ["c", "d", "e", "f", "g"]


def test_a_failure_between_compaction_and_deletion(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    write = log_sink.sink(log, compact_every=100)
    for k in range(3):
        write(rows_of(spark, [f"t{k}"]), k)
    parts = log_sink._parts
    monkeypatch.setattr(log_sink, "_parts", lambda *a: (*parts(*a)[:2], []))
    log_sink.compact(spark, log)
    monkeypatch.undo()
    assert len(parts(spark, log)[2]) == 3
    assert sorted(r.timestamp for r in log_sink.read(spark, log).collect()) == ["t0", "t1", "t2"]
    log_sink.compact(spark, log)
    assert parts(spark, log)[2] == [] and log_sink.read(spark, log).count() == 3


def package(rels: str) -> bytes:
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>scrivi a a@b.it</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", rels)
    return out.getvalue()


RELS = """<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t/hyperlink" Target="mailto:mario.rossi@x.it" TargetMode="External"/><Relationship Id="r2" Type="t/styles" Target="styles.xml"/></Relationships>"""


def test_outside_links_are_blanked_and_rows_kept_apart(spark):
    other = package(RELS).replace(b"a@b.it", b"a@b.it")
    files = spark.createDataFrame([(None, bytearray(package(RELS))), (None, bytearray(other)), ("p", bytearray(package(RELS))), ("p", bytearray(b"broken"))], "path string, content binary")
    done, mapping = docx.sanitize(files, "reversible", **OPTIONS)
    rows = done.collect()
    assert sum(r.error is None for r in rows) == 3 and sum(r.error is not None for r in rows) == 1
    for r in rows:
        if r.content:
            with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as z:
                links, text = z.read("word/_rels/document.xml.rels").decode(), z.read("word/document.xml").decode()
            assert links == RELS.replace("mailto:mario.rossi@x.it", "about:blank") and "<w:t>scrivi a &lt;EMAIL_1&gt;</w:t>" in text
    entries = [(r.doc_id, r.value, r.placeholder) for r in mapping.collect()]
    assert len(entries) == 2 and set(entries) == {(None, "a@b.it", "<EMAIL_1>"), ("p", "a@b.it", "<EMAIL_1>")}


def test_progress_of_sanitizing(spark, tmp_path):
    files = spark.createDataFrame([(f"p{i}", bytearray(package(RELS)) if i % 5 else bytearray(b"broken")) for i in range(40)], "path string, content binary").repartition(8)
    told = []
    done, _ = docx.sanitize(files, "maximum", **OPTIONS)
    counted, seen = engine.observed(done, "sanitized")
    with engine.progress(spark, "sanitize", lambda *x: told.append(x), every=0.02):
        counted.write.parquet(str(tmp_path / "out"))
    assert told and all(a[0] <= b[0] for a, b in zip(told, told[1:])) and told[-1][0] > 0 and told[-1][0] <= told[-1][1]
    assert seen.get["rows"] == 40 and seen.get["errors"] == 8 and seen.get["bytes"] > 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_marks_take_every_variant(spark):
    rows = [(1, "Stellantis e STELLANTIS, a@b.it; stellantis@b.it"), (None, "Rossi rossi"), (1, None), (2, "niente")]
    found = engine.detect(spark.createDataFrame(rows, "doc_id long, text string"), "maximum", **OPTIONS)
    marks = spark.createDataFrame([(1, "ORGANIZATION", 0, 10), (1, "PERSON", 25, 31), (1, "PERSON", 40, 400), (None, "PERSON", 6, 11), (2, "PERSON", 3, 3)], "doc_id long, entity_type string, start int, end int")
    got = {r.text: [(f.entity_type, r.text[f.start : f.end], f.source) for f in r.findings] for r in resolve.mark(found, marks).collect() if r.text}
    rule = found.where("doc_id = 1 and text is not null").first().findings[0].source
    assert got[rows[0][1]] == [("ORGANIZATION", "Stellantis", "manual"), ("ORGANIZATION", "STELLANTIS", "manual"), ("PERSON", "a@b.it", "manual"), ("EMAIL_ADDRESS", "stellantis@b.it", rule)]
    assert got[rows[1][1]] == [("PERSON", "Rossi", "manual"), ("PERSON", "rossi", "manual")] and got["niente"] == []


@pytest.mark.parametrize("value, want", [("a.b", [(0, 3), (4, 7)]), (r"x\Ey", [(8, 12)]), ("", []), ("Q,", [(13, 14)])])
def test_occurrences(spark, value, want):
    from veilspark.operators import report

    df = spark.createDataFrame([("a.b A.B x\\Ey q, end".replace(" x", " x", 1), value)], "t string, v string")
    assert [tuple(x) for x in df.select(report.occurrences(F.col("t"), F.col("v"))).first()[0]] == want
