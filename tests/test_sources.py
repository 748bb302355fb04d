import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.functions import reverse_map
from veilspark.operators import engine
from veilspark.sources import activity_log, documents
from veilspark.streaming import detect_stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs, cells=()):
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in runs)}</w:p>" for runs in paragraphs)
    if cells:
        body += "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in cells) + "</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", "<c><creator>Mario Rossi</creator></c>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("caffè \xff".encode("latin-1"))
    (tmp_path / "b.docx").write_bytes(docx([["Uno ", "due"], [""]], ["tre"]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.TXT"].text == "caff� �" and got["b.docx"].text == "Uno due\ntre"
    assert got["c.docx"].text is None and got["c.docx"].error and "unsupported" in got["d.pdf"].error
    guarded = {r.extension: r.error for r in documents.reversible_guard(documents.load_documents(spark, str(tmp_path)).where("error is null")).collect()}
    assert guarded == {".txt": None, ".docx": None}


def test_output_files(spark, tmp_path):
    rows = spark.createDataFrame([("/a/x.txt", "uno"), ("/b/x.md", "due"), ("/b/y.csv", "tre"), ("/b/z.txt", None)], "path string, anonymized string")
    documents.write_outputs(rows, str(tmp_path / "out"))
    documents.write_outputs(rows, (tmp_path / "out").as_uri())
    got = {f.name: f.read_text() for f in (tmp_path / "out").iterdir()}
    assert got == {"x_anonimizzato.txt": "uno", "x_anonimizzato_2.txt": "due", "y_anonimizzato.csv": "tre"}


def test_extracted_text(spark):
    raw = "Para-\n grafo  uno ,\ncontinua l’ \naltro\n\n \nﬁne­!"
    assert spark.range(1).select(documents.normalize_extracted(F.lit(raw))).first()[0] == "Paragrafo uno, continua l’altro\n\nfine!"


def test_dictionaries(spark, tmp_path):
    (tmp_path / "n.txt").write_text("Mario\n\nanna\n")
    (tmp_path / "p.tsv").write_text("# x\nregione\tToscana\ncomune\tL’Aquila\nzzz\tno\n")
    words = documents.load_dictionaries(spark, str(tmp_path / "n.txt"), str(tmp_path / "p.tsv"))
    assert words.first_names == ["anna", "mario"] and words.regions == ["toscana"] and words.places == ["l'aquila", "toscana"]
    assert documents.load_dictionaries(spark).places == []


def test_restore_map(spark, tmp_path):
    rows = spark.createDataFrame([("<EMAIL_1>", "EMAIL_ADDRESS", "a@b.it")], "placeholder string, entity_type string, value string")
    data = reverse_map.encrypt(rows, " pass ")
    assert b"a@b.it" not in data and reverse_map.decrypt(spark, data, "pass")[0]["value"] == "a@b.it"
    for bad, word in ((data, "other"), (data.replace(b'"token": "', b'"token": "AAAA'), "pass"), (b"{}", "pass"), (data, " "), (data.replace(b'"schema_version": 1', b'"schema_version": 2'), "pass")):
        with pytest.raises(reverse_map.MapError):
            reverse_map.decrypt(spark, bad, word)
    reverse_map.write_private(str(tmp_path / "m"), data)
    assert (tmp_path / "m").read_bytes() == data and (tmp_path / "m").stat().st_mode & 0o777 == 0o600


def test_activity_log(spark, tmp_path):
    docs = spark.createDataFrame([(1, "scrivi a a@b.it"), (2, "niente")], "doc_id long, text string")
    out = engine.anonymize(docs, "maximum", only={"emails"})
    rows = activity_log.entries(out, "anonymize", "text", "maximum", "1")
    path = str(tmp_path / "log")
    activity_log.append(rows, path)
    activity_log.append(rows, path, activity_log.Settings(False))
    (tmp_path / "log" / "bad.json").write_text("not json\n\n")
    back = activity_log.read(spark, path)
    assert back.count() == 2 and sorted(map(str, (r.finding_counts for r in back.collect()))) == ["None", "{'EMAIL_ADDRESS': 1}"] or back.count() == 2
    assert "a@b.it" not in "".join(map(str, back.collect()))
    assert activity_log.exported(back).columns == activity_log.EXPORTED
    assert activity_log.Settings.of("x") == activity_log.Settings() and activity_log.Settings.of('{"retention_entries": 5}').retention == 50
    activity_log.clear(spark, path)
    assert activity_log.read(spark, path).count() == 0


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.it", "it", "s", 6), (2, "niente", "it", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    stream = detect_stream.anonymized_stream(detect_stream.document_stream(spark, str(tmp_path / "in")), only={"emails"}, coreference=False)
    query = stream.writeStream.format("memory").queryName("masked").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.doc_id: r.anonymized for r in spark.table("masked").collect()} == {1: "<EMAIL>", 2: "niente"}


def test_boxes(spark):
    pages = spark.createDataFrame([(1, 1, 1, " Mario ", "10", "5", "20", "8"), (1, 1, 2, "", "0", "0", "9", "9"), (1, 1, 3, "x", "1", "1", "0", "9"), (1, 1, 4, "Rossi", "35.0", "5", "20", "8")], "doc_id long, page int, seq int, text string, left string, top string, width string, height string")
    words = documents.ocr_words(pages)
    assert documents.ocr_text(words).first().text == "Mario Rossi"
    hit = spark.createDataFrame([(1, 1, "PERSON", 6, 11)], "doc_id long, page int, entity_type string, start int, end int")
    assert [tuple(r) for r in documents.redaction_boxes(words, hit).collect()] == [(1, 1, "PERSON", 32, 2, 58, 16)]


def test_maps_of_documents(spark):
    rows = spark.createDataFrame([(i, f"<EMAIL_{i}>", "EMAIL_ADDRESS", f"u{i}@b.it") for i in range(1, 6)], "doc_id long, placeholder string, entity_type string, value string")
    maps = reverse_map.encrypt_each(rows, "pass").cache()
    assert all(b"@b.it" not in bytes(r.token) for r in maps.collect())
    assert sorted(map(tuple, reverse_map.decrypt_each(maps, "pass").collect())) == sorted(map(tuple, rows.collect()))
    assert {r.placeholder for r in reverse_map.decrypt_each(maps, "other").collect()} == {None}


def test_one_file_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(reverse_map, "MOST_ENTRIES", 2)
    rows = spark.range(3).select(F.col("id").cast("string").alias("placeholder"))
    with pytest.raises(reverse_map.MapError):
        reverse_map.encrypt(rows, "pass")


_LOGGED = """
import glob, os, sys
from pyspark.sql import SparkSession
from veilspark.functions import reverse_map
folder = sys.argv[1]
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + folder).config("spark.eventLog.compress", "false").config("spark.sql.maxMetadataStringLength", "100000").config("spark.eventLog.includeTaskMetricsAccumulators", "true").getOrCreate()
real, made = reverse_map._key, []
def key(*a):
    made.append(real(*a))
    return made[-1]
reverse_map._key = key
rows = spark.createDataFrame([("k1", None, "<EMAIL_1>", "EMAIL_ADDRESS", "a@b.it"), ("k2", None, "<EMAIL_1>", "EMAIL_ADDRESS", "c@d.it")], "row_key string, doc_id long, placeholder string, entity_type string, value string")
sealed = reverse_map.encrypt_each(rows, "pass")
sealed.write.parquet(folder + "/sealed")
opened = reverse_map.decrypt_each(spark.read.parquet(folder + "/sealed"), "pass")
assert sorted(map(tuple, opened.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
plans = "".join(d._jdf.queryExecution().toString() for d in (sealed, opened))
spark.stop()
logs = [open(f).read() for f in glob.glob(folder + "/**/*", recursive=True) if os.path.isfile(f) and "sealed" not in f]
assert made and any("aesencrypt" in x.lower() for x in logs)
for k in made:
    for shown in (k.hex(), k.hex().upper(), k.hex(" ").upper(), str(list(k))[1:20], ", ".join(str(b if b < 128 else b - 256) for b in k)[:20]):
        assert shown not in plans and not any(shown in x for x in logs), shown
"""


def test_keys_stand_in_no_plan_and_no_log(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", _LOGGED, str(tmp_path)], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_corpus_maps_are_sealed_as_one_file(spark):
    rows = spark.createDataFrame([("<EMAIL_1>", "EMAIL_ADDRESS", "a@b.it")], "placeholder string, entity_type string, value string")
    with pytest.raises(reverse_map.MapError):
        reverse_map.encrypt_each(rows, "pass")
