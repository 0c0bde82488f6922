import json
import os

from pyspark.sql import functions as F

from fieldloom.streaming import ingest

DOCS = "application_id long, doc_id string, raw_text string, document_type string, arrived timestamp"
FORMS = "application_id long, name string, dob string, arrived timestamp"


def text(name):
    return f"First Name: {name}\nLast Name: Kumar\nDOB: 19/04/2001"


def doc(key, at, doc_id="d"):
    return {"application_id": key, "doc_id": doc_id, "raw_text": text("Ramesh"), "document_type": None, "arrived": at}


def form(key, at, name="Ramesh Kumar"):
    return {"application_id": key, "name": name, "dob": "19-04-2001", "arrived": at}


def write(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        path = folder / f"{i:02}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def test_either_side_may_come_first(spark, tmp_path):
    """Replayed a file at a time: late, early, repeated and missing forms, and rows after the watermark."""
    day = "2026-01-{:02} 10:00:00".format
    write(tmp_path / "docs", [[doc(1, day(1)), doc(2, day(1))], [doc(3, day(2)), doc(1, day(1))], [doc(4, day(2)), doc(3, day(2), "e")], [doc(90, day(20))], [doc(92, day(21))], [doc(5, day(1))], [doc(91, day(25))]])
    write(tmp_path / "forms", [[form(3, day(1)), form(3, day(1))], [form(1, "2026-01-02 09:00:00"), form(4, day(6))], [form(1, "2026-01-02 09:00:00")], [form(90, day(20))], [form(92, day(21))], [form(2, day(1)), form(5, day(1))], [form(91, day(25))]])

    def stream(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))

    pairs = ingest.late_pairs(stream("docs", DOCS), stream("forms", FORMS), apart="1 day", late="2 days")
    q = pairs.select("application_id", "doc_id", "doc_name", "form_name").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.application_id, r.doc_id, r.doc_name, r.form_name) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    met, alone = ("Ramesh Kumar", "Ramesh Kumar"), ("Ramesh Kumar", None)
    # rows count as late by the watermark of the batch before; 2's form comes after it, 4's is too far from its document, 5 is late altogether
    assert got == [(1, "d", *met), (2, "d", *alone), (3, "d", *met), (3, "e", *met), (4, "d", *alone), (90, "d", *met), (91, "d", *met), (92, "d", *met)]


def test_late_verification_decides_and_restarts(spark, tmp_path):
    write(tmp_path / "docs", [[doc(1, "2026-01-01 10:00:00"), doc(2, "2026-01-01 10:00:00")]])
    write(tmp_path / "forms", [[form(1, "2026-01-01 20:00:00")]])

    def run():
        docs, forms = (spark.readStream.schema(s).json(str(tmp_path / n)) for n, s in (("docs", DOCS), ("forms", FORMS)))
        ingest.start_late_verification(docs, forms, str(tmp_path / "out"), str(tmp_path / "cp"), at=F.lit("2026-02-01").cast("timestamp")).awaitTermination()
        return sorted([(r.name, r.decision, tuple(r.notes)) for r in spark.read.json(str(tmp_path / "out")).select("user.name", "response.decision", "response.notes").collect()], key=str) if (tmp_path / "out").exists() else []

    run()
    (tmp_path / "docs/99.json").write_text(json.dumps(doc(9, "2026-01-20 10:00:00")))
    (tmp_path / "forms/99.json").write_text(json.dumps(form(9, "2026-01-20 10:00:00")))
    got = run()
    assert [g[1] for g in got if g[0]] == ["MATCH", "MATCH"]
