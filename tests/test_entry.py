import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 50


def test_entry_runs(spark):
    assert e.entry(spark).limit(5).count() == 5


def test_rest_works_without_corpus_operators(tmp_path):
    for name in ("fieldloom", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else __import__("shutil").copytree(ROOT / name, tmp_path / name, ignore=lambda d, names: {"llm"} & set(names))
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()), 1"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k.startswith("JAVA")})


def test_people_are_dealt_out_by_key(spark):
    from fieldloom.plans import inputs

    people = inputs.people(spark, "/root/testdata/sf0.001")
    assert people.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_sql_of_latin_states_the_same_rule():
    import duckdb

    from fieldloom.functions import latin
    from fieldloom.plans import catalog

    texts = ["Straße ẞ Øre Łódź æ", "é x̀", "Москва Αθήνα “a’ – …", "a\tb\nc\x7f", "", None, "سلام", "​x­", "İ"]
    db = duckdb.connect()
    db.execute("create table documents (doc_id int, text varchar)")
    db.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert dict(db.execute(catalog.ORACLES["n1_latin"]).fetchall()) == {i: latin.to_latin(t or "") for i, t in enumerate(texts)}
