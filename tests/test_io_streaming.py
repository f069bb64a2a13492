import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.sources import readers, writers
from corvane.streaming import events as X

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_text_and_docx(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\r\n three")
    got = readers.text_lines(spark, str(tmp_path / "*.txt")).orderBy("line_no").collect()
    assert [(x.page, x.line) for x in got] == [(1, "one"), (1, "two"), (1, " three")]
    xml = f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", xml)
    (tmp_path / "c.docx").write_bytes(b"broken")
    out = readers.docx_lines(spark, str(tmp_path / "*.docx")).collect()
    assert [x.line for x in out if x.error is None] == ["First", "A | B"] and sum(x.error is not None for x in out) == 1


def test_strict_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,\"two, \"\"q\"\"\"\n")
    assert readers.strict_csv(spark, str(tmp_path / "x.csv"), ["a", "b"]).first().asDict() == {"a": 'two, "q"', "b": "1"}
    with pytest.raises(ValueError):
        readers.strict_csv(spark, str(tmp_path / "x.csv"), ["a", "c"])


def test_quarantine_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    good, bad = readers.quarantine(df, {"has_text": F.col("t").isNotNull(), "small": F.col("n") < 2})
    assert good.count() == 1 and bad.first().violations == ["has_text", "small"]
    assert writers.snapshot(df, str(tmp_path / "s")) == 2
    with pytest.raises(Exception, match="(?i)exists"):
        writers.snapshot(df, str(tmp_path / "s"))
    writers.export_csv(df, str(tmp_path / "e"), [F.col("n")])
    assert spark.read.csv(str(tmp_path / "e"), header=True).count() == 2
    tables = {"candidates": spark.createDataFrame([("c",), ("d",)], "id string"), "evidence": spark.createDataFrame([("c", 1), ("d", 2)], "candidate_id string, n int")}
    left = writers.delete_cascade(tables, spark.createDataFrame([("c",)], "candidate_id string"))
    assert [x.id for x in left["candidates"].collect()] == ["d"] and left["evidence"].count() == 1


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("e1", "view", f"2024-01-01T00:00:{s:02d}Z") for s in range(0, 40, 4)] + [("e2", "click", "2024-01-02T05:00:00+07:00")]
    spark.createDataFrame(rows, "id string, event_type string, created_at string").write.parquet(folder)
    stream = X.read_stream(spark, folder, "id string, event_type string, created_at string")
    run(X.event_counts(stream), "counts", "complete")
    assert {(x.event_type, x.n) for x in spark.table("counts").collect()} == {("view", 10), ("click", 1)}
    run(X.first_uploads(stream, ["id"]), "firsts", "append")
    assert spark.table("firsts").count() == 2
    timed = stream.withColumn("at", F.col("created_at").cast("timestamp"))
    run(X.admit(timed, "event_type", "at", 20, 3), "admitted", "append")
    ok = [(x["at"] % 60, x.admitted) for x in spark.table("admitted").where("key = 'view'").orderBy("at").collect()]
    assert [s for s, a in ok if a] == [0, 4, 8, 20, 24, 28]


def test_keep_current(spark, tmp_path):
    step = X.keep_current(str(tmp_path / "t"), "k", ["v"])
    step(spark.createDataFrame([("a", 1), ("b", 5)], "k string, v int"), 0)
    step(spark.createDataFrame([("a", 3), ("b", 2)], "k string, v int"), 1)
    assert {(x.k, x.v) for x in spark.read.parquet(str(tmp_path / "t/1")).collect()} == {("a", 3), ("b", 5)}


def test_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['corvane.llm'] = None; import __spark_entry__ as e; assert 'p5_found' in e.queries() and 'p7_ids' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
