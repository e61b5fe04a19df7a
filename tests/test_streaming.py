from inkloom.sources import docx
from inkloom.streaming import ingest

from .test_documents import package


def test_packages_stream_in(spark, tmp_path):
    drop, out, state = (tmp_path / n for n in ("drop", "out", "state"))
    drop.mkdir()
    (drop / "a.docx").write_bytes(package())
    ingest.write_entities(ingest.package_stream(spark, str(drop)), str(out), str(state)).awaitTermination(120)
    (drop / "b.docx").write_bytes(package())
    ingest.write_entities(ingest.package_stream(spark, str(drop)), str(out), str(state)).awaitTermination(120)
    rows = spark.read.parquet(str(out))
    assert docx.entity(rows, "paragraphs").where("part = 'word/document.xml'").groupBy("doc_id").count().count() == 2


def test_change_counts(spark, tmp_path):
    path = str(tmp_path / "changes")
    spark.sql("select timestamp'2024-01-01 10:05:00' as date, 'insertion' as change_type union all select timestamp'2024-01-01 10:50:00', 'insertion' union all select timestamp'2024-01-01 11:01:00', 'deletion'").write.parquet(path)
    stream = spark.readStream.schema("date timestamp, change_type string").parquet(path)
    q = ingest.change_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.change_type, r.n) for r in spark.table("counts").collect()) == [("deletion", 1), ("insertion", 2)]
