import base64
import hashlib

import pytest
from oracle import database, rows
from pyspark.sql import functions as F
from tidemill.llm import warc

PAGES = [(1, "u\r\nx", "a" * 300_000), (2, None, "a" * 300_000), (3, "x", None), (4, "y", ""), (None, "z", "q"), (None, "z", "q"), (5, "é", "é" * 70_000), (5, "é", "é" * 70_000), (6, "é", "\r\n\r\n"), (None, "s", "a" * 300_000), (-7, "n", "WARC/1.1\r\n\r\n")]


def pages(spark):
    return spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, kind string").repartition(3)


def brute_force(least=0):
    out = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "")]
        owner = max((p for p in same if p is not None), default=None)
        revisit = len(data) >= least and len(same) > 1 and owner is not None and page != owner
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "chunk", "broadcast"), [(0, 1000, 10), (0, 1 << 16, 0), (1, 1 << 20, 10)])
def test_records_come_back(spark, tmp_path, monkeypatch, least, chunk, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    path = str(tmp_path / "archive")
    warc.write_archive(pages(spark), path, least=least, chunk=chunk)
    assert sorted((tuple(r) for r in warc.read_archive(spark, path).collect()), key=repr) == brute_force(least)
    stored = spark.read.parquet(path)
    assert stored.agg(F.max(F.length("data"))).first()[0] <= max(chunk + 4, 700)


def test_damage_is_found(spark, tmp_path):
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_archive(pages(spark), path, chunk=1000)
    harmed = F.when((F.col("chunk") == 3), F.concat(F.lit(b"?"), F.substring("data", 2, 2000))).otherwise(F.col("data"))
    spark.read.parquet(path).withColumn("data", harmed).write.parquet(other)
    with pytest.raises(Exception, match="damaged in chunk 3"):
        warc.read_archive(spark, other).collect()


def test_records_that_splits_cut_come_back_once(spark, tmp_path):
    path, dealt, gone = (str(tmp_path / x) for x in "abc")
    warc.write_archive(pages(spark), path, chunk=5000)
    stored = spark.read.parquet(path)
    stored.repartition(7).write.parquet(dealt)
    assert sorted((tuple(r) for r in warc.read_archive(spark, dealt).collect()), key=repr) == brute_force()
    stored.orderBy("record", "chunk").coalesce(1).withColumn("file", F.floor(F.monotonically_increasing_id() / 11)).write.partitionBy("file").parquet(gone + "0")
    spark.read.parquet(gone + "0").drop("file").write.parquet(gone)
    assert sorted((tuple(r) for r in warc.read_archive(spark, gone).collect()), key=repr) == brute_force()
    assert "Exchange" not in warc.read_archive(spark, path)._jdf.queryExecution().executedPlan().toString()
    stored.where("chunk <> 2").write.parquet(str(tmp_path / "lacking"))
    with pytest.raises(Exception, match="lacks chunks"):
        warc.read_archive(spark, str(tmp_path / "lacking")).collect()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archive(pages(spark).where("false"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_query_matches_its_sql(spark, data):
    from tidemill.llm.queries import ORACLE_SQL, op8_warc

    expected, found = database(data).sql(ORACLE_SQL["op8_warc"]), op8_warc(spark, data)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


def test_a_page_of_many_megabytes_passes_in_chunks(spark, tmp_path):
    large = "é<p>" * 4_000_000
    df = spark.createDataFrame([(1, "u", large), (2, "u", "x")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "archive"))
    data = large.encode()
    found = {r.page_id: tuple(r)[1:] for r in warc.read_archive(spark, str(tmp_path / "archive")).collect()}
    assert found[1] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response", None) and found[2][0] == 1
    chunks = spark.read.parquet(str(tmp_path / "archive")).where("record IS NOT NULL").agg(F.count("*"), F.max(F.length("data"))).first()
    assert chunks[0] > len(data) / (1 << 14) and chunks[1] < (1 << 14) + 1_000
