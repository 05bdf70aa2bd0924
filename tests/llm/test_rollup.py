import duckdb
import pytest
from pyspark.sql import functions as F

from provspark.llm.rollup import Rollup, counted, deletes, inserts, revisions
from provspark.llm.rollup_query import SQL, op3, rolled
from provspark.session import scratch
from tools.check import rows_of


def totals(rollup):
    return {tuple(r) for r in rollup.totals().collect()}


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = op3(spark, sf)
    cursor = con.execute(SQL)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.fixture
def docs(spark):
    rows = [(1, "a b c", "en", "s"), (2, "a, b!", "en", "s"), (3, None, None, "s"), (4, "", "de", None), (4, "", "de", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("sign", F.lit(9))


def test_batches_are_idempotent_and_add_up(spark, docs):
    rollup = Rollup(spark, scratch(spark, "test-rollup"))
    assert rollup.totals().collect() == []
    rows = counted(docs)
    english = rows.where("lang = 'en'")
    assert rollup.commit("a", inserts(rows, "words1"))
    first = totals(rollup)
    assert first == {("s", "en", "words1", 2, 5), ("s", None, "words1", 1, 0), (None, "de", "words1", 2, 0)}
    assert not rollup.commit("a", inserts(rows, "words1")) and totals(rollup) == first
    rollup.commit("b", revisions(english, "words1", "words2"))
    assert ("s", "en", "words2", 2, 5) in totals(rollup) and not any(r[2] == "words1" and r[1] == "en" for r in totals(rollup))
    rollup.commit("c", deletes(english, "words2"))
    assert not any(r[1] == "en" for r in totals(rollup))
    assert rollup.commit("empty", inserts(rows.limit(0), "words1"))


def test_a_broken_batch_does_not_count_and_is_written_anew(spark, docs):
    rollup = Rollup(spark, scratch(spark, "test-rollup"))
    rows = counted(docs)
    inserts(rows, "words1").write.parquet(f"{rollup.folder}/batch=a")
    mark = rollup._path(f"{rollup.folder}/batch=a/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)  # as if the job had died
    assert rollup.totals().collect() == []
    assert rollup.commit("a", inserts(rows, "words1"))
    assert sum(r[3] for r in totals(rollup)) == 5


def test_no_documents(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert rolled(docs.limit(0), labels, scratch(spark, "test-rollup")).collect() == []
    left = rolled(docs, labels, scratch(spark, "test-rollup")).collect()
    assert ("s", "en", "words2", 1, 2) in {tuple(r) for r in left}
