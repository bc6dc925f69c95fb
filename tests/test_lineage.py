import os

from corpusmill.functions import lineage


def test_cut_tables_are_read_back_and_released(spark):
    df = spark.createDataFrame([(1, "a", [1.5]), (2, None, None)], "k long, t string, v array<double>")
    before = lineage.written()
    got = lineage.cut(df.repartition(3))
    assert got.schema == df.schema and sorted(r["k"] for r in got.collect()) == [1, 2]
    assert lineage.cut(df.limit(0)).count() == 0
    paths = lineage._WRITTEN[before:]
    assert all(os.path.isdir(p) for p in paths)
    lineage.release(spark, before + 1)
    assert [os.path.isdir(p) for p in paths] == [True, False]
    lineage.release(spark, before)
    assert not any(os.path.isdir(p) for p in paths)
