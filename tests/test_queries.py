import duckdb
import pytest
from pyspark.sql import functions as F

from folio import queries
from folio.functions import text as T

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_vectors(spark):
    assert one(spark, ["100 KB", "2.5 mb", "7", "1B", " 1 GB ", "0.5 B", "0", "-1", ".5", "1.", "1,000", "1 TB", ""], T.parse_size) == [102400, 2621440, 7168, 1, 1073741824] + [None] * 8
    assert one(spark, ["media/a.png", "/word/media/a.png", "../media/a.png", "a.png"], T.media_path) == ["word/media/a.png"] * 4
    assert one(spark, ["a  b\tc   ", "a b", "  a", ""], T.split_cells) == [["a", "b", "c"], ["a b"], ["a"], []]
    assert one(spark, ["a&<b>\"'", "\x01\t", "&amp;"], T.escape_xml) == ["a&amp;&lt;b&gt;&quot;&apos;", "\t", "&amp;amp;"]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1048575,), (1048576,), (1073741824,)], "v long")
    assert [r[0] for r in sizes.select(T.format_size(F.col("v"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1024.0 KB", "1.0 MB", "1.00 GB"]
