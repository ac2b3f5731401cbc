"""The SQL of the operators that have one, on small tables with empty, blank, null and repeated texts."""

import duckdb
import pytest

from tidegate.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tmp_path, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [
        (10_000, "", "en", "s", 0), (10_001, None, None, None, None), (10_002, " \n\t", "en", None, 3), (10_003, "a b", "en", "s", 3),
        (10_004, "A  b", None, "s", 4), (10_005, "é " * 200, "fr", "s", 400)
    ]
    docs.unionByName(
        spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int").select(*docs.columns)
    ).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = [(9_000_000, None, None), (9_000_001, "u\n", "é" * 5000), (9_000_002, "v", ""), *((9_100_000 + i, "w", f"<p>{i}</p>") for i in range(300))]
    pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    one = vectors.first().embedding
    odd = [(None, one), (-1, one), (-1, one), (-2, one[:63]), (-3, [*one, 1.0]), (-4, [*one[1:], None]), (-5, [*one[1:], float("nan")]),
           (-6, [*one[1:], float("inf")]), (-7, [*one[1:], 1e30]), (-8, None), (-9, []), (-10, [300.5] * 64), (-11, [-0.001] * 64)]
    vectors.unionByName(spark.createDataFrame(odd, vectors.schema)).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    plain = lambda rows: sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=str)
    assert sorted(names) == sorted(got.columns)
    assert plain(tuple(r[c] for c in names) for r in got.collect()) == plain(want.fetchall())
