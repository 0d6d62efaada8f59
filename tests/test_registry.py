import math

import pytest

from selvage.plans import registry, rules, sheets  # noqa: F401 (rules and sheets register their queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}"
        return str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, small, oracle, name):
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = oracle.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert plain(got.select(columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, small, name):
    registry.QUERIES[name](spark, small).collect()


def test_nearest_segment_against_all(spark, small):
    from pyspark.sql import functions as F

    from selvage.functions import geometry as G
    from selvage.operators import sheet as S

    rows = S.segments(registry.subpaths(spark, small)).cache()
    taps = spark.createDataFrame([(i, i % 25, i * 37.0 % 400, i * 53.0 % 500, 60.0) for i in range(40)], "tap int, doc long, x double, y double, tolerance double")
    brute = taps.join(rows, "doc").withColumn("d", G.point_segment_distance(F.array("x", "y"), F.col("a"), F.col("b"))).where("d <= tolerance").groupBy("tap").agg(F.min("d").alias("d"))
    want = {r["tap"]: round(r["d"], 9) for r in brute.collect()}
    assert {r["tap"]: round(r["distance"], 9) for r in S.nearest_segment(taps, rows).collect()} == want


def test_matches_of_shifted_pages(spark):
    from selvage.operators import sheet as S

    shapes = [[[400.0, 10.0], [430.0, 12.0], [435.0, 40.0]], [[410.0, 200.0], [440.0, 260.0]], [[420.0, 300.0], [450.0, 390.0], [455.0, 399.0]]]
    rows = [("d", 1, k, 0, s, False, "s") for k, s in enumerate(shapes)] + [("d", 2, k, 0, [[x - 380.0, y] for x, y in s], False, "s") for k, s in enumerate(shapes)]
    got = S.page_matches(spark.createDataFrame(rows, "doc string, page int, path int, sub int, points array<array<double>>, closed boolean, style string")).collect()
    assert [(r["a"], r["b"], r["dx"], r["dy"], r["votes"]) for r in got] == [(1, 2, 380.0, 0.0, 3)]


def test_scale_of_labelled_square(spark):
    from selvage.operators import sheet as S

    side = 5 * 72 / 2.54
    square = [[100.0, 100.0], [100.0 + side, 100.0], [100.0 + side, 100.0 + side], [100.0, 100.0 + side]]
    sub = spark.createDataFrame([("d", 1, 0, 0, square, True, "s"), ("d", 1, 1, 0, [[0.0, 0.0], [9.0, 9.0]], False, "s")], "doc string, page int, path int, sub int, points array<array<double>>, closed boolean, style string")
    texts = spark.createDataFrame([("d", 1, "Test 5 cm", 120.0, 120.0, 8.0)], "doc string, page int, str string, x double, y double, height double")
    pages = spark.createDataFrame([("d", 1), ("e", 1)], "doc string, page int")
    found = S.square_candidates(sub, texts)
    scale = {r["doc"]: r for r in S.detect_scale(pages, found).collect()}
    assert scale["d"]["cm_per_pt"] == pytest.approx(2.54 / 72) and scale["d"]["source"] == "square" and scale["e"]["source"] == "default"
    assert S.without_scale_marks(sub, found, S.detect_scale(pages, found)).count() == 1


def test_progress_stream(spark, tmp_path):
    """Events arriving as files fold to the newest state of each marker."""
    from selvage.streaming import progress as R

    rows = [("r", "m", 0, "progress", 30.0, 1, 1, None), ("r", "m", 1, "progress", 20.0, 0, 2, None), ("r", "m", 2, "result", 20.0, 0, 9, None), ("s", "m", 0, "error", None, None, None, "x")]
    spark.createDataFrame(rows, R.EVENT).write.parquet(str(tmp_path / "in"))
    stream = R.latest(spark.readStream.schema(R.EVENT).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest_progress").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("latest_progress").collect()
    assert [(r["run_id"], r["kind"], r["iterations"]) for r in got] == [("r", "result", 9)]


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
