import json

import pytest
from pyspark.sql import functions as F

from ratebook.operators import metrics as M
from ratebook.operators import relational as R
from ratebook.operators.staging import shared_folder, stage
from ratebook.sources import tables as T


def test_csv_round_trip_and_missing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, None, None)], "id long, s string, v double")
    T.write_csv(df, str(tmp_path / "t"))
    back = T.read_feed(spark, str(tmp_path / "t"), df.schema, {"id": "bigint", "extra": "double"})
    assert back.dtypes == [("id", "bigint"), ("s", "string"), ("v", "double"), ("extra", "double")]
    assert sorted(map(tuple, back.drop("extra").collect())) == sorted(map(tuple, df.collect()))


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,x,a\n1,q,10\n,r,z\n")
    got = T.read_csv(spark, str(tmp_path / "t.csv"), "a long, b long, c double")
    assert got.dtypes == [("a", "bigint"), ("b", "bigint"), ("c", "double")]
    assert sorted(map(tuple, got.collect()), key=str) == [(10, 1, None), (None, None, None)]
    snap = T.newest_snapshot(spark, str(tmp_path / "*.csv"), "b long, a long", "csv")
    assert sorted(map(tuple, snap.collect()), key=str) == [(1, 10), (None, None)]


def test_missing_input_is_an_empty_table(spark, tmp_path):
    df = T.read_or_empty(spark, str(tmp_path / "none"), "id long, v double")
    assert df.columns == ["id", "v"] and df.count() == 0


def test_newest_snapshot(spark, tmp_path):
    for year in (2019, 2025, 2021):
        spark.range(3).withColumn("y", F.lit(year)).toPandas().to_parquet(tmp_path / f"d_{year}.parquet")
    pattern = str(tmp_path / "d_*.parquet")
    assert {r["y"] for r in T.newest_snapshot(spark, pattern).collect()} == {2025}
    best = T.preferred_or_newest(spark, str(tmp_path / "d_2019.parquet"), pattern)
    assert {r["y"] for r in best.collect()} == {2019}
    rest = T.preferred_or_newest(spark, str(tmp_path / "no.parquet"), pattern)
    assert {r["y"] for r in rest.collect()} == {2025}


def test_fact_is_pruned_by_partition(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "2020 + id % 3 AS season", "CAST(1 + 10 * (id % 2) AS INT) AS level_id", "'R' AS game_type")
    T.write_fact(df, str(tmp_path / "fact"))
    back = T.regular_season(spark.read.parquet(str(tmp_path / "fact")), 2021, 2022, [1])
    assert back.count() == df.filter("season >= 2021 AND level_id = 1").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "PushedFilters: [IsNotNull(game_type)" in plan


def test_publish_and_sample(spark, tmp_path):
    df = spark.range(10).toDF("id")
    T.publish({"all": df, "some": T.sample_rows(df, 3), "same": T.sample_rows(df, -1)}, str(tmp_path))
    sizes = {n: spark.read.parquet(str(tmp_path / n)).count() for n in ("all", "some", "same")}
    assert sizes == {"all": 10, "some": 3, "same": 10}


def test_stage_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id % 7 AS k", "id AS v").groupBy("k").agg(F.sum("v").alias("s"))
    written = stage(df)
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert "Aggregate" not in written._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(written.collect()) == sorted(df.collect())


def test_spec_files(spark, tmp_path):
    spec = {"stats": {"hitters": [
        {"name": "r", "kind": "rate", "numerator": "hit", "denominator": "pitches"},
        {"name": "q", "kind": "quantile", "value": "v", "quantile": 0.25, "sample_n": "swings"},
        {"name": "d", "kind": "derived", "depends_on": ["r", "q"]},
    ]}}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    loaded = M.load_specs(tmp_path / "s.json")["hitters"]
    assert [m.kind for m in loaded] == ["rate", "quantile", "derived"]
    assert loaded[0].den == "*" and loaded[1].where == "swing" and loaded[2].expr == "r - q"
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yml").write_text(yaml.safe_dump(spec))
    assert M.load_specs(tmp_path / "s.yml")["hitters"] == loaded
    with pytest.raises(ValueError):
        M.metric_from_spec({"name": "x", "kind": "mode", "value": "v"})


def test_require_unique_fails_on_repeats(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate key"):
        R.merge_frames(df.select("k").distinct(), [df], ["k"]).collect()
    with pytest.raises(ValueError, match="missing join keys"):
        R.require_unique(df, ["z"])
