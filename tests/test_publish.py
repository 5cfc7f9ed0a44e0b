"""The ten-table runs of both inputs, end to end."""

from checks.queries import feed, pitch
from ratebook.plans import feed as FEED
from ratebook.plans import products as PR
from ratebook.sources.tables import publish

from .conftest import SF


def test_full_fact_tables(spark, tmp_path):
    tables = PR.all_tables(pitch(spark, SF))
    publish(tables, str(tmp_path))
    read = {n: spark.read.parquet(str(tmp_path / n)) for n in tables}
    assert len(read) == 10
    assert read["hitters"].count() == read["hitter_pctiles"].count() > 0
    grades = read["pitch_types"].filter("stuff IS NOT NULL")
    assert grades.filter("stuff NOT BETWEEN 20 AND 80").count() == 0
    direct = PR.hitters(pitch(spark, SF)).select("batter_mlbid", "season", "level_id", "chase", "EV90th", "PA")
    rolled = read["hitters"].select(*direct.columns)
    assert sorted(map(str, direct.collect())) == sorted(map(str, rolled.collect()))


def test_feed_tables(spark, tmp_path):
    tables = FEED.feed_outputs(feed(spark, SF))
    publish(tables, str(tmp_path), "csv")
    assert len(tables) == 10
    for name, df in tables.items():
        back = spark.read.option("header", True).csv(str(tmp_path / name))
        assert back.count() == df.count() > 0
