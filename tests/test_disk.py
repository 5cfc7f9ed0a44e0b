"""What is written for the full fact: narrow rows."""

from __future__ import annotations

import datetime

import pytest

from pyspark.sql import functions as F

from checks import fixtures
from checks.queries import pitch


@pytest.fixture
def tables(spark, tmp_path):
    """Small given tables with NULLs and repeated keys."""
    day = datetime.date(1995, 1, 1)
    lines = [
        (
            i % 9, None if i % 7 == 0 else i % 45, i % 4, i % 7, None if i % 11 == 0 else float(i % 50 + 1),
            None if i % 13 == 0 else 900.0 + 7.31 * i, None if i % 17 == 0 else (i % 11) / 100,
            (i % 9) / 100, "RAN"[i % 3], "FO"[i % 2], day + datetime.timedelta(days=29 * i),
        )
        for i in range(200)
    ]
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                     "l_linestatus string, l_shipdate date"),
        "supplier": ([(k, f"S{k}") for k in (0, 1, 2, 2)], "s_suppkey long, s_name string"),
        "orders": ([(k, None if k == 3 else k * 5, "F") for k in range(8)], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "part": ([(k, k % 50, f"B{k}", "T") for k in range(40)], "p_partkey long, p_size int, p_brand string, p_type string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_written_fact_is_narrow(spark, tables):
    """Features are projected from the written rows, not written with them."""
    fact = pitch(spark, tables)
    written = set(spark.read.parquet(*fact.inputFiles()).columns)
    assert {"price", "primary_velo", "avg_ext"} <= written
    assert not written & {"vbreak", "pa_id", "pitch_tag", "exit_velo"}
    assert {"vbreak", "pa_id", "pitch_tag", "exit_velo", "primary_velo", "loc_adj_vaa"} <= set(fact.columns)


def test_clustered_rows_are_the_same(spark, tables):
    """Rows dealt by supplier, the supplier joined last, are those of the SQL; each lies in few files."""
    for text in (fixtures.OBS, fixtures._BASE):
        plain = fixtures._run(spark, tables, text)
        dealt = fixtures._run(spark, tables, text, clustered=True)
        assert plain.columns == dealt.columns and plain.count() > 0
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, dealt.collect()))


def test_supplier_states_are_complete_before_their_exchange(spark, tables):
    """A supplier's rows lie in one written file, so map-side states are one row a key."""
    rows = fixtures.obs(spark, tables, clustered=True)
    places = rows.select("entity_id", F.input_file_name().alias("file")).distinct().collect()
    assert len(places) == len({p.entity_id for p in places}) > 1
