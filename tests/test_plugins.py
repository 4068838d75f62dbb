"""Extension points: the listing source, notification targets, plans that push down."""

from __future__ import annotations

import contextlib
import io

import quern.catalog  # noqa: F401
from quern import tables
from quern.plugins import ListingSource
from quern.registry import QUERIES
from quern.sources.listing import list_objects
from quern.streaming.events import notify


class Shelf:
    def parts(self, prefix):
        return [prefix + "a", prefix + "b"]

    def entries(self, part):
        yield part + "/1", 10
        yield part + "/2", 20


def test_listing_source(spark):
    spark.dataSource.register(ListingSource)
    df = spark.read.format("quern_listing").option("backend", "tests.test_plugins:Shelf").option("prefix", "p/").load()
    assert sorted(tuple(r) for r in df.collect()) == [("p/a/1", 10), ("p/a/2", 20), ("p/b/1", 10), ("p/b/2", 20)]


def test_notify(spark):
    got = {}
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "dest string, n int")
    notify({d: lambda df, n, d=d: got.update({d: sorted(r["n"] for r in df.collect())}) for d in ("x", "y", "z")})(rows, 0)
    assert got == {"x": [1, 3], "y": [2], "z": []}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["metadata_range"](spark, sf_dir))
    assert "StringStartsWith(p_type,S)" in text and "p_retailprice" not in text
    assert "o_totalprice" not in plan(QUERIES["field_read"](spark, sf_dir))
    o = tables.load(spark, sf_dir, "part").selectExpr("p_name as key", "p_size as size")
    assert "StringStartsWith(p_name,a)" in plan(list_objects(o, "a"))


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["k_cheapest"](spark, sf_dir))


def test_no_query_has_a_cartesian_product(spark, sf_dir):
    for name in ("event_fanout", "file_chunk_range_join", "version_asof", "cost_matrix", "sequential_runs"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, sf_dir)), name
