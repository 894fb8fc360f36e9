"""The catalog's queries against their SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from terrafold.plans import catalog

DATA = "/root/testdata/sf0.001"
NAMES = ["way_nodes", "members", "parents_ways", "parents_relations", "nodes_of_set", "members_of_set", "parents_of_set", "connected_to", "predicate_filter", "feature_string",
         "coarse_shared_location", "orphans", "containing_line", "geojson_way", "geojson_relation", "csv_rows"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, db, name):
    got = catalog.queries()[name](spark, DATA)
    want = db.execute(catalog.oracle_sql()[name]).to_arrow_table().select(got.columns)
    assert Counter(tuple(r) for r in got.collect()) == Counter(zip(*want.to_pydict().values(), strict=True))
