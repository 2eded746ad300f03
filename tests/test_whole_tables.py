"""Queries that group, pair or gate all rows leave out none."""

from millrace.plans.catalog import QUERIES
from millrace.sources.tables import batches, records

DATA = "/root/testdata/sf0.001"


def test_no_row_is_left_out(spark):
    rows = lambda name: QUERIES[name](spark, DATA).collect()
    count = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").count()
    assert sum(len(r.vs.split(",")) for r in rows("q03_group_then_sort")) == count("lineitem")
    assert len(rows("q14_partitioned_product")) == count("region") * count("nation") * count("supplier")
    assert len(rows("op64_plain_read")) == sum(len(r.sizes.split(",")) for r in rows("op68_ordered_grouped")) == records(spark, DATA).count()
    assert sum(r.n for r in rows("op73_input_gate")) == batches(spark, DATA).count()
