"""Queries whose tasks take small shares of the table."""

from jobtide.plans import queries

SF = "/root/testdata/sf0.001"


def test_routed_results_are_worked_on_in_small_shares_with_the_callers_settings(spark):
    before = dict(spark.conf.getAll)
    shared, plain = (f(spark, SF) for f in (queries.QUERIES["route_deltas"], queries.QUERIES["route_deltas"].__wrapped__))
    conf = shared.sparkSession.conf
    assert int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= queries.SHARES
    assert conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == queries.SHARE_SIZE
    assert conf.get("spark.sql.files.maxPartitionBytes") == queries.SPLIT_SIZE
    assert conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert sorted(map(repr, shared.collect())) == sorted(map(repr, plain.collect()))
    assert dict(spark.conf.getAll) == before
