"""The collapse for occupancy counts every line item, of all sites."""

from channelweave.plans import catalogue


def test_all_sites_are_counted(spark, sf_dir):
    got = catalogue.QUERIES["collapse_occupancy"](spark, sf_dir).collect()
    assert sum(r.n for r in got) == catalogue.levels(spark, sf_dir).count() and min(r.n for r in got) >= 20
