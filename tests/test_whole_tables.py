"""The catalog's queries of merged deliveries hold every row of their tables."""

from pyspark.sql import functions as F

from panelforge import catalog

SF = "/root/testdata/sf0.01"


def test_every_row_is_in_the_job(spark):
    q = catalog.queries()
    events, customer = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("events", "customer"))
    hours = events.select("event_type", F.date_trunc("hour", "ts")).distinct().count()
    assert q["bars_upsert_all"](spark, SF).count() == hours
    found = q["constituent_merge_all"](spark, SF)
    assert found.select("ticker").distinct().count() == customer.select("c_name").distinct().count()
    assert {r.found for r in found.select("found").distinct().collect()} == {"both", "weights", "sectors"}
    assert q["sector_map_all"](spark, SF).count() == customer.select("c_nationkey").distinct().count()
