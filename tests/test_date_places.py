import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import catalog
from quillmill.plans import reference


@pytest.mark.parametrize("descending", [True, False])
def test_places_like_a_loop(spark, descending):
    r = random.Random(3)
    rows = [(i, None if i % 3 else r.randrange(40)) for i in range(500)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges even of few rows
    try:
        got = catalog.date_places(spark.createDataFrame(rows, "id long, d long").repartition(5), "d", "id", descending).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda x: (x[1] is None, (-x[1] if descending else x[1]) if x[1] is not None else 0, x[0]))
    assert [(x["place"], x["id"], x["d"]) for x in got] == [(n, *x) for n, x in enumerate(want, 1)]


def test_every_live_paper_has_a_place(spark):
    d = "/root/testdata/sf0.01"
    live = catalog.live(spark.read.parquet(f"{d}/papers.parquet"))
    got = reference.papers_sorted_nulls_last(spark, d)
    assert sorted(x["place"] for x in got.collect()) == list(range(1, live.count() + 1))
    dated = live.filter("published_at IS NOT NULL").count()
    assert got.filter(F.col("published_at").isNull()).agg(F.min("place")).first()[0] == dated + 1
