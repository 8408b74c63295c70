"""Tables that are published together."""

import pytest
from pyspark.sql import functions as F

from lakestat.sources.publishing import contents, publish, published, versions


def test_all_tables_or_none(spark, tmp_path):
    root = str(tmp_path / "state")
    assert versions(spark, root) == [] and contents(spark, root) == {}
    make = lambda n: spark.range(n).withColumn("v", F.col("id") * n)
    rows = lambda name, v=None: published(spark, root, name, v).count()
    assert publish(spark, root, {"observations": make(3), "analyses": make(4), "alerts": make(0)}) == 1
    assert (rows("observations"), rows("analyses"), rows("alerts")) == (3, 4, 0)
    failing = make(5).withColumn("v", F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        publish(spark, root, {"observations": make(9), "analyses": failing, "alerts": make(9)})
    assert versions(spark, root) == [1] and (rows("observations"), rows("analyses"), rows("alerts")) == (3, 4, 0)
    held = published(spark, root, "observations")
    grown = held.unionByName(spark.range(3, 5).withColumn("v", F.lit(0).cast("long")))
    assert publish(spark, root, {"observations": grown, "alerts": make(2)}) == 2
    assert held.count() == 3 and (rows("observations"), rows("analyses"), rows("alerts")) == (5, 4, 2)
    assert (rows("observations", 1), rows("alerts", 1)) == (3, 0)


def test_a_publication_from_an_old_state_is_refused(spark, tmp_path):
    root = str(tmp_path / "state")
    publish(spark, root, {"a": spark.range(1)})
    publish(spark, root, {"a": spark.range(2)}, base=1)
    with pytest.raises(RuntimeError, match="publication 2"):
        publish(spark, root, {"a": spark.range(7)}, base=1)
    assert published(spark, root, "a").count() == 2 and versions(spark, root) == [1, 2]
    with pytest.raises(ValueError, match="no publication 9"):
        contents(spark, root, 9)
