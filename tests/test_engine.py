"""The facade over the relations of the test tables."""

import pytest

from lakestat.engine import Engine
from lakestat.plans import model, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    m = [f(spark, DATA) for f in (model.bodies, model.observations, model.analyses, model.alerts, model.history, model.scenes)]
    return Engine(spark, *m)


def test_answers_for_one_body(engine, spark):
    assert engine.health()["status"] == "ok"
    body = engine.observations.first().water_body_id
    one, all_of_them = engine.trend(body).collect(), engine.trend().collect()
    assert len(one) == 1 and one[0] in all_of_them
    assert engine.timeline(body).count() == one[0].observations == engine.list_observations(body).count()
    assert engine.latest_analysis().count() == engine.analyses.select("observation_id").distinct().count()
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey" in engine.trend(body)._jdf.queryExecution().toString()
    assert engine.counts().first().observations == engine.observations.count()
    assert engine.new_alerts().count() <= engine.scored_records().count() == engine.records.count()
    assert engine.nearby(75.5, 18.0, 500.0).count() >= engine.nearby(75.5, 18.0, 80.0).count()
    assert engine.choose_scenes(model.targets(spark, DATA)).count() > 0


def test_every_query_has_a_docstring_or_sql():
    assert set(registry.QUERIES) >= set(registry.ORACLE_SQL)
    assert [n for n, f in registry.QUERIES.items() if n not in registry.ORACLE_SQL and not f.__doc__] == []
