from factsieve.operators.insights import group_gap, trend
from factsieve.plans.facts import Facts


def test_findings_look_at_all_columns_or_at_the_leading_ones(spark):
    numbers = [f"cast((id * {7 + 2 * i}) % 11 as double) + 0.5 as n{i}" for i in range(4)]
    df = spark.range(60).selectExpr(*numbers, "if(id < 30, 'a', 'b') as kind", "if(id < 30, 10.5, 90.25) + id % 3 as last",
                                    "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) as at")
    facts = Facts(df).warm()
    assert [r["columns"] for r in group_gap(facts).collect()] == ["last,kind"]
    assert [r["columns"] for r in trend(facts).collect()][:1] == ["at,last"]
    assert group_gap(facts, numbers=3).count() == 0 and group_gap(facts, groups=0).count() == 0
    assert trend(facts, numbers=3).count() == 0
