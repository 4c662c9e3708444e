"""Scenarios against a plain Python model of the same rules."""

import random

import pytest

from tallyloom.operators import insights, scenario
from tallyloom.operators.scenario import Assumptions

SETS = [
    Assumptions(), Assumptions(0, 0, 0, 0, 0, "zero"), Assumptions(100, 100, 100, 100, 100, "all"),
    Assumptions(33, 67, 25, 40, 10, "odd"), Assumptions(1, 1, 1, 1, 1, "one"),
    Assumptions(100, 100, 50, 50, 100, "half"), Assumptions(40, 40, 40, 40, 40, "forty"),
]


def model(rows, a):
    part = lambda n, percent: max(0, min(n, round(n * (percent / 100.0))))
    sentiment = lambda r: {1: "neg", 2: "neg", 3: "neu", 4: "pos", 5: "pos"}.get(int(r), "?") if r is not None else "?"
    n = len(rows)
    neg = [r for r, _ in rows if sentiment(r) == "neg"]
    neu = [r for r, _ in rows if sentiment(r) == "neu"]
    no, yes = sum(f == 0 for _, f in rows), sum(f == 1 for _, f in rows)
    recommended = n - no if 0 < no + yes < n else yes
    reached = part(len(neg), a.negative_reached)
    improved = part(reached, a.intervention_success)
    up = part(improved, a.success_to_positive)
    lifted = part(len(neu), a.neutral_to_positive)
    total = sum(r for r, _ in rows if r is not None)
    total += sum(4 - r for r in neg[:up]) + sum(3 - r for r in neg[up:improved]) + sum(4 - r for r in neu[:lifted])
    advocates = part(no, a.advocacy_conversion)
    return dict(
        n=n, neg=len(neg), neu=len(neu), pos=n - len(neg) - len(neu), recommended=recommended, not_recommended=no,
        reached_neg=reached, successful_neg=improved, neg_to_pos=up, neg_to_neu=improved - up, neu_to_pos=lifted,
        advocacy_conversions=advocates, sim_recommended=recommended + advocates, sim_not_recommended=no - advocates,
        sim_neg=len(neg) - improved, sim_rating_sum=total, sim_avg_rating=total / n if n else 0,
    )


def random_rows(seed, count=90):
    rng = random.Random(seed)
    ids = rng.sample(range(5 * count), count)
    return [
        dict(
            row_id=i, rating=rng.choice([1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 7.0, None]),
            recommended_ind=rng.choice([0.0, 1.0, 2.0, None]), department_name=rng.choice("ABC"),
        )
        for i in ids
    ]


def check(found, expected):
    for name, value in expected.items():
        assert found[name] == pytest.approx(value, abs=1e-9), name
    assert found.sim_neg + found.sim_neu + found.sim_pos == found.n
    if found.recommended + found.not_recommended == found.n:
        assert found.sim_recommended + found.sim_not_recommended == found.n


@pytest.mark.parametrize("ways", [2, 3, 16])
def test_overall_scenarios(clean, ways):
    rows = random_rows(1)
    ordered = [(r["rating"], r["recommended_ind"]) for r in sorted(rows, key=lambda r: r["row_id"])]
    found = {r.scenario: r for r in scenario.run_simulation(clean(*rows), SETS, ways=ways).collect()}
    assert len(found) == len(SETS)
    for a in SETS:
        check(found[a.name], model(ordered, a))


@pytest.mark.parametrize("ways", [2, 16])
def test_scenarios_per_department(clean, ways):
    rows = random_rows(2)
    found = scenario.run_simulation(clean(*rows), SETS, by="department_name", ways=ways).collect()
    assert len(found) == 3 * len(SETS)
    for r in found:
        mine = sorted((x for x in rows if x["department_name"] == r.department_name), key=lambda x: x["row_id"])
        a = next(a for a in SETS if a.name == r.scenario)
        check(r, model([(x["rating"], x["recommended_ind"]) for x in mine], a))


@pytest.mark.parametrize(
    "rows",
    [
        [dict(rating=5.0), dict(rating=3.0)], [dict(rating=1.0), dict(rating=5.0)], [dict(rating=1.0)],
        [dict(rating=None, recommended_ind=None)],
    ],
)
def test_degenerate_scopes(clean, rows):
    (found,) = scenario.finite_kpis(scenario.run_simulation(clean(*rows), SETS[2])).collect()
    full = [({"rating": 5.0, "recommended_ind": 1.0} | r) for r in rows]
    check(found, model([(r["rating"], r["recommended_ind"]) for r in full], SETS[2]))
    assert found.finite


def test_empty_scope_is_all_zero(clean):
    empty = clean({}).limit(0)
    result = scenario.run_simulation(empty, SETS[:2])
    for r in result.collect():
        assert set(r.asDict().values()) == {0, r.scenario}
    assert scenario.sentiment_comparison(result).count() == 0
    assert scenario.department_simulation(empty).count() == 0
    one = scenario.run_simulation(empty)
    (row,) = insights.scenario_insights(one, scenario.department_simulation(empty)).collect()
    assert row.insight == "No reviews in scope"


def test_departments_are_ranked_and_small_ones_count_in_the_overall_rate(clean):
    table = clean(
        *[dict(department_name="Large", rating=5.0)] * 8, *[dict(department_name="Large", rating=1.0)] * 2,
        *[dict(department_name="Poor", rating=1.0)] * 4, dict(department_name="Tiny", rating=1.0),
    )
    found = scenario.department_simulation(table, Assumptions(0, 0, 0, 0, 0), min_reviews=2).collect()
    assert [(r.department, r.priority) for r in found] == [("Poor", "High"), ("Large", "Medium")]
    assert found[0].share == pytest.approx(400 / 15)
    impact = scenario.department_impact(table, Assumptions(100, 100, 0, 0, 0), min_reviews=2).collect()
    assert [(r.department, r.negative_reduction) for r in impact] == [("Poor", 4), ("Large", 2)]


def test_long_tables(clean):
    result = scenario.run_simulation(clean(dict(rating=1.0), dict(rating=3.0), dict(rating=5.0)), SETS[2])
    comparison = scenario.sentiment_comparison(result).collect()
    assert [(r.sentiment, r.series, r.reviews) for r in comparison][:2] == [
        ("Negative", "Dataset Baseline", 1), ("Negative", "Simulated Scenario", 0),
    ]
    changes = {r.metric: r for r in scenario.kpi_change(result).collect()}
    assert changes["Average Rating"].direction == "improved" and changes["Neutral Rate"].direction == "improved"
    assert changes["Recommendation Rate"].direction == "unchanged"
    assert scenario.kpi_improvement(result).count() == 4
    assert [r.reviews for r in scenario.movement_steps(result).collect()] == [1, 0, 1, 1]


def test_scenarios_of_one_name_stay_apart(clean):
    table = clean(*random_rows(3))
    ordered = [(r["rating"], r["recommended_ind"]) for r in sorted(random_rows(3), key=lambda r: r["row_id"])]
    pair = [Assumptions(negative_reached=50), Assumptions(negative_reached=100)]
    found = sorted(scenario.run_simulation(table, pair).collect(), key=lambda r: r.reached_neg)
    assert len(found) == 2
    for row, a in zip(found, pair):
        check(row, model(ordered, a))
    assert scenario.department_simulation(table, pair).count() == 6


def test_null_and_oddly_named_segments(clean):
    rows = [r | {"clothing_id": float(i % 3) if i % 4 else None} for i, r in enumerate(random_rows(4))]
    table = clean(*rows).withColumnRenamed("clothing_id", "Shop `x` name")
    found = scenario.run_simulation(table, SETS[2], by="Shop `x` name").collect()
    assert len(found) == 4
    for r in found:
        mine = sorted((x for x in rows if x["clothing_id"] == r["Shop `x` name"]), key=lambda x: x["row_id"])
        check(r, model([(x["rating"], x["recommended_ind"]) for x in mine], SETS[2]))


def test_ledger_is_bounded_whatever_the_ids(clean):
    rng = random.Random(6)
    rows = [r | {"row_id": rng.getrandbits(62)} for r in random_rows(5)]
    table = clean(*rows)
    ordered = [(r["rating"], r["recommended_ind"]) for r in sorted(rows, key=lambda r: r["row_id"])]
    (found,) = scenario.run_simulation(table, SETS[2], ways=2).collect()
    check(found, model(ordered, SETS[2]))
    ranged = scenario._bucketed(table, scenario._cut_points(table, 2), 2)
    assert ranged.filter("bucket IS NOT NULL").select("bucket").distinct().count() <= 8
