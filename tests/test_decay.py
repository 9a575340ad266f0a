"""Carried exponential sums against sums over all pairs."""

import math
import random

import pytest

from conftest import at, event, utc_ms
from glycoflow.operators.decay import decaying_sums
from glycoflow.plans import dose

TERMS = "subject_id long, tau_no int, from_ms long, to_ms long, weight double"


def pairs(terms, instants, taus):
    out = {}
    for subject, t in instants:
        sums = [0.0] * len(taus)
        for s, no, a, b, w in terms:
            if s == subject and w is not None and a <= t < b:
                sums[no] += w * math.exp(-(t - a) / 60000 / taus[no])
        out[subject, t] = sums
    return out


@pytest.mark.parametrize("block_ms", [3_600_000, 60_000, 86_400_000])
def test_sums_as_of_all_pairs(spark, block_ms):
    rng = random.Random(block_ms)
    taus = [77.0, 10.5, 420.0]
    hour = 3_600_000
    terms = []
    for _ in range(300):
        a = rng.choice([rng.randrange(-5 * hour, 5 * hour), rng.randrange(-5, 5) * hour, rng.randrange(-300, 300) * 60_000])
        b = a + rng.choice([0, 1, hour, 5 * hour, rng.randrange(1, 9 * hour)])
        terms.append((rng.randint(1, 3), rng.randint(0, 2), a, b, rng.choice([1.0, 2.5, -1.0, None, rng.random()])))
    instants = {(rng.randint(1, 4), rng.choice([t[2], t[3], t[2] - 1, t[3] - 1, rng.randrange(-6 * hour, 14 * hour)])) for t in terms}
    got = decaying_sums(spark.createDataFrame(terms, TERMS), spark.createDataFrame(sorted(instants), "subject_id long, at_ms long"), taus, block_ms=block_ms)
    rows = {(r.subject_id, r.at_ms): [r.sum_0, r.sum_1, r.sum_2] for r in got.collect()}
    want = pairs(terms, instants, taus)
    assert rows.keys() == want.keys()
    for key, sums in want.items():
        assert rows[key] == pytest.approx(sums, abs=1e-9)


def test_nothing_acts_and_nothing_is_asked(spark):
    none = spark.createDataFrame([], TERMS)
    asked = spark.createDataFrame([(1, 5)], "subject_id long, at_ms long")
    assert [tuple(r) for r in decaying_sums(none, asked, [10.0]).collect()] == [(1, 5, 0.0)]
    some = spark.createDataFrame([(1, 0, 0, 10, 1.0)], TERMS)
    assert decaying_sums(some, asked.limit(0), [10.0]).count() == 0


INSULIN = {"bolus": (15, 240, 55), "basal": (90, 1440, 300)}


def emitted(df):
    """Rows that the joins and explodes of an executed plan have made."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name:
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("doses", [400, 4000])
def test_requests_cost_the_same_at_any_density_of_doses(spark, make_log, doses):
    rng = random.Random(doses)
    rows = [event(f"d{i}", at(0, -rng.randrange(120_000_000)), "insulin", 1.0, type=rng.choice(["bolus", "basal"])) for i in range(doses)]
    log = make_log(rows)
    asked = [(i, 1, at(-50 * i), 30.0, 6.0) for i in range(40)]
    requests = spark.createDataFrame(asked, "request_id long, subject_id long, as_of timestamp, carbs double, current_bsl double")
    out = dose.state_at(log, requests)
    # Two joins bring the state back to the requests or meet drinks and rising meals; none emits a row per dose.
    assert emitted(out) <= 3 * len(asked)
    got = {r.request_id: r.iob for r in out.collect()}
    for i, _, moment, _, _ in asked:
        want = 0.0
        for _, _, ts, _, value, meta, *_ in rows:
            m = (utc_ms(moment) - utc_ms(ts)) / 60000
            onset, duration, half = INSULIN[meta[0]]
            if 0 <= m < duration:
                a, b = half * 1.4, onset * 0.7
                want += value * (a * math.exp(-m / a) - b * math.exp(-m / b)) / (a - b)
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9)
