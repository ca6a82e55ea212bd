"""Where a local fill stops: the first failure to authenticate, or the first wait that is too long."""

import random

import pytest

from lectern.operators import ledger

STEP = "_key struct<place:long>, done boolean, auth boolean, requests long, seconds long"


def walked(rows, secs, requests):
    """The rule as a walk in order."""
    done = failed = spent = since = 0
    for place, ok, auth, r, s in rows:
        spent, since = spent + r, since + s
        done, failed = done + ok, failed + (not ok)
        if auth:
            return place, "auth"
        if ok:
            spent = since = 0
        elif spent >= requests and since >= secs:
            return place, "stall", done, failed, spent, since
    return None


@pytest.mark.parametrize("seed", range(4))
def test_the_stop_is_that_of_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.random() < 0.3, rng.random() < 0.004 * seed, rng.randint(0, 5), rng.randint(0, 200)) for i in range(400)]
    frame = spark.createDataFrame([((i,), ok, auth and not ok, r, s) for i, ok, auth, r, s in rows], STEP)
    rows = [(i, ok, auth and not ok, r, s) for i, ok, auth, r, s in rows]
    for secs, requests in ((600, 20), (300, 1), (10**6, 10**6)):
        stop = ledger.fill_stop(frame, secs, requests).first()["_stop"]
        want = walked(rows, secs, requests)
        if want is None:
            assert stop is None
        else:
            assert (stop["_key"]["place"], stop["kind"]) == want[:2]
            assert want[1] == "auth" or (stop.n_done, stop.n_failed, stop.since_requests, stop.since_seconds) == want[2:]


def test_nothing_processed_nothing_stops(spark):
    assert ledger.fill_stop(spark.createDataFrame([], STEP)).first()["_stop"] is None
