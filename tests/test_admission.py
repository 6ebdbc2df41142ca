import datetime as dt
import random

import pytest

from kgspark.operators import admission as A

T0 = dt.datetime(2024, 1, 1)


def plain(rows, user_limit, global_limit, seconds=3600):
    admitted, out = [], {}
    for i, user, at, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        second = int((at - T0).total_seconds() // 1)
        recent = [u for s, u in admitted if s > second - seconds]
        if len(recent) >= global_limit:
            out[i] = "global"
        elif user and recent.count(user) >= user_limit:
            out[i] = "user"
        else:
            out[i] = "ok"
            admitted.append((second, user))
    return out


@pytest.mark.parametrize("name, seed, n, span, users", [("steady", 1, 1500, 40_000, 6), ("burst", 2, 1200, 900, 4), ("sparse", 3, 300, 900_000, 3), ("one user", 4, 800, 20_000, 1)])
def test_admission_equals_a_loop(spark, name, seed, n, span, users):
    """Bursts, ties, hot seconds and rows without a user; segments so small that starts must be carried over."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=rnd.randint(0, span), microseconds=rnd.choice([0, 0, 500_000, rnd.randint(0, 999_999)]))
        rows.append((i, rnd.choice([None, ""] + [f"u{k}" for k in range(users)] * 3), at, "x"))
    hot = T0 + dt.timedelta(seconds=span // 2)
    rows += [(n + i, rnd.choice(["u0", "u0", "u1", None]), hot + dt.timedelta(microseconds=rnd.randint(0, 999_999)), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, who string, at timestamp, verdictless string").repartition(5)
    got = A.admit(df, "who", "at", "id", 5, 20, segment_rows=200)
    assert {r.id: r.verdict for r in got.collect()} == plain(rows, 5, 20)
    assert got.columns == [*df.columns, "verdict"] and got.count() == len(rows)


def test_admission_of_nothing(spark):
    assert A.admit(spark.createDataFrame([], "id long, who string, at timestamp"), "who", "at", "id").count() == 0
