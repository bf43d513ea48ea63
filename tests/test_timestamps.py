from datetime import datetime, timezone
from itertools import product

import numpy as np
from conftest import rows

from chronoweave.operators.timestamps import BACKWARD, DAY_US, SWITCH, normalise, viterbi

us = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)

# text, zone, date order, expected
CASES = [
    ("2021-03-04", "UTC", "dmy", us(2021, 3, 4)),
    ("  *2021-03-04T05:06:07.1234567Z*. ", "Asia/Tokyo", "dmy", us(2021, 3, 4, 5, 6, 7) + 123456),
    ("Date: 03/04/2021", "UTC", "dmy", us(2021, 4, 3)),
    ("03/04/2021", "UTC", "mdy", us(2021, 3, 4)),
    ("04/13/2021 8:05 PM", "UTC", "mdy", us(2021, 4, 13, 20, 5)),
    ("12/04/2021 12:05 am", "UTC", "mdy", us(2021, 12, 4, 0, 5)),
    ("5.3.2021 11:10", "UTC", "mdy", us(2021, 3, 5, 11, 10)),
    ("2021-03-28 02:30", "Europe/Berlin", "dmy", us(2021, 3, 28, 1, 30)),  # skipped
    ("2021-10-31 02:30", "Europe/Berlin", "dmy", us(2021, 10, 31, 0, 30)),  # twice
    ("2020-02-02 08:22:14 america/new_york", "UTC", "dmy", us(2020, 2, 2, 13, 22, 14)),
    ("2020-02-02T08:22[Asia/Kathmandu]", "UTC", "dmy", us(2020, 2, 2, 2, 37)),
    ("2020-02-25 15:02:57 GMT+5", "UTC", "dmy", us(2020, 2, 25, 10, 2, 57)),
    ("2020-02-25 15:02:57-07", "UTC", "dmy", us(2020, 2, 25, 22, 2, 57)),
    ("sat, 20 feb 2021 12:01:25 -0600", "UTC", "dmy", us(2021, 2, 20, 18, 1, 25)),
    ("11. März 2020", "UTC", "dmy", us(2020, 3, 11)),
    ("1er août 2020", "UTC", "dmy", us(2020, 8, 1)),
    ("14 de septiembre de 2020", "UTC", "dmy", us(2020, 9, 14)),
    ("February 8, 2020", "UTC", "dmy", us(2020, 2, 8)),
    ("20200219T122732Z", "UTC", "dmy", us(2020, 2, 19, 12, 27, 32)),
    ("1580735995", "Asia/Tokyo", "dmy", 1580735995_000000),
    ("1581392647074", "Asia/Tokyo", "dmy", 1581392647074_000),
    *[(t, "UTC", "dmy", None) for t in ("2021-02-29", "30.02.2023", "31/04/2024 09:15", "2022-06", "Q3 2023", "2021", "soon", "", "-", None, "2024-13-40", "x" * 20000, "13/13/2021")],
    ("2021-03-04", None, "dmy", None),
]


def frame(spark, cases):
    return spark.createDataFrame([(i, t, "s", i, z, o, "clash") for i, (t, z, o, *_) in enumerate(cases)], "id int, txt string, src string, seq int, tz string, ord string, _text string")


def test_declared_forms(spark):
    got = dict(rows(normalise(frame(spark, CASES), row_id="id", text="txt", source="src", seq="seq", zone="tz", date_order="ord"), "id", "epoch_us"))
    assert got == {i: c[3] for i, c in enumerate(CASES) if c[3] is not None}


def test_path_settles_unclear_dates(spark):
    texts = ["13/04/2021", "05/04/2021", "06/04/2021", "14/04/2021", "soon", "15/04/2021"]
    df = frame(spark, [(t, "UTC", None) for t in texts])
    got = dict(rows(normalise(df, row_id="id", text="txt", source="src", seq="seq", zone="tz"), "id", "epoch_us"))
    assert got == {0: us(2021, 4, 13), 1: us(2021, 4, 5), 2: us(2021, 4, 6), 3: us(2021, 4, 14), 5: us(2021, 4, 15)}
    assert got == dict(rows(normalise(df, row_id="id", text="txt", source="src", seq="seq", zone="tz", date_order="ord"), "id", "epoch_us"))
    assert rows(normalise(df.limit(0), row_id="id", text="txt", source="src", seq="seq", zone="tz")) == []


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 4, 5)
        f = [rng.integers(0, 3, s) for s in sizes]
        t = [rng.integers(0, 6, s) * DAY_US for s in sizes]

        def cost(p):
            return sum(SWITCH * (f[i][a] != f[i + 1][b]) + BACKWARD * (t[i + 1][b] < t[i][a] - DAY_US) for i, (a, b) in enumerate(zip(p, p[1:])))

        assert cost(viterbi(f, t)) == min(cost(p) for p in product(*map(range, sizes)))


def test_choice_is_the_same_at_every_slice_size(spark):
    rng = np.random.default_rng(5)
    cases = []
    for i in range(60):
        d, m = rng.integers(1, 29), rng.integers(1, 13)
        text = [f"{d:02d}/{m:02d}/2021", f"{min(d, 12):02d}/{m:02d}/2021", f"2021-{m:02d}-{d:02d}"][rng.choice(3, p=[0.3, 0.6, 0.1])]
        cases.append((text, "UTC", None if i % 3 else "mdy"))
    df = frame(spark, cases)
    args = dict(row_id="id", text="txt", source="src", seq="seq", zone="tz", date_order="ord")
    whole = rows(normalise(df, **args))
    assert len(whole) > 30
    for size in (1, 3, 17):
        assert rows(normalise(df, slice_rows=size, **args)) == whole


def test_equal_day_and_month_follow_any_order(spark):
    df = frame(spark, [("03/03/2021", "UTC", "mdy"), ("03/03/2021", "UTC", "dmy"), ("03/03/2021", "UTC", None)])
    got = rows(normalise(df, row_id="id", text="txt", source="src", seq="seq", zone="tz", date_order="ord"), "id", "epoch_us")
    assert got == [(i, us(2021, 3, 3)) for i in range(3)]


def test_ties_of_the_order_are_cut_too(spark):
    df = spark.createDataFrame([(i, "03/04/2021", "s", 7, "UTC", None) for i in range(40)] + [(99, "05/13/2021", "s", 8, "UTC", None)], "id int, txt string, src string, seq int, tz string, ord string")
    args = dict(row_id="id", text="txt", source="src", seq="seq", zone="tz")
    whole = rows(normalise(df, **args))
    assert len(whole) == 41 and rows(normalise(df, slice_rows=5, **args)) == whole
