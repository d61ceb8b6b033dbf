import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayloom.operators import calendar, columns, joins, lags, panel
from tests.conftest import day

KEYS = ["Country", "Province"]


def rows(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def test_lag_counts_calendar_days_and_matches_null_keys(edge_panel):
    got = rows(lags.lag_features(edge_panel, KEYS, "n", 3), *KEYS, "Date", "n_1", "n_2", "n_3")
    assert ("A", "x", day("2020-03-04"), None, 15, 10) in got
    assert ("A", "x", day("2020-03-05"), 12, None, 15) in got
    assert ("A", None, day("2020-03-05"), None, None, 4) in got
    assert ("B", "y", day("2020-03-02"), 7, None, None) in got


def test_lag_forms_agree(edge_panel):
    names = [*KEYS, "Date", "n", "n_1", "n_2", "n_3"]
    by_window = rows(lags.lag_features(edge_panel, KEYS, "n", 3), *names)
    assert by_window == rows(lags.lag_features_by_join(edge_panel, KEYS, "n", 3), *names)


def test_decumulate_keeps_negative_and_gaps(edge_panel):
    got = rows(panel.decumulate(edge_panel, KEYS, ["n"]), *KEYS, "Date", "n")
    assert ("B", "y", day("2020-03-02"), -2) in got
    assert ("A", "x", day("2020-03-04"), None) in got
    filled = rows(panel.decumulate(edge_panel, KEYS, ["n"], fill=0), *KEYS, "Date", "n")
    assert ("A", "x", day("2020-03-01"), 0) in filled


def test_duplicate_key_is_rejected(edge_panel):
    panel.assert_unique(edge_panel, KEYS)
    with pytest.raises(panel.DuplicateKeyError):
        lags.lag_features(edge_panel.union(edge_panel.limit(1)), KEYS, "n", 2, check_unique=True)


def test_null_keys_in_sums(edge_panel):
    assert panel.sum_panel(edge_panel, ["Province"], ["n"], None).count() == 3
    assert panel.sum_panel_known(edge_panel, ["Province"], ["n"]).where("Province IS NULL").isEmpty()


def test_cumulate_peers_share_the_total(spark):
    df = spark.createDataFrame([("A", day("2020-01-01"), 1), ("A", day("2020-01-01"), 2), ("A", day("2020-01-02"), 4)],
                               "k string, Date date, n bigint")
    assert sorted(r["n"] for r in panel.cumulate(df, ["k"], ["n"]).collect()) == [3, 3, 7]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 12), st.integers(-5, 9)), min_size=1, max_size=25,
                unique_by=lambda r: r[:2]))
def test_lags_and_totals_against_brute_force(spark, data):
    start = dt.date(2020, 2, 20)
    table = {(k, start + dt.timedelta(d)): v for k, d, v in data}
    df = spark.createDataFrame([(k, d, v) for (k, d), v in table.items()], "k string, Date date, n bigint")
    lagged = {(r["k"], r["Date"]): (r["n_1"], r["n_4"]) for r in lags.lag_features(df, ["k"], "n", 4).collect()}
    totals = {(r["k"], r["Date"]): r["n"] for r in panel.cumulate(df, ["k"], ["n"]).collect()}
    for k, d in table:
        assert lagged[k, d] == (table.get((k, d - dt.timedelta(1))), table.get((k, d - dt.timedelta(4))))
        assert totals[k, d] == sum(v for (k2, d2), v in table.items() if k2 == k and d2 <= d)


def test_decumulate_undoes_cumulate_on_gap_free_series(spark):
    series = [("A", dt.date(2020, 1, 1) + dt.timedelta(i), v) for i, v in enumerate([3, 0, -2, 8, 5])]
    df = spark.createDataFrame(series, "k string, Date date, n bigint")
    back = panel.decumulate(panel.cumulate(df, ["k"], ["n"]), ["k"], ["n"], fill=0).orderBy("Date").collect()
    assert [r["n"] for r in back] == [0, 0, -2, 8, 5]


def test_harmonise_encode_decode(spark):
    df = spark.createDataFrame([("Viet Nam",), ("Peru",), ("Peru",), (None,), ("Atlantis",)], "Country string")
    same = joins.harmonise(df, "Country", {"Viet Nam": "Vietnam"})
    assert rows(same, "Country") == {("Vietnam",), ("Peru",), (None,), ("Atlantis",)}
    assert same.count() == 5
    dictionary = joins.fit_dictionary(same.where("Country <> 'Atlantis'"), "Country", "i")
    assert rows(dictionary, "Country", "i") == {("Peru", 0), ("Vietnam", 1)}
    encoded = joins.encode(same, dictionary, ["Country"])
    assert encoded.count() == 3
    decoded = joins.decode(spark.createDataFrame([(0,), (7,)], "i int"), dictionary, ["i"])
    assert rows(decoded, "i", "Country") == {(0, "Peru"), (7, None)}


def test_decode_lookup_null_key_and_null_value(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    got = rows(joins.decode_lookup(df, "c", {"a": None, None: "none"}, "other", "d"), "c", "d")
    assert got == {("a", None), (None, "none"), ("z", "other")}


def test_union_guard_and_future(spark, edge_panel):
    with pytest.raises(ValueError):
        calendar.union_positional(edge_panel, edge_panel.select(*reversed(edge_panel.columns)))
    moved = calendar.future_by_shift(edge_panel, 1)
    assert moved.count() == edge_panel.count() + 3
    assert moved.agg(F.max("Date")).first()[0] == day("2020-03-06")
    fixed = calendar.extend_calendar(edge_panel, KEYS, 2, until=day("2020-03-05"))
    assert fixed.count() == 7 * 3
    common = calendar.extend_calendar(edge_panel, KEYS, 2, until=columns.max_date(edge_panel))
    assert rows(common, *KEYS, "Date") == rows(fixed, *KEYS, "Date")


def test_filters_by_day(edge_panel):
    assert columns.filter_recent(edge_panel, 1).count() == 3
    assert columns.filter_recent(edge_panel, 1, as_of=day("2020-03-03")).count() == 6
    assert columns.filter_on_date(edge_panel, None).count() == 0
    assert columns.filter_after(edge_panel, edge_panel.where("Country = 'B'")).count() == 3


def test_latest_per_key_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (2, 5, "c")], "k int, v int, x string")
    assert rows(columns.latest_per_key(df, ["k"], ["v"]), "k", "v", "x") == {(1, 2, "b"), (2, 5, "c")}


def test_targets_need_every_metric(spark):
    long = spark.createDataFrame([("a", "m", 1), ("a", "n", 2), ("b", "m", 3)], "k string, metric string, value int")
    assert rows(joins.join_targets(long, ["k"], ["m", "n"]), "k", "m", "n") == {("a", 1, 2)}
