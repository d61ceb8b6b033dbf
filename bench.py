"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS (default 8)
sets the local cores. Each query runs once to warm up and then BENCH_RUNS times (default 1);
the best time counts. Results go to the no-op sink, so every row is produced.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from dayloom.operators import forecast, lags  # noqa: E402
from dayloom.plans.catalogue import load_all  # noqa: E402
from dayloom.plans.views import country_panel  # noqa: E402
from dayloom.session import build_session, clear_scratch  # noqa: E402

HEADLINE = (
    "panel_sum cumulate decumulate lag_join lag_window lag_features lag_features_40 daily_new_cases status_pivot "
    "daily_residual_rollup latest_row_per_key upsert_latest dict_encode history_state recursive_forecast "
    "forecast_metric submission_join trend_forecast forecast_table per_key_models additive_forecast gbt_forecast "
    "json_array_explode sink_bulk_ndjson incremental_load clean_text profile_text number_measures date_measures "
    "standardise_dates assign_sequence nest_json_by_id null_profile stream_daily_rollup stream_upsert"
).split()


def extra(spark, folder):
    """Pairs to compare: the same lags by self joins and by one window."""
    days = country_panel(spark, folder).select("Country", "Date", "Confirmed")
    return {
        "lags_7_by_window": lambda: lags.lag_features(days, ["Country"], "Confirmed", 7),
        "lags_7_by_join": lambda: lags.lag_features_by_join(days, ["Country"], "Confirmed", 7),
        "lags_40_by_window": lambda: lags.lag_features(days, ["Country"], "Confirmed", 40),
        "recursive_forecast_30_days": lambda: forecast.recursive_forecast(days, ["Country"], "Confirmed", 40, 30),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "dayloom-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    jobs = {name: (lambda run=registry[name].run: run(spark, folder)) for name in HEADLINE}
    jobs.update(extra(spark, folder))
    spark.range(1_000_000).select(F.sum("id")).collect()
    only = set(sys.argv[1:])
    times = {}
    for name, job in jobs.items():
        if only and name not in only:
            continue
        best = None
        for attempt in range(runs + 1):
            started = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
            if attempt:
                best = taken if best is None else min(best, taken)
        times[name] = round(best if best is not None else taken, 4)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    clear_scratch(spark)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name,
    }))


if __name__ == "__main__":
    main()
