"""Times the headline queries on one machine and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from edgelab.plans import registry

HEADLINE = ["hourly_bars", "window_indicators", "scan_indicators", "event_information", "causal_bands", "band_race", "permuted_bars", "family_pvalues", "variance_ratio", "backtest_overfitting", "trade_stats", "equity_curves", "order_flow", "simulated_trades"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["hourly_bars"](spark, sf).count()  # starts the engine
    took = {}
    for name in HEADLINE:
        t = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
