"""Times of headline queries; prints one JSON line."""

import json
import os
import time

from tabulon import registry
from tabulon.session import get_session

HEADLINE = [
    "r11_sales_performance", "r12_order_anomalies", "f1_parse_clf", "r1_requests_per_minute", "r9_windowed_sums", "q4_q10_validate", "a9_inventory_summary", "a16_totals_with_all",
    "a19_elasticity", "a24_rfm", "w4_recommendations", "j13_apply_merge", "c5_connected_components", "p22_detect_pii",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["r11_sales_performance"](spark, folder).count()  # warm-up
    times = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
