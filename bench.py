"""Headline benchmark: prints one JSON line with the seconds of each query.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_KEYS`` a comma list of
queries. The list is gone through twice, each query built and fully computed; the better run counts, so
that one-off class loading and compilation in the fresh JVM do not; ``first`` has the seconds of the first run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from popgauge.probes import QUERIES  # noqa: E402
from popgauge.session import get_session  # noqa: E402

HEADLINE = [
    "multi_task_distribution", "ground_truth", "eval_low_dim", "eval_high_dim", "score_table",
    "bootstrap_floor", "hd_noise_floor", "oof_cell_probability", "ks_weighted", "weighted_corr",
    "kde_weighted", "join_cells_back", "weighted_sample_replace", "permutation_average", "sequence_pack",
    "parse_level", "extract_tag", "impute_chained", "by_prompting", "bootstrap_gbt", "build_tasks_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = os.environ.get("BENCH_KEYS")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    wanted = keys.split(",") if keys else HEADLINE
    runs: dict[str, list[float]] = {key: [] for key in wanted}
    for _ in range(2):
        for key in wanted:
            start = time.perf_counter()
            QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            runs[key].append(time.perf_counter() - start)
            if os.environ.get("BENCH_VERBOSE"):
                print(key, [round(r, 2) for r in runs[key]], file=sys.stderr, flush=True)
    seconds = {key: round(min(times), 3) for key, times in runs.items()}
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "first": {key: round(times[0], 3) for key, times in runs.items()}, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
