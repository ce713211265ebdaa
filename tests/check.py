"""Run probe queries against their SQL: ``python tests/check.py [folder] [key ...]``."""

import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from oracle import connect, differences  # noqa: E402

from popgauge.session import get_session  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(queries)
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = queries[key](spark, folder)
            if key in oracles:
                found = differences(df, con, oracles[key])
                note = "ok" if not found else "DIFF " + " | ".join(found)
            else:
                note = f"rows-only {df.count()}"
        except Exception as error:  # report and go on with the next query
            note = "ERROR " + "".join(traceback.format_exception_only(error))[:1500]
        bad += not note.startswith(("ok", "rows-only"))
        print(f"{key:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{len(keys)} queries, {bad} bad")


main()
