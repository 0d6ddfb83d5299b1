"""Run queries against their oracles: ``python tests/check_queries.py [sf_dir] [name …]``."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle_support import compare, connect  # noqa: E402

from ledgerloom.catalog import all_queries  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402


def main() -> None:
    arguments = sys.argv[1:]
    sf_dir = arguments.pop(0) if arguments and arguments[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                              "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, (run, sql) in all_queries().items():
        if arguments and not any(name.startswith(a) for a in arguments):
            continue
        start = time.time()
        try:
            if sql:
                count, problem = compare(spark, con, run, sql, sf_dir)
            else:
                count, problem = run(spark, sf_dir).count(), "rows only"
        except Exception as error:  # noqa: BLE001
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem in (None, 'rows only') else 'FAIL'} {name} rows={count} {time.time() - start:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
