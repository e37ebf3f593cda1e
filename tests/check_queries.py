"""Run registered queries on a data folder and compare each with its SQL twin.

    python tests/check_queries.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_module  # noqa: E402
from compare import connect, difference  # noqa: E402
from riskgrain.session import build_session  # noqa: E402


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    con = connect(args.sf)
    failed = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        started = time.time()
        try:
            df = fn(spark, args.sf)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                state = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
                state = f"rows-only {len(rows)} {rows[:2]}"
        except Exception as error:  # report and go on
            problem, state = error, "ERROR " + "".join(traceback.format_exception_only(error))[:1500]
        failed += problem is not None
        print(f"{name:34s} {time.time() - started:6.2f}s {state[:600]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
