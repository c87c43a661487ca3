"""Developer tool: `python tests/run_all.py [sf_dir] [name prefix ...]` compares and times."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import __spark_entry__ as entry  # noqa: E402
from tests.compare import compare, connect  # noqa: E402
from turnloom.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                difference = compare(df, con, oracles[name])
                verdict = "ok" if difference is None else f"DIFF {difference}"
            else:
                verdict = f"no oracle, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {str(error)[:600]}"
        bad += verdict.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
    print("problems:", bad)
