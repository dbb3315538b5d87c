"""Run registered queries against their SQL twins: ``python tests/check.py [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from barweave.plans.catalog import QUERIES  # noqa: E402
from barweave.session import local_session  # noqa: E402


def main(argv):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    entry.queries()
    names = [n for n in QUERIES if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) or QUERIES[n].ops.split()[0].startswith(a) and a.isupper() for a in argv)]
    if os.environ.get("PLAIN"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
        names = [n for n in names if QUERIES[n].sql]
    else:
        spark = local_session()
    con = connect(sf)
    bad = 0
    for n in names:
        q, t = QUERIES[n], time.time()
        try:
            df = q.run(spark, sf)
            if q.sql:
                diff = compare(df, con, q.sql)
            else:
                rows = df.collect()
                diff = None if rows else "no rows"
                if os.environ.get("SHOW"):
                    print("\n".join(str(r) for r in rows[:5]))
        except Exception as e:  # noqa: BLE001
            diff = "ERROR " + str(e).strip()[:600] if not os.environ.get("TRACE") else traceback.format_exc()
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'BAD '} {q.ops:10s} {n:36s} {time.time() - t:6.2f}s {'' if q.sql else '(rows only)'} {diff or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
