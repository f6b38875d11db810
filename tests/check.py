"""Run queries against their SQL: python tests/check.py [sf_dir] [name part ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from annolake.plans import all_queries  # noqa: E402

args = sys.argv[1:]
sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
queries, oracles = all_queries()
con = connect(sf)
bad = 0
for name in queries:
    if args and not any(part in name for part in args):
        continue
    start = time.time()
    try:
        if name in oracles:
            problem = compare(name, spark, con, sf, queries, oracles)
        else:
            problem = "" if queries[name](spark, sf).count() >= 0 else "?"
    except Exception as error:
        problem = f"{type(error).__name__}: {str(error)[:700]}"
    bad += bool(problem)
    print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
print("failures:", bad)
