"""Run registered queries against DuckDB and print the outcome: python tests/check_queries.py [folder] [names...]"""

import sys
import time

sys.path[:0] = [__file__.rsplit("/", 2)[0], __file__.rsplit("/", 1)[0]]

from oracle import compare, connect

import __spark_entry__ as entry
from maskloom.session import local_session

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            if name in sql:
                problem = compare(df, con, sql[name])
            else:
                problem = None if df.count() >= 0 else "?"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s "
              f"{'' if name in sql else '(rows only) '}{problem or ''}", flush=True)
    print(f"{bad} failures")
