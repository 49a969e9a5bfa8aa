"""Command-line check: python tests/check.py [--sf DIR] [name or prefix ...]."""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")
from compare import differences, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidegrid.session import local_session  # noqa: E402


def main(args):
    sf = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf, args = args[1], args[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql = entry.queries(), entry.oracle_sql()
    con = duck(sf)
    bad = []
    for name in qs:
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sql:
                diff, n = differences(df, con, sql[name])
            else:
                n = df.count()
                diff = [] if n else ["no rows"]
        except Exception as e:  # noqa: BLE001
            diff, n = [f"{type(e).__name__}: {str(e)[:600]}"], 0
        mark = "ok " if not diff else "BAD"
        print(f"{mark} {name} rows={n} {time.time() - t:.2f}s {'' if name in sql else '(no sql)'} {' | '.join(diff)}", flush=True)
        if diff:
            bad.append(name)
    print("bad:", bad)


main(sys.argv[1:])
