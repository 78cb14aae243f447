"""Run all (or the named) registered queries against DuckDB: python tests/check_all.py [folder] [prefix ...]"""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from fleetlens.session import local_session  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main(folder="/root/testdata/sf0.01", *prefixes):
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                err = compare(spark, con, fn, sqls[name], folder)
            else:
                err = None if fn(spark, folder).count() else "no rows"
        except Exception as e:
            err = f"{type(e).__name__}: {str(e)[:600]}"
        bad += err is not None
        print(f"{'ok ' if err is None else 'BAD'} {name} {time.time() - start:.2f}s {err or ''}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
