"""Compare registered queries with their SQL twins: ``run_oracle.py SF [name...]``."""

import sys
import time
import traceback

sys.path.insert(0, ".")
from gradeloom.session import local_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(sf: str, wanted: list[str]) -> int:
    spark, con = local_session(8), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or n in wanted or any(w.endswith("*") and n.startswith(w[:-1]) for w in wanted)]
    failed = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracle:
                diff = differences(df, con, oracle[name])
                verdict = "ok" if not diff else "DIFF " + " | ".join(diff)
            else:
                verdict = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            verdict = "ERROR " + str(e)[:900]
            if "-v" in wanted:
                traceback.print_exc()
        failed += verdict.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - t:6.1f}s {name:24s} {verdict}", flush=True)
        spark.catalog.clearCache()
    print("failed", failed, "of", len(names))
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], [a for a in sys.argv[2:]]) > 0)
