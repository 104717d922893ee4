"""Run queries against their SQL: ``python -m tests.check [directory] [name ...]``.
"""

import sys
import time

from spanworks.queries import all_queries, all_sql
from tests.compare import connect, difference
from tests.session import make_session


def main(directory: str, names: list[str]) -> int:
    spark, con = make_session(), connect(directory)
    queries, sql = all_queries(), all_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, directory)
            text = difference(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
            bad += bool(text) and name in sql
        except Exception as e:  # report and go on with the next query
            text, bad = f"{type(e).__name__}: {str(e)[:600]}", bad + 1
        print(f"{'ok ' if not text else ''}{name} {time.time() - start:.1f}s {text}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]))
