"""Check all (or the named) queries against their twins: python tests/run_catalog.py [sf] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.harness import DATA, differences, session  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    spark = session()
    import __spark_entry__ as entry

    twins, bad = entry.oracle_sql(), 0
    sf_dir = str(DATA / sf)
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in twins:
                problems = differences(df, twins[name], sf_dir)
            else:
                problems = [] if df.count() > 0 else ["no rows"]
        except Exception as problem:  # noqa: BLE001
            problems = [f"{type(problem).__name__}: {str(problem)[:600]}"]
        bad += bool(problems)
        kind = "same" if name in twins else "rows"
        print(f"{'BAD ' + str(problems) if problems else kind} {name} {time.time() - start:.1f}s", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "sf0.01", sys.argv[2:]))
