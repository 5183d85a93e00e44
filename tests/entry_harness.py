"""Like ``oracle_harness`` over every query of ``__spark_entry__``.

Usage: python tests/entry_harness.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from maieutic.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, ors = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        try:
            info = compare(spark, con, name, qs[name], ors.get(name), sf_dir)
        except Exception as e:  # report and go on
            info = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:1500]}"}
        bad += info["status"] not in ("match", "rows-only")
        print(info, flush=True)
    print(f"done: {bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
