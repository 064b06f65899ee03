"""Summarise the physical plan of every registered query (no execution).

    python tools/plan_summary.py [sf_dir] > PLANS.md
Counts, in the initial adaptive plan of each query (subqueries included):
shuffles (Exchange), sort-merge joins, broadcast hash joins, Parquet scans.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from chainlens.session import build_session
    from chainlens.queries import QUERIES
    spark = build_session(shuffle_partitions=16)
    print("| query | shuffles | sort-merge joins | broadcast joins | scans | other operators |")
    print("|---|---|---|---|---|---|")
    for k, fn in QUERIES.items():
        if k.startswith("stream_"):
            print(f"| {k} | – | – | – | – | streaming query run to completion (see README) |")
            continue
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf).explain("formatted")
        tree = "\n".join(line for line in buf.getvalue().split("\n\n")[0].splitlines())
        subq = buf.getvalue().count("Subquery:")
        shuffles = len(re.findall(r"\bExchange \(", tree))
        smj = len(re.findall(r"SortMergeJoin", tree))
        bhj = len(re.findall(r"BroadcastHashJoin", tree))
        scans = len(re.findall(r"Scan parquet", tree))
        other = [op for op in ("Expand", "Generate", "Window", "TakeOrderedAndProject", "Union",
                               "ObjectHashAggregate", "SortAggregate") if op in tree]
        if subq:
            other.append(f"{subq} scalar subquer{'y' if subq == 1 else 'ies'}")
        print(f"| {k} | {shuffles} | {smj} | {bhj} | {scans} | {', '.join(other)} |")
    spark.stop()


if __name__ == "__main__":
    main()
