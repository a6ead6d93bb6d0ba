"""python -m tidemark [QUERY] [--data FOLDER] [--out FOLDER]: list the queries, or run one
and show it or write it as Parquet (as CSV,
where Parquet can't hold its types)."""

from __future__ import annotations

import argparse

from .plans import QUERIES
from .session import session
from .sources.files import write_table


def main() -> None:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("query", nargs="?", choices=sorted(QUERIES))
    p.add_argument("--data", default="/root/testdata/sf0.01")
    p.add_argument("--out")
    a = p.parse_args()
    if not a.query:
        print("\n".join(sorted(QUERIES)))
        return
    df = QUERIES[a.query](session(), a.data)
    if a.out:
        print(f"written as {write_table(df, a.out)}")
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
