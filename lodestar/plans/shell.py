"""An interactive search over a text file: count, search, extract, regex, quit."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from lodestar.sources.collections import FlatCollection
from lodestar.sources.storage import text_records

HELP = "count QUERY | search QUERY | extract OFFSET LENGTH | regex PATTERN | quit"


def answer(flat: FlatCollection, line: str, first: int = 10) -> str | None:
    """What a command line says; None ends the session."""
    verb, _, rest = line.strip().partition(" ")
    if verb == "quit":
        return None
    try:
        if verb == "count":
            return str(flat.count(rest))
        if verb == "search":
            return " ".join(str(r.offset) for r in flat.search(rest).orderBy("offset").limit(first).collect())
        if verb == "extract":
            offset, length = map(int, rest.split())
            return flat.extract(offset, length).decode("utf-8", "replace")
        if verb == "regex":
            return " ".join(f"({r.offset},{r.length})" for r in flat.regex_search(rest).orderBy("offset").limit(first).collect())
    except (ValueError, IndexError) as e:
        return f"error: {e}"
    return HELP


def main(argv: list[str], read: Callable[[], str] = lambda: input("> ")) -> int:
    if len(argv) != 1:
        print("usage: python -m lodestar.plans.shell PATH", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    flat = FlatCollection.build(text_records(spark, argv[0])).persist()
    while (said := answer(flat, read())) is not None:
        print(said)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
