"""A line interpreter over a store: put, get, delete, scan, help, exit."""

from __future__ import annotations

import sys

from kvlake.sources.store import Store

HELP = "put KEY VALUE [TTL_SECONDS] | get KEY | delete KEY | scan [FROM [TO]] | help | exit"


def execute(store: Store, line: str) -> str | None:
    """The answer to a line; None for exit. Keys and values are UTF-8 words."""
    word = line.split()
    try:
        match word:
            case []:
                return ""
            case ["put", key, value]:
                store.put(key.encode(), value.encode())
                return "ok"
            case ["put", key, value, ttl]:
                store.put(key.encode(), value.encode(), int(float(ttl) * 1000))
                return "ok"
            case ["get", key]:
                found = store.get(key.encode())
                return "(none)" if found is None else found.decode("utf-8", "replace")
            case ["delete" | "del", key]:
                store.delete(key.encode())
                return "ok"
            case ["scan", *bounds] if len(bounds) <= 2:
                rows = store.scan(*[b.encode() for b in bounds]).collect()
                return "\n".join(f"{bytes(r.key).decode('utf-8', 'replace')} = {bytes(r.value).decode('utf-8', 'replace')}" for r in rows) or "(none)"
            case ["help"]:
                return HELP
            case ["exit" | "quit"]:
                return None
        return f"unknown: {line.strip()}\n{HELP}"
    except (ValueError, RuntimeError) as e:
        return f"error: {e}"


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("kvlake").getOrCreate()
    with Store(spark, sys.argv[1]) as store:
        for line in sys.stdin:
            answer = execute(store, line)
            if answer is None:
                break
            print(answer, flush=True)


if __name__ == "__main__":
    main()
