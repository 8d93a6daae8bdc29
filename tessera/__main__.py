"""``python -m tessera TASK ROOT [VALUE ...] [--OPTION VALUE ...] [--report FILE.csv]``

Values are read as YAML scalars; commas make lists.  A table is shown, or written to the report.
``check`` ends with status 2 where an issue is an error, other wrong uses with status 1.
"""

from __future__ import annotations

import sys

import yaml
from pyspark.sql import DataFrame, SparkSession

from .manager import TASKS, run_task
from .sinks.reports import write_csv


def value(text: str):
    if "," in text and not text.lstrip().startswith(("{", "[")):
        return [value(part) for part in text.split(",") if part.strip()]
    return yaml.safe_load(text)


def arguments(words: list[str]) -> tuple[list, dict]:
    plain, options, rest = [], {}, iter(words)
    for word in rest:
        if not word.startswith("--"):
            plain.append(value(word))
            continue
        name, given, text = word[2:].partition("=")
        text = text if given else next(rest, None)
        if text is None:
            raise ValueError(f"--{name} needs a value")
        options[name.replace("-", "_")] = value(text)
    return plain, options


def tables_in(result) -> list[DataFrame]:
    parts = result.values() if isinstance(result, dict) else result if isinstance(result, (tuple, list)) else [result]
    return [p for p in parts if isinstance(p, DataFrame)]


def main(words: list[str], spark: SparkSession | None = None) -> int:
    if len(words) < 2 or words[0] not in TASKS:
        print(__doc__, "\nTasks: ", ", ".join(sorted(TASKS)), sep="", file=sys.stderr)
        return 1
    task, root = words[:2]
    plain, options = arguments(words[2:])
    report = options.pop("report", None)
    spark = spark or SparkSession.builder.appName(f"tessera {task}").getOrCreate()
    result = run_task(spark, task, root, *plain, **options)
    found = tables_in(result)
    if report and found:
        flat = found[-1].select(*[c if not t.startswith(("array", "map", "struct")) else found[-1][c].cast("string").alias(c) for c, t in found[-1].dtypes])
        write_csv(flat, report)
    elif found:
        for table in found:
            table.show(50, truncate=False)
    elif result is not None:
        print(result)
    if task == "check" and found[0].where("level = 'error'").limit(1).count():
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
