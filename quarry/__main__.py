"""python -m quarry analyze|check FOLDER [--select A,B] [--json]: reports of a tree of Python files; check exits with 0, 1 or 2."""

import argparse
import json
import os
import sys


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("command", choices=("analyze", "check"))
    p.add_argument("folder")
    p.add_argument("--select", default="", help="analyses, by commas")
    p.add_argument("--skip", default="")
    p.add_argument("--config")
    p.add_argument("--json", action="store_true")
    o = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from quarry import analyze, config
    from quarry.sources import python_files, sinks

    names = lambda s: tuple(x for x in s.split(",") if x)
    settings = config.load(o.config, o.folder.removeprefix("file://") if "://" not in o.folder else ".")
    spark = SparkSession.builder.getOrCreate()
    files = python_files.scan(spark, o.folder if "://" in o.folder else f"file://{os.path.abspath(o.folder)}", settings.include, settings.exclude)
    a = analyze.analyze(spark, files, settings, tuple(config.chosen(names(o.select), names(o.skip))))
    if o.command == "check":
        rows = analyze.check(a).collect()
        print("\n".join(f"{r.rule}: {r.issues}" for r in rows))
        return sinks.exit_code(sum(r.issues for r in rows), a.reports["errors"].limit(1).count() > 0)
    if o.json:
        print(json.dumps(sinks.rows(a.summary, 1)[0], default=str))
    else:
        print(sinks.table(a.summary, 1, "Summary"))
        if a.suggestions is not None:
            print(sinks.table(a.suggestions.select("priority", "category", "severity", "effort", "title", "path", "line"), 70, "Suggestions"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
