"""python -m trackwise COMMAND FOLDER [ARGUMENT...]: prints a command's result as tab-separated lines; see ``plans/commands.py``.

Results are whole, but pareto_routes gives the first 5 and pareto_gr the first 1000 solutions unless told otherwise (none: all).
build FOLDER [COUNTRIES [BY_LOCATIONS [USE_CACHE [SKIP_OSM [STAGES]]]]]: lists are joined by semicolons, STAGES as in ``plans/build.py``.
"""

import inspect
import sys

from pyspark.sql import SparkSession

from .plans import build, commands

HIDDEN = ("read", "ops", "places", "sections", "edges", "lines", "tunnels")
QUESTIONS = tuple(n for n, f in vars(commands.Folder).items() if inspect.isfunction(f) and not n.startswith("_") and n not in HIDDEN)


def typed(function, arguments: list[str]) -> list:
    """Arguments as the parameters' types say."""
    kinds = [p.annotation for p in inspect.signature(function).parameters.values()][1:]
    if "build_all" in function.__name__:
        kinds = kinds[1:]

    def one(kind: str, value: str):
        if "bool" in kind:
            return value.lower() in ("true", "yes", "1", "--maxspeed")
        if "int" in kind:
            return None if value.lower() == "none" else int(value)
        return float(value) if "float" in kind else value

    return [one(str(k), v) for k, v in zip(kinds, arguments, strict=False)]


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in ("build", *QUESTIONS):
        print(f"{__doc__}\ncommands: build, {', '.join(QUESTIONS)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("trackwise").getOrCreate()
    command, folder, *rest = argv
    if command == "build":
        for name, what in build.build_all(spark, folder, *typed(build.build_all, rest)).items():
            print(name, what, sep="\t")
        return 0
    asked = getattr(commands.Folder, command)
    shown = asked(commands.Folder(spark, folder), *typed(asked, rest))
    if shown is not None:
        print(*shown.columns, sep="\t")
        for row in shown.toLocalIterator():
            print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
