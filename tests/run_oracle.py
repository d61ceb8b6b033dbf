"""Check queries from the command line: python tests/run_oracle.py [folder] [name ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dayloom.plans.catalogue import load_all  # noqa: E402
from dayloom.session import build_session  # noqa: E402
from tests.oracle import check, connect  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    connection = connect(folder)
    bad = []
    for name in args or registry:
        started = time.time()
        try:
            rows, problems = check(spark, connection, registry[name], folder)
        except Exception as error:  # report and go on with the next query
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:700]}"]
            if len(args) == 1:
                traceback.print_exc()
        kind = "sql " if registry[name].sql else "rows"
        status = "ok  " if not problems and rows > 0 else "BAD "
        if status == "BAD ":
            bad.append(name)
        print(f"{status}{kind} {name}: {rows} rows, {time.time() - started:.2f}s", *problems, sep="\n      ", flush=True)
    print(f"{len(args or registry) - len(bad)} ok, {len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
