"""Command line: python -m tracequill.check TRACE [--config FILE] [--threshold NAME=VALUE] [--json] [--report FILE].

Exit codes: 0 the gate passes, 1 a rule is violated, 2 usage or input error.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .operators import gate
from .session import local_session
from .sinks.reports import gate_markdown
from .sources import binary, files


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracequill.check", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("trace", nargs="+", help="a trace file, or `check` and a trace file")
    parser.add_argument("--config")
    parser.add_argument("--threshold", help=" or ".join(f"{k}=VALUE" for k in gate.DEFAULTS))
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--report")
    try:
        given = parser.parse_args(arguments)
    except SystemExit as e:
        return 2 if e.code else 0
    path = given.trace[-1]
    try:
        config = json.loads(Path(given.config).read_text()) if given.config else {}
        if given.threshold:
            name, _, value = given.threshold.partition("=")
            if name not in gate.DEFAULTS:
                raise ValueError(f"no such threshold: {name}")
            config[name] = float(value)
        if not Path(path).is_file():
            raise ValueError(f"cannot read {path}")
        spark = local_session()
        events = binary.read_ndv(spark, path).withColumnRenamed("pos", "seq").drop("file") if path.lower().endswith(".ndv") else files.read_trace(spark, path)
        rules = [r.asDict() for r in gate.evaluate(events, config).collect()]
        report = gate_markdown(rules)
        if given.report:
            Path(given.report).write_text(report)
    except Exception as e:  # whatever is wrong with the input
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    passed = all(r["status"] != "fail" for r in rules)
    print(json.dumps({"passed": passed, "rules": rules}, indent=2) if given.json else report)
    return 0 if passed else 1


if __name__ == "__main__":
    sys.exit(main())
