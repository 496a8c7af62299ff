"""Command line: run, rank, enroll and scan over a configured pair of folders."""

import argparse
import importlib
import os
import sys
from functools import partial

from pyspark.sql import SparkSession

from curatrix.config import load
from curatrix.plans.pipeline import Project
from curatrix.sources.assessor import HttpAssessor
from curatrix.sources.images import decode_png


def _plugin(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _positive(value: str) -> int:
    number = int(value)
    if number < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return number


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="curatrix", description=__doc__)
    parser.add_argument("--version", action="version", version="0.1.0")
    parser.add_argument("--state", default="~/.local/state/curatrix")
    parser.add_argument("--config", default="selector.toml")
    parser.add_argument("--detector", metavar="MODULE:CLASS", help="finds faces; needed by enroll, scan and run")
    parser.add_argument("--assessor", metavar="MODULE:CLASS", help="rates pictures; needed by rank and run, unless --endpoint is given")
    parser.add_argument("--endpoint", metavar="URL", help="a chat endpoint of this machine that rates pictures")
    parser.add_argument("--decoder", metavar="MODULE:FUNCTION", help="RGB pixels of a file's bytes; PNG is built in")
    steps = parser.add_subparsers(dest="step", required=True)
    steps.add_parser("run").add_argument("--scan-only", action="store_true")
    steps.add_parser("rank")
    steps.add_parser("enroll")
    steps.add_parser("scan").add_argument("--limit", type=_positive)
    told = parser.parse_args(args)
    os.umask(0o077)
    try:
        spark = SparkSession.builder.appName("curatrix").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        config, decode = load(told.config), _plugin(told.decoder) or decode_png
        assessor = partial(HttpAssessor, told.endpoint, config, decode) if told.endpoint else _plugin(told.assessor)
        project = Project(spark, config, told.state, _plugin(told.detector), assessor, decoder=decode)
        if told.step == "run":
            print(project.run(told.scan_only) or "scanned")
        elif told.step == "rank":
            print(project.rank())
        elif told.step == "enroll":
            project.enroll()
        else:
            print(project.scan(told.limit))
        return 0
    except KeyboardInterrupt:
        print("interrupted; what is finished is kept, and the same command goes on from there", file=sys.stderr)
        return 130
    except (ValueError, OSError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
