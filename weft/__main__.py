"""python -m weft run|plan|validate module:pipeline [--profiles file.yaml --profile name] [--config file.yaml] [--tasks a,b] [--state folder] [--force]"""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import WeftError
from .operators.state import store
from .plans import profiles
from .plans.config import included, problems, selected, values_of
from .plans.run import plan, run


def main(argv: list[str] | None = None) -> int:
    """0 if all went well; 1, with what is wrong on the error output, if not."""
    p = argparse.ArgumentParser(prog="weft")
    p.add_argument("what", choices=["run", "plan", "validate"])
    p.add_argument("pipeline", help="module:name of a pipeline")
    p.add_argument("--profiles", default="profiles.yaml")
    p.add_argument("--profile")
    p.add_argument("--config", help="file with values for all tasks, YAML or JSON")
    p.add_argument("--tasks", help="names of the tasks to run, parted by commas")
    p.add_argument("--state", help="folder of the state table; digests of outputs are kept beside it")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    if "." not in sys.path:
        sys.path.insert(0, ".")
    module, _, name = a.pipeline.partition(":")
    try:
        pipeline = getattr(importlib.import_module(module), name or "pipeline")
        profile = profiles.resolve(profiles.load(a.profiles), a.profile) if a.profile else None
        config, base = (included(a.config) or {}, str(Path(a.config).parent)) if a.config else ({}, ".")
        if a.what == "validate":
            wrong = problems(pipeline, profile.args if profile else {}, values_of(config, base))
            if a.tasks:
                selected(pipeline, a.tasks)
            for line in wrong or ["all arguments fit"]:
                print(line)
            return int(bool(wrong))
        spark = SparkSession.builder.getOrCreate()
        if a.state and "://" not in a.state:  # Spark may have been started elsewhere
            a.state = str(Path(a.state).resolve())
        kept = store("table" if a.state else "memory", spark, a.state)
        if a.what == "plan":
            lines = [f"{action} {task}" for action, task in plan(pipeline, spark, kept, profile)]
        else:
            lines = run(pipeline, spark, kept, profile, force=a.force, config=config, base=base, tasks=a.tasks)["log"]
    except (WeftError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    for line in lines:
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
