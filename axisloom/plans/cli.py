"""Command lines: run a flow on a JSON document of inputs, and look at run folders."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from axisloom.plans.flow import Flow
from axisloom.sources.store import RunFolder, list_runs
from axisloom.sources.tables import read_inputs
from axisloom.streaming.status import read_heartbeat


def run_flow(flow: Flow, spark: SparkSession, argv: Sequence[str] | None = None) -> RunFolder:
    """Run a flow as ``--inputs FILE --folder FOLDER [--output NAME ...] [--resume] [--errors raise|continue]``."""
    parser = argparse.ArgumentParser(prog=flow.name or "flow", description=flow.description, epilog=flow.describe(), formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--inputs", required=True, help="JSON document with " + ", ".join(flow.roots()))
    parser.add_argument("--folder", required=True, help="run folder")
    parser.add_argument("--output", action="append", help="outputs wanted, by default all")
    parser.add_argument("--resume", action="store_true", help="keep cells that are there")
    parser.add_argument("--errors", choices=("raise", "continue"), default="raise")
    given = parser.parse_args(argv)
    result = flow.map(spark, read_inputs(spark, given.inputs), folder=given.folder, outputs=given.output, resume=given.resume, errors=given.errors)
    return result.run


def main(spark: SparkSession, argv: Sequence[str] | None = None) -> str:
    """``runs FOLDER`` or ``status FOLDER`` as JSON."""
    parser = argparse.ArgumentParser(prog="axisloom")
    parser.add_argument("what", choices=("runs", "status"))
    parser.add_argument("folder")
    parser.add_argument("--most", type=int)
    given = parser.parse_args(argv)
    if given.what == "runs":
        found = [{"path": m["path"], "updated": m["updated"], "outputs": sorted(m["outputs"])} for m in list_runs(spark, given.folder, given.most)]
    else:
        found = {"outputs": [r.asDict() for r in RunFolder(spark, given.folder).status().collect()], "heartbeat": read_heartbeat(spark, given.folder)}
    text = json.dumps(found, indent=1)
    print(text)
    return text
