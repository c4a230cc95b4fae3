"""Command line: verdicts for files and folders, as a table or JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .operators.calibrate import FusionModel
from .operators.provenance import provenance
from .operators.scoring import predictions, verdict_table
from .session import session
from .sources.files import contents, expand


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glasswort", description="Provenance and detector verdicts for image files.")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--metadata-only", action="store_true", help="read metadata; load no model")
    p.add_argument("--no-metadata", action="store_true")
    p.add_argument("--no-abstain", action="store_true")
    p.add_argument("--model", help="JSON file of an ensemble")
    p.add_argument("--scorers", default="brightness", help="names, joined by commas")
    p.add_argument("--operating-point", default="fpr5")
    p.add_argument("--batch-size", type=int, default=8)
    p.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """0; 1 if the ensemble can't be loaded; 2 if no file is found."""
    args = parser().parse_args(argv)
    spark = session()
    listed = expand(spark, args.inputs, not args.no_recursive)
    if listed.isEmpty():
        print("no image files found", file=sys.stderr)
        return 2
    files = contents(spark, listed)
    if args.metadata_only:
        rows = provenance(files).select("ordinal", "path", "says_ai", "partial_ai", "says_camera", "generator", "description", "weak", "camera", "has_c2pa", "errors")
    else:
        try:
            model = FusionModel.load(spark, args.model) if args.model else None
            rows = predictions(files, args.scorers.split(","), model, args.operating_point, not args.no_metadata, not args.no_abstain, args.batch_size)
        except Exception as e:  # noqa: BLE001 - reported to the caller
            print(f"cannot load the ensemble: {e}", file=sys.stderr)
            return 1
        if not args.json:
            for r in verdict_table(rows).orderBy("ordinal").toLocalIterator():
                print(f"{r['verdict']:<13} {r['bar']} {r['p']:>6}  {r['path']}  ({r['basis']})")
            for r in rows.groupBy("verdict").count().orderBy("verdict").collect():
                print(f"{r['verdict']}: {r['count']}")
            return 0
    shown = rows.orderBy("ordinal").drop("ordinal")
    lines = shown.select(F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "false"}).alias("j"))
    print(json.dumps([json.loads(r["j"]) for r in lines.toLocalIterator()], indent=2))
    return 0
