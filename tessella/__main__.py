"""Command line: normalize, plan-media, export-dataset, validate, status, run, init, doctor. Exit 0 ok, 1 failed, 2 usage, 130 interrupted."""

from __future__ import annotations

import argparse
import difflib
import json
import sys
from pathlib import Path

COMMANDS = ("normalize", "plan-media", "export-dataset", "validate", "status", "run", "init", "doctor")
AREAS = ("inputs", "captures", "media", "datasets", "runs")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("--root", default=".")
    s = p.add_subparsers(dest="command", required=True)
    n = s.add_parser("normalize", help="post files to a normalised Parquet table")
    n.add_argument("selected")
    n.add_argument("out")
    m = s.add_parser("plan-media", help="download jobs of a capture, as JSON lines")
    m.add_argument("selected")
    m.add_argument("out")
    m.add_argument("--accounts", nargs="*")
    for kind in ("covers", "slides", "avatars"):
        m.add_argument(f"--no-{kind}", action="store_true")
    m.add_argument("--dry-run", metavar="MEDIA", help="only report what is planned and still missing in this media folder")
    e = s.add_parser("export-dataset", help="publish a dataset folder")
    for a in ("selected", "media", "out"):
        e.add_argument(a)
    e.add_argument("--zip", action="store_true")
    e.add_argument("--dry-run", action="store_true")
    e.add_argument("--require-verified-media", action="store_true")
    v = s.add_parser("validate", help="check a published dataset")
    v.add_argument("dataset")
    s.add_parser("status", help="files of each area")
    r = s.add_parser("run", help="export and validate with a resumable state")
    for a in ("state", "selected", "media", "datasets"):
        r.add_argument(a)
    s.add_parser("init", help="make the areas")
    s.add_parser("doctor", help="check the environment")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    word = next((a for a in argv if not a.startswith("-")), "")
    if word and word not in COMMANDS and "--root" not in argv:
        near = difflib.get_close_matches(word, COMMANDS, 1)
        print(f"unknown command {word!r}" + (f"; did you mean {near[0]}?" if near else ""), file=sys.stderr)
        return 2
    try:
        a = parser().parse_args(argv)
    except SystemExit as x:
        return 0 if x.code in (0, None) else 2
    try:
        return _run(a)
    except KeyboardInterrupt:
        return 130
    except Exception as x:
        print(f"{type(x).__name__}: {x}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace) -> int:
    from .plans import state

    root = Path(a.root)
    if a.command == "init":
        for d in AREAS:
            (root / d).mkdir(parents=True, exist_ok=True)
        return 0
    if a.command == "status":
        print(json.dumps(state.workspace_status(root)))
        return 0
    from .session import session

    spark = session()
    if a.command == "doctor":
        print(json.dumps({"spark": spark.version, "rows": spark.range(3).count()}))
        return 0
    from pyspark.sql import functions as F

    from .plans import export, media, normalize, validate
    from .sources import text

    if a.command == "normalize":
        normalize.normalized_posts(normalize.split_items(text.posts(spark, a.selected))[0], ["source_file", "record"]).select(*normalize.COLUMNS).write.parquet(a.out)
    elif a.command == "plan-media":
        planned = media.plan_posts(text.posts(spark, a.selected), a.accounts)
        jobs = media.job_fingerprints(media.download_jobs(planned, not a.no_covers, not a.no_slides, not a.no_avatars), planned)
        if a.dry_run:
            present = text.media_files(spark, a.dry_run).select(F.col("relative").alias("path"), "length")
            print(json.dumps(media.plan_report(planned, jobs, present).first().asDict()))
        else:
            jobs.write.json(a.out)
    elif a.command == "export-dataset":
        print(json.dumps(export.export_dataset(spark, a.selected, a.media, a.out, archive=a.zip, dry_run=a.dry_run, require_verified=a.require_verified_media)["counts"]))
    elif a.command == "validate":
        report = validate.validate(spark, a.dataset)
        print(json.dumps(report))
        return int(not report["ok"])
    else:
        return int(state.run_pipeline(spark, Path(a.state), a.selected, a.media, a.datasets, {"selected": a.selected, "media": a.media})["status"] != "completed")
    return 0


if __name__ == "__main__":
    sys.exit(main())
