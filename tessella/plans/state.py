"""Run state: batches of accounts, a four-stage state machine with durable checkpoints, resume, revisions, one writer."""

from __future__ import annotations

import contextlib
import fcntl
import json
import math
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inventory import chunks
from ..sources.capture import StateError, capture_fingerprint, fingerprint
from .export import atomic_write

# The stages in order, and what a stage or a run can be.
VERSION = "creative-capture-run-v1"
STAGES = ("scrape", "download", "export", "validate")
STATUSES = ("pending", "running", "completed", "partial", "failed", "interrupted")
FAILED_BATCH = ("FAILED", "TIMED-OUT", "ABORTED")


def now() -> str:
    return datetime.now(UTC).isoformat()


def batches(accounts: DataFrame, size: int) -> DataFrame:
    """(batch_index, profiles): accounts in order, ``size`` to a batch."""
    if isinstance(size, bool) or size < 1:
        raise ValueError("the batch size must be positive")
    return chunks(accounts, "ord", "account", size).select(F.col("chunk").alias("batch_index"), F.col("members").alias("profiles"))


def batch_action(planned: DataFrame, previous: DataFrame) -> DataFrame:
    """planned (batch_index, items_sha256) against previous (batch_index, checkpoint, status, items_sha256, run_id): what to do with each.

    A completed batch with unchanged items is skipped; a waiting one is awaited by its run id; one
    whose launch has an unknown outcome is never repeated by itself; a failed or new one starts.
    """
    p = previous.select("batch_index", "checkpoint", "status", F.col("items_sha256").alias("was"), "run_id")
    j = planned.join(p, "batch_index", "left")
    act = (
        F.when(F.col("checkpoint").isNull(), "start")
        .when((F.col("checkpoint") == "completed") & F.col("was").eqNullSafe(F.col("items_sha256")), "skip")
        .when(F.col("checkpoint") == "launch_unknown", "refuse")
        .when(F.col("checkpoint").isin("launching") & F.col("run_id").isNull(), "refuse")
        .when(F.col("status").isin(*FAILED_BATCH) | (F.col("checkpoint") == "launch_rejected"), "start")
        .when(F.col("run_id").isNotNull(), "wait")
        .otherwise("start")
    )
    return j.select("batch_index", act.alias("action"))


@contextlib.contextmanager
def single_writer(root: Path) -> Iterator[None]:
    """One writer a folder, other processes and threads refused at once; the same thread may enter again."""
    key, me = str(Path(root).resolve()), threading.get_ident()
    with _guard:
        held = _held.get(key)
        if held and held[0] != me:
            raise StateError("another writer is at work")
        if held:
            held[2] += 1
        else:
            f = open(Path(root, ".lock"), "w")  # noqa: SIM115
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                f.close()
                raise StateError("another writer is at work") from None
            _held[key] = [me, f, 1]
    try:
        yield
    finally:
        with _guard:
            held = _held[key]
            held[2] -= 1
            if not held[2]:
                held[1].close()
                del _held[key]


_guard, _held = threading.Lock(), {}


def check_options(config: dict) -> None:
    """Refuse options that can't be: counts must be positive, retries not negative, times and the charge cap finite and positive."""
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    for name in ("batch_size", "max_posts", "actor_timeout", "concurrency", "checkpoint_every"):
        if name in config and not (whole(config[name]) and config[name] >= 1):
            raise ValueError(f"{name} must be positive")
    if "retries" in config and not (whole(config["retries"]) and config["retries"] >= 0):
        raise ValueError("retries can't be negative")
    for name in ("timeout", "max_charge_usd"):
        v = config.get(name)
        if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v <= 0):
            raise ValueError(f"{name} must be finite and positive")


def require_keys(config: dict, keys: set[str]) -> None:
    if gone := sorted(keys - set(config)):
        raise StateError(f"the configuration lacks {', '.join(gone)}")


def new_run(path: Path, config: dict) -> dict:
    if path.exists():
        raise StateError(f"{path} exists; resume it instead")
    check_options(config)
    state = {"schema_version": VERSION, "run_id": uuid.uuid4().hex, "created_at": now(), "status": "pending", "config": config, "config_fingerprint": fingerprint(config), "publication": 0}
    state["stages"] = {s: {"status": "pending", "attempts": 0} for s in STAGES}
    save(path, state)
    return state


def save(path: Path, state: dict) -> None:
    atomic_write(path, json.dumps(state, indent=2, ensure_ascii=False, default=str).encode())


def load(path: Path, config: dict | None = None) -> dict:
    """The checkpoint, or an error that leaves the file as it is: any field of the wrong form is refused."""
    try:
        s = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise StateError(f"unreadable checkpoint: {type(e).__name__}") from None
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    ok = (
        isinstance(s, dict) and s.get("schema_version") == VERSION and isinstance(s.get("run_id"), str) and len(s["run_id"]) == 32 and set(s["run_id"]) <= set("0123456789abcdef")
        and s.get("status") in STATUSES and isinstance(s.get("config"), dict) and s.get("config_fingerprint") == fingerprint(s["config"]) and whole(s.get("publication"))
        and isinstance(s.get("stages"), dict) and set(s["stages"]) == set(STAGES)
        and all(isinstance(x, dict) and x.get("status") in STATUSES and whole(x.get("attempts")) and isinstance(x.get("result", {}), dict) and isinstance(x.get("error", ""), str) for x in s["stages"].values())
    )
    if not ok:
        raise StateError("the checkpoint has an invalid form")
    if config is not None and fingerprint(config) != s["config_fingerprint"]:
        raise StateError("the configuration differs from the run's")
    return s


def run_stage(path: Path, state: dict, stage: str, work: Callable[[], dict], reuse: Callable[[dict], bool] = lambda _: False) -> dict:
    """Run a stage with a checkpoint before and after; a completed one that may be reused isn't run again."""
    own = state["stages"][stage]
    if own["status"] == "completed" and reuse(own.get("result", {})):
        return own["result"]
    own |= {"status": "running", "attempts": own["attempts"] + 1, "started_at": now()}
    own.pop("error", None)
    state["status"] = "running"
    save(path, state)
    try:
        result = work()
    except BaseException as e:
        own |= {"status": "interrupted" if isinstance(e, KeyboardInterrupt) else "failed", "error": type(e).__name__, "finished_at": now()}
        state["status"] = own["status"]
        save(path, state)
        raise
    own |= {"status": "completed" if result.get("complete", True) else "partial", "result": result, "finished_at": now()}
    save(path, state)
    return result


def next_revision(folder: Path) -> Path:
    """datasets/NNNN, one beyond the highest; published revisions never change."""
    taken = [int(p.name) for p in folder.glob("[0-9][0-9][0-9][0-9]") if p.is_dir()]
    return folder / f"{max(taken, default=0) + 1:04d}"


def published_by(folder: Path, lineage: dict) -> Path | None:
    """The revision that a run published from these inputs, if one is there: the run may have ended before it could say so."""
    for p in sorted(folder.glob("[0-9][0-9][0-9][0-9]"), reverse=True):
        manifest = p / "manifest.json"
        if manifest.is_file() and json.loads(manifest.read_text(encoding="utf-8")).get("pipeline") == lineage:
            return p
    return None


def finish(path: Path, state: dict) -> dict:
    states = {s["status"] for s in state["stages"].values()}
    state["status"] = "completed" if states == {"completed"} else "failed" if "failed" in states else "interrupted" if "interrupted" in states else "partial"
    state["finished_at"] = now()
    save(path, state)
    return state


def workspace_status(root: Path, areas: tuple[str, ...] = ("inputs", "captures", "media", "datasets", "runs")) -> dict[str, int | None]:
    """Files below each area; null where it is absent."""
    return {a: sum(len(f) for _, _, f in os.walk(root / a)) if (root / a).is_dir() else None for a in areas}


def run_pipeline(spark, path: Path, selected: str, media: str, datasets: str, config: dict, capture: Callable[[], dict] | None = None, download: Callable[[], dict] | None = None) -> dict:
    """Capture and download as given (both optional: no acquisition here), then export and validate; resumes at ``path``."""
    from . import export, validate

    with single_writer(path.parent):
        state = load(path, config) if path.exists() else new_run(path, config)
        own = lambda: capture_fingerprint(Path(selected), spark, f"{path.parent}/.capture")
        run_stage(path, state, "scrape", capture or (lambda: {"complete": True, "fingerprint": own()}))
        run_stage(path, state, "download", download or (lambda: {"complete": True}))
        inputs = fingerprint({"capture": own(), "media": sorted((p.relative_to(media).as_posix(), p.stat().st_size, p.stat().st_mtime_ns) for p in Path(media).rglob("*") if p.is_file())})

        def publish() -> dict:
            lineage = {"run_id": state["run_id"], "inputs": inputs}
            target = published_by(Path(datasets), lineage)
            if target:
                told = json.loads((target / "manifest.json").read_text(encoding="utf-8"))
            else:
                target = next_revision(Path(datasets))
                target.parent.mkdir(parents=True, exist_ok=True)
                told = export.export_dataset(spark, selected, media, str(target), lineage=lineage, require_verified=bool(config.get("require_verified_media")))
            state["publication"] += 1
            return {"complete": told["completion"]["media"], "dataset": str(target), "inputs": inputs}

        told = run_stage(path, state, "export", publish, lambda r: r.get("inputs") == inputs and Path(r.get("dataset", "")).is_dir())
        if config.get("zip"):
            export.ensure_zip(Path(told["dataset"]))  # made again if a run ended before it, else verified
        run_stage(path, state, "validate", lambda: _checked(validate.validate(spark, told["dataset"])))
        return finish(path, state)


def _checked(report: dict) -> dict:
    if not report["ok"]:
        raise StateError(f"invalid dataset: {report['issues'][:3]}")
    return report | {"complete": True}
