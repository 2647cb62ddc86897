"""Lifecycle state, audit log, evaluation reports and workspace: what the engine keeps between runs."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators.retrievers import RECORD

FIELDS = [f.strip().split()[0] for f in RECORD.split(",")]
EVENT = "event_iso_ts string, action string, source_unit_id string, details map<string,string>"


class StateStore:
    """Lifecycle records as numbered snapshots; the largest number that was written whole is the state.

    A reader always finds a whole snapshot, and a writer that fails leaves the one before it.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        if not storage.exists(self.spark, self.folder):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)]
        numbers = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
        return [n for n in numbers if storage.exists(self.spark, f"{self.folder}/v={n}/_SUCCESS")]

    def read(self) -> DataFrame:
        """The latest records; none before the first write."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(f"{self.folder}/v={found[-1]}")

    def write(self, records: DataFrame, keep: int = 2, after: int | None = None) -> int:
        """A new snapshot; older ones than the last ``keep`` go.

        It follows the snapshot ``after`` that its records were made from, by default the latest.  The next number is
        claimed by a file that only one writer can create, so of two writers the later gets ``StateChanged``,
        and neither overwrites what the other wrote.  Rows are written under another name and renamed when whole.
        """
        found = self.versions()
        number = (after if after is not None else found[-1] if found else 0) + 1
        made = f"{self.folder}/new-{uuid.uuid4().hex}"
        records.select(FIELDS).write.parquet(made)
        claim = f"{self.folder}/claim-{number}"
        if number in found or not storage.claimed(self.spark, claim):
            storage.discard(self.spark, made)
            raise StateChanged(f"snapshot {number} of {self.folder} was written, or is being written, by another writer")
        storage.renamed(self.spark, made, f"{self.folder}/v={number}")
        for old in found[: max(0, len(found) + 1 - keep)]:
            storage.discard(self.spark, f"{self.folder}/v={old}")
            storage.discard(self.spark, f"{self.folder}/claim-{old}")
        return number

    def give_up(self, number: int) -> None:
        """Free the number of a writer that is known to have died between its claim and its snapshot."""
        if number not in self.versions():
            storage.discard(self.spark, f"{self.folder}/claim-{number}")


class StateChanged(RuntimeError):
    """Another writer was first; read the state again."""


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON object keyed by unit; none if the file is absent or unreadable."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        found = None
    rows = []
    for unit, value in (found if isinstance(found, dict) else {}).items():
        if isinstance(value, dict):
            mark = value.get("deletion_mark_iso_ts")
            text = {f: str(value.get(f, "active" if f == "status" else "")) for f in FIELDS}
            rows.append(tuple((text | {"source_unit_id": unit, "deletion_mark_iso_ts": None if mark is None else str(mark)})[f] for f in FIELDS))
    return spark.createDataFrame(rows, RECORD)


def export_json(records: DataFrame, path: str) -> None:
    """Records as one JSON object with sorted keys; for states that a single file is meant to hold."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for n, row in enumerate(records.select(FIELDS).orderBy("source_unit_id").toLocalIterator()):
            out.write(f"{',' if n else ''}\n  {json.dumps(row.source_unit_id)}: {json.dumps(row.asDict(), sort_keys=True)}")
        out.write("\n}\n")


def append_events(events: DataFrame, folder: str) -> None:
    """Add events (``EVENT``) to the audit log, one JSON object a line."""
    events.write.mode("append").json(folder)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the audit log; blank and unreadable lines are left out."""
    if not storage.exists(spark, folder):
        return spark.createDataFrame([], EVENT)
    found = spark.read.schema(f"{EVENT}, _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    return found.where("_corrupt_record is null and (action is not null or source_unit_id is not null)").drop("_corrupt_record")


def audit_markdown(report: DataFrame) -> str:
    """The audit report (section, name, n) as Markdown; it has a row for each status and action, not for each record."""
    titles = {"state": "State summary", "status": "Statuses", "timestamps": "Timestamps", "events": "Events", "reingestion": "Ingestion"}
    rows = report.collect()
    lines = ["# Lifecycle audit"]
    for section, title in titles.items():
        found = sorted((r.name, r.n) for r in rows if r.section == section)
        lines += ["", f"## {title}", "", *[f"- {name}: {n}" for name, n in found or [("none", 0)]]]
    return "\n".join(lines) + "\n"


def evaluation_report(metrics: DataFrame, sanity: DataFrame, issues: DataFrame, settings, datasets: list[str]) -> dict:
    """One report of an evaluation: figures, the state of its datasets and the options that matter."""
    row = metrics.first().asDict()
    whole = [r.asDict() for r in sanity.orderBy("dataset").collect()]  # a row for each dataset
    total = next(r for r in whole if r["dataset"] is None)
    return {
        "datasets": datasets,
        "sample_count": row.pop("sample_count"),
        "metrics": row,
        "dataset_sanity": {k: v for k, v in total.items() if k != "dataset"}
        | {"datasets_checked": len(datasets), "per_dataset": [r for r in whole if r["dataset"] is not None]}
        | {"issue_preview": [r.asDict() for r in issues.collect()]},
        "config": {k: getattr(settings, k) for k in ("top_k", "min_retrieval_score", "generation_mode", "data_path")},
    }


def write_report(report: dict, folder: str, now: datetime | None = None) -> tuple[Path, Path]:
    """The report as JSON and as Markdown, named by the time."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    as_json, as_text = base / f"offline_eval_{stamp}.json", base / f"offline_eval_{stamp}.md"
    as_json.write_text(json.dumps({"timestamp": stamp} | report, indent=2) + "\n", encoding="utf-8")
    sanity = report["dataset_sanity"]
    lines = ["# Offline evaluation", "", f"Samples: {report['sample_count']}", "", "| Metric | Value |", "|---|---:|"]
    lines += [f"| {name} | {value:.4f} |" for name, value in report["metrics"].items()]
    lines += ["", "## Datasets", ""]
    lines += [f"- {k}: {sanity[k]}" for k in ("datasets_checked", "nonempty_lines", "valid_rows", "invalid_rows", "parse_errors")]
    if sanity["issue_preview"]:
        lines += ["", "| Dataset | Line | Code | Detail |", "|---|---:|---|---|"]
        lines += [f"| {i['dataset']} | {i['line']} | {i['code']} | {i['detail']} |" for i in sanity["issue_preview"]]
    as_text.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return as_json, as_text


def reset_workspace(
    reports: str, datasets: str | None = None, scratch: str | None = None, state: str | None = None, confirm: bool = False
) -> list[str]:
    """Paths that a reset removes: reports, and datasets, scratch documents and state where they are named.

    Without ``confirm`` nothing is touched.
    """
    import shutil

    found = sorted(Path(reports).glob("offline_eval_*"))
    if datasets:
        found += sorted(Path(datasets).glob("*.jsonl"))
    found += [Path(p) for p in (scratch, state) if p and Path(p).exists()]
    if confirm:
        for path in found:
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    return [str(p) for p in found]
