"""Commands: evaluate, audit, cleanup, dedupe, reset, serve.

    python -m lodestone.cli evaluate --data data --dataset eval/datasets/a.jsonl
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import service, storage
from lodestone.config import Settings, read_thesaurus
from lodestone.operators import answers, builder, evaluation, lifecycle, provenance, retrieval, retrievers
from lodestone.sources import parsers, state


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def ingest(spark: SparkSession, root: str, settings: Settings, now: str, records: DataFrame | None = None):
    """(index, lifecycle state, files): a folder read, built and written."""
    documents, files = parsers.load_documents(spark, root, now)
    folder = storage.new_folder(spark, "index")
    chunks, after = builder.build_chunks(documents, settings, records, now, folder=f"{folder}/documents")
    index = retrievers.Index.write(chunks, folder)
    return index, after, builder.ingestion_files(files, index.chunks)


def evaluate(
    spark: SparkSession, root: str, datasets: list[str], settings: Settings, now: str, thesaurus: dict | None = None, records: DataFrame | None = None
) -> dict:
    """The report of an evaluation: every sample of the datasets asked of the documents below ``root``."""
    lines = storage.written(evaluation.read_samples(spark, datasets), storage.new_folder(spark, "samples"))
    samples = lines.where("query is not null").drop("issues")
    index, _, _ = ingest(spark, root, settings, now, records)
    instant = F.to_timestamp(F.lit(now))
    request = retrievers.Request(samples.select("query_id", "query"), index, settings, thesaurus, records, instant)
    found = storage.written(
        retrievers.evidence(retrievers.retrieve(request), index), storage.new_folder(spark, "evidence")
    )  # top_k rows a sample
    tabular = F.coalesce(retrieval.tabular_intent("query", thesaurus), F.lit(False))
    queries = samples.select("query_id", "query", tabular.alias("tabular"))
    context, _ = answers.ground(queries, found)
    trust = service.trusted(queries, context, settings, instant, thesaurus)
    said = service.answered(queries, context, settings.generation_mode)
    sound = provenance.validate_provenance(queries, context, answers.citations(context), context.select("chunk_id", "source"))
    metrics = evaluation.summarise(evaluation.judge(samples, found, context, said, trust, sound))
    return state.evaluation_report(metrics, evaluation.dataset_sanity(lines), evaluation.issue_preview(lines), settings, datasets)


def cleanup(spark: SparkSession, folder: str, older_than_days: int | None, dry_run: bool, now: str) -> dict:
    """Purge deleted units from the state in ``folder``; a dry run only counts."""
    store = state.StateStore(spark, folder)
    records, instant = store.read(), F.to_timestamp(F.lit(now))
    report = lifecycle.purge_report(records, instant, older_than_days).first().asDict() | {"dry_run": dry_run}
    if not dry_run and report["purged_count"]:
        store.write(lifecycle.purge(records, instant, older_than_days))
    return report


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, **options):
        added = commands.add_parser(name)
        for option, more in options.items():
            added.add_argument("--" + option.replace("_", "-"), **more)

    profile = {"default": "profiles/default.json"}
    command(
        "evaluate", data={"default": "data"}, dataset={"action": "append", "default": []}, profile=profile, thesaurus={"default": None},
        top_k={"type": int, "default": 5}, min_retrieval_score={"type": float, "default": 0.25},
        generation_mode={"default": "extractive"}, reports={"default": "eval/reports"},
    )
    command("audit", state={"required": True}, log={"required": True}, format={"choices": ["json", "markdown"], "default": "json"})
    command("cleanup", state={"required": True}, older_than_days={"type": int}, dry_run={"action": "store_true"})
    command("dedupe", data={"default": "data"}, top={"type": int, "default": 20})
    command("reset", reports={"default": "eval/reports"}, datasets={}, scratch={}, state={}, confirm={"action": "store_true"})
    command("serve", data={"default": "data"}, profile=profile, port={"type": int, "default": 8000})
    return parser


def run(spark: SparkSession, given: argparse.Namespace) -> str:
    """The output of a command."""
    now = utc_now()
    if given.command == "evaluate":
        asked = {k: getattr(given, k) for k in ("top_k", "min_retrieval_score", "generation_mode")}
        settings = Settings.from_profile(given.profile, data_path=given.data, **asked)
        thesaurus = read_thesaurus(given.thesaurus or settings.thesaurus_path)
        report = evaluate(spark, given.data, given.dataset, settings, now, thesaurus)
        if not report["sample_count"]:
            return "No evaluation rows found."
        return "\n".join(str(p) for p in state.write_report(report, given.reports))
    if given.command == "audit":
        report = lifecycle.audit_report(state.StateStore(spark, given.state).read(), state.read_events(spark, given.log))
        if given.format == "markdown":
            return state.audit_markdown(report)
        sections: dict[str, dict] = {}
        for r in report.collect():  # a row for each status and action
            sections.setdefault(r.section, {})[r.name] = r.n
        return json.dumps(sections, indent=2, sort_keys=True)
    if given.command == "cleanup":
        return json.dumps(cleanup(spark, given.state, given.older_than_days, given.dry_run, now), sort_keys=True)
    if given.command == "dedupe":
        documents, _ = parsers.load_documents(spark, given.data, now)
        found = {"files": evaluation.duplicate_groups(documents), "lines": evaluation.repeated_lines(documents)}
        return json.dumps({k: [r.asDict() for r in evaluation.most_frequent(v, given.top).collect()] for k, v in found.items()}, indent=2)
    if given.command == "reset":
        paths = state.reset_workspace(given.reports, given.datasets, given.scratch, given.state, given.confirm)
        return "\n".join([*paths, f"{len(paths)} {'removed' if given.confirm else 'would be removed; confirm with --confirm'}"])
    settings = Settings.from_profile(given.profile, data_path=given.data)
    index, _, files = ingest(spark, given.data, settings, now)
    served = service.Service(index, settings, now, parsers.diagnostics(files), read_thesaurus(settings.thesaurus_path), files=files)
    served.serve(port=given.port).serve_forever()
    return ""


def main(words: list[str] | None = None) -> None:
    given = arguments().parse_args(words)
    spark = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(run(spark, given))


if __name__ == "__main__":
    main()
