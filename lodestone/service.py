"""The engine behind HTTP: health, ingestion diagnostics, and answers to questions.

The index is written once and only read here.  A question is a batch of one: its evidence, at most ``top_k``
rows, is gathered once, and everything after the ranking is a plan over those rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.config import Settings
from lodestone.functions import text as t
from lodestone.operators import answers, provenance, retrieval, retrievers
from lodestone.operators.retrievers import Index, Request

VERSION = "1.0"
#: The answer to a blank question, and what its message says of citations.
BLANK = "Please provide a query."
NO_CITATIONS = {"count": 0, "total_count": 0, "hidden_count": 0, "label": "no citations"}
POLICIES = {"live": "implementation_hook", "mock": "mock_passthrough", "tabular": "tabular_row_grounded", "extractive": "extractive_grounded"}


def answered(queries: DataFrame, context: DataFrame, mode: str) -> DataFrame:
    """Answers of a mode; queries (query_id, query, tabular) with tabular intent are answered from table rows."""
    if mode in ("mock", "live"):
        return answers.fixed_answers(queries, context, mode)
    prose = answers.extractive_answers(queries.where("not tabular"), context)
    return prose.unionByName(answers.tabular_answers(queries.where("tabular"), context))


def trusted(queries: DataFrame, context: DataFrame, settings: Settings, now, thesaurus: dict | None) -> DataFrame:
    """Confidence of every query by what its context carries."""
    own = lambda name, kind: F.col(name) if name in context.columns else F.lit(None).cast(kind)
    rows = context.withColumns(
        {
            "tier": t.extraction_tier(F.coalesce(own("extraction_method", "string"), F.lit("text_parser"))),
            "status": own("status", "string"),
            "deleted": F.coalesce(own("deletion_mark_iso_ts", "string"), F.lit("")) != "",
            "ts": t.parse_ts(own("last_upsert_iso_ts", "string")),
            "is_tabular": F.coalesce(own("is_tabular", "boolean"), F.lit(False)),
        }
    )
    named = answers.query_intents(queries, thesaurus).join(queries.select("query_id", "tabular"), "query_id")
    tabular = F.array(F.lit("tabular"))
    intents = named.select("query_id", F.when(F.col("tabular"), F.array_union(tabular, "intents")).otherwise(F.col("intents")).alias("intents"))
    return answers.confidence(rows, settings, now, intents, queries)


@dataclass
class Service:
    """``chunks`` is an index, or a table of chunks that becomes one."""

    chunks: DataFrame | Index
    settings: Settings
    now: str
    diagnostics: DataFrame | None = None
    thesaurus: dict | None = None
    records: DataFrame | None = None
    files: DataFrame | None = None
    index: Index = field(init=False)

    def __post_init__(self) -> None:
        if isinstance(self.chunks, Index):
            self.index = self.chunks
        else:
            self.index = Index.write(self.chunks, storage.new_folder(self.chunks.sparkSession, "index"))

    def chat(self, question: str) -> dict:
        question = question.strip()
        if not question:
            return {
                "contract_version": VERSION, "message": {"text": BLANK, "citations_summary": dict(NO_CITATIONS)}, "citations": [],
                "collapsed_citations": [], "confidence": "abstain", "answer": BLANK, "abstained": True,
            }
        spark = self.index.chunks.sparkSession
        now = F.to_timestamp(F.lit(self.now))
        asked = spark.createDataFrame([(0, question)], "query_id long, query string")
        request = Request(asked, self.index, self.settings, self.thesaurus, self.records, now)
        response = retrievers.retrieve(request)
        found = retrievers.evidence(response, self.index)
        absent = {n: F.lit(None).cast(k) for n, k in (("is_tabular", "boolean"), ("status", "string")) if n not in found.columns}
        found = found.withColumns(absent) if absent else found
        held = spark.createDataFrame(found.collect(), found.schema)  # top_k rows at most
        queries = asked.withColumn("tabular", F.coalesce(retrieval.tabular_intent("query", self.thesaurus), F.lit(False)))
        context, trace = answers.ground(queries, held)
        sound = provenance.complete_sources(context)
        mode = self.settings.generation_mode
        said = answered(queries, sound, mode)
        raw = answers.citations(answers.used_citations(sound, said))
        cited = provenance.complete_citations(raw, sound.select("chunk_id", "source"))
        trust = trusted(queries, sound, self.settings, now, self.thesaurus)
        body = json.loads(answers.envelopes(asked, said, cited, trust).first().envelope)
        traced = trace.first().asDict()
        body["confidence"] = body["confidence"] if body["confidence"] in ("high", "low") else "abstain"
        message = body["message"]
        message["tabular_trace"] = {k: v for k, v in traced.items() if k != "query_id" and v is not None}
        kept, all_cited = cited.count(), raw.count()
        checks = {
            "source_validation": provenance.validate_sources(sound),
            "citation_validation": provenance.validate_citations(cited),
            "citation_quality": provenance.validate_quality(cited, sound.select("chunk_id", "source")),
        }
        message["provenance_validation"] = {k: v.first().asDict() for k, v in checks.items()}
        message["provenance_validation"]["complete"] = all(v["invalid"] == 0 for v in message["provenance_validation"].values())
        message["provenance_validation"]["enforcement"] = {
            "source_chunks": {"input_total": context.count(), "retained": sound.count()},
            "citations": {"input_total": all_cited, "retained": kept, "dropped": all_cited - kept},
        }
        message["generation"]["grounding_policy"] = POLICIES[mode if mode in ("mock", "live") else "tabular" if traced["tabular_intent"] else "extractive"]
        if str(self.settings.retrieval_diagnostics_mode).lower() in ("summary", "verbose"):
            message["retrieval_diagnostics"] = json.loads(response.diagnostics.select(F.to_json(F.struct("*"))).first()[0])
        return body

    def health(self) -> dict:
        return {
            "status": "ok",
            "mode": self.settings.generation_mode,
            "contract_version": VERSION,
            "chunks_indexed": self.index.chunks.count(),
        }

    def ingestion(self) -> dict:
        """Diagnostics of the last ingestion: a summary, and the files where they are known."""
        summary = {} if self.diagnostics is None else self.diagnostics.first().asDict()
        files = [] if self.files is None else [r.asDict() for r in self.files.toLocalIterator()]
        return {"contract_version": VERSION, "files": files, "summary": summary}

    def handler(self) -> type[BaseHTTPRequestHandler]:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _send(self, body: dict, status: int = 200) -> None:
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                routes = {"/health": service.health, "/ingestion/diagnostics": service.ingestion}
                route = routes.get(self.path.removeprefix("/api"))
                self._send(route()) if route else self._send({"error": "not found"}, 404)

            def do_POST(self) -> None:
                if self.path.removeprefix("/api") != "/chat":
                    return self._send({"error": "not found"}, 404)
                size = int(self.headers.get("Content-Length") or 0)
                try:
                    question = json.loads(self.rfile.read(size) or b"{}").get("query") or ""
                except (ValueError, AttributeError):
                    return self._send({"error": "a JSON object with a query is needed"}, 400)
                self._send(service.chat(str(question)))

            def log_message(self, *_: object) -> None:
                pass

        return Handler

    def serve(self, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
        return ThreadingHTTPServer((host, port), self.handler())


def display(body: dict, message_id: str) -> dict:
    """An envelope as a page shows it: five citations at most, and signals of how the answer came about."""
    message = body.get("message") or {}
    cited = body.get("citations") if isinstance(body.get("citations"), list) else body.get("sources")
    cited = cited if isinstance(cited, list) else []
    signals = []
    if isinstance(checks := message.get("provenance_validation"), dict):
        passed = checks.get("complete") is True
        signals.append({"key": "provenance", "label": f"Provenance {'pass' if passed else 'warn'}", "status": "pass" if passed else "warn"})
    if isinstance(made := message.get("generation"), dict):
        gone = made.get("abstained") is True
        signals.append({"key": "generation", "label": f"Generation {'abstained' if gone else 'grounded'}", "status": "warn" if gone else "pass"})
    if isinstance(message.get("tabular_trace"), dict):
        signals.append({"key": "tabular", "label": "Tabular trace", "status": "info"})
    return {
        "content": body.get("answer") or message.get("text") or "No answer returned.",
        "citations": [
            {
                "id": f"{message_id}-{n}",
                "title": c.get("title") or c.get("document") or f"Source {n + 1}",
                "snippet": c.get("snippet") or c.get("text") or c.get("content") or "Retrieved evidence will appear here.",
                "link": c.get("link") or "#",
            }
            for n, c in enumerate(cited[:5])
        ],
        "confidence": body.get("confidence") or ("High" if cited else "Low"),
        "score": body.get("score"),
        "signals": signals,
    }
