import json
import threading
from urllib.request import Request, urlopen

import pytest

from lodestone.config import Settings
from lodestone.operators import builder
from lodestone.service import Service, display


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(0, 0, "a.txt:0", "data/a.txt", "alpha beta gamma delta", "note"), (1, 0, "b.txt:0", "data/b.txt", "nothing to see in here", "note")]
    return spark.createDataFrame(rows, "doc_ord long, chunk_index int, chunk_id string, source string, text string, doc_type string").cache()


def test_envelopes(chunks):
    service = Service(chunks, Settings(), "2024-02-01T00:00:00Z")
    found = service.chat("alpha beta?")
    assert found["answer"] == "alpha beta gamma delta" and [c["chunk_id"] for c in found["citations"]] == ["a.txt:0"]
    assert found["confidence"] in ("high", "low") and not found["abstained"]
    assert found["message"]["citations_summary"] == {"count": 1, "total_count": 1, "hidden_count": 0, "label": "citations available"}
    lost = service.chat("zebra")
    assert lost["abstained"] and lost["confidence"] == "abstain" and lost["reason_code"] == "no_supporting_evidence"
    assert service.chat("  ")["abstained"]
    mock = Service(chunks, Settings(generation_mode="mock"), "2024-02-01T00:00:00Z").chat("alpha")
    assert mock["answer"] == "[mock] received query: alpha"
    live = Service(chunks, Settings(generation_mode="live"), "2024-02-01T00:00:00Z").chat("alpha")
    assert live["reason_code"] == "live_adapter_unconfigured"


def test_http(chunks):
    server = Service(chunks, Settings(retrieval_backend="tfidf"), "2024-02-01T00:00:00Z").serve(port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    health = json.load(urlopen(f"{base}/api/health"))
    assert health["status"] == "ok" and health["chunks_indexed"] == 2
    assert json.load(urlopen(f"{base}/ingestion/diagnostics"))["files"] == []
    found = json.load(urlopen(Request(f"{base}/chat", json.dumps({"query": "gamma"}).encode(), method="POST")))
    assert found["answer"] == "alpha beta gamma delta"
    server.shutdown()


def test_tables_are_answered_by_their_rows(spark):
    docs = spark.createDataFrame([(0, "data/t.txt", "name | quarter\nalpha | q1\nbeta | q2"), (1, "data/p.txt", "alpha is a word of prose")], "doc_ord long, source string, text string")
    index, _ = builder.build_chunks(docs, Settings(), now="2024-01-01T00:00:00Z")
    thesaurus = {"intent_groups": {"tabular": ["table"]}}
    service = Service(index, Settings(retrieval_diagnostics_mode="verbose"), "2024-02-01T00:00:00Z", thesaurus=thesaurus)
    found = service.chat("table alpha q1")
    assert found["answer"] == "alpha | q1" and found["message"]["tabular_trace"]["matched_rows"] == 1
    assert found["message"]["generation"]["grounding_policy"] == "tabular_row_grounded"
    assert found["message"]["provenance_validation"]["complete"] and found["citations"][0]["chunk_id"] == "t.txt:0"
    assert found["message"]["retrieval_diagnostics"]["backend"] == "lexical"
    lost = service.chat("table gamma q4")
    assert lost["abstained"] and lost["reason_code"] == "tabular_row_evidence_missing"
    shown = display(found, "m")
    assert shown["citations"][0]["id"] == "m-0" and [s["status"] for s in shown["signals"]] == ["pass", "pass", "info"]


def test_deleted_sources_are_not_answered_from(spark, chunks):
    from lodestone.operators.retrievers import RECORD
    from lodestone.functions import text as t

    unit = chunks.select(t.source_unit_id("source").alias("u")).where("source = 'data/a.txt'").first().u
    records = spark.createDataFrame([(unit, "data/a.txt", "f", "", "", "2024-01-01T00:00:00Z", "soft_deleted")], RECORD)
    assert Service(chunks, Settings(), "2024-02-01T00:00:00Z", records=records).chat("alpha beta")["abstained"]
