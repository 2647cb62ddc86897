import io
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.config import Settings
from lodestone.operators import answers, evaluation, lifecycle, retrieval
from lodestone.sources import parsers
from lodestone.streaming import audit

def now():
    return F.to_timestamp(F.lit("2024-02-01T00:00:00Z"))

RECORD = "source_unit_id string, source string, content_fingerprint string, ingestion_iso_ts string, last_upsert_iso_ts string, deletion_mark_iso_ts string, status string"


def chunks(spark, texts):
    return spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "doc_ord long, chunk_index int, text string")


def asked(spark, query):
    return retrieval.query_terms(spark.createDataFrame([(1, query)], "query_id long, query string"))


def test_overlap_and_jaccard_order_differently(spark):
    index = retrieval.postings(chunks(spark, ["apple apple apple apple", "apple pie", "none"]))
    scores = {m: {r.doc_ord: r.base for r in retrieval.lexical_scores(asked(spark, "apple pie"), index, m).collect()} for m in ("overlap", "jaccard", "containment")}
    assert scores == {"overlap": {0: 2.0, 1: 1.0}, "jaccard": {0: 0.5, 1: 1.0}, "containment": {0: 0.5, 1: 1.0}}


def test_tfidf_of_the_query_itself_is_one(spark):
    found = chunks(spark, ["red house", "blue house", "green tree"])
    scores = retrieval.tfidf_scores(asked(spark, "red house"), retrieval.postings(found), 3).collect()
    assert {r.doc_ord: round(r.base, 6) for r in scores}[0] == 1.0 and len(scores) == 2


def test_fusion_and_ties(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, 0.5), (1, 2, 0, 0.9)], "query_id long, doc_ord long, chunk_index int, score double")
    ranked = retrieval.ranked(rows, None)
    assert [r.doc_ord for r in ranked.orderBy("rank").collect()] == [2, 0, 1]
    fused = {r.doc_ord: r.score for r in retrieval.rrf(ranked, ranked.where("doc_ord < 2"), 60).collect()}
    assert fused == {2: round(1 / 61, 6), 0: round(2 / 62, 6), 1: round(2 / 63, 6)}


def test_expansion_follows_the_order_of_entries():
    thesaurus = {"terms": {"table": ["tabular form"], "grid": ["table"], "late": ["matrix"], "matrix": ["grid"]}}
    assert retrieval.expand_terms("tabular", thesaurus) == ["grid", "matrix", "tabular", "table"] or set(
        retrieval.expand_terms("tabular", thesaurus)
    ) == {"tabular", "table", "grid", "matrix"}


def test_modifiers(spark):
    row = spark.createDataFrame([(3, "policy", True, "Name | Value", "Name | Value\nx | alpha", ["alpha"])], "repeat_count int, doc_type string, is_tabular boolean, header_text string, text string, terms array<string>")
    settings = Settings()
    got = row.select(
        retrieval.boilerplate_factor(settings).alias("b"), retrieval.metadata_weight(settings).alias("m"), retrieval.table_boost(settings, F.lit(True)).alias("t")
    ).first()
    assert (round(got.b, 6), got.m, round(got.t, 6)) == (round(1 / 1.5, 6), 1.1, 1.35)


def test_embedding(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, ""), (4, "zzz")], "id long, text string")
    v = {r.id: r.vector for r in retrieval.embed(texts, "id").collect()}
    assert v[1] == v[2] and not any(v[3]) and abs(sum(x * x for x in v[4]) - 1) < 1e-9 and len(v[1]) == 256


def record(unit, status="active", ts="2024-01-01T00:00:00Z", mark=None, fp="f"):
    return unit, "s", fp, ts, ts, mark, status


def test_filters(spark):
    units = spark.createDataFrame([(u,) for u in ("a", "b", "c", "d", "e", "none", "")], "source_unit_id string")
    records = spark.createDataFrame(
        [record("a"), record("b", mark="x"), record("c", "Retired"), record("d", ts="2020-01-01T00:00:00Z"), record("e", ts="bad")], RECORD
    )
    settings = Settings(status_deny_list=("retired",), freshness_max_age_days=100, freshness_invalid_ts_policy="exclude", lifecycle_require_persisted_record=True)
    found = lifecycle.with_filter_reason(units, records, settings, now())
    assert {r.source_unit_id: r.filter_reason for r in found.collect()} == {
        "a": None, "b": "soft_deleted", "c": "status_denied", "d": "freshness_stale", "e": "freshness_invalid_timestamp",
        "none": "missing_persisted_record", "": "missing_source_unit_id",
    }
    assert lifecycle.filter_diagnostics(found).first().retained == 1


def test_upserts(spark):
    records = spark.createDataFrame([record("a", "soft_deleted", mark="m", fp="1"), record("b", fp="1")], RECORD)
    batch = spark.createDataFrame([("a", "s", "1", 0), ("b", "s", "2", 0), ("c", "s", "1", 0), ("c", "s", "1", 1)], "source_unit_id string, source string, content_fingerprint string, seq int")
    skip = {r.source_unit_id: r for r in lifecycle.upsert(records, batch, "now", True).collect()}
    assert [skip[u].action for u in "abc"] == ["unchanged_skipped", "updated", "unchanged_skipped"]
    assert skip["a"].status == "soft_deleted" and skip["c"].status == "active" and skip["c"].ingestion_iso_ts == "now"
    plain = {r.source_unit_id: r for r in lifecycle.upsert(records, batch, "now").collect()}
    assert plain["a"].status == "active" and plain["a"].deletion_mark_iso_ts is None and plain["a"].ingestion_iso_ts != "now"


def test_soft_delete_and_purge(spark):
    records = spark.createDataFrame([record("a"), record("b"), record("c", "soft_deleted", mark="bad")], RECORD)
    deleted = lifecycle.soft_delete(records, spark.createDataFrame([("a",), ("zz",)], "source_unit_id string"), "2023-01-01T00:00:00Z")
    plan = {r.source_unit_id: r.purge for r in lifecycle.purge_plan(deleted, now(), 30).collect()}
    assert plan == {"a": "purge", "b": "keep", "c": "invalid_mark"}
    assert [r.source_unit_id for r in lifecycle.purge(deleted, now()).collect()] == ["b"]


def test_grounding(spark):
    rows = spark.createDataFrame([(1, "alpha q1", "name | quarter | value\nalpha | q1 | 10\nbeta | q2 | 20"), (2, "gamma q4", "name | v\nalpha | q1")], "query_id long, query string, text string")
    found = {r.query_id: r for r in answers.ground_rows(rows).collect()}
    assert found[1].matched_row_count == 1 and found[1].matched_terms == ["alpha", "q1"] and not found[2].tabular_grounded


def test_grounding_takes_time_in_proportion_to_the_rows(spark):
    """A table of 6000 rows, which took minutes while every row cut the whole text again."""
    text = "name | quarter\n" + "\n".join(f"alpha{i} | q{i % 4}" for i in range(6000))
    rows = spark.createDataFrame([(1, "q1 name", text), (2, None, text), (3, "q1", None)], "query_id long, query string, text string")
    start = time.monotonic()
    found = {r.query_id: r for r in answers.ground_rows(rows, 2).collect()}
    assert time.monotonic() - start < 30
    assert found[1].matched_row_count == 1500 and found[1].matched_rows[0].row_text == "alpha1 | q1"
    assert found[2].matched_row_count == found[3].matched_row_count == 0


EVIDENCE = "query_id long, rank int, score double, chunk_id string, source string, text string, doc_type string"


def test_answers_and_abstentions(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    evidence = spark.createDataFrame([(1, 1, 0.9, "a:0", "a", " some useful text ", "x"), (1, 2, 0.8, "a:0", "a", "more useful text", "x"), (2, 1, 0.9, "b:0", "b", "short", "x")], EVIDENCE)
    found = {r.query_id: r for r in answers.extractive_answers(queries, evidence).collect()}
    assert found[1].answer == "some useful text\nmore useful text" and found[1].cited_chunk_ids == ["a:0"]
    assert (found[2].reason_code, found[3].reason_code) == ("usable_evidence_missing", "no_supporting_evidence")


def test_citation_quality(spark):
    cited = spark.createDataFrame(
        [(1, 1, "a:0", "a", "d/a", "a long enough snippet", 0.9, "a:0", "x"), (1, 2, "q", "a", "d/a", "a long enough snippet", 0.9, "q:9", "x"),
         (1, 3, "a:0", "a", "d/a", "a long enough snippet", 0.9, "a:0", "x"), (1, 4, "b:0", "b", "d/b", "tiny", 0.9, "b:0", "x"), (1, 5, "c:0", "c", " ", "a long enough snippet", 0.9, "c:0", "x")],
        "query_id long, rank int, id string, title string, document string, snippet string, score double, chunk_id string, doc_type string",
    )
    sources = spark.createDataFrame([("a:0", "d/a"), ("b:0", "d/b"), ("c:0", "d/c")], "chunk_id string, source string")
    judged = answers.quality_failures(cited, sources)
    assert {r["rank"]: r.failures for r in judged.collect()} == {1: [], 2: ["source_traceability"], 3: ["duplicate_policy"], 4: ["snippet_adequacy"], 5: ["missing_fields"]}
    assert answers.provenance(judged).first().completeness == 0.2
    assert {r["rank"]: r.visible for r in answers.split_citations(cited).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_confidence(spark):
    schema = "query_id long, rank int, score double, tier string, status string, deleted boolean, ts timestamp, is_tabular boolean, doc_type string"
    rows = spark.createDataFrame([(1, i, 1.0, "structured", "active", False, None, True, "x") for i in (1, 2, 3)] + [(2, 1, 0.1, "plain", "retired", False, None, False, "x")], schema)
    intents = spark.createDataFrame([(2, ["tabular"])], "query_id long, intents array<string>")
    found = {r.query_id: r for r in answers.confidence(rows, Settings(), now(), intents).collect()}
    assert found[1].label == "high" and found[1].score == pytest.approx(1.0)
    assert (found[2].label, found[2].reason) == ("abstain", "tabular_evidence_missing")


def test_samples_and_fallbacks():
    assert evaluation.validate_sample("{") == ["invalid_json"] and evaluation.validate_sample("[]") == ["invalid_row_shape"]
    assert evaluation.validate_sample('{"query": " ", "expected_sources": [1], "excluded_sources": 3}') == ["missing_query", "invalid_field_item_type", "invalid_field_type"]
    entries = [{"id": "reset", "question_examples": ["how do I reset"], "confidence_threshold": 0.4}, {"id": "generic_fallback", "question_examples": []}]
    assert evaluation.choose_fallback("How do I reset?", entries)["id"] == "reset"
    assert evaluation.choose_fallback("How do I reset?", entries, 0.9)["id"] == "generic_fallback"
    assert evaluation.choose_fallback("zzz", entries, faq={"zzz": "reset"})["id"] == "reset"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_parsers(spark):
    assert parsers.json_lines(b'{"user":{"name":"Alice","roles":["admin","analyst"]},"active":true,"e":{}}') == (
        'user.name: "Alice"\nuser.roles[0]: "admin"\nuser.roles[1]: "analyst"\nactive: true\ne: {}'
    )
    assert parsers.html("<p>a<script>no</script></p><p>b</p>") == "a\nb"
    assert parsers.xml(b"<r><a>x</a><b> y </b></r>") == "x\ny"
    mail = b"MIME-Version: 1.0\nContent-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>hello</p>\n--B--\n"
    assert parsers.mhtml(mail) == "hello"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = zipped({
        "xl/workbook.xml": f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="North" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c t="inlineStr"><is><t>Name</t></is></c><c t="inlineStr"><is><t>Value</t></is></c></row><row><c t="inlineStr"><is><t>x</t></is></c><c><v>1</v></c></row></sheetData></worksheet>',
    })
    files = [("a/x.xlsx", book), ("a/y.bin", b""), ("a/.gitkeep", b""), ("a/bad.docx", b"no"), ("a/z.TXT", b"ok \xff"), ("a/p.pdf", b"%PDF")]
    rows = {r.source: r for r in parsers.parse_files(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert rows["a/x.xlsx"].text == "Name | Value\nx | 1" and rows["a/x.xlsx"].table_metadata[0].has_header
    assert rows["a/z.TXT"].text == "ok " and rows["a/p.pdf"].skip_reason == "parser_unavailable"
    assert rows["a/y.bin"].skip_reason == "unsupported_format" and rows["a/.gitkeep"].skip_reason == "internal_artifact"
    assert rows["a/bad.docx"].skip_reason.startswith("parse_error")


def test_stream_equals_batch(spark, tmp_path):
    schema = "ts timestamp, source_unit_id string, action string"
    rows = spark.sql("select timestamp'2024-01-01' + make_dt_interval(0, 0, id * 7) ts, 'u' source_unit_id, 'a' action from range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = audit.tumbling(audit.read_events(spark, str(tmp_path / "in"), schema))
    audit.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    closed = {(r.window_start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed and closed <= {(r.window_start, r.n) for r in audit.tumbling(rows).collect()}


def test_settings(tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"lifecycle": {"preferred_statuses": ["active"], "freshness_days_default": 30}, "retrieval": {"preferred_doc_types": ["Policy"]}}')
    found = Settings.from_profile(path, top_k=9)
    assert found.status_allow_list == ("active",) and found.freshness_max_age_days == 30 and found.top_k == 9
    assert found.metadata_weight_rules["doc_type"]["policy"] == 1.2
    assert Settings.from_profile(tmp_path / "none.json") == Settings()


def test_registered_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "doc_ord", "chunk_index", "score"]


def test_vector_search_asks_every_twentieth_row(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    path = "/root/testdata/sf0.001"
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    found = __spark_entry__.queries()["vec_cosine_topk"](spark, path)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    want = []
    for q in sorted(i for i in vectors if i % 20 == 0):
        scores = [(-round(float(vectors[q] @ v), 4), i) for i, v in vectors.items() if vectors[q] @ v >= 0.25]
        want += [(q, rank, i) for rank, (_, i) in enumerate(sorted(scores)[:5], 1)]
    assert len({q for q, *_ in want}) == 25 and [r[:3] for r in got] == want
