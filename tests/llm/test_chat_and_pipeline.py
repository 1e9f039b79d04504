"""Tool-call linking, the pipeline and the registered queries."""

import json

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shelfsight.llm import bpe, decontam, neardup, quality, queries, toolcalls
from tests import check

CALL = "conv_id long, call_id string, turn long, name string, arguments string"
RESULT = "conv_id long, call_id string, turn long, content string"
SCHEMAS = [("add", "a", "BIGINT", True), ("add", "b", "BIGINT", False), ("say", "text", "STRING", True)]
SF = "/root/testdata/sf0.001"


def linked(spark, calls, results, needs=None):
    schemas = spark.createDataFrame(SCHEMAS, "name string, key string, type string, required boolean")
    n = None if needs is None else spark.createDataFrame(needs, "conv_id long, call_id string, needs string")
    return toolcalls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), schemas, n)


def test_statuses_and_canonical_json(spark):
    calls = [(1, "x", 1, "add", '{"b": 2, "a": 1}'), (1, "y", 2, "add", '{"b": 2}'), (1, "z", 3, "add", '{"a": "1"}'), (1, "u", 4, "add", '{"a": 1, "q": 0}'),
             (1, "v", 5, "nope", "{}"), (1, "w", 6, "say", "not json"), (1, "p", 7, "say", '{"text": "é"}'), (1, "x", 8, "say", '{"text": "again"}'), (None, None, None, None, None)]
    results = [(1, "x", 2, "three"), (1, "x", 3, "again"), (1, "lost", 1, None)]
    got = linked(spark, calls, results).collect()
    assert len(got) == len(calls) + len(results)
    status = sorted((r.kind, r.call_id or "", r.status) for r in got)
    assert status == sorted([
        ("call", "x", "ok"), ("call", "y", "missing a"), ("call", "z", "wrong type a"), ("call", "u", "unknown key q"), ("call", "v", "unknown tool"),
        ("call", "w", "not an object"), ("call", "p", "pending"), ("call", "x", "repeated"), ("call", "", "orphan"),
        ("result", "x", "ok"), ("result", "x", "repeated"), ("result", "lost", "orphan")])
    first = next(r for r in got if r.call_id == "x" and r.status == "ok" and r.kind == "call")
    assert first.message == '{"body":{"a":1,"b":2},"call_id":"x","kind":"call","name":"add"}'
    assert all(json.loads(r.message)["kind"] == r.kind for r in got)


def test_order_follows_dependencies_and_cycles_come_last(spark):
    calls = [(7, c, 10 - i, "say", '{"text": "t"}') for i, c in enumerate("abcd")] + [(7, "m", 1, "say", '{"text": "t"}'), (7, "n", 2, "say", '{"text": "t"}')]
    results = [(7, c, 0, c) for c in "abcdmn"]
    needs = [(7, "b", "a"), (7, "c", "b"), (7, "d", "c"), (7, "d", "unknown"), (7, "m", "n"), (7, "n", "m")]
    got = sorted(linked(spark, calls, results, needs).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(12))
    at = {(r.kind, r.call_id): r.position for r in got}
    assert all(at["call", c] < at["result", c] for c in "abcd") and all(at["result", x] < at["call", y] for x, y in ("ab", "bc", "cd"))
    assert {r.call_id for r in got[8:]} == {"m", "n"} and {r.status for r in got[8:]} == {"cycle"}


def test_plain_messages_keep_every_turn(spark):
    plain = [(1, 0, "system", "be brief"), (1, 3, None, None), (1, 9, "tool", "x"), (2, 0, "system", "alone"), (None, None, "system", "lost")]
    messages = spark.createDataFrame(plain, "conv_id long, turn long, role string, text string")
    schemas = spark.createDataFrame(SCHEMAS, "name string, key string, type string, required boolean")
    calls = spark.createDataFrame([(1, "a", 1, "say", '{"text": "t"}'), (1, "b", 4, "say", '{"text": "t"}')], CALL)
    results = spark.createDataFrame([(1, "a", 2, "r")], RESULT)
    got = toolcalls.link(calls, results, schemas, None, messages).collect()
    assert len(got) == len(plain) + 3
    one = [r for r in sorted(got, key=lambda r: r.position) if r.conv_id == 1]
    assert [(r.position, r.kind, r.call_id) for r in one] == [
        (0, "message", None), (1, "call", "a"), (2, "message", None), (3, "call", "b"), (4, "message", None), (5, "result", "a")]
    assert one[0].message == '{"body":{"content":"be brief","role":"system"},"kind":"message"}'
    assert one[2].message == '{"body":{"content":""},"kind":"message"}' and {r.status for r in got if r.kind == "message"} == {"ok"}


def test_empty_tables(spark):
    assert linked(spark, [], []).count() == 0


@pytest.mark.parametrize("name", ["op7_licence_digests", "op8_tool_call_linking"])
def test_matches_duckdb(spark, name):
    note, ok = check.compare(spark, check.duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 11))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_do_what_their_operators_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_classifier"](spark, docs, SF)
    assert ids(one) == ids(quality.quality_scores(docs, labels).where("predicted = 1")) and one.columns == docs.columns
    two = stage["minhash_near_dedup"](spark, one, SF)
    assert ids(two) == ids(neardup.near_duplicates(one, 5, 80).where("kept"))
    three = stage["benchmark_decontamination"](spark, two, SF)
    assert ids(three) == ids(decontam.contamination(two, items).where("NOT contaminated"))
    four = stage["secret_scan"](spark, three, SF)
    assert ids(four) == ids(three) and four.where("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    import public_tokenizers as P
    want = bpe.encode_decode(four, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).select("doc_id", "ids_sha256").collect()
    got = entry.queries()["pipeline"](spark, SF).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_pipeline_takes_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
