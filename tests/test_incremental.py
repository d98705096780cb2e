"""Incremental audit, accept-limit, published files, observed figures, standard input and pull."""

from __future__ import annotations

import http.server
import io
import json
import threading
import time
import urllib.parse

import pytest
from plumbline import __main__ as cli
from plumbline import api
from plumbline.config import Config
from plumbline.operators import corpus, incremental
from plumbline.sources import files, registry
from plumbline.streaming import audit as streaming
from plumbline.streaming import memo


def test_only_unknown_lines_are_audited(spark, tmp_path):
    line = lambda i: (json.dumps({"study_id": str(i), "randomized_n": i, "arm_ns": {"a": i + i % 2}}),)
    rows = [line(i) for i in range(1, 21)] + [line(1)] * 3 + [("broken",), (" ",), (None,)]
    df, store = spark.createDataFrame(rows, "value string"), str(tmp_path / "store")
    first = incremental.audit_new(df.limit(10), store).count()
    known = incremental.stored(spark, store, Config()).count()
    out = incremental.audit_new(df, store).collect()
    assert (first, known, len(out)) == (10, 10, 24) and incremental.stored(spark, store, Config()).count() == 21
    want = {r.study_id: r.feasibility_verdict for r in api.audit_lines(spark.createDataFrame(rows[:20], "value string"))[0].collect()}
    assert {r.study_id: r.feasibility_verdict for r in out if r.errors is None} == want
    assert [r.errors for r in out if r.errors] == [["randomized_n", "not_json"]]
    # other settings find nothing there
    other = Config(alpha=0.01)
    assert incremental.stored(spark, store, other).count() == 0
    incremental.audit_new(df, store, other)
    assert incremental.stored(spark, store, other).count() == 21


def test_accept_limit_and_publishing(spark, tmp_path):
    df = spark.createDataFrame([(k % 7, k, f"v{k}") for k in range(200)], "day int, id int, v string")
    got = [(r.day, r.id) for r in incremental.accept_first(df, ["day", "id"], 60).collect()]
    assert sorted(got) == sorted((k % 7, k) for k in range(200))[:60]
    assert incremental.accept_first(df, ["day", "id"], 200).count() == 200 and incremental.accept_first(df, ["id"], 0).count() == 0
    with pytest.raises(RuntimeError, match="200 of 201"):
        incremental.accept_first(df, ["id"], 201)
    path, about = str(tmp_path / "out"), spark.createDataFrame([(60,)], "accepted int")
    files.publish(df.limit(60), about, path, 60)
    with pytest.raises(RuntimeError):
        files.publish(df.limit(5), about, path, 60)
    assert spark.read.text(path).count() == 60 and spark.read.text(path + ".manifest").count() > 0


def test_observed_figures_match_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"randomized_n": 5}\n{"randomized_n": 6, "arm_ns": {"a": 9}}\n{"randomized_n": -1}\nx\n')
    seen = []
    q = streaming.start(spark, str(tmp_path / "in"), str(tmp_path / "f"), str(tmp_path / "q"), str(tmp_path / "c"), once=True, on_metrics=lambda n, m: seen.append(m))
    q.awaitTermination(120)
    by = {r.verdict: r["count"] for r in spark.read.parquet(str(tmp_path / "f")).groupBy("verdict").count().collect()}
    assert not any(v for m in seen[1:] for v in m.values())  # a last batch without lines may follow
    assert seen[:1] == [{"findings": 24, "flag": by.get("flag", 0), "warn": by["warn"], "pass": by.get("pass", 0), "not_applicable": by["not_applicable"], "quarantined": 2, "not_json": 1}]


def test_standard_input(spark, monkeypatch):
    for text, n in (('{"randomized_n": 5}\n{"randomized_n": 6}\n', 2), ('{\n "randomized_n": 5\n}', 1), ('[{"randomized_n": 5},\n {"randomized_n": 7}]', 2)):
        monkeypatch.setattr("sys.stdin", io.StringIO(text))
        assert api.audit_lines(files.read_stdin(spark))[0].count() == n


def test_percentiles_with_ties_groups_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(corpus, "EDGES", 5)
    df = spark.createDataFrame([(None if k % 4 == 3 else k % 4, float(k % 9) if k % 3 else 4.0) for k in range(400)] + [(0, None)], "g int, v double")
    got = {r.g: (r.p10, r.p50, r.p90) for r in corpus.nearest_rank(df, "v", (0.1, 0.5, 0.9), ("g",)).collect()}
    for g in (0, 1, 2, None):
        vs = sorted(r.v for r in df.collect() if r.g == g and r.v is not None)
        assert got[g] == tuple(vs[-(-len(vs) * k // 10) - 1] for k in (1, 5, 9))
    assert corpus.nearest_rank(df.limit(0), "v", (0.5,), ("g",)).count() == 0


def study(i, status="COMPLETED"):
    design = {"studyType": "INTERVENTIONAL", "enrollmentInfo": {"count": 10 + i, "type": "ACTUAL"}, "designInfo": {"allocation": "RANDOMIZED"}}
    state = {"overallStatus": status, "lastUpdatePostDateStruct": {"date": f"2024-01-{i + 1:02d}"}}
    return {"protocolSection": {"identificationModule": {"nctId": f"N{i:02d}"}, "statusModule": state, "designModule": design}, "resultsSection": {"participantFlowModule": {}}, "hasResults": True}


@pytest.fixture
def stub():
    """A registry of three pages, and the requests that it saw."""
    pages, seen = [[study(5), study(1, "RECRUITING")], [study(3), study(2)], [study(9)]], []

    class Stub(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            seen.append(asked)
            k = int(asked.get("pageToken", "0"))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"studies": pages[k]} | ({"nextPageToken": str(k + 1)} if k < 2 else {})).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/studies", seen
    server.shutdown()


def test_pull(spark, tmp_path, monkeypatch, stub):
    """The first acceptable studies by id are published; a shortfall leaves the old files."""
    url, out = stub[0], str(tmp_path / "records")
    monkeypatch.setattr(api, "session", lambda: spark)
    assert cli.main(["pull", url, "--output", out, "--limit", "3"]) == 0
    assert sorted(json.loads(r.value)["study_id"] for r in spark.read.text(out).collect()) == ["N02", "N03", "N05"]
    with pytest.raises(RuntimeError, match="cohort incomplete"):
        cli.main(["pull", url, "--output", out, "--limit", "5"])
    assert spark.read.text(out).count() == 3


def test_registry_source_pushes_filters_and_reads_windows(spark, stub):
    url, seen = stub
    registry.register(spark)
    d = spark.read.format("study_registry").option("url", url).option("pause", "0").load()
    found = d.where("status = 'COMPLETED' AND updated >= DATE'2024-01-03' AND updated <= DATE'2024-01-06'").select("study_id").collect()
    assert sorted(r.study_id for r in found) == ["N02", "N03", "N05"]
    assert seen[0]["filter.overallStatus"] == "COMPLETED" and seen[0]["filter.advanced"].endswith("AREA[LastUpdatePostDate]RANGE[2024-01-03,2024-01-06]")
    reader = registry.RegistryReader({"from": "2024-01-01", "to": "2024-01-31", "windows": "3"})
    parts = reader.partitions()
    assert [(p.first.day, p.last.day) for p in parts] == [(1, 10), (11, 20), (21, 31)]
    assert reader.asked(parts[1])["filter.advanced"].endswith("RANGE[2024-01-11,2024-01-20]")


def test_registry_stream_goes_on_from_its_page_token(spark, tmp_path, stub):
    registry.register(spark)
    s = spark.readStream.format("study_registry").option("url", stub[0]).load()
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(120):
        time.sleep(0.5)
        if any("pageToken" in x and x["pageToken"] == "2" for x in stub[1]) and not q.status["isTriggerActive"]:
            break
    q.processAllAvailable()
    q.stop()
    assert sorted(r.study_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["N01", "N02", "N03", "N05", "N09"]


def test_memo_gives_responses_back_within_their_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    args = (spark, str(folder), str(tmp_path / "o"), str(tmp_path / "c"))

    def drop(name, text, ttl=3600):
        (folder / name).write_text(text)
        memo.start(*args, ttl_seconds=ttl, once=True).awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "o")).collect()
        return sorted(r.status for r in rows), len({r.response for r in rows})

    assert drop("a.jsonl", '{"randomized_n": 5}\n{"randomized_n": 5}\n{"randomized_n": 6}\n') == (["hit", "miss", "miss"], 2)
    assert drop("b.jsonl", '{"randomized_n": 5}\nbroken\n') == (["hit", "hit", "miss", "miss", "miss"], 3)


def test_memo_forgets_after_its_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / name).write_text('{"randomized_n": 5}\n')
        memo.start(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "c"), ttl_seconds=1, once=True).awaitTermination(120)
        time.sleep(2)
    assert [r.status for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["miss", "miss"]
