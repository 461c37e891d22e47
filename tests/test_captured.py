"""Result pages, files, dispatch, settings, queues and job streams on small inputs."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import extraction, runs, state
from gleaner.sources import files
from gleaner.sources import result_pages as RP


def test_brave_blocks():
    block = lambda href, title, snippet: f'<div data-type="web"><a href="{href}">x</a><div class="title search-snippet-title"> {title} </div><div class="generic-snippet"><div class="content">{snippet}</div></div></div>'
    page = "<body>" + block("https://a.com", "A  b", "one <b>two</b>") + block("/settings", "Own", "own") + block("https://b.com/x", "B", "s") + block("https://c.com/x", "Cc", " ") + '<div data-type="web">no link</div>' + block("http://[bad", "Dd", "s") + block("//e.com/p", "Ee", "s")
    assert [(r["title"], r["url"], r["snippet"], r["position"]) for r in RP.brave_rows(page, 5)] == [("A b", "https://a.com/", "one two", 1), ("Ee", "https://e.com/p", "s", 2)]
    assert len(RP.brave_rows("".join(block(f"https://a.com/{i}", "Tt", "s") for i in range(30)), 5)) == 10 and RP.brave_rows("", 5) == []


def test_google_containers():
    item = lambda href, text: f'<div data-hveid="1"><div><a href="{href}"> {text}  x</a></div><div class="VwiC3b">snip  pet</div></div>'
    page = item("https://a.com/1", "Aa") + item("https://google.com/search?q=1", "Nav") + item("https://www.google.com/x", "Own") + item("https://docs.google.com/x", "Docs") + '<a href="https://b.com/">outside</a>' + '<div data-hveid="2"><a href="https://c.com/">Cc</a></div>'
    assert [(r["title"], r["url"], r["snippet"]) for r in RP.google_rows(page, 5)] == [("Aa  x", "https://a.com/1", "snip pet"), ("Docs  x", "https://docs.google.com/x", "snip pet")]
    deep = "<div>" * 3000 + item("https://a.com/1", "Aa") + "</div>" * 3000
    assert len(RP.google_rows(deep, 1)) == 1


def test_files(spark, tmp_path):
    pdf = b"%PDF-1.4\n3 0 obj << /Title (T) >> endobj\n4 0 obj << /Length 1 >> stream\nBT (Hello) Tj ET\nendstream endobj\ntrailer << /Info 3 0 R >>"
    (tmp_path / "a.pdf").write_bytes(pdf)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-" + b"x" * 4000)
    (tmp_path / "c.txt").write_bytes(pdf)
    rows = {os.path.basename(r.path): r for r in files.pdf_files(spark, str(tmp_path), max_bytes=1000).collect()}
    assert set(rows) == {"a.pdf", "b.pdf"} and (rows["a.pdf"].title, rows["a.pdf"].text, rows["a.pdf"].error) == ("T", "Hello", None) and rows["b.pdf"].error == "Http"
    saved = tmp_path / "rep"
    saved.mkdir()
    (saved / "a.com.json").write_text(json.dumps({"last_flags": ["BotWall"], "hit_count": 2, "last_seen": "2024-01-01T00:00:00Z"}, indent=1))
    (saved / "old.com.json").write_text(json.dumps({"last_flags": [], "hit_count": 1, "last_seen": "x"}))
    (saved / "bad.com.json").write_text("{")
    now = time.time()
    os.utime(saved / "old.com.json", (now - 90_000, now - 90_000))
    assert [(r.domain, r.hits, r.flags) for r in files.reputation_files(spark, str(saved), now).collect()] == [("a.com", 2, ["BotWall"])]
    assert files.pacing_file(spark, str(tmp_path)).count() == 0
    (tmp_path / "pacing.json").write_text(json.dumps({"last_calls": {"bing": 5}, "cooldowns": {"brave": 9}, "api_quota_spend": 3}))
    assert {(r.engine, r.last_call_ms, r.cooldown_until_ms, r.api_quota_spend) for r in files.pacing_file(spark, str(tmp_path)).collect()} == {("bing", 5, None, 3), ("brave", None, 9, 3)}


def test_settings(spark):
    entries = [("a", "CDP_HOST", "x"), ("a", "SERVE_PORT", "70000"), ("a", "SERVE_PORT", "81"), ("a", "AX_TIMEOUT", "7"), ("a", "ax_TIMEOUT", "bad"), ("a", "UPDATE_DISABLED", " ON "), ("b", "SERVE_BIND", "h:1"), ("b", "SERVE_PORT", "82"), ("b", "_TIMEOUT", "1"), ("c", "OTHER", "1")]
    df = spark.createDataFrame([(run, i, f"{files.PREFIX}{key}", value) for i, (run, key, value) in enumerate(entries)], "run string, at int, key string, value string")
    got = {r.run: r for r in files.settings(df).collect()}
    assert (got["a"].cdp_host, got["a"].serve_bind, got["a"].update_disabled, got["a"].command_timeouts) == ("x", "127.0.0.1:81", True, {"ax": 7})
    assert got["b"].serve_bind == "h:1" and got["c"].serve_bind == "127.0.0.1:9080" and got["c"].reputation_ttl_secs == 86400


def test_dispatch_of_odd_rows(spark):
    rows = [(1, "https://e.com/a.pdf", None, None), (2, "https://arxiv.org/abs/1", None, None), (3, "https://github.com/o/r", None, None), (4, None, None, None), (5, "https://e.com/", "<p>" + "words here " * 10, None)]
    got = {r.page_id: r for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, content binary")).collect()}
    assert [got[i].error for i in range(1, 6)] == ["Unsupported", "Empty", "Empty", "Empty", None] and got[5].content.startswith("words here")


def attempts(spark, rows):
    return spark.createDataFrame(rows, "request long, seq long, engine string, outcome string, hits int")


def test_events_and_frames(spark):
    rows = [(0, 0, "google", "Captcha", 0), (0, 1, "brave", "Ok", 2), (0, 2, "bing", "Ok", 2), (1, 3, "google", "Network", 0), (1, 4, "bing", "Ok", 0), (2, 5, "bing", "Ok", 0)]
    events = runs.search_events(attempts(spark, rows))
    told = {(r.request, r.seq): (r.kind, r.engine, r.detail) for r in events.collect()}
    assert [told[0, i] for i in range(6)] == [("JobStarted", None, None), ("EngineEvent", "google", "Captcha"), ("EngineEvent", "google", "Cooldown"), ("Result", "brave", "1"), ("Result", "brave", "2"), ("Done", None, None)]
    assert told[1, 3] == ("Error", None, "AllEnginesFailed") and told[2, 2] == ("Done", None, None) and len(told) == 6 + 4 + 3
    targets = spark.createDataFrame([(0, 7, 0), (1, 7, 1), (2, 8, 0)], "request long, job long, at int")
    assert {(r.job, r.results, r.engine, r.failure) for r in runs.fan_out(events, targets).collect()} == {(7, 2, "brave", "AllEnginesFailed"), (8, 0, None, None)}
    assert {(r.request, r.status, r.results) for r in runs.batch(events).collect()} == {(0, "ok", 2), (1, "err", 0), (2, "ok", 0)}
    jobs = spark.createDataFrame([(7, False, False), (8, False, True), (9, True, False)], "job long, refused boolean, late boolean")
    frames = {(r.job, r.seq): (r.name, r.detail) for r in runs.run_jobs(jobs, events, targets).collect()}
    last = {job: max(s for j, s in frames if j == job) for job in (7, 8, 9)}
    assert all(frames[job, seq][0] == "done" for job, seq in last.items()) and sum(1 for x in frames.values() if x[0] == "done") == 3
    assert frames[7, last[7]] == ("done", "2") and frames[7, last[7] - 1] == ("error", "engine-failed") and frames[8, last[8]] == ("done", "timeout")
    assert [frames[9, i] for i in range(2)] == [("error", "connection-failed"), ("done", "connection-failed")] and last[9] == 1


def test_queue_against_a_plain_clock(spark):
    rng = random.Random(4)
    rows = [(q, j, rng.randrange(200), rng.randrange(1, 40)) for q in range(3) for j in range(60)]
    got = {(r.queue, r.job): (r.start_ms, r.end_ms, r.waiting) for r in runs.queue(spark.createDataFrame(rows, "queue long, job long, arrived_ms long, run_ms long"), 4).collect()}
    for q in range(3):
        mine, busy, expected = sorted((a, j, r) for k, j, a, r in rows if k == q), [], {}
        waiting, clock = list(mine), 0
        while waiting:
            busy = [e for e in busy if e > clock]
            if waiting[0][0] <= clock and len(busy) < 4:
                a, j, r = waiting.pop(0)
                busy.append(clock + r)
                expected[j] = (clock, clock + r)
            else:
                clock += 1
        assert {j: got[q, j][:2] for j in expected} == expected
        order = [j for _, j, _ in mine]
        for i, j in enumerate(order):
            assert got[q, j][2] == sum(1 for x in mine[i + 1 :] if x[0] <= expected[j][0])


def test_pacing_across_days_equals_a_plain_fold(spark):
    rng = random.Random(6)
    day = 86_400_000
    rows = [(e, i, rng.randrange(5 * day) // 1000 * 1000, rng.choice(["Ok", "Captcha", "RateLimited"])) for i, e in enumerate(rng.choices(["bing", "brave"], k=80))]
    rows += [("bing", 100, 2 * day - 500, "Captcha"), ("bing", 101, 2 * day + 100, "Ok"), ("bing", 102, 2 * day + 100, "Ok")]
    calls = spark.createDataFrame(rows, "engine string, seq long, ts_ms long, outcome string")
    paced = {r.seq: (r.before_ms, r.remaining_ms) for r in state.pacing(calls, F.lit(1000).cast("long")).collect()}
    cooled = {r.seq: r.cooldown_until_ms for r in state.cooldowns(calls).collect()}
    for engine in ("bing", "brave"):
        last = until = None
        for _, seq, ts, outcome in sorted((x for x in rows if x[0] == engine), key=lambda x: (x[2], x[1])):
            wait = None if last is None or ts - last >= 1000 else 1000 - (ts - last)
            if outcome in state.COOLDOWN_MS:
                until = max(until or 0, ts + state.COOLDOWN_MS[outcome])
            assert paced[seq] == (last, wait) and cooled[seq] == until
            last = ts
    plan = state.cooldowns(calls)._jdf.queryExecution().executedPlan().toString()
    assert "__day" in plan


def test_null_addresses_stay_in_the_ranking(spark):
    from gleaner.operators import hits

    rows = [(1, "q", "A", None, "s", "bing", 0.0, 0.5), (2, "q", "B", "https://a.com/", None, "bing", 0.0, 0.9), (3, "q", "C", None, "ss", "bing", 0.0, 0.5)]
    df = spark.createDataFrame(rows, "ord long, query string, title string, url string, snippet string, engine string, score double, domain_authority double")
    assert {r.ord: round(r.rank_score, 6) for r in hits.rank_composite(df).collect()} == {1: 0.5, 2: 0.65, 3: 0.65}
    assert {r.ord: r.times for r in hits.address_counts(df).collect()} == {1: 2, 2: 1, 3: 2}


def test_submitted_jobs_stream(spark, tmp_path):
    from gleaner.streaming import jobs as live

    (tmp_path / "in").mkdir()
    lines = [{"op": "simple", "trace_id": "t1", "args": {"query": "x"}}, {"op": "simple", "trace_id": "t2", "args": {}}, {"op": "ax", "trace_id": "t3", "args": {"url": "https://x"}, "timeout_ms": 500000}]
    (tmp_path / "in" / "1.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    query = live.submitted(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("submitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = {r.trace_id: r for r in spark.sql("SELECT * FROM submitted").collect()}
    assert got["t1"].problem is None and got["t1"].timeout_ms == 10000 and got["t2"].problem == "query is missing" and got["t3"].timeout_ms == 120000
    assert got[None].problem == "body is no job" and len(got) == 4


@pytest.mark.parametrize("mode", ["free", "api"])
def test_router_modes_by_priority(mode):
    order = state.PRIORITY[mode]
    asked = []
    assert state.Router(mode).search(0, lambda e: asked.append(e) or ("Ok", 0)) == (None, "Empty") and asked == order
    assert state.Router(mode).search(0, lambda e: ("Ok", 1) if e == order[-1] else ("Network", 0)) == (order[-1], "Served")


def test_command_line(capsys, spark, sf):
    from gleaner.__main__ import main

    assert main(["describe"]) == 0 and json.loads(capsys.readouterr().out)["name"] == "gleaner"
    assert main(["list"]) == 0 and "url1_canonicalize" in capsys.readouterr().out.split()
    assert main(["run", "rnk2_authority_top20", sf, "--limit", "3"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["status"] == "ok" and len(told["data"]) == 3 and set(told["data"][0]) == {"ord", "url", "domain_authority"}
    assert main(["run", "none", sf]) == 2 and json.loads(capsys.readouterr().out)["error"]["code"] == "invalid-input"
    assert main(["run", "rnk2_authority_top20", "/nowhere"]) == 1 and json.loads(capsys.readouterr().out)["status"] == "error"
    assert main(["config"]) == 0 and json.loads(capsys.readouterr().out)["data"]["reputation_ttl_secs"] == 86400
    with pytest.raises(SystemExit) as wrong:
        main(["run"])
    assert wrong.value.code == 2


@pytest.mark.parametrize("stretch", [5, 1 << 20])
def test_reputation_in_stretches_equals_a_plain_fold(spark, stretch):
    from gleaner.streaming.state import is_blocked, reputation_step

    rng = random.Random(8)
    log, now = [], {}
    for i in range(300):
        domain = "hot" if rng.random() < 0.6 else f"d{rng.randrange(4)}"
        now[domain] = now.get(domain, 1_700_000_000) + rng.choice([60, 3600, 50_000, 90_000])
        log.append((domain, i, now[domain], rng.choice(["write", "write", "write", "decay"]), rng.sample(["BotWall", "Paywall", "Captcha", "EmptyShell"], rng.randrange(3))))
    rows = spark.createDataFrame(log, "domain string, seq long, t long, kind string, flags array<string>").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.domain, r.seq): (r.hits, list(r.flags), r.blocked) for r in state.reputation(rows, stretch=stretch).collect()}
    held = {}
    for domain, seq, t, kind, flags in log:
        held[domain] = reputation_step(held.get(domain, (0, (), 0.0)), kind, flags, float(t))
        hits, kept, _ = held[domain]
        assert got[domain, seq] == (hits, sorted(kept), is_blocked(hits, kept)), (domain, seq)


@pytest.mark.parametrize(("mode", "pinned"), [("hybrid", False), ("free", False), ("hybrid", True)])
def test_routes_equal_one_router_a_run(spark, mode, pinned):
    rng = random.Random(12)
    rows = [(rng.randrange(4), i, 1000 * i + rng.randrange(400), rng.choice(state.PRIORITY["hybrid"]), rng.choice(["Ok", "Ok", "Captcha", "Network"]), rng.randrange(3)) for i in range(250)]
    calls = spark.createDataFrame(rows, "run long, seq long, ts_ms long, engine string, outcome string, hits int").repartition(5)
    got = {(r.run, r.seq): (r.engine, r.result) for r in state.route(calls, mode, pinned).collect()}
    routers = {}
    for run, seq, ts, engine, outcome, hits in sorted(rows, key=lambda x: (x[2], x[1])):
        router = routers.setdefault(run, state.Router(mode))
        assert got[run, seq] == router.search(ts, lambda e: (outcome, hits) if e == engine else ("Ok", 0), pinned=engine if pinned else None)
