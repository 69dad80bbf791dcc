"""Small cases at the edges of the rules."""

import hashlib
import json
import os
import re
import time
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions import secrets as X
from sessionloom.functions import text as T
from sessionloom.operators import scan
from sessionloom.operators.prefix import concat_parts, prefix_sums
from sessionloom.plans import extract as E
from sessionloom.plans import lifecycle as Y
from sessionloom.plans import lint as L
from sessionloom.plans.extract import evict
from sessionloom.sources import artifacts as A
from sessionloom.sources import journals as J
from sessionloom.sources import sessions as S
from sessionloom.sources.lines import digests, lines_from_text, read_lines, write_lines
from sessionloom.sources.sessions import parse_markdown, parse_sessions
from sessionloom.streaming import jobs
from sessionloom.workload.q_extract import answer_by_length

# Token characters, for a plain loop over matches.
T_CHARS = r"""[^,;'"`<>(){}\[\]\s]+"""


def one(spark, value, expr, schema="text string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_trim_knows_unicode_spaces(spark):
    assert one(spark, " ﻿ a b  ", T.full_trim(F.col("text"))) == "a b"
    assert one(spark, "\x1c a", T.full_trim(F.col("text"))) == "\x1c a"


@pytest.mark.parametrize("text,want", [
    ("tests pass but the build failed", "failure"), ("merged", "success"), ("todo: merged", "incomplete"),
    ("unredacted", "unknown"), ("äred", "failure"), ("pass", "unknown"), ("all checks passing", "success"),
])
def test_outcome_classes(spark, text, want):
    assert one(spark, text, T.classify_outcome(F.col("text"))) == want


@pytest.mark.parametrize("ref,want", [
    ("a/b.ts", None), ("/a", "absolute"), ("../a", "traversal"), ("a/../../b", "traversal"),
    ("a/../b", None), ("./a", None), ("a/..b", None),
])
def test_unsafe_refs(spark, ref, want):
    assert one(spark, ref, T.unsafe_ref(F.col("text"))) == want


def test_template_keeps_unknown_names(spark):
    e = T.interpolate("{{a}}-{{ b }}", {"a": F.lit("{{b}}")})
    assert one(spark, "", e) == "{{b}}-{{b}}<<missing>>"


MIXED = "qW3AB12CD34zXcVbNmLkJhGfD5e6f7a8b"


@pytest.mark.parametrize("gap,hits", [(40 - 3, 1), (40, 1), (41, 0)])
def test_keyword_window(spark, gap, hits):
    # The keyword ends `gap` characters before the token for the last two cases.
    text = "key" + " " * (gap if gap < 40 else gap - 3) + MIXED
    assert len(one(spark, text, X.secret_hits("text"))) == hits


def test_redaction_is_idempotent(spark):
    token = "gh" + "p_" + "a1B2" * 8
    text = f"password {token} and\nAPP_TOKEN={MIXED}\nend"
    once = one(spark, text, X.redact("text"))
    assert once == f"password {K.REDACTED} and\n{K.REDACTED}\nend"
    assert one(spark, once, X.redact("text")) == once


def test_prefix_sums_match_a_plain_loop(spark):
    rows = [("a", i // 3, i, i % 5) for i in range(40)] + [("b", i // 3, i, 2) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, b bigint, i bigint, n bigint")
    got = {(r.k, r.i): r.s for r in prefix_sums(df, ["k"], ["b"], ["i"], {"s": "n"}).collect()}
    for key in "ab":
        total = 0
        for k, _, i, n in rows:
            if k == key:
                assert got[(k, i)] == total
                total += n


def test_concat_parts_gives_one_text(spark):
    rows = [("a", i // 4, i, f"<{i}>") for i in range(50)]
    df = spark.createDataFrame(rows, "k string, b bigint, i bigint, text string")
    (one,) = concat_parts(df, ["k"], ["b"], ["i"]).collect()
    assert one.text == "".join(r[3] for r in rows) and (one.part_no, one.chars) == (0, len(one.text))


def test_running_totals_keep_null_keys_and_levels(spark):
    rows = [(None, None, 1, 5), (None, None, 2, 6), (None, 3, 0, 7), ("a", None, 0, 1), ("a", 1, 0, 2)]
    df = spark.createDataFrame(rows, "k string, level bigint, i bigint, n bigint")
    got = prefix_sums(df, ["k"], ["level"], ["i"], {"before": "n"}).collect()
    assert sorted((str(r.k), str(r.level), r.i, r.before) for r in got) == [
        ("None", "3", 0, 11), ("None", "None", 1, 0), ("None", "None", 2, 5), ("a", "1", 0, 1), ("a", "None", 0, 0)]


def _event(content):
    return '{"type":"user","message":{"role":"user","content":' + content + "}}"


def test_tool_results_of_any_depth(spark):
    content, want = '"deep"', "deep"
    for _ in range(9):
        content = '[{"type":"tool_result","content":' + content + "}]"
        want = "[tool_result] " + want
    lines = lines_from_text(spark.createDataFrame([("a", _event(content))], "artifact_id string, text string"))
    assert [r.text for r in S.parse_events(lines).collect()] == [want]


def test_deep_and_inline_texts_agree(spark):
    inner = ['"x"', '[]', '[{"type":"text","text":"plain"}]', '[{"type":"text","text":"  "}]', '7', 'null', '["s",{"type":"text","text":5}]',
             '[{"type":"text","text":" a "},{"type":"tool_use","name":""},{"type":"tool_use"},{"type":"text","text":"b\\u00a0"}]',
             '[{"type":"tool_result"},{"type":"tool_result","content":""},{"type":"text","text":"end"}]']
    texts = []
    for content in inner:
        for _ in range(4):
            texts.append(_event('[{"type":"text","text":"top"},' + content + "]") if content[0] == "{" else _event(content))
            content = '[{"type":"tool_result","content":' + content + '},{"type":"text","text":"after"}]'
    rows = spark.createDataFrame([(f"a{n:03d}", t) for n, t in enumerate(texts)], "artifact_id string, text string")
    lines = lines_from_text(rows)
    want = {r.artifact_id: r.text for r in S.parse_events(lines, 6).collect()}
    assert {r.artifact_id: r.text for r in S.parse_events(lines).collect()} == want
    for n, t in enumerate(texts):
        assert S.nested_text(json.loads(t)["message"]["content"]) == want.get(f"a{n:03d}", "")


def test_tool_results_four_hundred_levels_deep(spark):
    content = '[{"type":"tool_result","content":' * 400 + '"deep"' + "}]" * 400
    lines = lines_from_text(spark.createDataFrame([("a", _event(content))], "artifact_id string, text string"))
    assert [r.text for r in S.parse_events(lines).collect()] == ["[tool_result] " * 400 + "deep"]


def test_repeated_json_keys_keep_the_last(spark):
    line = '{"type":"user","message":{"role":"user","content":"old","content":"new"}}'
    lines = lines_from_text(spark.createDataFrame([("a", line)], "artifact_id string, text string"))
    assert [r.text for r in S.parse_events(lines).collect()] == ["new"]


def test_plain_text_of_many_chunks_is_one_message(spark):
    text = "\n".join(f"note {i}" for i in range(9000))
    lines = lines_from_text(spark.createDataFrame([("a.txt", f"\n {text}\n\n")], "artifact_id string, text string"))
    (m,) = S.parse_sessions(lines).collect()
    assert (m.role, m.text, m.span_start, m.span_end) == ("assistant", text, 0, len(text) + 4)


def test_one_finding_for_a_long_warning_list(spark):
    packets = spark.createDataFrame([("p", "dispatched")], "packet_id string, status string")
    warnings = spark.range(9000).selectExpr("'p' AS packet_id", "id AS pos", "concat('W', id) AS code", "true AS blocking")
    (f,) = L.blocking_warning_findings(SimpleNamespace(packets=packets, warnings=warnings)).collect()
    assert "9000 blocking" in f.message and f.message.endswith("W8998, W8999.") and ": W0, W1, W2," in f.message


def test_eviction_by_instant_and_without_a_stamp(spark):
    rows = [("bb", 10, None), ("aa", 10, "2024-01-01T00:00:00.100Z"), ("00", 10, "2024-01-01T00:00:00.900Z"), ("zz", 10, "2024-01-01T00:00:00.050Z")]
    df = spark.createDataFrame(rows, "key string, size bigint, last_accessed string")
    kept = lambda n: {r.key for r in evict(df, n).collect()}
    assert (kept(10), kept(20), kept(30), kept(40)) == ({"00"}, {"00", "aa"}, {"00", "aa", "zz"}, {"00", "aa", "zz", "bb"})


def test_status_changes_over_a_gap_in_the_numbers(spark):
    rows = [("p", 1, "draft"), ("p", 5, "dispatched"), ("p", 6000, "dispatched")]
    found = L.illegal_transitions(spark.createDataFrame(rows, "packet_id string, version bigint, status string")).collect()
    assert [(r.version, r.code[-3:]) for r in found] == [(5, "040")]


def test_marker_over_many_tiny_chunks(spark):
    text = "x" * 300 + "usage limit" + "y" * 20
    rows = [(1, i, c) for i, c in enumerate(text)] + [(1, 5000, "")]
    df = spark.createDataFrame(rows, "s bigint, seq bigint, text string")
    hit = scan.with_carry(df, "s", "seq", "text", K.MARKER_SPAN - 1).where(
        T.has_limit_marker(F.col("window"))).agg(F.min("seq")).first()[0]
    assert hit == text.index("usage limit") + len("usage limit") - 1


MD = "intro\n## User\nHéllo\r\n```\n## Tool\n```\n\n## assistant \n<!-- ts: 2024 -->\n<!-- ts: 2 -->x\n## System\n\n"


def test_markdown_messages_and_byte_spans(spark):
    df = spark.createDataFrame([("a", MD)], "artifact_id string, text string")
    got = parse_markdown(lines_from_text(df)).orderBy("ord").collect()
    assert [(m.role, m.text, m.ts) for m in got] == [
        ("user", "Héllo\n```\n## Tool\n```", None), ("assistant", "<!-- ts: 2 -->x", "2024")]
    raw = MD.encode()
    assert raw[got[0].span_start:].decode().startswith("Héllo")
    assert raw[got[1].span_start:got[1].span_end].decode() == "<!-- ts: 2 -->x"


def test_chunked_parse_equals_whole_parse(spark):
    rows = [("a", MD * 5)]
    lines = lines_from_text(spark.createDataFrame(rows, "artifact_id string, text string"))
    small = lines.withColumn("chunk", F.floor(F.col("pos") / 3).cast("bigint"))
    key = ["ord", "role", "text", "ts", "span_start", "span_end"]
    whole = parse_markdown(lines).select(*key).orderBy("ord").collect()
    assert parse_markdown(small).select(*key).orderBy("ord").collect() == whole


def test_read_lines_of_files(spark, tmp_path):
    (tmp_path / "one.md").write_bytes(MD.encode())
    (tmp_path / "two.md").write_bytes(b"no headers here\r\nat all")
    got = parse_sessions(read_lines(spark, str(tmp_path))).collect()
    plain = [m for m in got if m.unrecognized]
    assert len(got) == 3 and len(plain) == 1
    assert (plain[0].span_start, plain[0].span_end) == (0, 23)
    user = [m for m in got if m.role == "user"][0]
    assert MD.encode()[user.span_start:].decode().startswith("Héllo")


def test_a_file_in_many_splits_reads_as_a_whole(spark, tmp_path):
    body = [f"line {n}" * (n % 5) for n in range(700)]
    md = "# s\n" + "".join(f"## {'User' if n % 2 else 'Assistant'}\n" + "\n".join(body[n:n + 9]) + "\n" for n in range(120))
    blank = "\n" * 900
    for name, text in (("one.md", md), ("two.md", blank + "x"), ("three.md", "x" * 999 + "\n" + blank)):
        (tmp_path / name).write_bytes(text.encode())
    whole = lines_from_text(spark.createDataFrame(
        [("one.md", md), ("two.md", blank + "x"), ("three.md", "x" * 999 + "\n" + blank)], "artifact_id string, text string"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("300", "1000"):
            spark.conf.set(key, size)
            lines = read_lines(spark, str(tmp_path)).withColumn("artifact_id", F.regexp_extract("artifact_id", "[^/]*$", 0))
            got = lines.orderBy("artifact_id", "pos").collect()
            want = whole.orderBy("artifact_id", "pos").collect()
            assert [(r.artifact_id, r.line) for r in got] == [(r.artifact_id, r.line) for r in want]
            assert len({(r.artifact_id, r.pos) for r in got}) == len(got)
            assert len({r.chunk for r in got if r.artifact_id == "one.md"}) > 5
            rows = lambda x: sorted((m.artifact_id, m.role, m.text, m.span_start, m.span_end) for m in parse_sessions(x).collect())
            assert rows(lines) == rows(whole)
    finally:
        spark.conf.set(key, before)


def test_a_digest_depends_on_lines_alone(spark, tmp_path):
    texts = {"a": "x\n" * 9001, "b": "x\n" * 9001, "c": "x\n" * 9000, "d": "", "e": "\n", "f": "x\n" * 9001 + "y"}
    df = spark.createDataFrame(list(texts.items()), "artifact_id string, text string")
    whole = {r.artifact_id: r for r in digests(lines_from_text(df)).collect()}
    assert {k: (r.n_lines, r.bytes) for k, r in whole.items()} == {
        k: (t.count("\n") + 1, len(t)) for k, t in texts.items()}
    assert whole["a"].digest == whole["b"].digest and len({r.digest for r in whole.values()}) == 5
    hashes = [hashlib.sha256(line.encode()).hexdigest() for line in texts["f"].split("\n")]
    for _ in range(3):
        hashes = [hashlib.sha256("".join(hashes[i:i + 4096]).encode()).hexdigest() for i in range(0, len(hashes), 4096)]
    assert whole["f"].digest == "tree:" + hashes[0]
    for name in "abcef":
        (tmp_path / name).write_text(texts[name])
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000")
        got = {r.artifact_id[-1]: r.digest for r in digests(read_lines(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {k: whole[k].digest for k in "abcef"}
    assert digests(lines_from_text(df.limit(0))).count() == 0


def test_session_files_compile_as_they_arrive(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, text):
        (src / name).write_text(text)

    def run(known=None):
        rows = jobs.compile_files(spark, str(src), "now", known, F.regexp_extract("artifact_id", "[^/]*$", 0),
                                  str(tmp_path / "state"), maxFilesPerTrigger="2").collect()
        assert len({r.digest for r in rows}) == len(rows)
        return {r.packet_id: (r.objective, r.current_state) for r in rows}

    assert run() == {}
    said = lambda q, a: f"# s\n## User\n{q}\n## Assistant\n{a}\n"
    put("a.md", said("do a", "done a"))
    put("b.md", said("do a", "done a"))
    put("old.md", said("old", "old"))
    known = digests(lines_from_text(spark.createDataFrame([("o", said("old", "old"))], "artifact_id string, text string")))
    assert run(known) == {"a.md": ("do a", "done a")}
    put("c.jsonl", json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "do c"}}) + "\n")
    put("d.md", said("do a", "done a"))
    put("e.txt", "no format at all")
    want = {"a.md": ("do a", "done a"), "c.jsonl": ("do c", K.DEFAULT_STATE), "e.txt": (K.DEFAULT_OBJECTIVE, "no format at all")}
    assert run() == want
    assert run() == want


def test_tasks_do_not_grow_with_the_number_of_session_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(120):
        (src / f"{i}.md").write_text(f"## User\ndo {i}\n## Assistant\ndone {i}\n")
    tracker = spark.sparkContext.statusTracker()
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)

    def last_stage(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            spark.range(1).count()
        finally:
            spark.sparkContext._jsc.sc().clearJobGroup()
        return max(i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds)

    first = last_stage("before the files")
    assert jobs.compile_files(spark, str(src), "now", state_dir=str(tmp_path / "state")).count() == 120
    stages = [tracker.getStageInfo(i) for i in range(first + 1, last_stage("after the files"))]
    assert max(s.numTasks for s in stages if s) < 60
    assert spark.conf.get(key) == before


def test_a_repeated_batch_replaces_its_own_rows(spark, tmp_path):
    log = jobs.BatchLog(str(tmp_path / "log"), "k string")
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert log.read(spark, before=0).count() == 0
    log.write(rows("a"), 0)
    log.write(rows("b"), 1)
    assert [r.k for r in log.read(spark, before=1).collect()] == ["a"]
    log.write(rows("c"), 1)
    assert sorted(r.k for r in log.read(spark).collect()) == ["a", "c"]


def test_written_lines_are_read_back(spark, tmp_path):
    rows = [("a/x", 0, "é"), ("a/x", 1, ""), ("a/x", 2, "b\r"), ("y", 5, "only"), ("z", 1, "end"), ("z", 2, "")]
    given = spark.createDataFrame(rows, "artifact_id string, pos long, line string")
    counts = write_lines(given, str(tmp_path / "out")).collect()
    assert sorted((r.artifact_id, r.n_lines) for r in counts) == [("a/x", 3), ("y", 1), ("z", 2)]
    assert (tmp_path / "out/a/x").read_bytes() == "é\n\nb\r".encode()
    assert (tmp_path / "out/z").read_bytes() == b"end\n"
    assert write_lines(given.limit(0), str(tmp_path / "none")).count() == 0


def test_token_offsets_over_blocks(spark):
    text = " é ".join(f"t{n}_x" for n in range(1500)) + "!"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "--")], "id long, text string")
    df = scan.tokenize(rows, "id", "text")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, r.pos, r.offset, r.token) for r in df.orderBy("id", "pos").collect()]
    want = [(r[0], m.start(), m.group()) for r in rows.collect() if r[1] for m in re.finditer(T_CHARS, r[1])]
    assert [(i, o, t) for i, _, o, t in got] == want
    ones = [p for i, p, _, _ in got if i == 1]
    assert ones == list(range(len(ones)))


def test_journal_files_as_a_stream(spark, tmp_path):
    def put(name, rows):
        (tmp_path / "j").mkdir(exist_ok=True)
        (tmp_path / "j" / name).write_text("".join(json.dumps(r) + "\n" if r else "\n{torn\n" for r in rows))

    def run():
        rows = J.read_journal(spark, str(tmp_path / "j"), J.OUTCOME, stream=True, maxFilesPerTrigger="1")
        return {(r.packet_id, r.id) for r in jobs.latest_events(rows, str(tmp_path / "state")).collect()}

    (tmp_path / "j").mkdir()
    assert run() == set()
    put("0001.jsonl", [{"id": "a", "packet_id": "p"}, None, {"id": "b", "packet_id": "q"}, {"id": "c", "packet_id": "p"}])
    assert run() == {("p", "c"), ("q", "b")}
    put("0002.jsonl", [{"id": "d", "packet_id": "q"}, {"id": "0", "packet_id": "r"}])
    assert run() == {("p", "c"), ("q", "d"), ("r", "0")}
    assert run() == {("p", "c"), ("q", "d"), ("r", "0")}


def test_latest_session_file(spark, tmp_path):
    day = tmp_path / "2024" / "01" / "02"
    odd = tmp_path / "misc" / "01" / "02"
    for d in (day, odd):
        d.mkdir(parents=True)
    for path, age in ((day / "rollout-a.jsonl", 50), (day / "rollout-b.jsonl", 20),
                      (day / "other.jsonl", 1), (odd / "rollout-c.jsonl", 1)):
        path.write_text("{}")
        os.utime(path, (time.time() - age, time.time() - age))
    path = A.latest_session_file(spark, str(tmp_path)).first()["path"]
    assert path.endswith("rollout-b.jsonl")
    late = datetime.fromtimestamp(time.time() - 5, tz=timezone.utc)
    assert A.latest_session_file(spark, str(tmp_path), late).first()["path"] is None


def test_register_files_and_journal(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("abc")
    row = A.register(A.read_files(spark, str(tmp_path / "files")), F.lit("note")).first()
    assert (row.bytes, row.extension, row.digest[:8]) == (3, "txt", "ba7816bf")
    (tmp_path / "j").mkdir()
    good = json.dumps({"id": "1", "packet_id": "p1", "status": "ok"})
    last = json.dumps({"id": "2", "packet_id": "p1", "status": "failed"})
    (tmp_path / "j" / "d.jsonl").write_text(f"{good}\n\n{{broken\n{last}\n")
    rows = J.read_journal(spark, str(tmp_path / "j"), J.DISPATCH)
    assert rows.count() == 2
    assert Y.latest_by_packet(rows).first()["status"] == "failed"


def test_migration_chain():
    up = lambda df: df
    steps = [Y.Migration("a", "b", up), Y.Migration("b", "c", up), Y.Migration("a", "a", up)]
    assert [m.target for m in Y.migration_chain("a", "c", steps)] == ["b", "c"]
    assert Y.migration_chain("c", "a", steps) is None
    assert len(Y.migration_chain("a", "a", steps)) == 1
    assert Y.migration_chain("c", "c", steps) == []


def test_eviction_equals_a_loop(spark):
    rows = [(f"{i * 7919 % 256:02x}{i:04x}", 10 + i % 7, f"2024-01-0{1 + i % 3}T00:00:0{i % 2}Z")
            for i in range(60)]
    kept = {r.key for r in E.evict(
        spark.createDataFrame(rows, "key string, size bigint, last_accessed string"), 300).collect()}
    order = sorted(sorted(rows), key=lambda r: r[2], reverse=True)
    want, total = set(), 0
    for key, size, _ in order:
        total += size
        if total > 300:
            break
        want.add(key)
    assert kept == want


def test_completion_cache_answers_second_run(spark):
    prompts = spark.createDataFrame(
        [(f"p{i}", "objective", 0, "s", f"u{'x' * (i % 20)}") for i in range(40)],
        "packet_id string, extractor string, part_no bigint, system string, user string")
    found, fresh = E.complete_prompts(prompts, answer_by_length, "rule")
    cache = fresh.select("key", "text", "model")
    ok = {r.key for r in found.where("ok").collect()}
    again, more = E.complete_prompts(prompts, answer_by_length, "rule", cache)
    rows = again.collect()
    assert len(rows) == 40 and {r.key for r in rows if not r.live} == ok
    assert more.count() == 0 or not ({r.key for r in more.collect()} & ok)


def test_stream_fires_once_per_session(spark, tmp_path):
    src = tmp_path / "in"
    for n, rows in enumerate([[(1, 0, "usage li"), (2, 0, "fine")],
                              [(1, 1, "mit now"), (2, 1, "ok")], [(1, 2, "rate limit")]]):
        spark.createDataFrame(rows, "session_id bigint, seq bigint, text string").coalesce(1).write.mode(
            "append").parquet(str(src))
        time.sleep(1.1)
    stream = spark.readStream.schema("session_id bigint, seq bigint, text string").option(
        "maxFilesPerTrigger", 1).parquet(str(src))
    got = jobs.limit_triggers(stream).collect()
    assert [(r.session_id, r.seq) for r in got] == [(1, 1)]


def test_no_task_sees_all_pairs(spark):
    import __spark_entry__ as entry

    for name in ("collect_artifacts", "lint_missing_files", "assess_freshness", "compile_fast"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|NestedLoop|BatchEvalPython|ArrowEvalPython", plan), name


def test_schema_findings_at_every_depth(spark):
    from sessionloom import constants as K
    from sessionloom.plans.document_schema import document_findings

    stamp, lists = "2024-01-01T00:00:00.000Z", ["open_questions", "context_items", "constraints", "attempts", "acceptance_criteria", "warnings", "provenance_links", "source_artifacts"]
    good = {"schema_version": K.SCHEMA_VERSION, "id": "p-1", "title": "Title", "status": "draft", "validation_level": "draft", "task_type": "docs",
            "objective": "o", "current_state": "c", "next_action": "n", "confidence_score": 1, "created_at": stamp, "updated_at": stamp, **{n: [] for n in lists},
            "repo_context": {"attached": False, "root": None, "vcs": "none", "branch": None, "base_branch": None, "commit": None, "base_commit": None, "dirty": False}}
    question = {"id": "q-1", "text": "é" * 2000, "blocking": True, "status": "open"}
    docs = {
        "good": {**good, "open_questions": [question] * 300, "extensions": {"any": [1]}, "render_hints": {}},
        "question": {**good, "open_questions": [question, {**question, "text": "é" * 2001, "more": 1}, None, {}]},
        "repo": {**good, "repo_context": {**good["repo_context"], "attached": True, "commit": "XYZ"}},
        "missing": {k: v for k, v in good.items() if k not in ("id", "warnings")},
        "refs": {**good, "constraints": [{"id": "c-1", "type": "style", "text": "t", "severity": "info", "source": "user", "provenance_refs": ["ok", 3, "NO"]}]},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("null", None), ("text", '"x"'), ("cut", '{"id":')]
    got = {}
    for r in document_findings(spark.createDataFrame(rows, "uri string, doc string")).collect():
        got.setdefault(r.uri, set()).add((r.path, r.message))
    need = lambda at, names: {(at, f"must have required property '{n}'") for n in names}
    assert got == {
        "question": {("/open_questions/1/text", "must NOT have more than 2000 characters"), ("/open_questions/1", "must NOT have additional properties"),
                     ("/open_questions/2", "must be object"), *need("/open_questions/3", question)},
        "repo": {("/repo_context/root", "must be string"), ("/repo_context/vcs", "must be equal to constant"), ("/repo_context", 'must match "then" schema'),
                 ("/repo_context/commit", 'must match pattern "^[a-f0-9]{7,40}$"')},
        "missing": need("/", ["id", "warnings"]),
        "refs": {("/constraints/0/provenance_refs/1", "must be string"), ("/constraints/0/provenance_refs/2", 'must match pattern "^[a-z0-9][a-z0-9._-]{1,127}$"')},
        **{k: {("/", "packet is not an object")} for k in ("null", "text", "cut")},
    }
