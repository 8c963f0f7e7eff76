import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import enrich, graph, reconcile, setops, text
from tessera.schema import conform, validate

KEY = ["id"]
RULE = reconcile.either(reconcile.later("updated"), reconcile.differs("title"))


def test_bodies_differ_in_more_than_volatile_parts(spark):
    pairs = [
        ('{"t": "a bc"}', '{"t": "ab c"}', True), ('{"t":1,  "u":2}', '{"u":2,"t":1}', False), ("[1234567890]", "[1987654321]", True),
        ("[[1777733000, 5], 1]", "[[1777740000,999],1]", False), ('{"x": "[1777733000,5]"}', '{"x": "[1777740000,5]"}', True),
        ('["https://lh3.googleusercontent.com/a"]', '["https://lh3.googleusercontent.com/b"]', False), ('["https://example.com/x"]', '["https://example.com/y"]', True),
        ('{"_last_seen_in_server": "2024", "a": 1}', '{"_last_seen_in_server": "2025", "a": 1}', False), (None, "{}", True), ("no json 1", "no json 2", True), (None, None, False),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a string, b string")
    rule = reconcile.content_differs("body")
    got = df.select("k", rule(lambda _: F.col("a"), lambda _: F.col("b")).alias("d")).collect()
    assert [r["d"] for r in sorted(got)] == [d for _, _, d in pairs]


def test_partial_snapshots_flag_nothing(spark):
    old = spark.createDataFrame([("a", 1, "d0", False), ("b", 1, "d0", False), ("c", 1, "d0", True)], "id string, t int, _last_seen_in_server string, _preserved_missing boolean")
    new = spark.createDataFrame([("a", 2)], "id string, t int")
    got = reconcile.reconcile(new, old, ["id"], reconcile.later("t"), "d1", partial=True).collect()
    assert sorted((r["id"], r["t"], r[reconcile.SEEN], r[reconcile.GONE], r["action"]) for r in got) == [
        ("a", 2, "d1", False, "to_use"), ("b", 1, "d0", False, "to_copy"), ("c", 1, "d0", True, "to_copy")
    ]


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- reconcile ---------------------------------------------------------------------------------


def archive(frame, rows):
    return frame(rows, f"id string, updated long, title string, {reconcile.SEEN} string")


def test_reconcile_decides_each_row(frame):
    old = archive(frame, [("same", 1, "t", "d1"), ("newer", 1, "t", "d1"), ("named", 1, "t", "d1"), ("gone", 1, "t", "d1")])
    now = frame([("same", 1, "t"), ("newer", 2, "t"), ("named", 1, "u"), ("new", 1, None)], "id string, updated long, title string")
    got = reconcile.reconcile(now, old, KEY, RULE, "d2")
    assert values(got, "id", "action", reconcile.SEEN, reconcile.GONE) == [
        ("gone", reconcile.KEEP, "d1", True),
        ("named", reconcile.USE, "d2", False),
        ("new", reconcile.USE, "d2", False),
        ("newer", reconcile.USE, "d2", False),
        ("same", reconcile.COPY, "d2", False),
    ]
    assert reconcile.report(got).first().asDict() == {"added": 1, "updated": 2, "copied": 1, "preserved": 1, "total": 5}


def test_reconcile_twice_changes_nothing_and_never_shrinks(frame):
    old = archive(frame, [("a", 1, "t", "d1"), ("b", 1, "t", "d1")])
    now = frame([("b", 2, "t"), ("c", 1, "t")], "id string, updated long, title string")
    first = reconcile.reconcile(now, old, KEY, RULE, "d2")
    second = reconcile.reconcile(now, first.drop("action", "is_new"), KEY, RULE, "d2")
    same = ("id", "updated", "title", reconcile.SEEN, reconcile.GONE)
    assert values(first, *same) == values(second, *same)
    assert second.filter("action = 'to_use'").isEmpty() and second.count() == 3


def test_reappearing_row_loses_its_flag(frame):
    old = archive(frame, [("a", 1, "t", "d1")]).withColumn(reconcile.GONE, F.lit(True))
    now = frame([("a", 1, "t")], "id string, updated long, title string")
    assert values(reconcile.reconcile(now, old, KEY, RULE, "d2"), "id", reconcile.GONE) == [("a", False)]


def test_body_falls_back(frame):
    old = frame([("a", 1, "old"), ("b", 1, None)], "id string, updated long, body string")
    now = frame([("a", 2, None), ("b", 2, None)], "id string, updated long, body string")
    got = reconcile.reconcile(now, old, KEY, reconcile.later("updated"), "d", body="body")
    assert values(got, "id", "body", "body_missing") == [("a", "old", False), ("b", None, True)]


@pytest.mark.parametrize(
    ("source", "old", "new", "changed"),
    [
        ("deepseek", {"updated_at": 1.0, "title": "t"}, {"updated_at": 1.0005, "title": "t"}, False),
        ("deepseek", {"updated_at": 1.0, "title": "t"}, {"updated_at": 1.01, "title": "t"}, True),
        ("claude_ai", {"updated_at": "2025-01-01", "name": "n"}, {"updated_at": "2025-01-02", "name": "n"}, True),
        ("claude_ai", {"updated_at": "2025-01-01", "name": "n"}, {"updated_at": "2025-01-01", "name": "m"}, True),
        ("notebooklm", {"body": '{"t":[1700000000,5],"x":1}'}, {"body": '{"t":[1700000999,7],"x":1}'}, False),
        ("notebooklm", {"body": '{"x":1}'}, {"body": '{"x":2}'}, True),
        ("notebooklm", {"body": None}, {"body": '{"x":2}'}, True),
    ],
)
def test_change_rules(spark, source, old, new, changed):
    frames = [spark.createDataFrame([{"id": "a"} | x], "id string, " + ", ".join(f"{k} {'double' if isinstance(new[k], float) else 'string'}" for k in new)) for x in (new, old)]
    plan = reconcile.build_plan(*frames, KEY, reconcile.RULES[source])
    assert plan.first()["action"] == (reconcile.USE if changed else reconcile.COPY)


def test_guards():
    reconcile.guard_reconcile(50, 100)
    reconcile.guard_reconcile(0, 0)
    with pytest.raises(reconcile.DropTooLarge):
        reconcile.guard_reconcile(49, 100)


def test_preserved_files_need_a_listing(frame):
    threads = frame([("a", None, "1"), ("a", None, "2"), ("b", None, "3"), ("c", "b", "4")], "conversation_id string, parent_session_id string, file string")
    listed = frame([("2",), ("4",)], "file string")
    assert values(reconcile.preserved_files(threads, listed), "conversation_id", "is_preserved_missing") == [("a", False), ("b", False), ("c", False)]
    assert not any(v for _, v in values(reconcile.preserved_files(threads, listed.limit(0)), "conversation_id", "is_preserved_missing"))


def test_overlay_keeps_own_fields(frame):
    old = frame([("a", "x", {"_kept": "1", "plain": "2"}), ("b", "y", {})], "id string, body string, extra map<string,string>")
    new = frame([("a", "z", {"plain": "3"}, None), ("b", "q", {}, "timeout"), ("u", "v", {}, None)], "id string, body string, extra map<string,string>, error string")
    got = {r["id"]: (r["body"], r["extra"], r["refreshed"]) for r in reconcile.overlay(old, new).collect()}
    assert got == {"a": ("z", {"plain": "3", "_kept": "1"}, True), "b": ("y", {}, False)}


def test_payload_digest(frame):
    files = frame([("s", "b", "2"), ("s", "a", "1")], "source string, path string, digest string")
    none = frame([], "source string, content_hash string")
    first = reconcile.payload_changed(files, none)
    assert first.first()["changed"]
    assert not reconcile.payload_changed(files, first.select("source", "content_hash")).first()["changed"]


# --- graph -------------------------------------------------------------------------------------


def nodes(frame, rows):
    return frame([("c", n, p, k) for k, (n, p) in enumerate(rows)], "conversation_id string, node string, parent string, ord long")


def test_fork_gives_three_branches(frame):
    tree = nodes(frame, [("r", None), ("a", "r"), ("b", "a"), ("c1", "b"), ("c2", "b"), ("d", "c2"), ("lost", "nowhere")])
    got = graph.branch_forks(tree, frame([("c", "d")], "conversation_id string, current_node string"))
    assert values(got, "branch_id", "root_message_id", "leaf_message_id", "is_active", "parent_branch_id", "n_messages") == [
        ("c_c1", "c1", "c1", False, "c_main", 1),
        ("c_c2", "c2", "d", True, "c_main", 2),
        ("c_main", "r", "b", False, None, 3),
    ]
    assert values(graph.unreachable_nodes(tree), "unreachable") == [(1,)]


def test_long_chain_is_one_branch(frame):
    tree = nodes(frame, [(f"{k:04d}", f"{k - 1:04d}" if k else None) for k in range(300)])
    got = graph.branch_forks(tree, frame([], "conversation_id string, current_node string"))
    assert values(got, "branch_id", "leaf_message_id", "is_active", "n_messages") == [("c_main", "0299", False, 300)]


def test_leaf_traced_with_residual(frame):
    tree = nodes(frame, [("r", None), ("a", "r"), ("x", "r"), ("y", "x"), ("b", "a"), ("z", "x")])
    got = graph.leaf_traced(tree, frame([("c", "b")], "conversation_id string, current_node string"))
    assert values(got, "branch_id", "root_message_id", "leaf_message_id", "is_active", "parent_branch_id", "n_messages") == [
        ("c_main", "r", "b", True, None, 3),
        ("c_x", "x", "z", False, "c_main", 3),
    ]


@pytest.mark.parametrize(("walk", "leaf"), [("first", "b"), ("last", "z")])
def test_leaf_traced_without_a_leaf(frame, walk, leaf):
    tree = nodes(frame, [("r", None), ("a", "r"), ("x", "r"), ("b", "a"), ("z", "x")])
    got = graph.leaf_traced(tree, frame([("c", "unknown")], "conversation_id string, current_node string"), walk=walk)
    assert got.filter("is_active").first()["leaf_message_id"] == leaf


def test_chain_roots_and_cycles(frame):
    pointers = frame([("a", None), ("b", "a"), ("c", "b"), ("d", "missing"), ("x", "y"), ("y", "x"), ("w", "x")], "file string, previous string")
    got = graph.chain_roots(pointers)
    assert values(got, "file", "root", "in_cycle") == [
        ("a", "a", False), ("b", "a", False), ("c", "a", False), ("d", "missing", False), ("w", "w", True), ("x", "x", True), ("y", "x", True),
    ]


def test_merge_chains(frame):
    convs = frame(
        [("a", 0, None, "p", 1, 2, 2), ("b", 1, "t", None, 3, 9, 1)],
        "conversation_id string, file_ord int, title string, project string, created_at long, updated_at long, message_count long",
    )
    roots = frame([("a", "a"), ("b", "a")], "file string, root string")
    msgs = frame([("a", 1, "m1"), ("a", 2, "m2"), ("b", 1, "m3")], "conversation_id string, sequence long, message_id string")
    merged, numbered = graph.merge_chains(convs, roots, msgs)
    assert values(merged, "conversation_id", "title", "project", "created_at", "updated_at", "message_count") == [("a", "t", "p", 1, 9, 3)]
    assert values(numbered, "conversation_id", "message_id", "sequence") == [("a", "m1", 1), ("a", "m2", 2), ("a", "m3", 3)]


# --- enrich ------------------------------------------------------------------------------------


def test_reasoning_goes_ahead_or_back(frame):
    kinds = ["reasoning", "user", "reasoning", "agent", "reasoning", "user", "agent", "reasoning"]
    events = frame([("s", k, kind, f"{kind}{k}") for k, kind in enumerate(kinds)], "session string, ord int, kind string, text string")
    got = {r["ord"]: r["thinking"] for r in enrich.attach_reasoning(events).collect()}
    # The first stays pending over the user's message; the one after agent 3 overwrites its own.
    assert got == {1: None, 3: "reasoning4", 5: None, 6: "reasoning7"}


def test_reasoning_stays_pending_until_an_agent_speaks(frame):
    kinds = ["reasoning", "user", "reasoning", "agent", "user"]
    events = frame([("s", k, kind, f"r{k}") for k, kind in enumerate(kinds)], "session string, ord int, kind string, text string")
    got = {r["ord"]: r["thinking"] for r in enrich.attach_reasoning(events).collect()}
    assert got == {1: None, 3: "r0\n\nr2", 4: None}


def test_prefix_join_takes_longest(frame):
    prompts = frame([("c", 1, "Hello   World " + "x" * 60), ("c", 2, ""), ("d", 1, "something else entirely here")], "conversation_id string, ord int, text string")
    acts = frame([("hello world " + "x" * 60, 5), ("hello world " + "x" * 30 + " other", 3)], "text string, ts long")
    got = enrich.prefix_join(prompts, acts)
    assert values(got, "conversation_id", "ord", "ts", "matched_width") == [("c", 1, 5, 60), ("c", 2, None, None), ("d", 1, None, None)]
    assert values(enrich.match_status(got), "conversation_id", "status") == [("c", "PARTIAL"), ("d", "NONE")]


def test_activity_entries_in_two_languages(frame):
    html = "<div>Prompted hello <b>x</b><br>Jan 5, 2025, 3:04:05 PM BRT</div><div>Prompted oi<br>5 de fev. de 2025, 15:04:05 BRT</div>"
    got = enrich.activity_entries(frame([(html,)], "html string"), zone="America/Sao_Paulo")
    assert [(a, str(b)) for a, b in values(got, "prompt", "ts")] == [("hello x", "2025-01-05 18:04:05"), ("oi", "2025-02-05 18:04:05")]


def test_asset_files_follow_folder_order(frame):
    listing = frame([("c", "b", "f1__x.png"), ("c", "a", "f1__thumbnail.png"), ("c", "a", "f1__preview.png"), ("c", "z", "f2")], "conversation_id string, folder string, name string")
    pointers = frame([("c", "f1"), ("c", "f2")], "conversation_id string, file_id string")
    assert values(enrich.asset_files(pointers, listing, ["a", "b"]), "file_id", "path") == [("f1", "a/f1__preview.png"), ("f2", None)]


# --- sets, text, schema ------------------------------------------------------------------------


def test_keep_last_treats_null_keys_as_equal(frame):
    df = frame([(None, 1, "x"), (None, 2, "y"), ("a", 1, "z")], "k string, ord int, v string")
    assert values(setops.dedup_keep_last(df, ["k", "absent"], ["ord"]), "k", "v") == [("a", "z"), (None, "y")]
    assert values(setops.dedup_keep_first(df, ["k"], ["ord"]), "k", "v") == [("a", "z"), (None, "x"), (None, "y")]


def test_transcripts(frame):
    df = frame(
        [("q", "# t\n> hi\n> there\n\nhello\nyou\n\n> bye"), ("d", "junk\n--- USER ---\nhi\n--- ASSISTANT ---\nyo\nyo")], "path string, content string"
    )
    quoted = text.transcript_turns(df.filter("path = 'q'"), "blockquote")
    assert values(quoted, "turn", "role", "content") == [(1, "assistant", "# t"), (2, "user", "hi\nthere"), (3, "assistant", "hello\nyou"), (4, "user", "bye")]
    cut = text.transcript_turns(df.filter("path = 'd'"), "delimited")
    assert values(cut, "turn", "role", "content") == [(1, "user", "hi"), (2, "assistant", "yo\nyo")]


def test_terminal_tools(frame):
    df = frame([("p", "╭───╮\n│ x │\n╰───╯\n> do it\n⏺ Bash(ls -l)\n⏺ Read(a/b.py)\n⏺ Done")], "path string, content string")
    assert values(text.tool_lines(df), "tool_name", "command", "file_path") == [("Bash", "ls -l", None), ("Read", None, "a/b.py")]
    assert [r[1] for r in values(text.transcript_turns(df, "terminal"), "turn", "role")] == ["user", "assistant", "assistant", "assistant"]


def test_addresses_and_progress(frame):
    df = frame([(r'{"a":"https:\/\/x.org\/a.png?u=1&v=2","b":"https://x.org/b.mp4","c":"https://x.org/b.mp4"}', "step 3/4 of 9/10")], "j string, line string")
    row = df.select(text.addresses(F.col("j")).alias("u"), text.progress(F.col("line")).alias("p")).first()
    assert row["u"] == ["https://x.org/a.png?u=1&v=2", "https://x.org/b.mp4"] and row["p"] == 0.75
    kinds = df.select(F.transform(text.addresses(F.col("j")), text.address_kind)).first()[0]
    assert kinds == ["image", "video"]


def test_artifact_versions(frame):
    df = frame([("c", "a", "create", 1), ("c", "a", "update", 2), ("c", "a", "rewrite", 3)], "conversation_id string, artifact_id string, command string, ord int")
    assert values(text.artifact_versions(df, ["ord"]), "ord", "version", "is_patch") == [(1, 1, False), (2, 1, True), (3, 2, False)]


def test_redaction(frame):
    df = frame([({"api_key": "s", "x": "y"}, '{"text":"private \\"q\\"","keep":{"token":"abc","n":1}}')], "m map<string,string>, j string")
    row = df.select(text.redacted_map(F.col("m")), text.redacted_json(F.col("j"), ("text",))).first()
    assert row[0] == {"api_key": text.REDACTED, "x": "y"}
    assert row[1] == '{"text":"[REDACTED]","keep":{"token":"[REDACTED]","n":1}}'


def test_conform_and_validate(frame):
    df = frame([("m1", "c", "chatgpt", "user"), ("m2", "c", "nowhere", "robot"), (None, "c", "codex", "assistant")], "message_id string, conversation_id string, source string, role string")
    good, bad = validate(conform(df, "messages"), "messages")
    assert values(good, "message_id", "branch_id") == [("m1", "c_main")]
    assert values(bad, "message_id", "violations") == [("m2", "source,role"), (None, "message_id is missing")]


def test_exact_medians(spark):
    from tessera.plans.reports import with_median

    rows = [("a", v) for v in (1, 1, 2, 900, 901)] + [("b", -5), ("b", 3), (None, 7), ("c", None)] + [("d", k * k % 1009) for k in range(1000)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["k"]: (r["n"], r["median"]) for r in with_median(df, "v", ["k"]).collect()}
    want = {r["k"]: (r["n"], r["m"]) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.median("v").alias("m")).collect()}
    assert got == want and got["b"] == (2, -1.0) and got["c"] == (0, None)
    assert with_median(df.filter("v is null"), "v", []).collect() == [(0, None, None, None, None, None)]
    assert with_median(df, "v", []).first()["median"] == df.agg(F.median("v")).first()[0]


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1001])
def test_medians_of_values_that_lie_close(spark, n):
    """All within a sixteenth of an octave; parts are cut again, and the source is read once."""
    from tessera.plans import reports

    draw = random.Random(n)
    rows = [(draw.choice("ab"), 1.0 + draw.randrange(50_000) / 1e6) for _ in range(n)] + [("c", -float(k % 7)) for k in range(n)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in reports.with_median(df, "v", ["k"]).collect()}
    for k in {k for k, _ in rows}:
        own = sorted(v for x, v in rows if x == k)
        want = (len(own), sum(own), sum(own) / len(own), own[0], own[-1], statistics.median(own))
        assert got[k] == pytest.approx(want)
    assert reports.with_median(df, "v", []).first()["median"] == statistics.median(v for _, v in rows)


def test_medians_read_the_source_once(spark, tmp_path):
    from tessera.plans import reports

    spark.range(1000).selectExpr("id % 5 AS k", "id * id AS v").write.parquet(f"{tmp_path}/t")
    plan = reports.with_median(spark.read.parquet(f"{tmp_path}/t"), "v", ["k"])
    assert "FileScan" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 5
