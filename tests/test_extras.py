import json
import random

from pyspark.sql import functions as F

from tessera.operators import deep
from tessera.plans.normalize import extras
from tessera.schema import conform


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_deep_search(frame):
    doc = {"a": [[["https://x.org/1", "one", 3]], {"b": [["https://x.org/1", "again"], ["no", "address"]]}], "t": "# Head\n" + "x" * 2600}
    df = frame([("d", json.dumps(doc), "short"), ("e", "{broken", ""), ("f", None, None)], "id string, j string, answer string")
    assert values(deep.deep_citations(df, "id", "j"), "id", "url", "title") == [("d", "https://x.org/1", "one")]
    assert values(deep.long_texts(df, "id", "j", "answer").select("id", F.length("text").alias("n")), "id", "n") == [("d", 2607)]
    held = df.withColumn("answer", F.concat(F.lit("> "), F.get_json_object("j", "$.t")))
    assert deep.long_texts(held, "id", "j", "answer").count() == 0


def test_deep_search_stops_at_its_bound(frame):
    nested = ["https://x.org", "deep"]
    for _ in range(30):
        nested = [nested]
    assert deep.deep_citations(frame([("d", json.dumps(nested))], "id string, j string"), "id", "j").count() == 0


def plain_finds(value, depth=0, path=()):
    """The search as a recursive walk; names of objects in order."""
    text = lambda k: isinstance(value, list) and len(value) > k and isinstance(value[k], str)
    if text(3) and all(map(text, range(4))) and deep.ICON_PLACE in value[0] and value[1].startswith("http") and not any(p in value[1] for p in deep.OWN_PLACES):
        yield path, "source", value[1], value[2], depth, value[3]
    elif text(0) and text(1) and value[0].startswith(("http://", "https://")):
        yield path, "citation", value[0], value[1], depth, None
    elif isinstance(value, str) and len(value) >= 5:
        yield path, "text", None, value, depth, None
    if depth < deep.MAX_DEPTH:
        for k, child in enumerate([value[n] for n in sorted(value)] if isinstance(value, dict) else value if isinstance(value, list) else []):
            yield from plain_finds(child, depth + 1, (*path, k))


def test_deep_search_equals_a_walk(spark, frame):
    draw = random.Random(5)
    icon = "https://t0.gstatic.com/faviconV2?x"

    def value(deep_now):
        kind = draw.randrange(9 if deep_now < 17 else 4)
        if kind < 4:
            return draw.choice(["", "abc", "long text", "http://x.org/1", "https://lh3.googleusercontent.com/p", icon, None, 3, True])
        if kind < 7:
            return [value(deep_now + draw.choice([1, 1, 5])) for _ in range(draw.randrange(5))]
        if kind == 7:
            return [icon, draw.choice(["https://s.org", "https://gstatic.com/x", 3]), "title", draw.choice(["snippet", None]), [["http://in.org", "in"]]]
        return {f"k{draw.randrange(99)}": value(deep_now + 1) for _ in range(draw.randrange(4))}

    docs = [[value(0) for _ in range(6)] for _ in range(150)] + [None, 5, "a long text", {}]
    rows = frame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(-1, None)], "k int, j string").select("k", deep.deep_finds(F.try_parse_json("j"), 5).alias("x"))
    got = {r["k"]: [(tuple(x["path"]), x["kind"], x["url"], x["text"], x["depth"], x["snippet"]) for x in r["x"]] for r in rows.collect()}
    assert got.pop(-1) == [] and got == {k: list(plain_finds(d)) for k, d in enumerate(docs)}
    assert {x[1] for own in got.values() for x in own} == {"source", "citation", "text"} and max(x[4] for own in got.values() for x in own) > 8
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_pages_notebooks_and_index(frame):
    entries = [{"uuid": "e", "query_str": "q", "author_username": "other", "article_info": json.dumps({"title": "T"}), "blocks": [{"answer": "a"}]}, {"backend_uuid": "f"}]
    docs = frame([("s", json.dumps({"entries": entries})), ("none", '{"entries":[]}')], "slug string, j string").select("slug", F.parse_json("j").alias("doc"))
    heads, messages, branches = extras.pages(docs, owner="me")
    assert values(heads, "conversation_id", "title", "interaction_type", "message_count") == [("page:s", "T", "ai_ai", 4)]
    assert values(messages, "message_id", "sequence", "role", "content") == [("e_answer", 2, "assistant", "a"), ("e_query", 1, "user", "q"), ("f_answer", 4, "assistant", ""), ("f_query", 3, "user", "")]
    assert values(branches, "branch_id", "root_message_id", "leaf_message_id") == [("page:s_main", "e_query", "f_answer")]
    assets = frame([('{"asset_slug":"x","entry_uuid":"e","asset_type":"APP"}',), ('{"asset_slug":"y"}',), ('{"entry_uuid":"e"}',)], "j string").select(F.parse_json("j").alias("doc"))
    assert values(extras.asset_events(assets), "event_id", "message_id", "conversation_id", "tool_name") == [("asset:x", "e_asst", "e", "APP"), ("asset:y", "asset:y", "y", None)]
    outputs, notes = extras.legacy_notebooks(
        frame([("n", "a.m4a"), ("n", "b.xyz")], "conversation_id string, name string"),
        frame([("n", "x", "Briefing doc"), ("n", "y", "12345678-1234-1234-1234-123456789012"), ("n", "z", "plain")], "conversation_id string, name string, content string"),
    )
    assert values(outputs, "output_type", "output_type_name") == [(1, "audio_overview")]
    assert values(notes, "title", "kind") == [("x", "brief"), ("z", "note")]
    convs = conform(frame([("c", "old", None)], "conversation_id string, title string, source string"), "conversations")
    index = frame([("c", "new", "2025-01-01", None, True, True)], "conversation_id string, title string, created_at string, updated_at string, is_pinned boolean, deleted boolean")
    got = extras.with_index(convs, index.withColumn("created_at", F.to_timestamp("created_at")).withColumn("updated_at", F.to_timestamp("updated_at")))
    assert values(got, "title", "is_pinned", "is_preserved_missing") == [("new", True, True)]
