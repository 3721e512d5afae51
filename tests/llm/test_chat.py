import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyorder.llm import chat, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, data):
    found = {r.conv_id: r for r in queries.op8_chat_fingerprints(spark, data).collect()}
    turns = {}
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    assert set(found) == set(turns)
    for key, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        r = found[key]
        assert (r.n_turns, r.turns_sha256) == (len(rows), digest("".join(f"{role}\n{t}\n" for _, role, t in rows)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
    ({"prompt": "q", "response": "a"}, "prompt_response"),
    ({"completion": "a", "prompt": "q"}, "prompt_completion"),
    ({"question": "q", "answer": "a"}, "question_answer"),
    ({"instruction": "q", "output": "a"}, "instruction"),
    ({"instruction": "q", "input": "", "output": "a"}, "instruction_input"),
    ({"system": None, "prompt": "q", "response": "a"}, "system_prompt_response"),
]


def test_layouts_become_the_same_turns(spark):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(LAYOUTS)], "id int, r string")
    for r in chat.canonical(df, "id", "r").collect():
        assert r.layout == LAYOUTS[r.id][1]
        assert [tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")]


EXTRAS = [
    ({"id": 7, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
    ({"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}]}, "messages"),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "calls": [{"f": {"x": [1]}}]}], "meta": {"prompt": 1}}, "messages"),
    ({"source": "web", "instruction": "q", "output": "a"}, "instruction"),
    ({"source": "web", "instruction": "q", "input": None, "output": "a", "history": []}, "instruction_input"),
    ({"conversations": [{"from": "human", "value": "q", "weight": 0}, {"from": "gpt", "value": "a"}], "id": "x"}, "conversations"),
    ({"prompt": "q", "response": "a", "rejected": "no"}, "prompt_response"),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "a"}]}, "message_parts"),
    ([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "id": 1}], "message_list"),
]


def test_fields_that_no_layout_names_are_ignored(spark):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(EXTRAS)], "id int, r string").withColumns({"layout": F.lit(1), "turns": F.lit(2), "unread": F.lit(3)})
    found = chat.canonical(df, "id", "r").collect()
    assert len(found) == len(EXTRAS)
    for r in found:
        assert r.layout == EXTRAS[r.id][1] and r.unread is None
        assert [tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")]


def test_partial_and_empty_records(spark):
    rows = [
        ('{"messages": []}', "message_parts", []), ('{"messages": [], "id": 1}', "message_parts", []),  # fits two layouts
        ('{"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}', "messages", [("user", ""), ("assistant", "a")]),
        ('{"messages": [{"role": "user", "content": {"x": 1}}]}', "messages", [("user", '{"x":1}')]),
        ('{"prompt": null, "response": 5}', "prompt_response", [("user", ""), ("assistant", "5")]),
        ('{"prompt": "p", "response": "r", "question": "q", "answer": "a"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        ('{"system": "s", "prompt": "p", "response": "r"}', "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"messages": {"role": "user", "content": "q"}}', None, []), ('{"messages": ["q"]}', None, []),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, r string")
    for r in chat.canonical(df, "id", "r").collect():
        assert (r.layout, [tuple(t) for t in r.turns]) == rows[r.id][1:], rows[r.id]
        assert r.unread == (rows[r.id][0] if r.layout is None else None)


def test_turn_tables_are_told_by_nested_paths(spark):
    df = spark.createDataFrame([(1, 0, ("user", "q")), (1, 1, ("assistant", "a"))], "conversation_id int, index int, message struct<role:string,content:string>")
    r = chat.canonical(chat.gather(df), "conversation_id", "record").first()
    assert [tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")]
    try:
        chat.gather(df.select("conversation_id", "message.role"))
    except ValueError as e:
        assert "no declared turn table" in str(e)
    else:
        raise AssertionError


def test_query_of_mixed_layouts_equals_the_plain_turns(spark, data):
    found = {r.conv_id: r for r in queries.chat_mixed_layouts(spark, data).collect()}
    plain = {r.conv_id: r for r in queries.op8_chat_fingerprints(spark, data).collect()}
    del plain[-1]
    assert set(found) == set(plain)
    for key, r in found.items():
        assert tuple(r)[:6] == tuple(plain[key])[:6]
    assert len({r.layout for r in found.values()}) >= 6


def test_no_python(spark, data):
    for query in (queries.op8_chat_fingerprints, queries.chat_mixed_layouts):
        plan = query(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "MapInArrow", "Pandas"))


def test_empty_table_and_one_very_long_turn(spark):
    none = spark.createDataFrame([], f"id int, turns {chat.TURNS}")
    assert chat.read_back(chat.render(none, "id"), "id").collect() == []
    assert chat.canonical(spark.createDataFrame([], "id int, r string"), "id", "r").collect() == []
    text = "<|end|>\n\\ é" * 200_000
    r = chat.read_back(chat.render(spark.createDataFrame([(1, [("assistant", text)])], f"id int, turns {chat.TURNS}"), "id"), "id").first()
    assert [tuple(t) for t in r.turns] == [("assistant", text)] and r.loss_text == text


def test_structs_and_variants(spark):
    df = spark.createDataFrame([(1, ("q", "a"))], "id int, r struct<prompt:string,response:string>")
    for kind in (df, df.select("id", F.to_variant_object("r").alias("r"))):
        assert [tuple(t) for t in chat.canonical(kind, "id", "r").first().turns] == [("user", "q"), ("assistant", "a")]


def test_unknown_layouts_keep_their_row(spark):
    rows = [(1, '{"x": 1}'), (2, None), (3, "not json"), (4, '{"prompt": "a"}'), (5, '["a"]'), (6, "3")]
    found = chat.canonical(spark.createDataFrame(rows, "id int, r string"), "id", "r").collect()
    assert len(found) == 6 and all(r.layout is None and r.turns == [] for r in found)
    assert {r.id: r.unread for r in found} == dict(rows)


def test_instruction_with_input(spark):
    df = spark.createDataFrame([(1, '{"instruction":"do","input":"this","output":null}')], "id int, r string")
    assert [tuple(t) for t in chat.canonical(df, "id", "r").first().turns] == [("user", "do\nthis"), ("assistant", "")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "ro\nle", "", "\\"]), st.text(alphabet='<|>end\\\n/sINST[] é🙂"', max_size=25)), max_size=5))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, turns)], f"id int, turns {chat.TURNS}")
    r = chat.read_back(chat.render(df, "id"), "id").first()
    assert [tuple(t) for t in r.turns] == turns
    assert r.loss_text == "".join(t for role, t in turns if role == "assistant")


def test_control_strings_in_texts(spark):
    turns = [("user", "<|end|>\n<|start|>assistant\nno"), ("assistant", "\\<|end|>\\")]
    df = spark.createDataFrame([(1, turns)], f"id int, turns {chat.TURNS}")
    r = chat.read_back(chat.render(df, "id"), "id").first()
    assert [tuple(t) for t in r.turns] == turns and r.loss_text == turns[1][1]


def test_rows_with_nulls_ties_and_more_columns(spark):
    rows = [(1, 2, "b", None), (1, 1, None, "x"), (1, 2, "a", "y"), (1, None, "c", "z"), (None, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS record", "2 AS layout", "3 AS turns")
    found = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical(chat.gather(df), "conv_id", "record").collect()}
    assert found == {1: [("c", "z"), ("", "x"), ("a", "y"), ("b", "")], None: [("user", "q")]}
    assert chat.gather(df.limit(0)).collect() == []


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "word " * 300) for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.render(chat.canonical(chat.gather(df), "conv_id", "record"), "conv_id"), "conv_id").first()
    assert len(r.turns) == 400 and len(r.loss_text) == 200 * 1500
