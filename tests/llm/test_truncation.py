import pytest
from pyspark.sql import functions as F

from kinograph.llm import truncation as T

ARMS = [("g", "graph", 100), ("d", "description", 100)]
GRAPH = "[Context]\nmedium: a\nformat: b\ntopics: c\n[Entities]\ncook; tall\npot\ngarage door\n[Actions]\ncook - stirring - pot; none; "
SCHEMA = "output_id long, arm string, raw_output string, tokens int, finish_reason string, warning array<string>, error string, text string"


def judged(spark, data):
    outputs = spark.createDataFrame([(n, *d, None, None) for n, d in enumerate(data)], SCHEMA)
    found = T.judged_outputs(outputs, spark.createDataFrame(ARMS, "arm string, representation string, max_new_tokens int"))
    return {r.output_id: (r.cut, r.cause) for r in found.collect()}


@pytest.mark.parametrize(
    ("arm", "text", "complete"),
    [
        ("d", "A cook stirs.", True), ("d", "A cook stirs", False), ("d", "A cook sti", False), ("d", "He said “stop.”", True), ("d", "It fades out…", True), ("d", "厨师把碗放在桌上。", True),
        ("d", "厨师把碗", False), ("d", "A cook stirs. 🎬", True), ("d", "A cook stirs 🎬", False), ("d", "A cook stirs (no text.)", True), ("d", "A cook stirs. (No te.", False), ("d", "A cook, e.g.", False),
        ("d", "A cook stirs.\n", True), ("d", "A cook stirs,", False), ("d", "A cook st�", False), ("d", "A cook \\u00", False), ("d", "x " * 50_000 + "end.", True),
        ("g", GRAPH + "unknown", True), ("g", GRAPH + "garage door", True), ("g", GRAPH + "garage", False), ("g", GRAPH + "unk", False), ("g", GRAPH + "\n", False), ("g", GRAPH[: GRAPH.index("[Act")], False),
        ("g", GRAPH[: GRAPH.index("cook -")] + "none", True), ("g", GRAPH[: GRAPH.index("cook -")] + "non", False), ("g", GRAPH[: GRAPH.index("cook -")], False), ("g", "```\n" + GRAPH + "pot\n```", True),
        ("g", "```\n" + GRAPH + "pot", False), ("g", "```\n" + GRAPH + "pot\n``", False), ("g", "[Context]\nmed", False), (None, GRAPH + "pot", True), (None, GRAPH + "po", False), (None, "Fine.", True),
    ],
)
def test_endings(spark, arm, text, complete):
    assert judged(spark, [(arm, text, None, "stop", None)])[0][0] is not complete


def test_reasons_and_tokens(spark):
    data = [
        ("d", "A cook stirs.", 100, "stop", None), ("d", "A cook stirs.", 100, None, []), ("d", "A cook stirs.", 100, "unknown", None), ("d", "A cook stirs.", 7, "FinishReason.MAX_TOKENS", None),
        ("d", "A cook stirs.", 7, None, ["TOKEN_LIMIT"]), ("d", "A cook", 100, "STOP", None), ("d", None, 3, "length", None), ("d", "", 3, "length", None), ("d", " \n", 3, "length", None), ("x", "Well.", 900, None, None),
    ]
    found = judged(spark, data)
    assert {k: v[1] for k, v in found.items()} == {0: None, 1: "token_limit", 2: "token_limit", 3: "token_limit", 4: "token_limit", 5: "transfer", 9: None}
    shares = T.cut_shares(T.judged_outputs(spark.createDataFrame([(n, *d, None, None) for n, d in enumerate(data)], SCHEMA), spark.createDataFrame(ARMS, "arm string, representation string, max_new_tokens int")))
    assert {r.arm: (r.outputs, r.cut) for r in shares.collect()} == {"d": (6, 5), "x": (1, 0)}


def test_hidden_limits(spark, rows):
    """Texts are stored in 200 bytes of JSON, so their characters differ; complete ones of that length stay."""
    full = [f'The "cook" {k} stirs\nthe pot with care. ' * 9 for k in range(60)]
    stored = []
    for k, text in enumerate(full):
        cut, size = "", 0
        for c in text + "é" * (k % 3):
            step = 2 if c in '"\n' else 1
            if size + step > 200:
                break
            cut, size = cut + c, size + step
        stored.append(cut if size == 200 else cut + "x")
    natural = ["A cook stirs. " * (1 + k % 20) + "a" * (k % 37) + "." for k in range(400)]
    data = [("d", t, None, "stop", None) for t in stored + natural] + [("d", "Copies do not count.", 5, "stop", None)] * 50
    outputs = spark.createDataFrame([(n, *d, None, None) for n, d in enumerate(data)], SCHEMA)
    limits = rows(T.storage_limits(outputs.select("arm", "raw_output")), "measure", "length")
    assert ("json_escaped", 200) in limits and all(m != "characters" or n != 20 for m, n in limits)
    found = judged(spark, data)
    assert all(found[k][0] for k in range(60)) and sum(found[k][1] == "storage_limit" for k in range(60)) > 50
    assert not any(found[k][0] for k in range(60, len(data)))


def test_lengths(spark):
    text = 'é"<&>\n\U0001f600\r\n\\\t'
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*(c.cast("int").alias(m) for m, c in T.stored_lengths(F.col("t")).items())).first().asDict()
    import html
    import json

    assert got == {
        "characters": len(text), "utf8_bytes": len(text.encode()), "utf16_units": len(text.encode("utf-16-le")) // 2, "html_escaped": len(html.escape(text)),
        "json_escaped": len(json.dumps(text, ensure_ascii=False)) - 2, "json_ascii": len(json.dumps(text)) - 2, "crlf_lines": len(text.replace("\r\n", "\n").replace("\n", "\r\n")),
    }


def test_empty_table(spark):
    assert judged(spark, []) == {}
