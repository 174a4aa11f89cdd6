"""Positions of rejected lines in files of many ranges, and gold checked against its schema."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from armparity.functions import json_schema as J
from armparity.functions import payload as P
from armparity.plans.registry import Source
from armparity.session import checkpoint_root
from armparity.sources import jsonl

GOOD = '{{"trace_id":"{0}","subagent":"t","model":"m","status":"ok","output":{{"text":"{1}"}}}}'


def _sequential(name, data):
    """What a plain read from the front says: line number, byte, text of each broken line."""
    out, at = [], 0
    lines = data.split(b"\n")
    for no, raw in enumerate(lines[:-1] if data.endswith(b"\n") else lines, 1):
        text = raw.decode()
        text = text[:-1] if text.endswith("\r") else text
        if text.strip(" ") and not text.startswith('{"trace_id"'):
            out.append((name, no, at, text))
        at += len(raw) + 1
    return out


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0]), spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("cut", [37, 101, 4096, 1 << 20])
def test_rejects_are_where_a_sequential_read_finds_them(spark, small_ranges, cut):
    rng, path = random.Random(cut), f"{checkpoint_root(spark).removeprefix('file:')}/{uuid.uuid4().hex}"
    import os

    os.makedirs(path)
    want = []
    for f in range(4):
        lines = []
        for i in range(rng.randint(30, 80)):
            lines.append(rng.choice([GOOD.format(i, "é東🙂" * rng.randint(0, 9)), GOOD.format(i, "x" * rng.randint(0, 300)), "", "   ", "broken é東 " + "🙂" * rng.randint(0, 40), "{"]) + rng.choice(["", "", "\r"]))
        data = ("\n".join(lines) + ("\n" if f % 2 else "")).encode()
        with open(f"{path}/f{f}.txt", "wb") as out:
            out.write(data)
        want += _sequential(f"f{f}.txt", data)
    small_ranges(cut)
    if cut < 1000:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
    calls, rejects = jsonl.read_calls(spark, path)
    got = [(r.file.rsplit("/", 1)[1], r.line_no, r.offset, r.line) for r in rejects.collect()]
    assert sorted(got) == sorted(want)
    # each offset is where the line's bytes are
    for name, _, offset, line in got:
        with open(f"{path}/{name}", "rb") as data:
            data.seek(offset)
            assert data.read(len(line.encode())) == line.encode()
    assert calls.count() == sum(open(f"{path}/f{f}.txt", encoding="utf-8").read().count('{"trace_id"') for f in range(4))


SCHEMA = {
    "type": "object", "required": ["a", "z"], "additionalProperties": False,
    "properties": {
        "a": {"type": "string", "pattern": "^x"}, "b": {"type": ["integer", "null"], "minimum": 1, "maximum": 5}, "c": {"type": "array", "minItems": 1, "maxItems": 2, "items": {
            "type": "object", "properties": {"d": {"type": "boolean"}, "e": {"enum": ["u", "v"]}}, "required": ["d"]}}, "n": {"type": "number"}, "z": {}},
}
CASES = [
    ('{"a":"x1","z":1}', []), ('{"a":"x1","z":null,"b":null,"c":[{"d":true}],"n":1.5}', []), ('{"a":"x","z":0,"b":2.0}', []),
    ('{"a":"y","z":0}', ["$.a: not of the pattern"]), ('{"a":1,"z":0}', ["$.a: not string"]), ('{"z":0}', ["$.a: missing"]), ("{}", ["$.a: missing", "$.z: missing"]),
    ('{"a":"x","z":0,"b":"2"}', ["$.b: not integer or null"]), ('{"a":"x","z":0,"b":2.5}', ["$.b: not integer or null"]), ('{"a":"x","z":0,"b":0}', ["$.b: beyond the minimum"]),
    ('{"a":"x","z":0,"b":6}', ["$.b: beyond the maximum"]), ('{"a":"x","z":0,"c":[]}', ["$.c: fewer than 1 items"]), ('{"a":"x","z":0,"c":{}}', ["$.c: not array"]),
    ('{"a":"x","z":0,"c":[{"d":true},{"d":"t","e":"w"},{"e":"u"}]}', ["$.c: more than 2 items", "$.c[1].d: not boolean", "$.c[1].e: not an allowed value", "$.c[2].d: missing"]),
    ('{"a":"x","z":0,"q":1,"p":2}', ["$.p: unknown key", "$.q: unknown key"]), ("[1]", ["$: not object"]), ('"text"', ["$: not object"]), ("null", ["$: not object"]), ("{", ["$: not JSON"]), (None, ["$: missing"]),
    ('{"a":"x","z":0,"n":"1"}', ["$.n: not number"]),
]


def test_schema_defects(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", J.defects_of_text(F.col("t"), SCHEMA).alias("d")).collect()}
    assert got == {i: d for i, (_, d) in enumerate(CASES)}
    with pytest.raises(ValueError, match="not compiled: oneOf"):
        J.defects(F.col("t"), {"oneOf": []})
    with pytest.raises(ValueError, match="unknown type"):
        J.defects(F.col("t"), {"type": "date"})


def test_defects_agree_with_the_validity_metric(spark):
    """No defect means valid, over every answer of the study's log: two independent roads to the same schema."""
    calls = Source(spark, "/root/testdata/sf0.001").view("calls").filter("payload_json is not null")
    shape = P.shape(F.col("payload_json"))
    both = calls.select("call_id", "payload_json", P.schema_valid(F.col("task"), P.answer(F.col("payload_json"), shape), shape).alias("valid"),
                        P.gold_defects(F.col("task"), F.col("payload_json")).alias("defects")).collect()
    assert {r.valid for r in both} == {True, False}
    for r in both:
        assert r.valid == (not r.defects), (r.payload_json, r.defects)


def test_gold_items_are_checked_on_read(spark):
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    rubric = [{"id": f"r{k}", "criterion": "c"} for k in range(3)]
    gold = json.dumps({"summary": "s", "key_points": []})
    rows = [{"item_id": "1", "subagent": "chunk_summarizer", "gold": gold, "rubric": rubric}, {"item_id": "2", "subagent": "nobody", "gold": gold, "rubric": rubric},
            {"item_id": "3", "subagent": "chunk_summarizer", "gold": "{}", "rubric": rubric[:2]}, {"item_id": "4", "subagent": "chunk_summarizer", "gold": gold, "rubric": [rubric[0]] * 3},
            {"item_id": "5", "subagent": "chunk_summarizer", "gold": gold}]
    spark.createDataFrame([(json.dumps(r),) for r in rows] + [("  ",)], "value string").coalesce(1).write.text(path)
    items, rejects = jsonl.read_items(spark, path)
    assert [r.item_id for r in items.collect()] == ["1"]
    assert {json.loads(r.line)["item_id"]: r.reject for r in rejects.collect()} == {
        "2": "unknown task: nobody", "3": "gold.summary: missing; gold.key_points: missing; rubric needs three to five criteria", "4": "duplicate rubric id",
        "5": "rubric needs three to five criteria"}


def test_records_and_rejects_are_of_one_read(spark):
    import os

    path = f"{checkpoint_root(spark).removeprefix('file:')}/{uuid.uuid4().hex}"
    os.makedirs(path)
    lines = [GOOD.format(1, "x"), "", "{", GOOD.format(2, "y"), "  ", '{"trace_id":"3"}']
    with open(f"{path}/log.txt", "w") as out:
        out.write("\n".join(lines) + "\n")
    calls, rejects = jsonl.read_calls(spark, path)
    with open(f"{path}/log.txt", "w") as out:
        out.write("\n".join([*reversed(lines), "[", GOOD.format(4, "z")]) + "\n")
    assert sorted((r.trace_id, r.output.text) for r in calls.collect()) == [("1", "x"), ("2", "y")]
    at = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
    assert sorted((r.line_no, r.offset, r.line) for r in rejects.collect()) == [(3, at[2], lines[2]), (6, at[5], lines[5])]
