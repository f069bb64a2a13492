import json
import random

import pyarrow as pa
import pytest

from corvane.operators.nested import child_table, flatten_batch, flatten_json
from corvane.plans import analytics, records


def _strict(text):
    def no(_):
        raise ValueError

    return json.loads(text, parse_constant=no)


def _valid(text):
    try:
        return True, _strict(text)
    except (ValueError, RecursionError):
        return False, None


def brute(text):
    """Paths of the object elements, by plain recursion."""
    found = set()

    def walk(v, path, elem):
        while isinstance(v, str):
            good, inner = _valid(v)
            if not good or not isinstance(inner, (dict, list, str)):
                return
            v = inner
        if isinstance(v, dict):
            if elem:
                found.add(path)
            for k, x in v.items():
                walk(x, f"{path}.{k}", False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", True)

    if text is not None and _valid(text)[0]:
        walk(_valid(text)[1], "$", False)
    return found


def by_batch(texts):
    t = flatten_batch(pa.array([str(i) for i in range(len(texts))]), pa.array(texts, pa.string()))
    out = {}
    for i, p in zip(t["row_id"].to_pylist(), t["node_path"].to_pylist(), strict=True):
        out.setdefault(int(i), set()).add(p)
    return [out.get(i, set()) for i in range(len(texts))]


CASES = [
    None, "", "  ", "null", "12", '"x"', "[]", "{}", "[{}]", '{"a":[{"b":[null,{"c":[1,{}]}]}]}', "[[{}],[{},{}]]", '[1,"a",{"k":"v"}] ', "[{}] x", "[{},]", "[,{}]", "[{}{}]", '{"a" [{}]}',
    '{"a":[{}],}', '{"a":[{}]', '[{"a":01}]', '[{"a":NaN}]', '[{"a":tru}]', "[{'a':1}]", '[{"a":"\t"}]', '[{"a":"\\x"}]', '[{"a":"\\u12g4"}]', '[{"a":"\\u0041"}]', '{"q\\"[{":[{"z":"]}"}]}', "[{}]\\", '\\"[{}]',
    json.dumps(json.dumps([{"a": [{}]}])), json.dumps(json.dumps(json.dumps([{}]))), json.dumps({"x": ["[{}]", "{\"y\":[{}]}", "[{]"]}), json.dumps(['{"a":1}', json.dumps(json.dumps({"b": [{}]}))]), '{"a":[{"é":[{"日":"本"}]}]}', '[{"a":1}]\n[{"b":2}]', "]{}[", '{"a":1:2}', '{1:2}', '{"a":{"b"}}', '[1 2]', '[{"a":"b" "c"}]', '"abc', '[{"a":"\\\\"}]', '[{"a":"\\\\\\""}]', '﻿[{}]', ' [{}]', '[-1, 1e5, 1.0E-2, {}]', '[1., {}]', '[.5,{}]', '[+1,{}]', '{"a":[{}]}{"b":1}', '[{"a":"\\ud800"}]',
]


def test_cases_match_recursion():
    assert by_batch(CASES) == [brute(t) for t in CASES]


def test_random_and_damaged():
    r = random.Random(5)

    def val(d):
        k = r.random()
        if d == 0 or k < 0.3:
            return r.choice([None, True, -1.5e-3, 0, "", "a b", "{", '"', "\\", "[{}]", "é\n", "x,y:z"])
        if k < 0.55:
            return [val(d - 1) for _ in range(r.randrange(4))]
        if k < 0.9:
            return {r.choice(["a", "b c", "n", 'q"', "é"]) + str(i): val(d - 1) for i in range(r.randrange(4))}
        return json.dumps(val(d - 1))

    texts = []
    for _ in range(3000):
        t = json.dumps(val(5), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        if r.random() < 0.5 and t:
            i = r.randrange(len(t))
            t = t[:i] + r.choice(["", "", '"', "\\", "{", "}", "]", ",", ":", "0", " ", "\x01"]) + t[i + r.randrange(2) :]
        texts.append(t)
    assert by_batch(texts) == [brute(t) for t in texts]


def test_very_deep_and_long():
    deep = "[" * 3000 + "{}" + "]" * 3000
    long = "[" + ",".join('{"a":"%s"}' % ("x" * 50) for _ in range(20000)) + "]"
    got = by_batch([deep, long])
    assert got[0] == {"$" + "[0]" * 3000} and len(got[1]) == 20000


def test_slices_of_arrays():
    a = pa.array(["[{}]", None, '{"a":[{}]}', "x"]).slice(1)
    assert flatten_batch(pa.array(["1", "2", "3"]), a)["node_path"].to_pylist() == ["$.a[0]"]


def test_tables(spark):
    rows = [("r1", '{"jobs":[{"t":"x","y":3,"p":[{"n":1},null,{"n":"2"}]}]}', "clash"), ("r1", '{"jobs":[{"t":"x","y":3,"p":[]}]}', "c"), (None, '[{"t":null}]', None), ("r3", None, None)]
    df = spark.createDataFrame(rows, "id string, j string, node_path string")
    nodes = flatten_json(df, "j")
    got = {(r.row_id, r.node_path, r.parent_path, r.position) for r in nodes.collect()}
    assert ("r1", "$.jobs[0].p[2]", "$.jobs[0]", 2) in got and (None, "$[0]", None, 0) in got
    child = child_table(nodes, "$.jobs[].p[]", {"n": "int"}).orderBy("position").collect()
    assert [(c.row_id, c.parent_path, c.position, c.n) for c in child] == [("r1", "$.jobs[0]", 0, 1), ("r1", "$.jobs[0]", 2, 2)]
    assert flatten_json(df.limit(0), "j").count() == 0


@pytest.mark.parametrize("text", ['[{"a":1,"a":"2","b":null,"c":{"d":1}}]'])
def test_attributes(text):
    t = flatten_batch(pa.array(["1"]), pa.array([text]))
    assert dict(t["attributes"].to_pylist()[0]) == {"a": "2", "b": None}


def test_criteria_in_either_shape(spark, tmp_path):
    one = '[{"id":"c1","label":"a","type":"required","weight":2.0,"alternatives":[{"label":"x"}]}]'
    rows = [("j1", one), ("j2", '{"version":"v2","criteria":' + one + "}"), ("j3", json.dumps('{"criteria":' + one + "}")), ("j4", '{"other":' + one + "}")]
    spark.createDataFrame(rows, "id string, criteria_json string").write.parquet(f"{tmp_path}/jobs.parquet")
    got = {(r.row_id, r.node_path, r.position, r.id, r.weight) for r in records.p6_criteria(spark, str(tmp_path)).collect()}
    assert got == {("j1", "$[0]", 0, "c1", 2.0), ("j2", "$.criteria[0]", 0, "c1", 2.0), ("j3", "$.criteria[0]", 0, "c1", 2.0)}
    assert {r.job_id for r in analytics.criteria_calibration(spark, str(tmp_path)).collect()} == {"j1", "j2", "j3"}


def brute_every(text):
    """(path, parent, position, members, value) of all objects, and of all plain elements and roots, by plain recursion."""
    found = set()

    def plain(v):
        return None if v is None else v if isinstance(v, str) else json.dumps(v)

    def walk(v, path, above, place, member):
        own = v
        while isinstance(v, str):
            good, inner = _valid(v)
            if not good or not isinstance(inner, (dict, list, str)):
                break
            v = inner
        if isinstance(v, dict):
            members = {k: plain(x) for k, x in v.items() if not isinstance(x, (dict, list))}
            found.add((path, above, place, json.dumps(members, sort_keys=True), None))
            for k, x in v.items():
                walk(x, f"{path}.{k}", path, None, True)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", above, i, False)
        elif not member:
            found.add((path, above, place, None, plain(own)))

    if text is not None and _valid(text)[0]:
        walk(_valid(text)[1], "$", None, None, False)
    return found


EVERY = [
    '{"skills":["a",null,3,true,"[x","[1,{\\"k\\":\\"v\\"}]"],"jobs":[{"t":"x","period":{"from":"1","to":null},"skills":["b"]}],"one":{"title":"t"},"n":1}',
    '"text"', "null", "7", "[]", "{}", '[["a",[1]],{}]', json.dumps(json.dumps('{"a":["b"]}')), json.dumps([json.dumps(json.dumps([1, {"a": {"b": 2}}])), json.dumps("x"), json.dumps(json.dumps("{x"))]), '["a",]', "", None,
]


def test_every_value_matches_recursion():
    texts = EVERY + [t for t in CASES if t is None or not _valid(t)[0] or "1e5" not in t and "ud800" not in t]
    t = flatten_batch(pa.array([str(i) for i in range(len(texts))]), pa.array(texts, pa.string()), every=True)
    got = {}
    for x in t.to_pylist():
        members = None if x["attributes"] is None else json.dumps(dict(x["attributes"]), sort_keys=True)
        got.setdefault(int(x["row_id"]), set()).add((x["node_path"], x["parent_path"], x["position"], members, x["value"]))
    assert [got.get(i, set()) for i in range(len(texts))] == [brute_every(t) for t in texts]


def test_nodes_hold_plain_and_nested_values(spark, tmp_path):
    for name, column, text in (("candidates", "profile_json", EVERY[0]), ("jobs", "criteria_json", None), ("audit_events", "details_json", '{"by":{"role":"hm"},"n":2}')):
        spark.createDataFrame([("r", text)], f"id string, {column} string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(x.src_table, x.kind, x.position, x.parent_path, x.members, x.value) for x in records.p6_nodes(spark, str(tmp_path)).collect()}
    assert ("candidates", "$.skills[]", 0, "$", None, "a") in got and ("candidates", "$.jobs[].period", None, "$.jobs[0]", '{"from":"1"}', None) in {(*x[:4], x[4] and x[4].replace(',"to":null', ""), x[5]) for x in got}
    assert ("audit_events", "$.by", None, "$", '{"role":"hm"}', None) in got and ("audit_events", "$", None, None, '{"n":"2"}', None) in got
    assert {(x.src_table, x.node_path) for x in records.p6_found(spark, str(tmp_path)).collect()} == {("candidates", "$.jobs[0]"), ("candidates", "$.skills[5][1]")}
