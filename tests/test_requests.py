"""Chat requests against a plain version."""

import json
import random

import pytest

from grainmill.operators import requests as Q
from grainmill.plans import request_queries as P


def plain_request(body):
    """The checks, one after the other: an error or the values."""
    if not body:
        return "empty request body"
    try:
        v = json.loads(body)
    except ValueError:
        return "request body must be valid JSON"
    if not isinstance(v, dict):
        return "request body must be a JSON object"
    items = v.get("messages")
    if not isinstance(items, list) or not items:
        return "messages must be a non-empty list"
    messages = []
    for k, item in enumerate(items):
        if not isinstance(item, dict):
            return f"messages[{k}] must be an object"
        if item.get("role") not in ("system", "developer", "user", "assistant"):
            return f"messages[{k}].role must be system, user, or assistant"
        if not isinstance(item.get("content"), str):
            return f"messages[{k}].content must be a string"
        messages.append(({"developer": "user"}.get(item["role"], item["role"]), item["content"]))
    most = next((v[c] for c in ("max_tokens", "max_completion_tokens") if v.get(c) is not None), 4096)
    try:
        t, p, m = float(v.get("temperature", 0.3)), float(v.get("top_p", 0.9)), int(most)
    except (TypeError, ValueError):
        return "temperature, top_p and max_tokens must be numbers"
    if not 0 <= t <= 2:
        return "temperature must be between 0 and 2"
    if not 0 < p <= 1:
        return "top_p must be between 0 and 1"
    if m < 1:
        return "max_tokens must be at least 1"
    return str(v.get("model") or "local"), messages, t, p, min(m, 16384), bool(v.get("stream", False))


def told(df):
    return {r["k"]: r["error"] or (r["model"], [tuple(m) for m in r["messages"]], r["temperature"], r["top_p"], r["max_tokens"], r["stream"]) for r in Q.parse_requests(df, "local").collect()}


@pytest.mark.parametrize("seed", range(2))
def test_bodies_of_a_plain_version(spark, seed):
    rng = random.Random(seed)
    numbers = [0, 1, 2, 0.5, 1.0, -0.5, 2.5, 1e3, 1e300, 10**20, 5000, "1", " 0.5\t", "1_0", "1__0", "_1", "1e-1", ".5", "5.", "", " ", "hot", "1f", "0x1", "nan", "-Infinity", "+1", True, False, None, [], [1], {}, {"a": 1}, "7" * 30]
    any_value = ["", "x", 0, 5, 1.5, True, False, None, [], {}, "false"]

    def message():
        one = {"role": rng.choice(["system", "developer", "user", "assistant"]), "content": rng.choice(["", "hi", "zwei\nZeilen \"x\" é\U0001f600"])}
        if rng.random() < 0.1:
            one[rng.choice(["role", "content"])] = rng.choice(["tool", None, 5, ["user"], {"role": "user"}])
        if rng.random() < 0.05:
            del one[rng.choice(["role", "content"])]
        return one if rng.random() < 0.95 else rng.choice([None, 5, "x", [one]])

    bodies = []
    for _ in range(600):
        v = {"messages": [message() for _ in range(rng.randint(0, 4))]}
        for c in ("temperature", "top_p", "max_tokens", "max_completion_tokens"):
            if rng.random() < 0.3:
                v[c] = rng.choice(numbers if rng.random() < 0.4 else [1, "1", 0.5 if c[0] == "t" else 1])
        for c in ("model", "stream"):
            if rng.random() < 0.4:
                v[c] = rng.choice([x for x in any_value if c == "stream" or not isinstance(x, float)])
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5)
        bodies.append(text if rng.random() < 0.95 else text[: rng.randint(0, len(text))])
    bodies += [None, "", " ", "null", "5", '"x"', "[]", "{}", '{"messages": null}', '{"messages": "hi"}', '{"messages": {}}']
    got = told(spark.createDataFrame(list(enumerate(bodies)), "k int, body string"))
    want = {k: plain_request(b) for k, b in enumerate(bodies)}
    assert {k: (bodies[k], got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert len({w for w in want.values() if isinstance(w, str)}) > 10


def test_sizes_and_clashing_columns(spark):
    big = json.dumps({"messages": [{"role": "user", "content": "x" * Q.MOST_BYTES}]})
    long = json.dumps({"messages": [{"role": "user", "content": "x"}] * 5000})
    got = told(spark.createDataFrame([(0, big, "old", 5), (1, long, "old", 5)], "k int, body string, error string, model int"))
    assert got[0] == "request body too large" and len(got[1][1]) == 5000
    assert Q.parse_requests(spark.createDataFrame([], "k int, body string"), "local").count() == 0


def test_system_prompt_once(spark):
    body = '{"messages": [{"role": "%s", "content": "a"}]}'
    df = Q.parse_requests(spark.createDataFrame([(body % r,) for r in ("user", "system")], "body string"), "m")
    got = [[tuple(m) for m in r[0]] for r in df.select(Q.with_system_prompt(df["messages"], "be kind")).collect()]
    assert sorted(got) == [[("system", "a")], [("system", "be kind"), ("user", "a")]]


def test_query_bodies_of_a_plain_version(spark, sf_dir):
    bodies = {(r["conv_id"], r["turn"]): r["body"] for r in P.request_bodies(spark, sf_dir).collect()}
    got = {(r["conv_id"], r["turn"]): r for r in P.QUERIES["chat_requests"](spark, sf_dir).collect()}
    assert len(got) == len(bodies) > 0
    for k, body in bodies.items():
        want = plain_request(body)
        if isinstance(want, str):
            assert got[k]["error"] == want
        else:
            assert (got[k]["error"], got[k]["model"], got[k]["temperature"], got[k]["top_p"], got[k]["max_tokens"], got[k]["stream"]) == (None, want[0], *want[2:])
