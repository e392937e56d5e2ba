"""Formulas, diagrams, page data and the export quota on small cases of their own."""

import json
import random
from datetime import datetime, timedelta

from inkwell.operators import embedded as E
from inkwell.operators import quota as U
from inkwell.operators import wordfix as W
from inkwell.operators.lines import lines


def nested(levels):
    node = {"role": "human", "content": " deep "}
    for _ in range(levels):
        node = [node]
    return json.dumps(node)


def test_json_messages_reach_their_depth_and_number(spark):
    many = json.dumps([{"role": "user", "text": str(i)} for i in range(600)])
    rows = [(1, nested(24)), (2, nested(25)), (3, None), (4, "{"), (5, many), (6, '{"role": "ai", "parts": ["a", 1, "b"], "text": "c"}'), (7, '{"role": "ai", "parts": [], "text": "c"}'), (8, '{"role": "ai", "content": "\\ud800x"}'), (9, "[" * 100000)]
    found = E.json_messages(spark.createDataFrame(rows, "id long, json string")).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.id, r.path)):
        by.setdefault(r.id, []).append((r.role, r.content))
    assert by.pop(5) == [("user", str(i)) for i in range(E.MESSAGES)]
    assert by == {1: [("user", "deep")], 6: [("assistant", "a\n\nb")], 8: [("assistant", "?x")]}


def test_page_messages_take_the_first_layer(spark):
    flight = '"role":"user" junk "parts":["q \\"]\\" x"], "author": { "role" : "assistant"},"parts":["a"'
    both = '<script type="application/ld+json">[{"role":"bot","text":"t"}]</script>' + flight
    state = 'window.__INITIAL_STATE__ = ; {"s": "}\\"", "m": {"role": "user", "text": "u"}} tail'
    far = '"role":"user"' + " " * 4000 + '"parts":["lost"]'
    rows = [(1, flight), (2, both), (3, state), (4, far), (5, None), (6, ""), (7, "window.__INITIAL_STATE__ = {")]
    found = {(r.conv_id, r.turn): (r.role, r.text, r.layer) for r in E.page_messages(spark.createDataFrame(rows, "conv_id long, html string")).collect()}
    assert found == {(1, 0): ("user", 'q "]" x', "flight"), (2, 0): ("assistant", "t", "json"), (3, 0): ("user", "u", "json")}


def plain_quota(attempts):
    device, address, passed = {}, {}, set()
    for i, d, a, at in sorted(attempts, key=lambda x: (x[3], x[0])):
        day = (a, at.date())
        if device.get(d, 0) < U.DEVICE and address.get(day, 0) < U.ADDRESS:
            device[d], address[day] = device.get(d, 0) + 1, address.get(day, 0) + 1
            passed.add(i)
    return passed


def test_quota_equals_a_fold(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(i, None, rng.randrange(60) if rng.random() > 0.3 else 0, f"a{rng.randrange(12)}", "pdf", False, start + timedelta(minutes=rng.randrange(6000))) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, user_id long, device_id long, ip string, format string, check_only boolean, created_at timestamp_ntz")
    accounts = spark.createDataFrame([(7, "active", 98)], "id long, status string, exports long")
    passed = {r.id for r in U.decide(frame, accounts).collect() if r.verdict == "ok"}
    assert passed == plain_quota([(r[0], r[2], r[3], r[6]) for r in rows])
    users = [(i, 7, None, None, "docx", i == 1, start + timedelta(hours=i)) for i in range(5)] + [(8, 9, None, None, "pdf", False, start), (9, None, 1, None, "pdf", False, start), (10, 7, None, None, "odt", False, start)]
    verdicts = {r.id: r.verdict for r in U.decide(spark.createDataFrame(users, frame.schema), accounts).collect()}
    assert verdicts == {0: "ok", 1: "ok", 2: "ok", 3: "QUOTA_EXCEEDED", 4: "QUOTA_EXCEEDED", 8: "AUTH_REQUIRED", 9: "INVALID", 10: "INVALID"}
    assert U.decide(frame.limit(0), accounts).count() == 0


def test_linear_formulas(spark):
    text = "∏_(i=1)^n▒b_i\n斜率是 k^(2)π 吗\nα_(1)x\n`a_(1)`\n普通一行"
    found = {r.line_no: r.fixed for r in W.linear_formulas(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert found == {1: "$$\\prod_{i=1}^n b_i$$", 2: "斜率是$k^{2}\\pi$吗", 3: "$$\\alpha_{1}x$$"}


def test_diagrams_and_environments(spark):
    text = "a --> b\npie\nc --> d\n\nmindmap\n\nx --> y\ny --> z\n\\begin{cases}\n1\n\\end{cases}\n\\begin{align}"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in W.diagrams(lines(docs)).collect()] == [(1, 1, 3)]
    assert [tuple(r) for r in W.bare_environments(docs).collect()] == [(1, 9, 11, "cases")]
