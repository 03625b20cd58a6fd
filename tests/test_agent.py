import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ledgerloom.agent import loop, sandbox, sqltool
from ledgerloom.agent.router import CapExceeded, Model, Retryable, Router, failing, heuristic, over_http, scripted
from ledgerloom.operators import extraction
from ledgerloom.operators.tracing import Tracer

REJECTED = [
    "", "-- nothing", "DROP TABLE filings", "SELECT 1; SELECT 2", "INSERT INTO filings VALUES (1)", "WITH x AS (SELECT 1) DELETE FROM filings", "SELECT * FROM parquet.`/etc`", "SELECT * FROM read_csv('/etc/passwd')",
    "SELECT reflect('java.lang.System', 'getenv')", "SELECT java_method('java.lang.Runtime', 'getRuntime')", "SET spark.x = 1", "SELECT * FROM csv.`/x`", "EXPLAIN SELECT 1", "SELECT input_file_name() FROM filings", "SELEC 1",
    "PRAGMA x", "CALL y()", "SELECT * FROM text.`/etc/hosts`", "ADD JAR x", "/* */", "SELECT session_user()", "SELECT a.b.c(1)", "VALUES (1)); DROP TABLE x", "SELECT 1 INTO x", "DESCRIBE filings", "SELECT raise_error('x')",
]


@pytest.fixture
def views(spark):
    for name in ("filings", "companies", "review_queue", "llm_cache"):
        spark.range(80).selectExpr("CAST(id AS STRING) AS cik", "id AS n").createOrReplaceTempView(name)


@pytest.mark.parametrize("sql", REJECTED)
def test_rejected(spark, views, sql):
    with pytest.raises(sqltool.Rejected):
        sqltool.sql_query(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT * FROM review_queue", "SELECT n FROM filings UNION ALL SELECT n FROM review_queue", "SELECT (SELECT max(n) FROM llm_cache) AS x", "SELECT * FROM filings f, llm_cache c", "SELECT * FROM other.filings", "SELECT * FROM range(5)",
    "WITH review_queue AS (SELECT * FROM review_queue) SELECT * FROM review_queue", "WITH filings AS (SELECT * FROM review_queue) SELECT * FROM filings", "SELECT * FROM (WITH x AS (SELECT 1 AS n) SELECT * FROM x) y, x",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS n) SELECT * FROM a", "SELECT n FROM filings WHERE n IN (SELECT n FROM llm_cache)", "SELECT * FROM IDENTIFIER('review_queue')", "WITH x AS (SELECT n FROM review_queue) SELECT 1 FROM filings",
    "SELECT * FROM filings LATERAL VIEW java_method('a', 'b') t AS z", "SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM review_queue)) FROM filings", "TABLE review_queue", "FROM review_queue SELECT n", "SELECT CURRENT_USER",
])
def test_unreadable(spark, views, sql):
    with pytest.raises(sqltool.Rejected):
        sqltool.sql_query(spark, sql)


@pytest.mark.parametrize(
    ("sql", "n"),
    [
        ("SELECT * FROM filings", 50), ("select n from filings limit 3;", 3), ("WITH a AS (SELECT n FROM filings), b AS (SELECT n FROM a) SELECT * FROM b WHERE n < 2", 2), ("SELECT 'drop table x; --' AS t FROM filings LIMIT 1", 1),
        ("SELECT f.n FROM filings f, companies c WHERE f.cik = c.cik -- joined", 50), ("SELECT (SELECT count(*) FROM companies) AS n", 1), ("SELECT EXTRACT(year FROM DATE'2020-01-01') AS y FROM filings LIMIT 1", 1), ("SELECT * FROM (SELECT n FROM filings LIMIT 70) x", 50),
        ("SELECT n AS load, 1 AS `set` FROM filings ORDER BY n LIMIT 2", 2), ("SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY n) AS r FROM filings WHERE n BETWEEN 1 AND 3", 3),
        ("WITH a AS (SELECT n FROM filings) SELECT (SELECT max(n) FROM a) AS m", 1), ("SELECT n FROM filings INTERSECT SELECT n FROM companies WHERE n < 4", 4),
        ("SELECT x FROM filings LATERAL VIEW explode(array(1, 2)) t AS x WHERE n = 1", 2), ("SELECT CASE WHEN n > 1 THEN 'a' END AS c, count(*) AS k FROM filings GROUP BY 1 HAVING count(*) > 1", 2),
    ],
)
def test_accepted(spark, views, sql, n):
    assert sqltool.sql_query(spark, sql).count() == n


def test_rendering(spark):
    assert sqltool.as_table(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b")) == "a | b\n1 | \n(1 rows)"
    assert sqltool.observation("x" * 5000).endswith("[1000 more characters]") and len(sqltool.cell("y" * 90)) == 40
    assert "signals(" in sqltool.describe() and "review_queue" not in sqltool.describe()


@pytest.mark.parametrize(
    "code",
    [
        "import os", "import subprocess", "from pathlib import Path", "open('/etc/passwd')", "eval('1')", "().__class__.__bases__", "__import__('os')", "getattr(1, 'x')", "import socket", "x = '__class__'", "def f(:", "from . import x", "globals()",
    ],
)
def test_unsafe(code):
    with pytest.raises(sandbox.Unsafe):
        sandbox.run_python(code)


def test_sandbox_runs():
    assert sandbox.run_python("import math, statistics\nprint(math.floor(2.7), statistics.mean([1, 3]))").output.strip() == "2 2"
    assert not sandbox.run_python("1 / 0").ok and sandbox.run_python("while True: pass", seconds=1).ok is False
    assert not sandbox.run_python("x = [0] * 10**9", memory_mb=300).ok


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"tool": "t", "args": {"a": 1}}', {"tool": "t", "args": {"a": 1}}), ('```json\n{"name": "t", "arguments": "{\\"a\\": 2}"}\n```', {"tool": "t", "args": {"a": 2}}), ('{"function": {"name": "t", "parameters": {}}}', {"tool": "t", "args": {}}),
        ('{"answer": "yes"}', {"answer": "yes"}), ('[{"tool": "t"}]', {"tool": "t", "args": {}}), ("t(a=1, b='x')", {"tool": "t", "args": {"a": 1, "b": "x"}}), ("just prose", None), ("", None), ("[]", None), ('{"x": 1}', None),
        ('I will look: "tool": "t" and so on', {"tool": "t", "args": {}}), ('So {"answer": 3} it is', {"answer": "3"}), ('{"tool_call": {"name": "t", "arguments": "not JSON"}}', {"tool": "t", "args": {}}),
    ],
)
def test_decisions(text, want):
    assert loop.decide(loop.Reply(text)) == want
    assert loop.decide(loop.Reply(call=("t", {"z": 1}))) == {"tool": "t", "args": {"z": 1}}


def script(*replies):
    it = iter(replies)
    return lambda messages: next(it)


TOOLS = [loop.Tool("add", "adds", {"a": {}, "b": {}}, lambda a, b: str(a + b)), loop.Tool("fail", "fails", {}, lambda: 1 / 0)]
CALL = loop.Reply('{"tool": "add", "args": {"a": 1, "b": 2}}', cost_usd=0.4)


def test_loop_bounds():
    r = loop.run("q", script(CALL, CALL, loop.Reply('{"tool": "nope"}'), loop.Reply('{"tool": "fail"}'), loop.Reply('{"tool": "add", "args": {"c": 1}}'), loop.Reply(""), loop.Reply('{"answer": "done"}')), TOOLS)
    assert r.stopped == "answered" and r.answer == "done" and [s.ok for s in r.steps] == [True, False, False, False, False]
    assert "before" in r.steps[1].observation and "ZeroDivisionError" in r.steps[3].observation
    assert loop.run("q", script(*[CALL] * 3), TOOLS, max_steps=2).stopped == "max_steps_reached"
    assert loop.run("q", script(*[CALL] * 9), TOOLS, max_cost=0.5).stopped == "cost_cap_exceeded"
    times = iter([0, 0, 999, 999])
    late = loop.run("q", script(CALL, loop.Reply("")), TOOLS, clock=lambda: next(times))
    assert late.stopped == "time_budget_exhausted" and "add: 3" in late.answer
    assert loop.run("q", script(), TOOLS).stopped == "llm_error"


def test_router():
    calls = []

    def flaky(model, request):
        calls.append(model.name)
        if model.name == "a" or len(calls) < 4:
            raise Retryable("busy")
        return "fine"

    r = Router([Model("a", "p"), Model("b", "p", 1.0, 2.0)], {"p": flaky}, sleep=lambda s: None)
    first = r.complete({"prompt": "x"})
    assert first.model == "b" and calls == ["a"] * 3 + ["b"] and first.cost_usd > 0
    again = Router([Model("b", "p", 1.0, 2.0)], {"p": flaky}, cache=r.cache).complete({"prompt": "x"})
    assert again.cached and again.cost_usd == 0 and len(calls) == 4
    with pytest.raises(CapExceeded):
        Router([Model("b", "p", 1e6, 1e6)], {"p": flaky}, cap_usd=0.01).complete({"prompt": "y"})

    def broken(model, request):
        raise ValueError("no")

    with pytest.raises(ValueError):
        Router([Model("a", "x"), Model("b", "p")], {"x": broken, "p": flaky}).complete({})
    assert r.stats() == {"calls": 2, "hits": 0, "hit_rate": 0.0, "spent_usd": round(first.cost_usd, 6)}
    schema = extraction.PayloadSchema("t", {"direction": ("bullish", "neutral", "bearish"), "other": ("x", "y")}, slugs=("kind",))
    said = json.loads(heuristic("Do so. <document>Sales declined, and a loss is likely this year. We saw growth.</document>", schema))
    assert said["direction"] == "bearish" and said["evidence"] == ["Sales declined, and a loss is likely this year."] and said["confidence"] == 0.725 and said["other"] in ("x", "y")
    assert schema.check(said) == []


def test_providers():
    m = Model("m", "p")
    call = failing(2, scripted({"first": "1", "second": "2"}))
    r = Router([m], {"p": call}, sleep=lambda s: None)
    assert r.complete({"prompt": "the second"}).text == "2" and r.complete({"prompt": "first", "complaint": "second thoughts"}).text == "2"
    with pytest.raises(ValueError):
        r.complete({"prompt": "third"})
    tracer = Tracer()
    Router([m], {"p": lambda a, b: "x"}, tracer=tracer).complete({"prompt": "p"})
    assert tracer.rows[0]["kind"] == "llm" and tracer.rows[0]["attrs"]["tokens_out"] == 1


def test_over_http():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            state = {"busy": 503, "no": 404}.get(seen[-1]["model"], 200)
            body = json.dumps({"message": {"content": "fine"}}).encode()
            self.send_response(state)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = over_http(f"http://127.0.0.1:{server.server_port}/chat")
    try:
        assert call(Model("m", "p"), {"prompt": "a", "complaint": "b"}) == "fine" and seen[0]["messages"][0]["content"] == "a\n\nb"
        with pytest.raises(Retryable):
            call(Model("busy", "p"), {"prompt": "a"})
        with pytest.raises(RuntimeError):
            call(Model("no", "p"), {"prompt": "a"})
    finally:
        server.shutdown()
    with pytest.raises(Retryable):
        over_http("http://127.0.0.1:9/none", 2)(Model("m", "p"), {"prompt": "a"})
