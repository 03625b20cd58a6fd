"""A tool-using loop that always ends: bounded in steps, time and cost, with a partial answer where it must stop."""

from __future__ import annotations

import ast
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from ledgerloom.agent.sqltool import observation
from ledgerloom.functions.documents import parse_json_loose

MAX_STEPS, MAX_SECONDS = 8, 300.0


@dataclass
class Tool:
    name: str
    description: str
    parameters: dict
    run: Callable[..., str]

    def spec(self) -> dict:
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": self.parameters}}


@dataclass
class Reply:
    """What a model said: text or a native tool call, and its cost."""

    text: str = ""
    call: tuple[str, dict] | None = None
    cost_usd: float = 0.0


@dataclass
class Step:
    n: int
    tool: str
    args: dict
    observation: str
    ok: bool


@dataclass
class Result:
    answer: str
    stopped: str
    steps: list[Step] = field(default_factory=list)
    cost_usd: float = 0.0


def _arguments(value: object) -> dict:
    if isinstance(value, str):
        found = parse_json_loose(value)
        value = json.loads(found) if found is not None else {}
    return value if isinstance(value, dict) else {}


def decide(reply: Reply) -> dict | None:
    """{'tool', 'args'} or {'answer'}, or None where a reply says neither.

    Tried in this order: a native call; JSON, whole or within prose, of which a list counts by its first element, as a call,
    an answer or a function wrapper; a call written as name(key=value); and a tool named somewhere in prose.
    """
    if reply.call:
        return {"tool": reply.call[0], "args": reply.call[1] or {}}
    text = reply.text.strip()
    found = parse_json_loose(text)
    value = json.loads(found) if found is not None else None
    value = value[0] if isinstance(value, list) and value else value
    if isinstance(value, dict):
        inner = next((value[k] for k in ("function", "tool_call") if isinstance(value.get(k), dict)), value)
        name = inner.get("tool") or inner.get("name")
        if "answer" in value:
            return {"answer": str(value["answer"])}
        if name:
            return {"tool": str(name), "args": _arguments(inner.get("args", inner.get("arguments", inner.get("parameters", {}))))}
        return None
    m = re.fullmatch(r"(\w+)\((.*)\)", text, re.S)
    if m:
        try:
            call = ast.parse(f"f({m.group(2)})", mode="eval").body
            return {"tool": m.group(1), "args": {k.arg: ast.literal_eval(k.value) for k in call.keywords if k.arg}}
        except (SyntaxError, ValueError):
            return None
    m = re.search(r'"tool"\s*:\s*"(\w+)"', text)
    return {"tool": m.group(1), "args": {}} if m else None


_UNCLEAR = 'Reply with one JSON object and nothing else: {"tool": "<name>", "args": {...}} or {"answer": "..."}.'


def _use(n: int, name: str, args: dict, tools: dict[str, Tool], seen: set[str]) -> Step:
    if name not in tools:
        return Step(n, name, args, f"there is no tool {name!r}; there are {', '.join(sorted(tools))}", False)
    mark = json.dumps([name, args], sort_keys=True, default=str)
    if mark in seen:
        return Step(n, name, args, "this very call was made before; its result stands above", False)
    seen.add(mark)
    unknown = set(args) - set(tools[name].parameters)
    if unknown:
        return Step(n, name, args, f"unknown arguments {sorted(unknown)}", False)
    try:
        return Step(n, name, args, observation(str(tools[name].run(**args))), True)
    except Exception as e:
        return Step(n, name, args, observation(f"{type(e).__name__}: {e}"), False)


def run(
    question: str, ask: Callable[[list[dict]], Reply], tools: list[Tool], max_steps: int = MAX_STEPS, max_seconds: float = MAX_SECONDS, max_cost: float = 1.0, clock: Callable[[], float] = time.monotonic
) -> Result:
    """Asks, uses tools and asks again until there is an answer or a bound is met."""
    by_name, seen, began = {t.name: t for t in tools}, set(), clock()
    messages = [{"role": "system", "content": json.dumps([t.spec() for t in tools])}, {"role": "user", "content": question}]
    result = Result("", "max_steps_reached")
    for n in range(1, max_steps + 1):
        if clock() - began > max_seconds:
            result.stopped = "time_budget_exhausted"
            break
        if result.cost_usd >= max_cost:
            result.stopped = "cost_cap_exceeded"
            break
        try:
            reply = ask(messages)
        except Exception as e:
            result.stopped, result.answer = "llm_error", f"the model failed: {e}"
            return result
        result.cost_usd += reply.cost_usd
        decision = decide(reply)
        if decision is None:  # a slip that the model may mend at its next step
            messages += [{"role": "assistant", "content": reply.text}, {"role": "user", "content": _UNCLEAR}]
            continue
        if "answer" in decision:
            result.answer, result.stopped = decision["answer"], "answered"
            return result
        step = _use(n, decision["tool"], decision["args"], by_name, seen)
        result.steps.append(step)
        messages += [{"role": "assistant", "content": json.dumps(decision, default=str)}, {"role": "user", "content": f"{step.tool}: {step.observation}"}]
    known = "; ".join(f"{s.tool}: {s.observation[:200]}" for s in result.steps if s.ok) or "nothing was found"
    try:
        result.answer = ask([*messages, {"role": "user", "content": f"Stop ({result.stopped}) and answer from what is known."}]).text.strip()
    except Exception:
        result.answer = ""
    result.answer = result.answer or f"Stopped ({result.stopped}); so far: {known}"
    return result
