"""Choosing and calling models: a chain of providers with retries, a response cache and a cap on cost."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field

from ledgerloom import schemas
from ledgerloom.operators.extraction import Answer, PayloadSchema, request_key


@dataclass(frozen=True)
class Model:
    """A model: its provider's name, prices in dollars a million tokens."""

    name: str
    provider: str
    price_in: float = 0.0
    price_out: float = 0.0

    def cost(self, tokens_in: int, tokens_out: int) -> float:
        return (tokens_in * self.price_in + tokens_out * self.price_out) / 1e6


class Retryable(Exception):
    """A failure that another attempt or another model may mend."""


class CapExceeded(Exception):
    """The call might cost more than is left."""


@dataclass
class Router:
    """providers: name -> call(model, request) -> text."""

    chain: list[Model]
    providers: dict[str, Callable[[Model, dict], str]]
    cap_usd: float = float("inf")
    attempts: int = 3
    most_tokens_out: int = 1024
    sleep: Callable[[float], None] = time.sleep
    cache: dict[str, Answer] = field(default_factory=dict)
    tracer: object | None = None
    calls: int = 0
    hits: int = 0
    spent_usd: float = 0.0

    def complete(self, request: dict) -> Answer:
        """The first answer along the chain. Retryable failures lead to the next model, others end the walk."""
        last: Exception | None = None
        for model in self.chain:
            try:
                return self._attempt(model, request)
            except Retryable as e:
                last = e
        raise last or ValueError("the chain is empty")

    def _attempt(self, model: Model, request: dict) -> Answer:
        key = request_key(request | {"model": model.name, "provider": model.provider})
        self.calls += 1
        if key in self.cache:
            self.hits += 1
            a = self.cache[key]
            return Answer(a.text, a.model, a.tokens_in, a.tokens_out, 0.0, 0.0, True, model.provider)
        size = max(1, len(json.dumps(request)) // 4)
        if self.spent_usd + model.cost(size, self.most_tokens_out) > self.cap_usd:
            raise CapExceeded(f"{model.name} might exceed the cap of {self.cap_usd} dollars")
        began = time.monotonic()
        with self.tracer.span(f"llm.{model.name}", "llm", model=model.name, provider=model.provider, tokens_in=size) if self.tracer else nullcontext({"attrs": {}}) as span:
            text = self._retried(model, request)
            answer = Answer(text, model.name, size, max(1, len(text) // 4), 0.0, (time.monotonic() - began) * 1000, False, model.provider)
            answer.cost_usd = model.cost(answer.tokens_in, answer.tokens_out)
            span["attrs"] |= {"tokens_out": answer.tokens_out, "cost_usd": answer.cost_usd, "cached": False}
        self.spent_usd += answer.cost_usd
        self.cache[key] = answer
        return answer

    def _retried(self, model: Model, request: dict) -> str:
        for n in range(max(1, self.attempts)):
            try:
                return self.providers[model.provider](model, request)
            except Retryable:
                if n + 1 >= max(1, self.attempts):
                    raise
                self.sleep(min(20.0, 2**n) * (0.5 + random.random() / 2))
        raise AssertionError

    def stats(self) -> dict:
        return {"calls": self.calls, "hits": self.hits, "hit_rate": round(self.hits / self.calls, 3) if self.calls else 0.0, "spent_usd": round(self.spent_usd, 6)}


@dataclass
class Registry:
    """Models, chains of them and embedding models of a settings file."""

    models: dict[str, Model]
    chains: dict[str, list[str]] = field(default_factory=dict)
    embeddings: dict[str, dict] = field(default_factory=dict)
    default_embedding: str | None = None

    @classmethod
    def read(cls, path: str) -> Registry:
        from ledgerloom.sources.filings import read_settings

        s = read_settings(path)
        models = {n: Model(n, e.get("provider", ""), float(e.get("price_in") or 0), float(e.get("price_out") or 0)) for n, e in s["models"].items()}
        return cls(models, s["chains"], s["embeddings"], s["default_embedding"])

    def chain(self, asked: str | list[str] | None = None, **where) -> list[Model]:
        return [self.models[n] for n in asked] if isinstance(asked, list) else resolve_chain(self.models, self.chains, asked, **where)

    def embedding(self, asked: str | None = None, env: dict[str, str] | None = None, variable: str = "LEDGERLOOM_EMBEDDING") -> dict:
        """The embedding model asked for, else named by the environment, else the file's default."""
        import os

        name = asked or (os.environ if env is None else env).get(variable) or self.default_embedding
        if name not in self.embeddings:
            raise KeyError(f"no embedding model {name!r}")
        return self.embeddings[name] | {"name": name}


def resolve_chain(known: dict[str, Model], chains: dict[str, list[str]], asked: str | None = None, env: dict[str, str] | None = None, variable: str = "LEDGERLOOM_CHAIN", default: str = "default") -> list[Model]:
    """The models to try: of the chain (or the one model) asked for, else named by the environment, else the default chain."""
    import os

    name = asked or (os.environ if env is None else env).get(variable) or default
    names = chains.get(name) or ([name] if name in known else None)
    if names is None:
        raise KeyError(f"neither a chain nor a model: {name}")
    return [known[n] for n in names]


# --- Providers ----------------------------------------------------------------------------------------------------


def leaning(text: str) -> float:
    """(good - bad) / (good + bad) of the counted words, rounded to 3 places; 0 without any. The same as scalars.leaning."""
    low = text.lower()
    good, bad = (sum(low.count(w) for w in words) for words in (schemas.GOOD_WORDS, schemas.BAD_WORDS))
    return round((good - bad) / (good + bad), 3) if good + bad else 0.0


def pick(name: str, labels: tuple[str, ...], lean: float) -> str:
    """The label that fits a leaning; of a vocabulary without a known label, always the same one by the field's name."""
    wanted = schemas.BAD_LABELS if lean < -0.15 else schemas.GOOD_LABELS if lean > 0.15 else schemas.MIDDLING_LABELS
    low = {x.lower(): x for x in reversed(labels)}
    return next((low[w] for w in wanted if w in low), labels[int(hashlib.md5(name.encode()).hexdigest()[:4], 16) % len(labels)])


def telling(text: str, lean: float) -> list[str]:
    """The sentences of middling length with a word of the text's leaning, or else the first one."""
    fit = [x for x in (s.strip() for s in re.split(r"(?<=[.!?])\s+", text)) if 25 < len(x) < 400]
    words = schemas.BAD_WORDS if lean < 0 else schemas.GOOD_WORDS
    return [s for s in fit if any(w in s.lower() for w in words)] or fit[:1]


def heuristic(prompt: str, schema: PayloadSchema, quotes: int = 3) -> str:
    """A deterministic answer of a schema's shape by word counts over the prompt's documents, for offline use."""
    inner = re.findall(r"<document[^>]*>(.*?)</document>", prompt, re.S | re.I)
    text = "\n".join(inner) if inner else prompt
    lean = leaning(text)
    said = telling(text, lean)
    way = "negative" if lean < -0.15 else "positive" if lean > 0.15 else "neutral"
    value = {f: said[0] if said else "" for f in schema.slugs} | {f: pick(f, v, lean) for f, v in schema.vocabularies.items()}
    value |= {f: round(0.55 + min(abs(lean), 1.0) * 0.35, 3) for f in schema.numbers} | {f: f"The language scans {way} on balance." for f in schema.texts} | {f: said[:quotes] for f in schema.lists}
    return json.dumps(value, ensure_ascii=False)


def scripted(answers: dict[str, str], otherwise: Callable[[Model, dict], str] | None = None) -> Callable[[Model, dict], str]:
    """A provider that answers by the first needle that the last turn holds."""

    def call(model: Model, request: dict) -> str:
        turn = str(request.get("complaint") or request.get("prompt") or (request.get("messages") or [{}])[-1].get("content", ""))
        for needle, text in answers.items():
            if needle in turn:
                return text
        if otherwise is None:
            raise ValueError("nothing is scripted for this turn")
        return otherwise(model, request)

    return call


def failing(times: int, then: Callable[[Model, dict], str]) -> Callable[[Model, dict], str]:
    """A provider whose first calls fail in a way that may be tried again."""
    left = [times]

    def call(model: Model, request: dict) -> str:
        if left[0] > 0:
            left[0] -= 1
            raise Retryable("failing as asked")
        return then(model, request)

    return call


def over_http(url: str, seconds: float = 120.0, headers: dict[str, str] | None = None, read: Callable[[dict], str] = lambda r: r["message"]["content"]) -> Callable[[Model, dict], str]:
    """A provider behind a chat endpoint: posts {model, messages, stream: false} as JSON and reads the reply's text.

    Timeouts, refused connections and the states 408, 409, 429 and 5xx may be tried again; other failures not.
    """

    def call(model: Model, request: dict) -> str:
        messages = request.get("messages") or [{"role": "user", "content": "\n\n".join(x for x in (request.get("prompt"), request.get("complaint")) if x)}]
        body = json.dumps({"model": model.name, "messages": messages, "stream": False} | ({"format": request["schema"]} if request.get("schema") else {})).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"} | (headers or {})), timeout=seconds) as r:
                return read(json.loads(r.read()))
        except urllib.error.HTTPError as e:
            raise (Retryable if e.code in (408, 409, 429) or e.code >= 500 else RuntimeError)(f"{model.name}: state {e.code}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Retryable(f"{model.name}: {e}") from e

    return call


def asking(router: Router, schema: PayloadSchema | None = None) -> Callable[[str, str | None], Answer]:
    """complete(prompt, complaint) for extraction, by a router."""
    return lambda prompt, complaint: router.complete({"prompt": prompt, "complaint": complaint} | ({"fields": list(schema.fields)} if schema else {}))


def offline(schema: PayloadSchema) -> Callable[[str, str | None], Answer]:
    """complete(prompt, complaint) by the heuristic reader, in the shape of a model's answer."""
    return lambda prompt, complaint: Answer(heuristic(prompt, schema), "heuristic", provider="offline")
