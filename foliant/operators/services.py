"""Services that translate, over HTTP: what is asked of each kind, and a registry of all translators by name.

One class serves all kinds; they differ by paths, heads and the places of fields, which are the table KINDS. Retries and
time limits are those of `translate.call`.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from .translate import Fake, Translator

META_LIMIT = 10.0


@dataclass(frozen=True)
class Kind:
    """How a kind of service is spoken to: paths, the head with the key, where a model list and an answer stand."""

    ask: str
    models: str
    key_head: tuple[str, str]  # name, form
    list_at: tuple[str, str]  # field of the list, field of the id
    answer_at: tuple  # keys from the answer's object to its text
    heads: tuple[tuple[str, str], ...] = ()
    system_apart: bool = False  # the instruction is a field, not a message
    options_apart: bool = False  # length and temperature stand in a field of their own


CHAT = Kind("/chat/completions", "/models", ("Authorization", "Bearer {}"), ("data", "id"), ("choices", 0, "message", "content"))
#: The public interfaces of the kinds.
KINDS = {
    "openai": CHAT, "openai-compatible": CHAT, "deepseek": CHAT,
    "anthropic": Kind("/v1/messages", "/v1/models", ("x-api-key", "{}"), ("data", "id"), ("content", 0, "text"), (("anthropic-version", "2023-06-01"),), system_apart=True),
    "ollama": Kind("/api/chat", "/api/tags", ("", ""), ("models", "name"), ("message", "content"), options_apart=True),
}


@dataclass
class Service:
    """A translator behind an address. The name, with the model, is the cache's."""

    kind: str
    base_url: str
    model: str
    prompt: str
    api_key: str = ""
    max_output_tokens: int = 2000
    temperature: float = 0.3
    limit: float = 300.0

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.model}"

    def _send(self, path: str, body: dict | None, limit: float) -> dict:
        k = KINDS[self.kind]
        heads = {"Content-Type": "application/json", **dict(k.heads)}
        if k.key_head[0] and self.api_key:
            heads[k.key_head[0]] = k.key_head[1].format(self.api_key)
        request = urllib.request.Request(self.base_url.rstrip("/") + path, None if body is None else json.dumps(body).encode(), heads)
        try:
            with urllib.request.urlopen(request, timeout=limit) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            told = e.read().decode("utf-8", "replace").strip()
            raise RuntimeError(f"{self.kind} HTTP error {e.code}{': ' + told if told else ''}") from e

    def request(self, text: str) -> dict:
        k = KINDS[self.kind]
        ask = [{"role": "user", "content": text}]
        body: dict = {"model": self.model, "messages": ask if k.system_apart else [{"role": "system", "content": self.prompt}, *ask]}
        if k.system_apart:
            body["system"] = self.prompt
        if k.options_apart:
            return body | {"stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_output_tokens}}
        return body | {"max_tokens": self.max_output_tokens, "temperature": self.temperature}

    def translate(self, text: str) -> str:
        value = self._send(KINDS[self.kind].ask, self.request(text), self.limit)
        for key in KINDS[self.kind].answer_at:
            try:
                value = value[key]
            except (KeyError, IndexError, TypeError) as e:
                raise RuntimeError(f"{self.kind}: an answer without text") from e
        return value.strip() if isinstance(value, str) else ""

    def list_models(self) -> list[str]:
        listed, name = KINDS[self.kind].list_at
        found = self._send(KINDS[self.kind].models, None, META_LIMIT).get(listed)
        return [m[name] for m in found if isinstance(m, dict) and isinstance(m.get(name), str)] if isinstance(found, list) else []

    def health_check(self) -> None:
        """Raises if the service doesn't answer."""
        self.list_models()


REGISTRY: dict[str, Callable[..., Translator]] = {"fake": lambda **_: Fake()} | {name: (lambda kind: lambda **settings: Service(kind, **settings))(name) for name in KINDS}


def translator(name: str, **settings) -> Translator:
    """The translator of a name, whatever its case; an unknown one is a KeyError that says so."""
    if name.lower() not in REGISTRY:
        raise KeyError(f"no translator is called {name!r}")
    return REGISTRY[name.lower()](**settings)
