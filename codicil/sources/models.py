"""Models behind HTTP, made from settings: embeddings and chat completions as many servers offer them (POST /embeddings, POST /chat/completions with a stream of events).

| Setting | What it is |
| --- | --- |
| EMBEDDINGS_URL, EMBEDDINGS_MODEL | where vectors come from; without the first the hashing embedder stands in |
| EMBEDDINGS_KEY | sent as a bearer token, if set |
| CHAT_URL, CHAT_KEY, CHAT_MODELS | a hosted service and its models, parted by commas, asked in that order |
| LOCAL_CHAT_URL, LOCAL_CHAT_MODELS | a service on this machine, which gets more time and needs no key |
| CHAT_PROVIDERS | which of ``hosted`` and ``local`` to ask, in order; without it those that are configured |
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from codicil.functions.vectors import Embedder, HashingEmbedder
from codicil.operators.answers import ChatModel, ModelError, Provider, provider_chain
from codicil.operators.requests import settings

EMBED_SECONDS, CHAT_SECONDS = 60.0, 300.0


def _post(url: str, key: str | None, body: dict, seconds: float):
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        return urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=seconds)
    except urllib.error.HTTPError as e:
        with e:
            raise ModelError(f"HTTP {e.code}: {e.read(500).decode(errors='replace')}", e.code) from e


@dataclass(frozen=True)
class HttpEmbedder:
    """Vectors from a service; it goes to tasks as it is, its key included."""

    url: str
    model: str
    dimensions: int
    key: str | None = None

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        with _post(f"{self.url.rstrip('/')}/embeddings", self.key, {"model": self.model, "input": list(texts)}, EMBED_SECONDS) as answer:
            rows = json.load(answer)["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


@dataclass(frozen=True)
class HttpChat:
    """A chat model whose text comes as a stream of events."""

    provider: str
    model: str
    url: str
    key: str | None = None

    def stream(self, instructions: str, prompt: str) -> Iterator[str]:
        messages = [{"role": "system", "content": instructions}, {"role": "user", "content": prompt}]
        with _post(f"{self.url.rstrip('/')}/chat/completions", self.key, {"model": self.model, "messages": messages, "stream": True}, CHAT_SECONDS) as answer:
            for line in answer:
                data = line.decode(errors="replace").strip()
                if not data.startswith("data:") or (data := data[5:].strip()) == "[DONE]":
                    continue
                event = json.loads(data)
                if "error" in event:
                    raise ModelError(str(event["error"]))
                for choice in event.get("choices", [])[:1]:
                    if piece := (choice.get("delta") or {}).get("content"):
                        yield piece


def embedder_of(env: Mapping[str, str], dimensions: int) -> Embedder:
    """The embedder that settings name."""
    s = settings(env, {"EMBEDDINGS_URL": (str, None), "EMBEDDINGS_KEY": (str, None)})
    if s["EMBEDDINGS_URL"] is None:
        return HashingEmbedder(dimensions=dimensions)
    return HttpEmbedder(s["EMBEDDINGS_URL"], settings(env, {"EMBEDDINGS_MODEL": (str, ...)})["EMBEDDINGS_MODEL"], dimensions, s["EMBEDDINGS_KEY"])


def _models(provider: str, url: str, models: str, key: str | None = None) -> list[ChatModel]:
    return [HttpChat(provider, m.strip(), url, key) for m in models.split(",") if m.strip()]


PROVIDERS = [
    Provider("hosted", ("CHAT_URL", "CHAT_KEY", "CHAT_MODELS"), lambda has: _models("hosted", has["CHAT_URL"], has["CHAT_MODELS"], has["CHAT_KEY"])),
    Provider("local", ("LOCAL_CHAT_URL", "LOCAL_CHAT_MODELS"), lambda has: _models("local", has["LOCAL_CHAT_URL"], has["LOCAL_CHAT_MODELS"]), local=True),
]


def chat_models(env: Mapping[str, str]) -> list[ChatModel]:
    """The chain of models that settings name, in the order they are asked."""
    return provider_chain(dict(env), PROVIDERS, settings(env, {"CHAT_PROVIDERS": (list, None)})["CHAT_PROVIDERS"])
