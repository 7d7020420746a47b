"""The model client and the embedder of a production run, behind the interfaces of completion and embedding."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np

from lodestrata.constants import REQUEST_TIMEOUT_SECONDS
from lodestrata.operators.completion import RateLimited


class ChatClient:
    """A chat service that takes {"model", "messages", ...} at <url>/chat/completions and answers with choices.

    Made in each task by a factory (functools.partial(ChatClient, url, model, key)); the key travels in the factory, never in
    Spark's configuration. A 429 becomes RateLimited with the service's message and the wait that it asks for."""

    def __init__(self, url: str, model: str, api_key: str, opener: Callable | None = None):
        if not (url and model and api_key):
            raise ValueError("the chat service needs an address, a model and a key")
        self.url, self.model, self.api_key, self.open = url.rstrip("/"), model, api_key, opener or urllib.request.urlopen

    def complete(self, prompt: str, max_tokens: int | None, temperature: float) -> str | None:
        body = {"model": self.model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}
        if max_tokens is not None:
            body["max_tokens"] = max_tokens
        headers = {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"}
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with self.open(request, timeout=REQUEST_TIMEOUT_SECONDS) as answer:
                return json.loads(answer.read())["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as error:
            if error.code != 429:
                raise
            raise RateLimited(error.read().decode(errors="replace"), error.headers.get("retry-after")) from error


class SentenceEmbedder:
    """A sentence model, loaded once a worker; vectors have unit length. Needs the package sentence-transformers."""

    def __init__(self, model: str, load: Callable | None = None):
        if load is None:
            try:
                from sentence_transformers import SentenceTransformer as load
            except ImportError as error:
                raise RuntimeError("embedding with a sentence model needs the package sentence-transformers") from error
        self.model = load(model)

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode(texts, normalize_embeddings=True), np.float32) if texts else np.zeros((0, 0), np.float32)
