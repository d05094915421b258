"""Clients of language models over HTTP, as providers for reviews and rewrites.

A provider is called as provider(prompt, model) and returns {content, prompt_tokens, completion_tokens, cost}; what
means "try again" is raised as a ConnectionError, everything else as it is.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass

#: Answers of a server after which the same request may succeed.
AGAIN = (408, 425, 429, 500, 502, 503, 504)


def retryable(e: BaseException) -> bool:
    """No connection, a timeout, or a server that is busy; refused requests aren't tried again."""
    if isinstance(e, urllib.error.HTTPError):
        return e.code in AGAIN
    return isinstance(e, (urllib.error.URLError, ConnectionError, TimeoutError))


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except Exception as e:  # noqa: BLE001
        if retryable(e):
            raise ConnectionError(str(e)) from e
        raise


@dataclass(frozen=True)
class ChatClient:
    """Servers with the common chat interface. The key is read from an environment variable where it is used, so it is
    never sent with a plan; a missing one is an error before the first request."""

    url: str
    key_name: str | None = None
    timeout: float = 60.0

    def __call__(self, prompt: str, model: str) -> dict:
        key = os.environ.get(self.key_name, "").strip() if self.key_name else ""
        if self.key_name and not key:
            raise ValueError(f"{self.key_name} isn't set")
        got = _post(f"{self.url.rstrip('/')}/chat/completions", {"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}, {"Authorization": f"Bearer {key}"} if key else {}, self.timeout)
        used = got.get("usage") or {}
        content = ((got.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        return {"content": content, "prompt_tokens": int(used.get("prompt_tokens") or 0), "completion_tokens": int(used.get("completion_tokens") or 0), "cost": float(used.get("cost") or 0.0)}


@dataclass(frozen=True)
class LocalClient:
    """A server on one's own machines with the generate interface; it has no costs."""

    url: str = "http://localhost:11434"
    timeout: float = 300.0

    def __call__(self, prompt: str, model: str) -> dict:
        got = _post(f"{self.url.rstrip('/')}/api/generate", {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": 0}}, {}, self.timeout)
        return {"content": got.get("response") or "", "prompt_tokens": int(got.get("prompt_eval_count") or 0), "completion_tokens": int(got.get("eval_count") or 0), "cost": 0.0}

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(self.url, timeout=5) as answer:
                return answer.status == 200
        except Exception:  # noqa: BLE001
            return False
