"""Model clients for figure interpretation: any callable ``(prompt, uri, model) -> text`` will do; this one speaks HTTP.

A client travels to the executors, so it holds no key: the key is read from an
environment variable there, at the first call.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

LADDER = (1.0, 4.0, 15.0, 60.0)


class Refusal(RuntimeError):
    """An answer that is an error, with its code where there is one."""

    def __init__(self, code: object, text: str):
        super().__init__(f"{code}: {text[:300]}")
        self.code = code


def _passing(error: Exception) -> bool:
    """Whether to try again: too many requests, a server's fault, no connection, or an error within an answer."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, (urllib.error.URLError, TimeoutError, Refusal))


@dataclass(frozen=True)
class Remote:
    """``style``: ``chat`` (image by URL, answer among choices) or ``messages`` (image as base64 source, answer among contents)."""

    url: str
    key_variable: str = "VLM_API_KEY"
    style: str = "chat"
    timeout: float = 180.0
    most_tokens: int = 4096
    waits: tuple[float, ...] = LADDER
    open: Callable = urllib.request.urlopen
    sleep: Callable[[float], None] = time.sleep

    def request(self, prompt: str, uri: str, model: str) -> urllib.request.Request:
        if not (key := os.environ.get(self.key_variable)):
            raise Refusal("key", f"{self.key_variable} is not set")
        text = {"type": "text", "text": prompt}
        if self.style == "messages":
            kind, _, body = uri.removeprefix("data:").partition(";base64,")
            image = {"type": "image", "source": {"type": "base64", "media_type": kind, "data": body}}
            headers = {"x-api-key": key, "anthropic-version": "2023-06-01"}
        else:
            image = {"type": "image_url", "image_url": {"url": uri}}
            headers = {"Authorization": f"Bearer {key}"}
        body = {"model": model, "max_tokens": self.most_tokens, "messages": [{"role": "user", "content": [text, image]}]}
        return urllib.request.Request(self.url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})

    def once(self, prompt: str, uri: str, model: str) -> str:
        with self.open(self.request(prompt, uri, model), timeout=self.timeout) as reply:
            got = json.loads(reply.read())
        if error := got.get("error"):
            raise Refusal(error.get("code") if isinstance(error, dict) else None, str(error))
        if self.style == "messages":
            return "".join(x.get("text", "") for x in got["content"] if x.get("type") == "text")
        return got["choices"][0]["message"]["content"]

    def __call__(self, prompt: str, uri: str, model: str) -> str:
        for wait in (*self.waits, None):
            try:
                return self.once(prompt, uri, model)
            except Exception as e:  # noqa: BLE001 - sorted by kind below
                if wait is None or not _passing(e) or (isinstance(e, Refusal) and e.code == "key"):
                    raise
                self.sleep(wait)
        raise AssertionError
