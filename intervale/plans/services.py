"""Adapters for model services: what each kind of service wants to be sent, and where its answer is.

A transport (url, headers, body) -> (status, body) does the sending, so that
adapters run on executors with any HTTP library, or in tests with none.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from intervale.plans.clients import ClientError, Part, TransportError, status_error
from intervale.plans.config import ConfigError, Options, Profile

Transport = Callable[[str, dict[str, str], dict[str, Any]], tuple[int, dict[str, Any]]]
#: Where a service of each kind lives if its profile names no address.
ADDRESSES = {"openai_chat": "https://api.openai.com/v1", "openai_responses": "https://api.openai.com/v1", "anthropic_messages": "https://api.anthropic.com/v1"}
#: Tokens that a service which needs a number is asked for if the request has none, beside those for thinking.
DEFAULT_OUTPUT = 1024


def post(url: str, headers: dict[str, str], body: dict[str, Any], timeout: float | None = None) -> tuple[int, dict[str, Any]]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, json.load(answer)
    except urllib.error.HTTPError as e:
        return e.code, {"error": e.read().decode("utf-8", "replace")}
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        raise TransportError(str(e)) from e


@dataclass(frozen=True)
class Image:
    """A picture beside a prompt: its media type and base64 content."""

    mime: str
    content: str

    @property
    def url(self) -> str:
        return f"data:{self.mime};base64,{self.content}"

    @staticmethod
    def of(part: Part) -> Image:
        return Image(part.mime or "image/png", base64.b64encode(part.content).decode())


@dataclass
class Service:
    """A client of one profile; see ``intervale.plans.clients.Client``.

    Without a transport of its own, a request that takes longer than its time-out
    is a TransportError.
    """

    profile: Profile
    key: str | None
    options: Options = Options()
    send: Transport | None = None
    system: str | None = None
    images: tuple[Image, ...] = field(default_factory=tuple)

    path = ""

    def complete(self, prompt: str) -> str:
        """The answer to a prompt, beside the client's own pictures if it has any."""
        return self._ask([prompt, *self.images])

    def complete_parts(self, parts: list[Part]) -> str:
        """The answer to texts and pictures, sent in their order."""
        return self._ask([p.text if p.content is None else Image.of(p) for p in parts])

    def _ask(self, content: list[str | Image]) -> str:
        base = self.profile.base_url or ADDRESSES.get(self.profile.provider)
        if base is None:
            raise ConfigError(f"profile {self.profile.name} names no address")
        asked = self.profile.options(self.options)
        send = self.send or partial(post, timeout=asked.timeout_seconds)
        status, answer = send(base.rstrip("/") + self.path, self.headers(), {k: v for k, v in self.body(content, asked).items() if v is not None})
        if status >= 400:
            raise status_error(status, str(answer.get("error", answer)))
        try:
            return self.text(answer)
        except (KeyError, IndexError, TypeError) as e:
            raise ClientError(f"no answer in {answer}") from e

    def headers(self) -> dict[str, str]:
        return {"authorization": f"Bearer {self.key}"} if self.key else {}

    def body(self, content: list[str | Image], asked: Options) -> dict[str, Any]:
        raise NotImplementedError

    def text(self, answer: dict[str, Any]) -> str:
        raise NotImplementedError


class Chat(Service):
    """Chat completions, also of compatible services."""

    path = "/chat/completions"

    def body(self, content, asked):
        parts = [{"type": "image_url", "image_url": {"url": x.url}} if isinstance(x, Image) else {"type": "text", "text": x} for x in content]
        plain = content[0] if len(content) == 1 and isinstance(content[0], str) else parts
        messages = [*([{"role": "system", "content": self.system}] if self.system else []), {"role": "user", "content": plain}]
        return {
            "model": self.profile.model, "messages": messages, "temperature": asked.temperature, "max_completion_tokens": asked.max_output_tokens,
            "response_format": {"type": "json_object"} if asked.json_mode else None, "reasoning_effort": asked.reasoning_effort,
        }

    def text(self, answer):
        return answer["choices"][0]["message"]["content"]


class Responses(Service):
    path = "/responses"

    def body(self, content, asked):
        parts = [{"type": "input_image", "image_url": x.url} if isinstance(x, Image) else {"type": "input_text", "text": x} for x in content]
        return {
            "model": self.profile.model, "instructions": self.system, "input": [{"role": "user", "content": parts}], "temperature": asked.temperature, "max_output_tokens": asked.max_output_tokens,
            "text": {"format": {"type": "json_object"}} if asked.json_mode else None, "reasoning": {"effort": asked.reasoning_effort} if asked.reasoning_effort else None,
        }

    def text(self, answer):
        return "".join(part["text"] for item in answer["output"] if item["type"] == "message" for part in item["content"] if part["type"] == "output_text")


class Messages(Service):
    path = "/messages"

    def headers(self):
        return {"x-api-key": self.key or "", "anthropic-version": "2023-06-01"}

    def body(self, content, asked):
        parts = [{"type": "image", "source": {"type": "base64", "media_type": x.mime, "data": x.content}} if isinstance(x, Image) else {"type": "text", "text": x} for x in content]
        budget, most = asked.thinking_budget_tokens, asked.max_output_tokens
        if most is None:
            most = DEFAULT_OUTPUT + (budget or 0)
        if budget is not None and budget >= most:
            raise ClientError("the thinking budget must be under the output limit")
        return {
            "model": self.profile.model, "system": self.system, "messages": [{"role": "user", "content": parts}], "temperature": asked.temperature,
            "max_tokens": most, "thinking": None if budget is None else {"type": "enabled", "budget_tokens": budget},
        }

    def text(self, answer):
        return "".join(part["text"] for part in answer["content"] if part["type"] == "text")


KINDS: dict[str, type[Service]] = {"openai_chat": Chat, "openai_responses": Responses, "anthropic_messages": Messages, "openai_compatible_chat": Chat}


def connect(profile: Profile, environment: dict[str, str] | None = None, **more: Any) -> Service:
    """A client for a profile; raises ConfigError for an unknown kind or a key that isn't there."""
    if profile.provider not in KINDS:
        raise ConfigError(f"unknown provider {profile.provider}")
    return KINDS[profile.provider](profile, profile.key(environment), **more)
