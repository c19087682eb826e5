"""Vision models behind HTTP: what is sent and how the answer is read, the transport passed in.

A transport takes (url, headers, body) and returns (status, body); tests pass a stub, so nothing here
opens a connection.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

from vitrine.operators.analysis import ProviderError, Retry
from vitrine.sources.settings import Settings

Transport = Callable[[str, dict, dict], tuple[int, dict]]


@dataclass
class HttpProvider:
    """kind: ollama, gemini, openai or claude. Only the first is local and needs no key."""

    kind: str
    model: str
    url: str
    transport: Transport
    key: str = ""
    context: int = 0

    @property
    def name(self) -> str:
        return self.kind

    @property
    def local(self) -> bool:
        return self.kind == "ollama"

    def healthy(self) -> bool:
        return self.local or bool(self.key.strip())

    def analyze(self, frames: list, prompt: str) -> str:
        if not self.healthy():
            raise ProviderError(f"{self.kind}: the API key is not set")
        images = [base64.b64encode(f if isinstance(f, bytes) else f.encode()).decode() for f in frames]
        url, headers, body = getattr(self, f"_{self.kind}")(images, prompt)
        status, answer = self.transport(url, headers, body)
        if status == 429 and not self.local:
            raise ProviderError(f"{self.kind}: 429 Rate Limit")
        if status >= 400:
            raise ProviderError(f"{self.kind}: HTTP {status}: {answer.get('error', '')}")
        text = self.text(answer)
        if text is None:
            raise ProviderError(f"{self.kind}: empty response")
        return text

    def _ollama(self, images: list[str], prompt: str) -> tuple[str, dict, dict]:
        body = {"model": self.model, "prompt": prompt, "images": images, "stream": False}
        return f"{self.url}/api/generate", {}, body | ({"options": {"num_ctx": self.context}} if self.context else {})

    def _gemini(self, images: list[str], prompt: str) -> tuple[str, dict, dict]:
        parts = [{"text": prompt}, *({"inline_data": {"mime_type": "image/jpeg", "data": i}} for i in images)]
        return f"{self.url}/models/{self.model}:generateContent", {"x-goog-api-key": self.key}, {"contents": [{"parts": parts}]}

    def _openai(self, images: list[str], prompt: str) -> tuple[str, dict, dict]:
        parts = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{i}"}} for i in images)]
        return f"{self.url}/chat/completions", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "messages": [{"role": "user", "content": parts}]}

    def _claude(self, images: list[str], prompt: str) -> tuple[str, dict, dict]:
        parts = [*({"type": "image", "source": {"type": "base64", "media_type": "image/jpeg", "data": i}} for i in images), {"type": "text", "text": prompt}]
        return f"{self.url}/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": 2048, "messages": [{"role": "user", "content": parts}]}

    def text(self, answer: dict) -> str | None:
        """The first text of an answer, or None."""
        try:
            if self.local:
                response = answer.get("response") or ""
                return response if response.strip() else answer.get("thinking") or None
            if self.kind == "gemini":
                parts = answer["candidates"][0]["content"]["parts"]
            elif self.kind == "openai":
                return answer["choices"][0]["message"]["content"]
            else:
                parts = answer["content"]
            return next((p["text"] for p in parts if "text" in p), None)
        except (KeyError, IndexError, TypeError):
            return None


def installed_models(transport: Transport, url: str) -> list[str]:
    status, answer = transport(f"{url}/api/tags", {}, {})
    return [m["name"] for m in answer.get("models", [])] if status < 400 else []


def is_ready(models: list[str], configured: str) -> bool:
    return any(m.startswith(configured) for m in models)


def provider_from(settings: Settings, transport: Transport, keys: dict[str, str] | None = None) -> tuple[HttpProvider, Retry | None]:
    """The provider that the settings name (local by default) and its retries, if they are on."""
    kind = settings.text("llm_provider", "ollama")
    urls = {
        "ollama": settings.text("ollama_url", "http://localhost:11434"),
        "gemini": "https://generativelanguage.googleapis.com/v1beta",
        "openai": settings.text("openai_base_url", "https://api.openai.com/v1"),
        "claude": "https://api.anthropic.com/v1",
    }
    kind = kind if kind in urls else "ollama"
    model = settings.text(f"{kind}_model", "")
    provider = HttpProvider(kind, model, urls[kind].rstrip("/"), transport, (keys or {}).get(kind, ""), settings.number("ollama_num_ctx", 0))
    on = settings.flag("ext_llm_retry_enabled", True)
    return provider, Retry(settings.number("ext_llm_retry_max_attempts", 3), provider.local) if on else None
