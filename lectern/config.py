"""Run options and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Providers and the model used when none is given.
DEFAULT_MODELS = {
    "ollama": "qwen3:14b",
    "openai": "gpt-5-mini",
    "claude": "claude-sonnet-4-5",
}

# Request limits.
MAX_CHARS_PER_REQUEST = 3500
MAX_REQUESTS_PER_PART = 50_000
MAX_BYTES_PER_PART = 200_000_000

# Accounting thresholds.
STALL_SECONDS = 600
STALL_REQUESTS = 20
LOCAL_REQUEST_BUDGET = 3
ETA_MIN_SECONDS = 300
ETA_FIRST_PAGE = 4

# Glossary mining.
GLOSSARY_MIN_COUNT = 3
GLOSSARY_MAX_TERMS = 200

PROMPT_VERSION = "v2"
KEY_NAMESPACE = "lectern-cache-v1"
ID_NAMESPACE = "lectern"


@dataclass(frozen=True)
class EngineConfig:
    """Options shared by the request, cache and ledger operators."""

    provider: str = "ollama"
    model: str | None = None
    style: str = "essay"
    temperature: float = 0.3
    num_ctx: int = 8192
    max_chars: int = MAX_CHARS_PER_REQUEST
    max_requests_per_part: int = MAX_REQUESTS_PER_PART
    max_bytes_per_part: int = MAX_BYTES_PER_PART
    retries: int = 3

    @property
    def model_name(self) -> str:
        return self.model or DEFAULT_MODELS[self.provider]
