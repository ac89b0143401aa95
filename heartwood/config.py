"""Settings of a run: arguments over environment over the nearest settings file over defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

FILE = ".ctxconfig"
PREFIX = "CTX_"
DEFAULT_MODELS = {"anthropic": "claude-haiku-4-5", "openai": "gpt-4o-mini", "ollama": "llama3.2", "lmstudio": "local-model"}
LOCAL = {"ollama": "http://localhost:11434/v1", "lmstudio": "http://localhost:1234/v1"}
KEYS = {"anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY"}


class ConfigError(ValueError):
    """Settings that can't be used."""


class MissingKey(ConfigError):
    """No key for a provider that needs one."""


@dataclass
class Config:
    provider: str = "anthropic"
    model: str = ""
    api_key: str = field(default="", repr=False)
    base_url: str | None = None
    max_file_tokens: int = 8000
    max_depth: int | None = None
    token_budget: int | None = None
    max_tokens_per_run: int | None = None
    max_usd_per_run: float | None = None
    files_per_call: int | None = None
    max_concurrent_dirs: int | None = None
    extensions: list[str] | None = None
    cache_path: str | None = None
    max_cache_entries: int = 10_000
    watch_debounce_seconds: float = 0.5
    resume_cooldown_seconds: float = 60.0
    prompts: dict[str, str] = field(default_factory=dict)

    def resolved_model(self) -> str:
        return self.model.strip() or DEFAULT_MODELS.get(self.provider.strip().lower(), DEFAULT_MODELS["anthropic"])


#: How a setting is read, and whether null is one of its values.
_READ = {
    **dict.fromkeys(("provider", "model", "base_url"), (lambda v: str(v).strip(), False)),
    "cache_path": (str, True),
    **dict.fromkeys(("max_file_tokens", "max_cache_entries"), (int, False)),
    **dict.fromkeys(("max_depth", "token_budget", "max_tokens_per_run", "files_per_call", "max_concurrent_dirs"), (int, True)),
    "max_usd_per_run": (float, True),
    **dict.fromkeys(("watch_debounce_seconds", "resume_cooldown_seconds"), (float, False)),
}
#: Settings that the environment doesn't know under their own name.
_VARIABLES = {"watch_debounce_seconds": ("WATCH_DEBOUNCE",), "files_per_call": ("FILES_PER_CALL", "BATCH_SIZE"), "resume_cooldown_seconds": ()}


def optional_number(text: str, kind: type):
    """A number; null for none, null and an empty text."""
    return None if text.strip().lower() in ("", "none", "null") else kind(text.strip())


def _names(value, where: str) -> list[str] | None:
    value = [value] if isinstance(value, str) else value
    if value is not None and not (isinstance(value, list) and all(isinstance(x, str) for x in value)):
        raise ConfigError(f"extensions in {where} must be a list of texts")
    return value


def read_file(folder: str) -> tuple[str | None, dict]:
    """The settings file of the folder or of the nearest folder above it that has one; only that one is read."""
    folder = os.path.abspath(folder)
    while True:
        path = os.path.join(folder, FILE)
        if os.path.isfile(path):
            import yaml

            with open(path, encoding="utf-8") as f:
                data = yaml.safe_load(f.read()) or {}
            if not isinstance(data, dict):
                raise ConfigError(f"{path} isn't a mapping")
            return path, data
        if os.path.dirname(folder) == folder:
            return None, {}
        folder = os.path.dirname(folder)


def load(folder: str, environ: Mapping[str, str] | None = None, needs_key: bool = True, **arguments) -> Config:
    """The settings for a tree; arguments that are None don't count."""
    env = os.environ if environ is None else environ
    config, chosen = Config(), False
    path, data = read_file(folder)
    if "files_per_call" not in data and "batch_size" in data:
        data["files_per_call"] = data["batch_size"]
    for name, (read, optional) in _READ.items():
        if name in data and (optional or data[name] is not None):
            setattr(config, name, None if data[name] is None else read(data[name]))
            chosen |= name == "provider"
    if "extensions" in data:
        config.extensions = _names(data["extensions"], path)
    if isinstance(data.get("prompts"), dict):
        config.prompts.update(data["prompts"])
    for name, (read, optional) in _READ.items():
        value = next((env[f"{PREFIX}{v}"] for v in _VARIABLES.get(name, (name.upper(),)) if env.get(f"{PREFIX}{v}", "").strip()), None)
        if name == "cache_path":
            value = env.get(f"{PREFIX}CACHE_PATH")  # an empty one switches the cache off
        if value is not None:
            setattr(config, name, optional_number(value, read) if optional and read is not str else read(value))
            chosen |= name == "provider"
    if f"{PREFIX}EXTENSIONS" in env:
        config.extensions = [x.strip() for x in env[f"{PREFIX}EXTENSIONS"].split(",") if x.strip()] or None
    known = {f.name for f in fields(Config)}
    for name, value in arguments.items():
        if name not in known:
            raise TypeError(f"{name} is no setting")
        if value is not None:
            setattr(config, name, value)
            chosen |= name == "provider"
    if not chosen:
        config.provider = next((p for p, key in KEYS.items() if env.get(key, "").strip()), config.provider)
    config.provider = config.provider.strip().lower()
    if config.provider not in DEFAULT_MODELS:
        raise ConfigError(f"{config.provider} is no provider")
    config.model = config.resolved_model()
    if config.provider in LOCAL:
        config.base_url = config.base_url or LOCAL[config.provider]
        config.api_key = env.get("OPENAI_API_KEY", "").strip() or "not-needed"
    elif needs_key:
        config.api_key = env.get(KEYS[config.provider], "").strip()
        if not config.api_key:
            raise MissingKey(f"{KEYS[config.provider]} isn't set")
    return config
