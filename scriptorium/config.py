"""Settings of a model and of services, from arguments, the environment or .env files."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from pathlib import Path

#: What a model needs, by the name of its setting.
MODEL = {"key": "SCRIPTORIUM_API_KEY", "base_url": "SCRIPTORIUM_BASE_URL", "model": "SCRIPTORIUM_MODEL"}
SERVICE_KEY = "DOC2X_API_KEY"


def dotenv_values(text: str) -> dict[str, str]:
    """Settings in lines such as export NAME="value"; comments and lines without a name are passed over."""
    found = {}
    for line in map(str.strip, text.splitlines()):
        name, sign, value = line.removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if sign and name and not line.startswith("#"):
            found[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found


def candidate_files(explicit: str | None = None, env: MutableMapping[str, str] = os.environ) -> list[Path]:
    """.env files in the order in which they count, each once."""
    named = [explicit, env.get("SCRIPTORIUM_ENV_FILE"), Path.cwd() / ".env", Path(__file__).parents[1] / ".env", home_dir(env) / ".env"]
    return list(dict.fromkeys(Path(p).expanduser().resolve() for p in named if p))


def load(explicit: str | None = None, env: MutableMapping[str, str] = os.environ) -> list[Path]:
    """Read .env files into the environment, which counts before them; the files that were there."""
    files = [p for p in candidate_files(explicit, env) if p.is_file()]
    for p in files:
        for name, value in dotenv_values(p.read_text("utf-8")).items():
            env.setdefault(name, value)
    return files


def home_dir(env: MutableMapping[str, str] = os.environ) -> Path:
    return Path(env.get("SCRIPTORIUM_HOME") or Path.home() / "scriptorium").expanduser().resolve()


def model_settings(env: MutableMapping[str, str] = os.environ, **given: str | None) -> dict[str, str]:
    """key, base_url and model; ValueError names those that are missing."""
    found = {k: given.get(k) or env.get(name) or "" for k, name in MODEL.items()}
    if missing := [MODEL[k] for k, v in found.items() if not v.strip()]:
        raise ValueError(f"the model isn't configured; set {', '.join(missing)} in the environment or a .env file")
    return found


def status(env: MutableMapping[str, str] = os.environ, **given: str | None) -> dict[str, bool]:
    """Which settings are there."""
    found = {name: bool((given.get(k) or env.get(name) or "").strip()) for k, name in MODEL.items()}
    return found | {SERVICE_KEY: bool(env.get(SERVICE_KEY, "").strip())}


def conversion_method(requested: str, env: MutableMapping[str, str] = os.environ) -> str:
    """How a PDF is converted: as requested, or by the service whose key is set."""
    if requested != "auto":
        return requested
    if not env.get(SERVICE_KEY):
        raise ValueError(f"set {SERVICE_KEY}, or ask for the method text")
    return "doc2x"
