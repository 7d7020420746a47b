"""Settings from the environment. Secrets stay out of Spark's configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from lodestrata.constants import DEFAULT_TEMPERATURE


@dataclass(frozen=True)
class Settings:
    data_dir: Path = Path("data")
    collection: str = "filings"
    embed_model: str = "all-MiniLM-L6-v2"
    llm_model: str = ""
    temperature: float = DEFAULT_TEMPERATURE
    user_agent: str = ""
    api_key: str = field(default="", repr=False)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        return cls(
            data_dir=Path(env.get("DATA_DIR", "data")), embed_model=env.get("EMBED_MODEL", cls.embed_model), llm_model=env.get("GROQ_MODEL", ""),
            temperature=float(env.get("LLM_TEMPERATURE", DEFAULT_TEMPERATURE)), user_agent=env.get("SEC_USER_AGENT", ""), api_key=env.get("GROQ_API_KEY", ""),
        )
