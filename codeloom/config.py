"""Settings of the audit pipeline; all values explicit, none of them a credential."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# What is scanned and what is left out.
SOURCE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".go", ".php", ".c", ".h", ".cpp", ".cs")
CONFIG_EXTENSIONS = (".xml", ".json", ".yaml", ".yml", ".ini", ".toml", ".properties", ".conf")
EXCLUDED_PARTS = (".git", ".svn", ".hg", ".idea", ".vscode", "__pycache__", "node_modules", "venv", ".venv", "env", "dist", "build", "target", "out", "bin", "obj", "vendor", "third_party", "tmp", "temp", "logs", "log", "cache", ".cache", "coverage", ".pytest_cache", ".mypy_cache", "site-packages", "bower_components", "static", "assets", "public", "docs", "test", "tests")
#: Nine extensions whose dependencies are read from the code itself.
PARSED_EXTENSIONS = (".py", ".js", ".ts", ".java", ".go", ".php", ".c", ".cpp", ".cs")
NO_DEPENDENCY = "无外部依赖"
KNOWN_INPUT_LIMITS = {"gpt-4.1-mini": 8000}


@dataclass(frozen=True)
class Settings:
    source_extensions: tuple[str, ...] = SOURCE_EXTENSIONS
    config_extensions: tuple[str, ...] = CONFIG_EXTENSIONS
    excluded_parts: tuple[str, ...] = EXCLUDED_PARTS
    max_file_mb: float = 1.0
    parse_engine: str = "auto"  # auto, ast or llm; anything else counts as auto
    context_depth: int = 2
    max_nodes: int = 12
    max_branches: int = 3
    max_focus_paths: int = 6
    tree_dedup_limit: int = 1
    node_dedup_limit: int = 1
    final_dedup_limit: int = 1
    failure_threshold: float = 0.3
    candidate_threshold: int = 8
    model: str = "gpt-4.1-mini"
    max_input_tokens: int | None = 8000
    legacy_chunk_tokens: int | None = None
    overhead_tokens: int = 512
    max_attempts: int = 3
    backoff_seconds: float = 2.0
    timeout_seconds: float = 60.0
    max_concurrency: int = 5
    #: The reference drops long identifiers without a dot as natural language; off keeps them.
    drop_long_identifiers: bool = True

    def engine(self) -> str:
        return self.parse_engine.lower() if self.parse_engine.lower() in ("auto", "ast", "llm") else "auto"


def load(path: str) -> Settings:
    """Settings from a YAML file; the file is written with the defaults if it is missing."""
    import json

    try:
        import yaml  # optional
    except ImportError:
        yaml = None
    if not os.path.exists(path):
        values = {f.name: getattr(Settings(), f.name) for f in fields(Settings)}
        values = {k: list(v) if isinstance(v, tuple) else v for k, v in values.items()}
        with open(path, "w", encoding="utf-8") as out:
            out.write(yaml.safe_dump(values, allow_unicode=True) if yaml else json.dumps(values, ensure_ascii=False, indent=2))
        return Settings()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    values = (yaml.safe_load(text) if yaml else json.loads(text)) or {}
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

