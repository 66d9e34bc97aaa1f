"""What the operators for training data share: tables, rows that count once, languages."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import running  # noqa: F401 - used by the operators
from ..functions.storage import kept, spread  # noqa: F401 - used by the operators

LANGUAGE_NAMES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cs": "csharp", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def extension(ext: Column | str = "extension", path: Column | str = "path") -> Column:
    """The extension that counts: trimmed, lower-cased, with its dot; where it is null, the suffix of the path ('' if none)."""
    ext, path = (F.col(x) if isinstance(x, str) else x for x in (ext, path))
    own = F.lower(F.trim(ext))
    own = F.when(own.startswith("."), own).otherwise(F.concat(F.lit("."), own))
    return F.coalesce(own, F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)), F.lit(""))


def language(ext: Column) -> Column:
    """The name of an extension's language; the extension itself where it has none here, null where there is no extension."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(names[ext], F.nullif(ext, F.lit("")))
