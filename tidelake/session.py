"""The session and the configuration."""

from __future__ import annotations

import os
from collections.abc import Mapping
from copy import deepcopy
from typing import Any

from pyspark.sql import SparkSession

#: Times are in UTC, timestamps have microseconds, and a partitioned overwrite touches only the partitions it writes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(name: str = "tidelake", settings: Mapping[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Secret(str):
    """A text that shows itself only on purpose."""

    def __repr__(self) -> str:
        return "Secret(****)"


def typed(raw: str, like: Any) -> Any:
    """An environment value in the type of the one that it replaces."""
    if isinstance(like, bool):
        if raw.strip().lower() not in {"1", "0", "true", "false", "yes", "no", "on", "off"}:
            raise ValueError(f"{raw!r} is not a boolean")
        return raw.strip().lower() in {"1", "true", "yes", "on"}
    if isinstance(like, int):
        return int(raw)
    if isinstance(like, float):
        return float(raw)
    if isinstance(like, list):
        return [x.strip() for x in raw.split(",") if x.strip()]
    return raw


def settings_of(base: Mapping[str, Any], environ: Mapping[str, str] | None = None, prefix: str = "TIDELAKE", secrets: Any = None) -> dict[str, Any]:
    """``base`` with PREFIX__SECTION__KEY of the environment put in, in the types of what they replace.

    A value ``secret:NAME#KEY`` is looked up by ``secrets(NAME)[KEY]`` and comes back masked. Variables that name no
    existing key are ignored.
    """
    environ = os.environ if environ is None else environ
    out = deepcopy(dict(base))

    def walk(node: dict[str, Any], path: str) -> None:
        for key, value in node.items():
            at = f"{path}__{key.upper()}"
            if isinstance(value, dict):
                walk(value, at)
                continue
            if at in environ:
                node[key] = value = typed(environ[at], value)
            if isinstance(value, str) and value.startswith("secret:"):
                name, mark, field = value.removeprefix("secret:").partition("#")
                if not (name and mark and field):
                    raise ValueError(f"{key}: a secret is written secret:NAME#KEY")
                if secrets is None:
                    raise ValueError(f"{key}: no source of secrets is given")
                node[key] = Secret(secrets(name)[field])

    walk(out, prefix)
    return out
