"""Build configuration: YAML with a dataset and a build section, checked on the driver."""

from __future__ import annotations

import time
from datetime import datetime
from pathlib import Path


def load_config(path: str) -> dict:
    """The mapping of a YAML file (a byte order mark is allowed); both sections must be there."""
    import yaml

    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    x = yaml.safe_load(p.read_text(encoding="utf-8-sig"))
    if not isinstance(x, dict):
        raise ValueError("the configuration is no mapping")
    for section in ("dataset", "build"):
        if not isinstance(x.get(section), dict):
            raise ValueError(f"section {section} is missing")
    return x


def processing_timestamp(config: dict) -> str:
    """The build's timestamp as it stands; it must be ISO-8601, where Z stands for UTC."""
    t = config["build"].get("processing_timestamp")
    if not isinstance(t, str) or not t.strip():
        raise ValueError("processing_timestamp is empty")
    try:
        datetime.fromisoformat(t.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"processing_timestamp is not ISO-8601: {t}") from e
    return t


def dataset_version(config: dict) -> str:
    v = config["dataset"].get("version")
    if not isinstance(v, str) or not v.strip():
        raise ValueError("the dataset has no version")
    return v


def utc_now() -> str:
    """The present time in UTC as ISO-8601 text, to the second, for builds that fix none."""
    return time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime())
