"""Source files at a pinned version: fetched byte for byte, checked by digest and number of rows."""

from __future__ import annotations

import hashlib
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Pinned:
    """A file as a manifest describes it; what is '' or None is not checked."""

    path: str
    sha256: str = ""
    rows: int | None = None


def blob_at(repository: str, ref: str, path: str) -> bytes:
    """The bytes of a file at a version of a git repository; an unknown version or path raises."""
    return subprocess.run(["git", "-C", repository, "show", f"{ref}:{path}"], check=True, capture_output=True).stdout


def extract(repository: str, files: dict[str, tuple[str, str]]) -> list[str]:
    """Write {destination: (version, path)} byte for byte, making folders; the destinations in order."""
    for dest, (ref, path) in files.items():
        Path(dest).parent.mkdir(parents=True, exist_ok=True)
        Path(dest).write_bytes(blob_at(repository, ref, path))
    return list(files)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole files, for probing bytes on the cluster."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def preflight(files: dict[str, Pinned], count=None) -> list[tuple[str, str]]:
    """(name, problem) of every pinned file that is missing or differs; ``count(path)`` gives the rows."""
    out = []
    for name, p in files.items():
        if not Path(p.path).exists():
            out.append((name, "missing"))
            continue
        if p.sha256 and digest(p.path).lower() != p.sha256.lower():
            out.append((name, "sha256"))
        if p.rows is not None and count is not None and count(p.path) != p.rows:
            out.append((name, "rows"))
    return out
