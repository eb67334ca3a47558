"""Published weights by name: a registry, verified downloads, and their cache on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tomllib
import urllib.error
import urllib.request
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import SparkSession

from ..plans.schema import WeightsArtifact
from .artifacts import load_artifact

BASE_URL = "https://zenodo.org"
VARIABLE = "TESSELLA_REGISTRY"
PARQUET, MANIFEST = "weights.parquet", "weights.manifest.json"


class FetchError(ValueError):
    """A published artifact can't be had as asked."""


class UnknownArtifact(FetchError):
    """No registry has the name."""


class Incomplete(FetchError):
    """A download is shorter or longer than its record says."""


class Mismatch(FetchError):
    """A checksum differs."""


@dataclass(frozen=True)
class Entry:
    """Where an artifact is published: a record number or DOI, and its file names there."""

    name: str
    record: str
    parquet: str = PARQUET
    manifest: str = MANIFEST
    base_url: str = BASE_URL

    @property
    def number(self) -> str:
        return self.record.rsplit("zenodo.", 1)[-1]


def load_registry(path: str | None = None) -> dict[str, Entry]:
    """Entries by name: those of the file beside this module, then of the file that TESSELLA_REGISTRY names, then of `path`; later ones win. A named file that is missing, or an entry without a record, raises."""
    own = Path(__file__).with_name("registry.toml")
    files = [own] * own.exists() + [Path(p) for p in (os.environ.get(VARIABLE), path) if p]
    out: dict[str, Entry] = {}
    for file in files:
        if not file.exists():
            raise FetchError(f"no registry at {file}")
        for name, spec in tomllib.loads(file.read_text()).get("artifacts", {}).items():
            if "record" not in spec:
                raise FetchError(f"{file}: {name!r} has no record")
            out[name] = Entry(name, str(spec["record"]), *(spec.get(k, d) for k, d in (("parquet", PARQUET), ("manifest", MANIFEST), ("base_url", BASE_URL))))
    return out


def cache_folder(path: str | None = None) -> Path:
    return Path(path or os.environ.get("TESSELLA_CACHE") or Path.home() / ".cache" / "tessella")


def digest(path: Path, kind: str = "sha256") -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, kind).hexdigest()


def _get(url: str, to: Path | None = None, size: int | None = None):
    try:
        with urllib.request.urlopen(url) as reply:
            if to is None:
                return json.loads(reply.read())
            to.parent.mkdir(parents=True, exist_ok=True)
            with open(to, "wb") as f:
                shutil.copyfileobj(reply, f, 1 << 20)
    except urllib.error.URLError as e:
        raise FetchError(f"{url}: {e}") from e
    if size is not None and to.stat().st_size != size:
        raise Incomplete(f"{to.name}: {to.stat().st_size} bytes came, the record says {size}")


def _expected(manifest: dict, name: str) -> str:
    outputs = manifest.get("outputs") or {}
    for key in (name, PARQUET):
        if key in outputs:
            return outputs[key]
    raise FetchError(f"the manifest has no checksum of {name!r}, so it can't be verified; it has {sorted(outputs)}")


def _download(files: dict, name: str, to: Path) -> None:
    meta = files[name]
    _get(meta["links"]["self"], to, meta.get("size"))
    stated = str(meta.get("checksum", ""))
    if not stated.startswith("md5:"):
        raise FetchError(f"{name}: the record states no md5 but {stated!r}")
    if digest(to, "md5") != stated[4:]:
        raise Mismatch(f"{name}: md5 {digest(to, 'md5')}, the record says {stated[4:]}")


def fetch_weights(spark: SparkSession, name: str, *, record: str | None = None, base_url: str | None = None, parquet: str | None = None, manifest: str | None = None, registry: str | None = None, cache: str | None = None, refresh: bool = False) -> WeightsArtifact:
    """A published artifact, from the cache where a verified copy is there. With `record` no registry is asked and the name only labels the copy.

    Downloads are checked against size and md5 of the record, the weights against the sha256 in
    their manifest; a manifest without it raises before the weights are fetched. Nothing half
    done stays in the cache.
    """
    if record is not None:
        entry = Entry(name, str(record), parquet or PARQUET, manifest or MANIFEST, base_url or BASE_URL)
    else:
        known = load_registry(registry)
        if name not in known:
            raise UnknownArtifact(f"no artifact {name!r}; there are {sorted(known)}. Add it to a registry, or pass record")
        entry = replace(known[name], base_url=base_url) if base_url else known[name]
    folder = cache_folder(cache) / f"record-{entry.number}" / entry.name
    weights, account = folder / PARQUET, folder / MANIFEST
    if not refresh and weights.exists() and account.exists():
        if digest(weights) != _expected(json.loads(account.read_text()), entry.parquet):
            raise Mismatch(f"the copy at {folder} isn't what its manifest says; clear the cache and fetch again")
        return load_artifact(spark, str(folder))
    reply = _get(f"{entry.base_url.rstrip('/')}/api/records/{entry.number}")
    files = {f["key"]: f for f in reply.get("files", [])}
    if lost := [f for f in (entry.parquet, entry.manifest) if f not in files]:
        raise FetchError(f"record {entry.number} has no {lost}; it has {sorted(files)}")
    parts = folder / ".partial.json", folder / ".partial.parquet"
    try:
        _download(files, entry.manifest, parts[0])
        sha = _expected(json.loads(parts[0].read_text()), entry.parquet)
        _download(files, entry.parquet, parts[1])
        if digest(parts[1]) != sha:
            raise Mismatch(f"{entry.parquet}: sha256 {digest(parts[1])}, the manifest says {sha}")
        parts[1].replace(weights)
        parts[0].replace(account)
    finally:
        for p in parts:
            p.unlink(missing_ok=True)
    return load_artifact(spark, str(folder))


def cached(cache: str | None = None) -> list[dict]:
    """name, record, path and bytes of every copy in the cache."""
    found = sorted(p.parent for p in cache_folder(cache).glob(f"record-*/*/{PARQUET}"))
    return [{"name": p.name, "record": p.parent.name.removeprefix("record-"), "path": str(p), "bytes": sum(f.stat().st_size for f in p.iterdir())} for p in found]


def clear_cache(cache: str | None = None, name: str | None = None) -> int:
    """Delete the copies of a name, or all; returns how many there were."""
    gone = [c for c in cached(cache) if name in (None, c["name"])]
    for c in gone:
        shutil.rmtree(c["path"])
        parent = Path(c["path"]).parent
        if not any(parent.iterdir()):
            parent.rmdir()
    return len(gone)
