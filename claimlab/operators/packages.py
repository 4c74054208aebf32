"""Content-addressed evidence packages and case records."""

from __future__ import annotations

import hashlib
import json
import math
import shutil
from pathlib import Path

from claimlab.operators.records import replace_file


def json_safe(value):
    """NaN and infinities as null, keys as text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def digest(path: Path) -> dict:
    data = path.read_bytes()
    return {"sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)}


def save_package(root: str | Path, documents: dict[str, object]) -> Path:
    """Documents as canonical JSON in a folder named by the digest of their manifest."""
    texts = {f"{n}.json": json.dumps(json_safe(d), sort_keys=True, indent=1) for n, d in documents.items()}
    manifest = {n: {"sha256": hashlib.sha256(t.encode()).hexdigest(), "bytes": len(t.encode())} for n, t in sorted(texts.items())}
    name = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()[:16]
    folder = Path(root) / name
    for n, t in texts.items():
        replace_file(folder / n, t)
    replace_file(folder / "manifest.json", json.dumps(manifest, sort_keys=True, indent=1))
    return folder


def verify_package(folder: str | Path) -> list[str]:
    """What is wrong with a package; anything unreadable is wrong."""
    folder = Path(folder)
    try:
        manifest = json.loads((folder / "manifest.json").read_text(encoding="utf-8"))
        found = {p.name for p in folder.iterdir() if p.name != "manifest.json"}
        wrong = [f"missing {n}" for n in sorted(set(manifest) - found)] + [f"undeclared {n}" for n in sorted(found - set(manifest))]
        wrong += [f"changed {n}" for n in sorted(set(manifest) & found) if digest(folder / n) != manifest[n]]
        if hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()[:16] != folder.name:
            wrong.append("manifest does not match the folder's name")
        return wrong
    except (OSError, ValueError, TypeError) as e:
        return [f"unreadable: {e}"]


def list_packages(root: str | Path) -> list[str]:
    """Names, newest first."""
    return [p.name for p in sorted(Path(root).iterdir(), key=lambda p: p.stat().st_mtime, reverse=True) if (p / "manifest.json").exists()]


def zip_package(folder: str | Path) -> Path:
    if wrong := verify_package(folder):
        raise ValueError("; ".join(wrong))
    return Path(shutil.make_archive(str(folder), "zip", folder))


def case_record(case_id: str, state: str, artifacts: list[Path]) -> dict:
    """A case's result with the digests of its artifacts."""
    return {"schema_version": 1, "case_id": case_id, "state": state, "artifacts": [{"path": str(p), **digest(p)} for p in artifacts]}
