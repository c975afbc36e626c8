"""What a machine offers: packages, devices and paths, as one dictionary."""

from __future__ import annotations

import importlib.metadata
import json
import os
import platform
import shutil
import sys

#: Packages that runs may use.
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy", "Pillow", "torch", "open-clip-torch", "umap-learn", "scikit-learn", "faiss-cpu")


def package_version(name: str) -> str | None:
    try:
        return importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return None


def inventory(paths: list[str] | None = None, packages: tuple[str, ...] = PACKAGES) -> dict:
    """Python, platform, package versions (null: absent), whether a GPU tool is there, and each path's state."""
    return {
        "python": sys.version.split()[0],
        "platform": platform.platform(),
        "cpus": os.cpu_count(),
        "packages": {name: package_version(name) for name in packages},
        "gpu_tool": shutil.which("nvidia-smi"),
        "paths": {p: {"exists": os.path.exists(p), "readable": os.access(p, os.R_OK)} for p in paths or []},
    }


def write_inventory(path: str, paths: list[str] | None = None) -> dict:
    found = inventory(paths)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f, indent=2)
    return found
