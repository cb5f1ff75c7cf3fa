"""Named studies: where their tables are, and how they are read.

Tables are looked for in a folder; nothing is fetched here. A caller with a network can pass ``fetch``,
a function (url, path), and the copy is kept with a checksum beside it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from nodeloom.plans.dataset import ProfileDataset


@dataclass(frozen=True)
class Study:
    nodes: str
    subjects: str
    options: dict
    urls: dict[str, str] = field(default_factory=dict)


#: Registered studies by lower-case name.
STUDIES: dict[str, Study] = {}


def register(name: str, study: Study) -> None:
    STUDIES[name.lower()] = study


# The usual metrics, targets and encodings of three public studies.
register("sarica", Study("nodes.csv", "subjects.csv", {"dwi_metrics": ["md", "fa"], "target_cols": ["class"], "label_encode_cols": ["class"]}))
register("weston-havens", Study("nodes.csv", "subjects.csv", {"dwi_metrics": ["md", "fa"], "target_cols": ["Age"]}))
register("hbn", Study("nodes.csv", "subjects.tsv", {"dwi_metrics": ["dki_md", "dki_fa"], "target_cols": ["age", "sex", "scan_site_id"], "label_encode_cols": ["sex", "scan_site_id"], "index_col": "subject_id"}))


def checksum(path: str) -> str:
    """The MD5 of a local file, read in blocks."""
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def cached(url: str, path: str, fetch: Callable[[str, str], None]) -> bool:
    """Fetches ``url`` to ``path`` unless the copy there matches the checksum beside it; whether it was fetched."""
    side = f"{path}.md5"
    if os.path.exists(path) and os.path.exists(side):
        with open(side) as f:
            if f.read().strip() == checksum(path):
                return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fetch(url, path)
    with open(side, "w") as f:
        f.write(checksum(path))
    return True


def study(spark: SparkSession, name: str, folder: str, fetch: Callable[[str, str], None] | None = None, **options) -> ProfileDataset:
    """The dataset of a registered study, read from ``folder``; options override those of the study."""
    key = name.lower()
    if key not in STUDIES:
        raise ValueError(f"unknown study {name!r}; known are {sorted(STUDIES)}")
    found = STUDIES[key]
    if fetch is not None:
        for file, url in found.urls.items():
            cached(url, os.path.join(folder, file), fetch)
    return ProfileDataset.from_files(spark, f"{folder}/{found.nodes}", f"{folder}/{found.subjects}", **{**found.options, **options})
