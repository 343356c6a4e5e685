"""Labelled image sets on disk: class names, splits, label rows and glyph catalogues.

The small files that describe a set are read on the driver; images and labels are listed and read by Spark.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.curation import labelled_images

try:
    import yaml
except ImportError:  # only the files in YAML need it
    yaml = None

IMAGES = ("jpg", "jpeg", "png")


def _yaml(path: Path) -> dict:
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package")
    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def _description(folder: Path) -> Path:
    """The data.yaml of a set: its own, else the first below it."""
    own = folder / "data.yaml"
    found = own if own.exists() else next(iter(sorted(folder.rglob("data.yaml"))), None)
    if found is None:
        raise FileNotFoundError(f"no data.yaml under {folder}")
    return found


def _names(config: dict) -> list[str]:
    names = config.get("names") or []
    return [names[k] for k in sorted(names, key=int)] if isinstance(names, dict) else list(names)


def read_class_names(folder: str) -> list[str]:
    """Class names in the order of their ids; the file has a list, or a mapping by id."""
    return _names(_yaml(_description(Path(folder))))


def find_split(folder: str, split: str) -> str | None:
    """The folder of a split's images: of the usual layouts the first that exists and isn't empty."""
    root = Path(folder)
    return next((str(p) for p in (root / split / "images", root / "images" / split, root / split) if p.is_dir() and any(p.iterdir())), None)


def dataset_config(folder: str) -> tuple[dict, list[str]]:
    """The set's description with absolute paths of its splits, and its class names.  A split right under the folder
    comes before the path that is written down."""
    source = _description(Path(folder))
    config, base = _yaml(source), source.parent
    for key, split in (("train", "train"), ("val", "valid"), ("test", "test")):
        value = config.get(key)
        if value and not os.path.isabs(value):
            near = base / split / "images"
            config[key] = str((near if near.exists() else base / value).resolve())
    return config, _names(config)


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """image (the file's name without its suffix), path and rows (its labels) of each image of a split.

    An image without a label file has no rows, but is there; a split that isn't there gives an empty table."""
    classes, images = len(read_class_names(folder)), find_split(folder, split)
    if images is None:
        return spark.createDataFrame([], "image string, path string, rows array<struct<cid:int,cx:double,cy:double,w:double,h:double>>")
    files = spark.read.format("binaryFile").load(images).select("path").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))
    files = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("image"), "path")
    labels = Path(images).parent / "labels"
    if not labels.is_dir() or not any(labels.glob("*.txt")):
        lines = spark.createDataFrame([], "image string, value string")
    else:
        lines = spark.read.option("pathGlobFilter", "*.txt").text(str(labels)).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("image"), "value")
    return labelled_images(files, lines, classes)


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """cls, tag and box of the glyphs of a catalogue, without those whose box is empty."""
    glyphs = [(g["cls"], str(g.get("tag", "")), [int(v) for v in g["box"]]) for g in _yaml(Path(path)).get("glyphs", [])]
    df = spark.createDataFrame(glyphs, "cls string, tag string, box array<int>")
    return df.where("box[2] > box[0] and box[3] > box[1]")
