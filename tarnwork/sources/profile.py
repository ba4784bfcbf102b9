"""Device profile, configuration and bundle files of the driver's size."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.retrieval import bundle_faults

PROFILE = "name STRING, rack_count INT, floor_usable BOOLEAN, cavity_group STRING, accessories ARRAY<STRING>"


@dataclass(frozen=True)
class EvalConfig:
    """The defaults of thresholds and targets."""

    knn_k: int = 10
    tau: float = 0.5
    default_threshold: float = 0.5
    safety_recall_target: float = 0.95
    rack_target_precision: float = 0.95

    def __post_init__(self):
        if isinstance(self.knn_k, bool) or not isinstance(self.knn_k, int) or self.knn_k < 1:
            raise ValueError("knn_k must be a positive whole number")
        for name, low in (("tau", -1.0), ("default_threshold", 0.0), ("safety_recall_target", 0.0), ("rack_target_precision", 0.0)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= 1:
                raise ValueError(f"{name} must lie between {low} and 1")


def profile_rows(raw: dict, max_rack: int = 9, accessory_classes: Sequence[str] | None = None) -> list[tuple]:
    """Rows of a profile object; keys that begin with ``_`` are comments.

    A device may put things on its floor unless it says otherwise, and is its own cavity
    group unless it names one. All faults are reported together.
    """
    entries = {str(name): spec for name, spec in raw.items() if not str(name).startswith("_")} if isinstance(raw, dict) else {}
    faults = [] if entries else ["the profile is empty"]
    faults += [f"{name}: not an object" for name, spec in entries.items() if not isinstance(spec, dict)]
    read = {name: spec for name, spec in entries.items() if isinstance(spec, dict)}
    rows = [(n, s.get("rack_count"), s.get("floor_usable", True), str(s.get("cavity_group") or n).strip(), s.get("accessories")) for n, s in read.items()]
    checks = {
        f"rack_count must be 1 to {max_rack}": lambda count, floor, held: type(count) is int and 1 <= count <= max_rack,
        "floor_usable must be true or false": lambda count, floor, held: type(floor) is bool,
        "accessories must be a list of known names or null": lambda count, floor, held: held is None or isinstance(held, list) and (accessory_classes is None or all(x in accessory_classes for x in held)),
    }
    faults += [f"{name}: {what}" for name, count, floor, _, held in rows for what, holds in checks.items() if not holds(count, floor, held)]
    shapes: dict[str, list[str]] = {}
    for _, count, floor, group, _ in rows:
        shapes.setdefault(group, []).append(repr((count, floor)))
    faults += [f"{group}: devices of one cavity group differ" for group, held in shapes.items() if len(set(held)) > 1]
    if faults:
        raise ValueError("; ".join(faults))
    return rows


def read_profile(spark: SparkSession, path: str, **checks) -> DataFrame:
    """The profile file as a table; Spark reads it, so any file system will do."""
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    return spark.createDataFrame(profile_rows(json.loads(text), **checks), PROFILE)


def write_bundle(refs: DataFrame, path: str, fingerprint: str, calibration: DataFrame | None = None) -> None:
    """A gallery and its calibration (name, threshold) with their version; the manifest is written last."""
    parts = {"gallery": refs} | ({"calibration": calibration} if calibration is not None else {})
    for part, table in parts.items():
        table.write.mode("errorifexists").parquet(f"{path}/{part}")
    lines = [(json.dumps({"part": part, "fingerprint": fingerprint}),) for part in ("model", *parts)]
    refs.sparkSession.createDataFrame(lines, "value STRING").coalesce(1).write.text(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str, expected: str) -> list[str]:
    """The parts of a bundle, of which each must have the expected version."""
    found = [json.loads(r["value"]) for r in spark.read.text(f"{path}/manifest").take(8)]
    other = [f"{x['part']} is {x.get('fingerprint')!r}" for x in found if x.get("fingerprint") != expected]
    if other or not found:
        raise ValueError(f"bundle version is not {expected!r}: {', '.join(other) or 'no manifest'}")
    return [x["part"] for x in found]


def missing_parts(spark: SparkSession, path: str, parts: Sequence[str]) -> list[str]:
    """Those of the files and folders below ``path`` that are not there; an unfinished run lacks its last ones."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = {part: jvm.org.apache.hadoop.fs.Path(f"{path}/{part}") for part in parts}
    return [part for part, p in at.items() if not p.getFileSystem(conf).exists(p)]


def read_bundle(spark: SparkSession, path: str, expected: str, profile: DataFrame | None = None, parts: Sequence[str] = ("manifest", "gallery")) -> DataFrame:
    """The gallery, if no part lacks and model, gallery and calibration all have the expected version, which is not empty; with ``profile``, if its models agree with it."""
    if not expected:
        raise ValueError("a bundle has a version")
    lacking = missing_parts(spark, path, parts)
    if lacking:
        raise FileNotFoundError(f"{path} lacks {', '.join(lacking)}")
    _manifest(spark, path, expected)
    refs = spark.read.parquet(f"{path}/gallery")
    if profile is not None:
        faults = bundle_faults(refs, profile).orderBy("model").take(20)
        if faults:
            raise ValueError("; ".join(f"{r['model']}: {r['fault']}" for r in faults))
    return refs


def read_calibration(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """(name, threshold) of a bundle of the expected version."""
    if "calibration" not in _manifest(spark, path, expected):
        raise ValueError("the bundle has no calibration")
    return spark.read.parquet(f"{path}/calibration")


def write_results(results: DataFrame, path: str) -> None:
    """All results as JSON, and those that wait for the gallery, read from there, as a second set."""
    results.write.mode("errorifexists").json(f"{path}/results")
    written = results.sparkSession.read.schema(results.schema).json(f"{path}/results")
    written.where("pending_gallery").write.mode("errorifexists").json(f"{path}/pending")


def with_provenance(items: DataFrame, root: str) -> DataFrame:
    """``items`` (json_path, image_path, raw, stem, split) with ``document``: the annotation as the data set keeps it, and the names of both files.

    Where it came from and where it lies now replace what it said of its image; all else
    stays as it was, and ``raw`` too.
    """
    folder = F.concat(F.lit(root.rstrip("/") + "/"), F.col("split"))
    image = F.concat("stem", F.lower(F.regexp_extract("image_path", r"(\.[^./]+)$", 1)))
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), F.parse_json(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")).alias("value"))
    told = {"source_json": F.col("json_path"), "source_image": F.col("image_path"), "image": image, "image_name": image, "image_root": folder}
    given = F.parse_json("raw").cast("map<string,variant>")
    kept = F.map_filter(given, lambda k, v: ~k.isin(*told))
    both = F.map_concat(kept, F.map_from_entries(F.array(*[entry(k, v) for k, v in told.items()])))
    return items.withColumns({"document": F.to_json(both), "image_name": image, "json_name": F.concat("stem", F.lit(".json"))})


def write_split(items: DataFrame, path: str) -> None:
    """One folder a split; an existing data set is never overwritten."""
    items.write.mode("errorifexists").partitionBy("split").parquet(path)


def run_dir(parent: str, stamp: str, explicit: str | None = None, resume: str | None = None) -> Path:
    """The driver's folder of a run: that of the checkpoint it resumes, else ``explicit`` if that is empty, else stamp, stamp_01, stamp_02 and so on."""
    if resume is not None:
        home = Path(resume).resolve().parent
        if not Path(resume).is_file():
            raise FileNotFoundError(resume)
        if explicit is not None and Path(explicit).resolve() != home:
            raise ValueError(f"a resumed run stays in {home}")
        return home
    if explicit is not None:
        at = Path(explicit)
        if at.exists() and (not at.is_dir() or any(at.iterdir())):
            raise FileExistsError(f"{at} is not empty")
        at.mkdir(parents=True, exist_ok=True)
        return at
    for n in range(1000):
        at = Path(parent) / (f"{stamp}_{n:02d}" if n else stamp)
        try:
            at.mkdir(parents=True)  # fails if another run has it
            return at
        except FileExistsError:
            continue
    raise FileExistsError(parent)


def fresh_dir(parent: str, date: str, clock: str) -> Path:
    """A new folder of the driver's: date, then date_clock, then date_clock_n."""
    for name in (date, f"{date}_{clock}", *(f"{date}_{clock}_{n}" for n in range(1, 1000))):
        path = Path(parent) / name
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            continue
    raise FileExistsError(parent)
