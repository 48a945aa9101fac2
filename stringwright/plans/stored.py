"""A fitted cleaner on disk: learnt maps as Parquet tables, everything else as one JSON manifest.

Tables are read only where a transform comes to them. Functions cannot be stored: a registry with types
of the user's own is named in the manifest by its types, and must be given again when loading.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from stringwright.operators import features as P
from stringwright.operators import missing as M
from stringwright.operators import moments
from stringwright.operators import types as T
from stringwright.plans.cleaner import StringCleaner, StringCleanerModel

VERSION = 1
PLAIN = ["empty", "types", "first_types", "tokens", "repaired_cols", "groups", "ordinal", "balanced"]
SETTINGS = ["target", "encode", "dense", "vector_dims", "plain_strings", "strict_numbers", "drop_last", "seed"]
OPTIONS = ["cell_degrees", "radius_km", "in_degrees"]
RULE = ["kind", "ends", "ranked", "length", "pair", "directives"]
PLAN = ["strategy", "cols", "p_value", "fills", "coded", "whole"]


def save_cleaner(model: StringCleanerModel, path: str) -> None:
    """Write a fitted cleaner to a new folder that all executors reach."""
    tables: dict[str, DataFrame] = {}

    def kept(name: str, table: DataFrame | None) -> str | None:
        if table is None:
            return None
        tables[name] = table
        return name

    settings, plan = model.settings, model.missing
    normal = plan.normal
    manifest = {
        "version": VERSION,
        "settings": {k: getattr(settings, k) for k in SETTINGS},
        "options": {k: settings.options[k] for k in OPTIONS},
        "types": settings.registry.types,
        "nouns": kept("nouns", settings.options["nouns"]),
        "gazetteer": kept("gazetteer", settings.options["gazetteer"]),
        "model": {k: getattr(model, k) for k in PLAIN},
        "kept_texts": sorted(model.kept_texts),
        "missing": {k: getattr(plan, k) for k in PLAN},
        "missing_maps": kept("missing", plan.maps),
        "normal": None if normal is None else [normal.mean.tolist(), normal.cov.tolist(), normal.rounds, normal.settled],
        "repairs": kept("repairs", model.repairs),
        "target_codes": kept("target", model.target_codes),
        "rules": [
            {"col": c, "maps": kept(f"rule-{i}", r.maps)} | {k: getattr(r, k) for k in RULE} for i, (c, r) in enumerate(model.rules.items())
        ],
        "encoders": [
            {"col": c, "encoder": e, "size": size, "map": kept(f"encoder-{i}", m)} for i, (c, (e, m, size)) in enumerate(model.encoders.items())
        ],
        "report": kept("report", model.report()),
    }
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    # last, so that a folder with a manifest is whole
    spark = model.repairs.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")


class StoredModel(StringCleanerModel):
    """A cleaner read from disk; its report is the one of the fit."""

    stored_report: DataFrame

    def report(self) -> DataFrame:
        return self.stored_report


def load_cleaner(spark: SparkSession, path: str, types: T.TypeRegistry = T.DEFAULT_TYPES) -> StoredModel:
    """Read a fitted cleaner. ``types`` must know the user's own types it was fitted with."""
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    if manifest["version"] != VERSION:
        raise ValueError(f"a manifest of version {manifest['version']}")
    if manifest["types"] != types.types:
        raise ValueError(f"fitted with the types {', '.join(manifest['types'])}")

    def read(name: str | None) -> DataFrame | None:
        return None if name is None else spark.read.parquet(f"{path}/{name}")

    options = manifest["options"]
    settings = StringCleaner(
        **{k: v for k, v in manifest["settings"].items() if k != "drop_last"},
        nouns=read(manifest["nouns"]), gazetteer=read(manifest["gazetteer"]), types=types,
        cell_degrees=options["cell_degrees"], radius_km=options["radius_km"], compat_xyz=not options["in_degrees"],
    )
    settings.drop_last = manifest["settings"]["drop_last"]
    model = StoredModel(settings)
    for k, v in manifest["model"].items():
        setattr(model, k, v)
    model.kept_texts = set(manifest["kept_texts"])
    model.missing = M.MissingPlan(manifest["missing"]["strategy"], manifest["missing"]["cols"])
    for k, v in manifest["missing"].items():
        setattr(model.missing, k, v)
    model.missing.maps = read(manifest["missing_maps"])
    if manifest["normal"] is not None:
        mean, cov, rounds, settled = manifest["normal"]
        model.missing.normal = moments.Normal(np.array(mean), np.array(cov), rounds, settled)
    model.repairs, model.target_codes = read(manifest["repairs"]), read(manifest["target_codes"])
    for entry in manifest["rules"]:
        rule = P.FeatureRule(entry["col"], entry["kind"])
        for k in RULE:
            setattr(rule, k, P.Ends(*entry[k]) if k == "ends" else entry[k])
        rule.maps = read(entry["maps"])
        model.rules[entry["col"]] = rule
    for entry in manifest["encoders"]:
        model.encoders[entry["col"]] = (entry["encoder"], read(entry["map"]), entry["size"])
    model.stored_report = read(manifest["report"])
    return model
