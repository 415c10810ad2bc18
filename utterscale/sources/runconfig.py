"""Run configurations as a table: one JSON object per row, fixed keys, defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key -> (type, default). Names of corpora and runs are neutral here.
KEYS: dict[str, tuple[str, Any]] = {
    "train_corpora": ("array<array<string>>", [["corpus", "train"]]),
    "eval_corpora": ("array<array<string>>", [["corpus", "train"]]),
    "experiment_name": ("string", "experiment"),
    "experiment_tag": ("string", "getting_started"),
    "n_steps": ("bigint", 30),
    "device": ("string", "cuda"),
    "batch_size": ("bigint", 2),
    "eval_batch_size": ("bigint", 2),
    "gradient_accumulation_steps": ("bigint", 90),
    "gradient_checkpointing": ("bigint", 1),
    "learning_rate": ("double", 3e-05),
    "validation_freq": ("bigint", 100),
    "save_step": ("bigint", 100),
    "logging_step": ("bigint", 10),
    "checkpoint": ("string", None),
    "n_valid_samples": ("bigint", -1),
    "n_train_samples": ("bigint", -1),
    "alt_base_path": ("string", "./"),
    "label_smoothing_factor": ("double", 0.0),
    "wav2vec_base_model": ("string", "facebook/wav2vec2-xls-r-300m"),
    "bf16": ("boolean", False),
    "fp16": ("boolean", True),
    "optim": ("string", "adamw_hf"),
    "freeze_w2vm": ("boolean", False),
    "save_total_limit": ("bigint", 2),
    "seed": ("bigint", 123),
    "dataset_kwargs": ("string", "{}"),
    "data_dir": ("string", "/"),
}


def _literal(kind: str, value: Any) -> Column:
    if kind.startswith("array"):
        return F.from_json(F.lit(json.dumps(value)), kind)
    return F.lit(value).cast(kind)


def expand(rows: DataFrame, column: str = "config") -> DataFrame:
    """One column per known key, defaults where the key is absent, plus ``unknown_keys`` and ``error``.

    An explicit ``null`` stays null, as a key that is present is never defaulted. ``error`` is
    ``json`` for a text that is no JSON object, or ``type: `` and the keys whose value has the
    wrong type; such a row takes no defaults.
    """
    # a JSON flag may be written 0/1 where the key is a number, so numbers read flags too
    flag = "gradient_checkpointing"
    schema = ", ".join(f"{k} {'string' if k == flag else kind}" for k, (kind, _) in KEYS.items())
    parsed = rows.withColumns({"_c": F.from_json(column, schema), "_keys": F.json_object_keys(column),
                               "_v": F.try_parse_json(column)})

    def given(key: str) -> Column:
        found = F.col(f"_c.{key}")
        if key == flag:
            found = F.when(found == "true", 1).when(found == "false", 0).otherwise(found.try_cast("bigint"))
        return found

    def value(key: str, kind: str, default: Any) -> Column:
        return (F.when(F.array_contains("_keys", key), given(key))
                .when(F.col("error").isNull(), _literal(kind, default)).alias(key))

    wrong = F.array(*[F.when(F.try_variant_get("_v", f"$.{k}", "string").isNotNull() & given(k).isNull(), k) for k in KEYS])
    parsed = parsed.withColumn("_wrong", F.array_join(wrong, ", ")).withColumn("error", F.when(
        F.col("_v").isNull() | F.col("_keys").isNull(), "json").when(F.col("_wrong") != "", F.concat(F.lit("type: "), "_wrong")))

    known = F.array(*[F.lit(k) for k in KEYS])
    return parsed.select(*rows.columns, *[value(k, kind, d) for k, (kind, d) in KEYS.items()],
                         F.array_except("_keys", known).alias("unknown_keys"), "error")


@dataclass(frozen=True)
class RunConfig:
    """Driver-side form of one configuration; unknown keys are refused by name."""
    values: dict[str, Any]

    @classmethod
    def from_dict(cls, given: dict[str, Any]) -> "RunConfig":
        unknown = sorted(set(given) - set(KEYS))
        if unknown:
            raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
        defaults = {k: ({} if k == "dataset_kwargs" else d) for k, (_, d) in KEYS.items()}
        return cls({**defaults, **given})

    @classmethod
    def from_json(cls, text: str) -> "RunConfig":
        return cls.from_dict(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(self.values)

    def __getitem__(self, key: str) -> Any:
        return self.values[key]
