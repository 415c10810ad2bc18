"""Strict type checks on JSON rows, as a table job with a quarantine.

A rule is a type name, optionally nullable, for one path. A row that breaks any rule
carries the names of the broken ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# integers beyond 64 bits are decimals of 19 to 38 digits without a fraction; 1.0 is a shorter one
LONG = r"DECIMAL\((19|[23]\d),0\)"
INTEGER, REAL = rf"^(BIGINT|{LONG})$", rf"^(?!{LONG}$)(DOUBLE|FLOAT|DECIMAL\(.*\))$"
NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"
KINDS = {"int": INTEGER, "float": NUMBER, "real": REAL, "str": "^STRING$", "bool": "^BOOLEAN$",
         "list": "^ARRAY<", "dict": "^OBJECT<"}


@dataclass(frozen=True)
class Rule:
    """``kind`` of the value; ``each`` applies to list elements, ``members`` to a dict.

    ``float`` takes integers too, ``real`` does not; neither takes a bool.
    """
    kind: str
    nullable: bool = False
    each: "Rule | None" = None
    members: Mapping[str, "Rule"] = field(default_factory=dict)


def type_tag(value: Column) -> Column:
    """Type name of a variant; null for a missing or null value."""
    tag = F.schema_of_variant(value)
    return F.when(tag != "VOID", tag)


def holds(value: Column, rule: Rule) -> Column:
    """Whether one variant value keeps the rule, never null."""
    tag = type_tag(value)
    ok = F.coalesce(tag.rlike(KINDS[rule.kind]), F.lit(False))
    if rule.each is not None:
        items = F.when(ok, F.try_variant_get(value, "$", "array<variant>"))
        ok = ok & F.coalesce(F.forall(items, lambda x: holds(x, rule.each)), F.lit(False))
    for name, member in rule.members.items():
        ok = ok & holds(F.variant_get(value, f"$.{name}", "variant"), member)
    return (tag.isNull() | ok) if rule.nullable else ok


def validate(rows: DataFrame, json: str, rules: Mapping[str, Rule]) -> DataFrame:
    """Adds ``violations``: names of broken rules, ``['json']`` if the text is no JSON."""
    parsed = rows.withColumn("_v", F.try_parse_json(json))
    broken = [F.when(~holds(F.variant_get("_v", f"$.{path}", "variant"), rule), path)
              for path, rule in rules.items()]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return parsed.withColumn("violations", F.when(F.col("_v").isNull(), F.array(F.lit("json"))).otherwise(found)).drop("_v")


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with one row per broken rule."""
    good = validated.where(F.size("violations") == 0).drop("violations")
    bad = validated.where(F.size("violations") > 0).withColumn("rule", F.explode("violations")).drop("violations")
    return good, bad


def coerce_float(json: Column, path: str) -> Column:
    """Number at ``path`` as a double; null for anything else, a bool included."""
    value = F.variant_get(F.try_parse_json(json), f"$.{path}", "variant")
    return F.when(type_tag(value).rlike(NUMBER), F.try_variant_get(value, "$", "double"))


def type_of(rule: Rule) -> str:
    """The column type that holds every value of the rule."""
    if rule.kind == "list":
        return f"array<{type_of(rule.each) if rule.each else 'variant'}>"
    if rule.kind == "dict":
        return "struct<" + ", ".join(f"`{name}`: {type_of(member)}" for name, member in rule.members.items()) + ">" if rule.members else "variant"
    return {"int": "decimal(38,0)", "float": "double", "real": "double", "str": "string", "bool": "boolean"}[rule.kind]


def typed(rows: DataFrame, json: str, rules: Mapping[str, Rule], column: str = "checked") -> DataFrame:
    """Adds ``violations`` and ``column``: the named members as one typed struct, null if a rule is broken.

    Members without a rule are left out; an absent member that may be null is null.
    """
    value = F.try_parse_json(json)
    members = [F.try_variant_get(value, f"$.{path}", type_of(rule)).alias(path) for path, rule in rules.items()]
    return validate(rows, json, rules).withColumn(column, F.when(F.size("violations") == 0, F.struct(*members)))


def serialise(rows: DataFrame, json: str, rules: Mapping[str, Rule], column: str = "serialised") -> DataFrame:
    """Adds ``violations`` and ``column``: the checked row as JSON text, its members in the rules'
    order; null if a rule is broken. The text keeps all rules, and serialises to itself."""
    checked = typed(rows, json, rules, "_c")
    return checked.withColumn(column, F.to_json("_c", {"ignoreNullFields": "false"})).drop("_c")
