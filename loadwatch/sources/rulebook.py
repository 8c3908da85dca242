"""Rule files: reading, writing, numbering."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.model import Rule, rule_to_dict
from loadwatch.operators.rules import validate_rule

_FILE_SCHEMA = ("id string, `table` string, type string, severity string, params string, enabled boolean, "
                "note string, author string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule catalogue as rows, parameters kept as JSON text."""
    return (spark.read.schema(_FILE_SCHEMA).option("multiLine", True).json(path)
            .fillna({"enabled": True, "note": "", "author": "system"}))


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a catalogue file; a rule file is written by hand and its size is that of a configuration."""
    rows = read_rules(spark, path).collect()
    return [Rule.from_dict({**r.asDict(), "params": json.loads(r.params or "{}")}) for r in rows]


def save_rules(spark: SparkSession, rules: list[Rule], path: str) -> None:
    """The catalogue as one JSON array, in a folder any Hadoop file system can hold."""
    text = json.dumps([rule_to_dict(r) for r in rules], ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions of a kept catalogue: Spark marks a folder when its write has ended."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[8:]) for n in names if n.startswith("version=")
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def kept_rules(spark: SparkSession, folder: str) -> list[Rule] | None:
    """The newest complete version of the catalogue in `folder`; None if there is none."""
    known = _versions(spark, folder)
    return load_rules(spark, f"{folder}/version={known[-1]}") if known else None


def keep_rules(spark: SparkSession, rules: list[Rule], folder: str) -> None:
    """Writes the catalogue as a new version, if it changed; a crash leaves the version before it. The last few stay."""
    known = _versions(spark, folder)
    if known and load_rules(spark, f"{folder}/version={known[-1]}") == list(rules):
        return
    save_rules(spark, rules, f"{folder}/version={known[-1] + 1 if known else 1}")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for old in known[:-4]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={old}"), True)


def number_rules(raws: list[dict], catalog) -> list[Rule]:
    """Default rules, numbered `R001`, `R002` and so on, each one validated."""
    return [validate_rule(Rule.from_dict(raw, id=f"R{i:03d}"), catalog) for i, raw in enumerate(raws, 1)]


def next_id(rules: list[Rule]) -> str:
    numbers = [int(r.id[1:]) for r in rules if r.id[1:].isdigit()]
    return f"R{max(numbers, default=0) + 1:03d}"


def rules_for_tables(tables: DataFrame, rules: DataFrame) -> DataFrame:
    """Each table with its enabled rules; `rules` comes from a rule file and carries its own size hint."""
    return tables.join(rules.where(F.col("enabled")), "table")
