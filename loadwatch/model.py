"""Contract of the monitor: tables, rules, enumerations and the shapes of its result tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Statuses, severities, rule types, operators and aggregates of the contract.
OK, WARN, FAIL, ERROR = "ok", "warn", "fail", "error"
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}
RULE_TYPES = ("not_null", "unique", "range", "allowed_values", "compare", "same_day", "outlier", "sql")
OPERATORS = ("<=", "<", ">=", ">", "=", "!=")
AGGREGATES = ("sum", "avg", "count", "max", "min")
TEXT, INTEGER, DECIMAL, DATE = "text", "integer", "decimal", "date"
NUMERIC = (INTEGER, DECIMAL)

# Thresholds of the monitors.
GRACE_MINUTES = 60
SPARSE_ROWS = 30
HISTORY_POINTS = 60
WEEKDAY_POINTS = 6
TRAILING_POINTS = 14
MIN_POINTS = 4
VOLUME_Z = 3.5

# Spanish words accepted in connector and rule files, with their English names.
SPANISH = {
    "no_nulos": "not_null",
    "unico": "unique",
    "rango": "range",
    "valores_permitidos": "allowed_values",
    "comparacion": "compare",
    "fecha_del_dia": "same_day",
    "critica": "critical",
    "alta": "high",
    "media": "medium",
    "baja": "low",
    "suma": "sum",
    "promedio": "avg",
    "conteo": "count",
    "maximo": "max",
    "minimo": "min",
}


def english(word: Any) -> Any:
    """English name of a contract word; anything else is returned unchanged."""
    return SPANISH.get(word, word) if isinstance(word, str) else word


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # text | integer | decimal | date
    description: str = ""
    spark_type: str = ""  # type captured at connect; empty means the default of the logical type

    def data_type(self) -> str:
        return self.spark_type or {TEXT: "string", INTEGER: "bigint", DECIMAL: "double", DATE: "date"}[self.type]


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Field, ...]
    title: str = ""
    description: str = ""
    owner: str = ""
    owner_email: str = ""
    expected_at: int = 7 * 60  # minutes after midnight
    load_type: str = "incremental"  # incremental | snapshot
    date_column: str = ""
    consumers: tuple[str, ...] = ()

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Field:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"column '{name}' does not exist in {self.name}")


@dataclass(frozen=True)
class Rule:
    id: str
    table: str
    type: str
    severity: str
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    note: str = ""
    author: str = "system"

    @classmethod
    def from_dict(cls, raw: dict[str, Any], **defaults: Any) -> Rule:
        raw = {**defaults, **raw}
        params = {k: english(v) if k == "aggregate" else v for k, v in raw.get("params", {}).items()}
        return cls(**{**raw, "type": english(raw["type"]), "severity": english(raw["severity"]), "params": params})


@dataclass(frozen=True)
class Catalog:
    """The monitored tables and their rules. Both come from a configuration file read by the driver."""

    tables: tuple[TableSpec, ...]
    rules: tuple[Rule, ...] = ()

    def spec(self, name: str) -> TableSpec:
        for t in self.tables:
            if t.name == name:
                return t
        raise ValueError(f"table '{name}' does not exist")

    def rules_for(self, table: str, enabled_only: bool = True) -> list[Rule]:
        return [r for r in self.rules if r.table == table and (r.enabled or not enabled_only)]


SPEC_SCHEMA = ("table string, table_order int, title string, owner string, owner_email string, expected_at int, "
               "load_type string, consumers array<string>, expected_columns array<string>")

RULE_SCHEMA = ("id string, table string, type string, severity string, params string, enabled boolean, note string, "
               "author string")

LOAD_SCHEMA = "load_date date, table string, arrived_minute int, row_count bigint, columns array<string>"

METRIC_SCHEMA = "load_date date, table string, metric string, value double"

CHECK_SCHEMA = (
    "load_date date, table string, check_id string, check_order int, name string, kind string, "
    "severity string, rule_type string, status string, value double, threshold string, message string, "
    "failing_rows bigint, total_rows bigint, sql string"
)
CHECK_COLUMNS = [c.split(" ")[0] for c in CHECK_SCHEMA.split(", ")]


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows the driver already holds (configuration, calendar days) as a local relation.

    Its exact size is known to the optimizer, which broadcasts it only below its own threshold.
    """
    shape = T.StructType.fromDDL(schema)
    names = shape.fieldNames()
    cells = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(shape))
    return spark.createDataFrame(cells, schema=shape)


def specs_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """One row per monitored table."""
    return small_frame(spark, [(t.name, i, t.title or t.name, t.owner, t.owner_email, t.expected_at, t.load_type,
                                list(t.consumers), t.column_names) for i, t in enumerate(catalog.tables)], SPEC_SCHEMA)


def rules_frame(spark: SparkSession, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    """One row per rule, its parameters as JSON."""
    return small_frame(spark, [(r.id, r.table, r.type, r.severity, json.dumps(r.params, ensure_ascii=False), r.enabled,
                                r.note, r.author) for r in rules], RULE_SCHEMA)


def rule_to_dict(rule: Rule) -> dict[str, Any]:
    return asdict(rule)


def severity_weight(col) -> Any:
    """Weight of a severity column."""
    out = None
    for name, weight in SEVERITY_WEIGHT.items():
        out = F.when(col == name, weight) if out is None else out.when(col == name, weight)
    return out
