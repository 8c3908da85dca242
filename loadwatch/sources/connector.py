"""Connector files, schema capture and the reading of one load."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadwatch.model import DATE, DECIMAL, INTEGER, TEXT, Catalog, Field, Rule, TableSpec
from loadwatch.sources.dialect import Dialect, read_dialect, sniff

# Keys of a connector file, Spanish name to English name.
CONFIG_KEYS = {
    "fuente": "source",
    "titulo": "title",
    "descripcion": "description",
    "ruta": "path",
    "formato": "format",
    "manifiesto": "manifest",
    "hora_esperada": "expected_at",
    "responsable": "owner",
    "correo": "email",
    "url_proyecto": "project_url",
    "url_corrida": "run_url",
    "reglas_automaticas": "auto_rules",
    "tablas": "tables",
    "reglas": "rules",
    "nombre": "name",
    "archivo": "file",
    "tipo": "load_type",
    "columna_fecha": "date_column",
    "consumidores": "consumers",
}


# ------------------------------------------------------------------ scans
def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, dialect: Dialect | None = None) -> DataFrame:
    """CSV with a header row. Its dialect is found and its types are inferred on the first read only; pass both afterwards (a schema
    alone means commas)."""
    if dialect is None:
        dialect = sniff(spark, path) if schema is None else Dialect()
    return read_dialect(spark, path, dialect, schema)


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (scan_csv if path.lower().endswith(".csv") else scan_parquet)(spark, path, schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


# ----------------------------------------------------------------- schema
def logical_type(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return INTEGER
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return DECIMAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return TEXT


def infer_fields(schema: T.StructType) -> tuple[Field, ...]:
    """Name, logical type and Spark type of every column."""
    return tuple(Field(f.name, logical_type(f.dataType), (f.metadata or {}).get("comment", ""),
                       f.dataType.simpleString()) for f in schema.fields)


def infer_spec(df: DataFrame, name: str, **attributes: Any) -> TableSpec:
    return TableSpec(name=name, columns=infer_fields(df.schema), **attributes)


def _iso_text(col: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS`, with six decimals only when there are some."""
    return F.when(F.date_format(col, "SSSSSS") == "000000", F.date_format(col, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def plain(col: Column, data_type: T.DataType) -> Column:
    """A cell as the monitor stores it."""
    if isinstance(data_type, T.BooleanType):
        return col.cast("int")
    if isinstance(data_type, T.DecimalType):
        return col.cast("double")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    if isinstance(data_type, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return _iso_text(col)
    if isinstance(data_type, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    if isinstance(data_type, (T.IntegralType, T.StringType)):
        return col
    return col.cast("string")


def normalize_types(df: DataFrame) -> DataFrame:
    """Every column in its stored form: numbers and text kept, the rest spelled as text."""
    return df.select([plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _rule_value(name: str, data_type: T.DataType) -> str:
    """A cell as the rules see it: native dates, booleans as 0 and 1, NaN as missing."""
    if isinstance(data_type, T.BooleanType):
        return f"CAST({name} AS INT)"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN NOT isnan({name}) THEN {name} END"
    return name


def align_to_spec(df: DataFrame, spec: TableSpec, keep: tuple[str, ...] = ("load_date",)) -> DataFrame:
    """The columns of the contract only, with its types: missing ones become NULL, unknown ones are dropped, and a column
    that arrives with another type is cast to the contract's, what doesn't fit becoming NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for c in spec.columns:
        name = f"`{c.name}`"
        empty = "INT" if c.data_type() == "boolean" else c.data_type()
        value = _rule_value(name, types[c.name]) if c.name in types else f"CAST(NULL AS {empty})"
        if c.name in types and c.spark_type and types[c.name] != T.StructType.fromDDL(f"c {c.spark_type}")["c"].dataType:
            text_flag = c.data_type() == "boolean" and isinstance(types[c.name], T.StringType)
            cast = f"CAST(try_cast({name} AS BOOLEAN) AS INT)" if text_flag else f"try_cast({name} AS {empty})"
            value = _rule_value(cast, T.StructType.fromDDL(f"c {empty}")["c"].dataType)
        columns.append(name if value == name else f"{value} AS {name}")
    return df.selectExpr(*columns, *[k for k in keep if k in types and k not in spec.column_names])


# -------------------------------------------------------------- connector
@dataclass(frozen=True)
class Connector:
    name: str
    title: str
    path: str
    manifest: str
    expected_at: int
    catalog: Catalog
    files: dict[str, str]
    auto_rules: frozenset[str] = frozenset()
    run_url: str = ""
    description: str = ""
    project_url: str = ""
    schemas: dict[str, T.StructType] = field(default_factory=dict)
    dialects: dict[str, Dialect] = field(default_factory=dict)  # of the CSV tables, as found when the connector was loaded

    def spec(self, table: str) -> TableSpec:
        return self.catalog.spec(table)

    def current(self, spark: SparkSession, table: str) -> tuple[DataFrame | None, list[str]]:
        """The table as published now, with the columns it brought; (None, contract columns) when the file is gone."""
        path = self.files[table]
        if not path_exists(spark, path):
            return None, self.spec(table).column_names
        try:
            received = scan(spark, path).schema if not path.lower().endswith(".csv") else _csv_header(spark, path, self.dialects[table])
        except AnalysisException:
            return None, self.spec(table).column_names
        if path.lower().endswith(".csv"):
            frozen = self.schemas[table]
            known = {f.name: f for f in frozen.fields}
            schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in received])
            return scan_csv(spark, path, schema, self.dialects[table]), received
        return scan_parquet(spark, path, received), received.fieldNames()


def _csv_header(spark: SparkSession, path: str, dialect: Dialect) -> list[str]:
    return spark.read.option("header", True).option("sep", dialect.delimiter).option("quote", dialect.quote).csv(path).columns


def _translate(config: Any) -> Any:
    return {CONFIG_KEYS.get(k, k): v for k, v in config.items()}


def read_config(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading a YAML connector needs PyYAML; a JSON file works without it") from exc
    return yaml.safe_load(text)


def load_connector(spark: SparkSession, config: str | dict[str, Any], path: str | None = None) -> Connector:
    """A connector from its configuration file or dict, the schema of each table captured from its file."""
    cfg = _translate(read_config(config) if isinstance(config, str) else config)
    candidates = path or cfg["path"]
    candidates = candidates if isinstance(candidates, list) else [candidates]
    base = next((c for c in candidates if path_exists(spark, c)), candidates[0]).rstrip("/")
    hour, minute = (int(x) for x in str(cfg.get("expected_at", "07:00")).split(":"))
    name = cfg.get("source", "source")
    specs, files, schemas, dialects = [], {}, {}, {}
    for raw in cfg["tables"]:
        t = _translate(raw)
        file = f"{base}/{t.get('file', t['name'] + '.' + cfg.get('format', 'parquet'))}"
        if not path_exists(spark, file):
            raise FileNotFoundError(f"cannot find {file}: check the path of the connector")
        if file.lower().endswith(".csv"):
            dialects[t["name"]] = sniff(spark, file)
            schemas[t["name"]] = scan_csv(spark, file, None, dialects[t["name"]]).schema
        else:
            schemas[t["name"]] = scan_parquet(spark, file).schema
        files[t["name"]] = file
        specs.append(TableSpec(
            name=t["name"], columns=infer_fields(schemas[t["name"]]), title=t.get("title", t["name"]),
            description=t.get("description", ""), owner=t.get("owner", cfg.get("owner", name)),
            owner_email=t.get("email", cfg.get("email", "")), expected_at=hour * 60 + minute,
            load_type=t.get("load_type", "incremental"), date_column=t.get("date_column") or "",
            consumers=tuple(t.get("consumers", []))))
    rules = tuple(Rule.from_dict(r, id=f"R{i:03d}") for i, r in enumerate(cfg.get("rules") or [], 1))
    with_rules = {r.table for r in rules}
    auto = {s.name for s in specs} - with_rules if cfg.get("auto_rules", True) else set()
    return Connector(name=name, title=cfg.get("title", name), path=base, manifest=cfg.get("manifest", ""),
                     expected_at=hour * 60 + minute, catalog=Catalog(tuple(specs), rules), files=files,
                     auto_rules=frozenset(auto), run_url=cfg.get("run_url", ""),
                     description=cfg.get("description", ""), project_url=cfg.get("project_url", ""), schemas=schemas, dialects=dialects)


# ------------------------------------------------------------------ loads
def read_load(df: DataFrame, spec: TableSpec, day: date | None) -> DataFrame:
    """The rows of one load: those of `day` for an incremental table, otherwise the whole table."""
    if day is None or spec.load_type != "incremental" or spec.date_column not in df.columns:
        return df
    return df.where(F.col(f"`{spec.date_column}`").cast("date") == F.lit(day))


def tag_loads(df: DataFrame, spec: TableSpec, snapshot_day: date | None = None) -> DataFrame:
    """Every load of a table at once, each row tagged with its load date; a row without a date belongs to no load."""
    if spec.load_type == "incremental" and spec.date_column in df.columns:
        return df.withColumn("load_date", F.col(f"`{spec.date_column}`").cast("date")).where("load_date is not null")
    return df.withColumn("load_date", F.lit(snapshot_day).cast("date"))


def available_dates(tables: list[tuple[DataFrame, TableSpec]]) -> DataFrame | None:
    """Distinct non-null dates across the incremental tables; None when there is no such table."""
    parts = [df.select(F.col(f"`{spec.date_column}`").cast("date").alias("load_date")).distinct()
             for df, spec in tables if spec.load_type == "incremental" and spec.date_column in df.columns]
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).where("load_date is not null").distinct()
