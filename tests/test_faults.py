"""Every fault is detected by its check and the incident closes by itself; normal days almost never alert."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadwatch.model import Catalog, Field, Rule, TableSpec
from loadwatch.operators.incidents import incidents
from loadwatch.operators.rules import validate_rule
from loadwatch.plans.validate import validate

START, DAYS, FAULT_DAY = date(2026, 1, 5), 70, 60
WEEKDAY = (1.15, 1.0, 1.0, 1.0, 1.05, 0.55, 0.3)
SPEC = TableSpec("credits", (Field("id", "text"), Field("document", "text"), Field("cut_on", "date"), Field("amount", "decimal"),
                             Field("balance", "decimal"), Field("ratio", "decimal"), Field("channel", "text"), Field("rate", "decimal")),
                 expected_at=390)
RULES = [("unique", "critical", {"columns": ["id"]}), ("same_day", "critical", {"column": "cut_on"}),
         ("compare", "high", {"column": "balance", "operator": "<=", "other_column": "amount"}),
         ("range", "critical", {"column": "ratio", "min": 0, "max": 100}), ("not_null", "critical", {"column": "document"}),
         ("allowed_values", "medium", {"column": "channel", "values": ["app", "pse", "office"]}),
         ("outlier", "high", {"column": "amount", "aggregate": "avg", "z": 4, "same_weekday": False}),
         ("sql", "critical", {"condition": "rate < 2500 OR rate > 7000"})]
FAULTS = {  # fault -> check that must see it
    "never_arrives": "availability", "late_arrival": "availability", "empty": "volume_low", "partial": "volume_low", "twice": "unique",
    "yesterday": "same_day", "balance_above": "compare", "negative_ratio": "range", "unit_error": "outlier", "no_document": "not_null",
    "new_channel": "allowed_values", "dropped_column": "structure", "wrong_rate": "sql",
}


def clean_days(seed, days, base=200):
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(days):
        day = START + timedelta(days=i)
        n = max(1, int(base * WEEKDAY[day.weekday()] * rng.normal(1, 0.06)))
        amount = np.round(rng.lognormal(16, 0.45, n), 0)
        parts.append(pd.DataFrame({
            "id": [f"{seed}-{i}-{k}" for k in range(n)], "document": [str(k) for k in range(n)], "cut_on": day, "amount": amount,
            "balance": np.round(amount * rng.uniform(0.2, 1, n), 0), "ratio": rng.uniform(0, 9, n).round(2),
            "channel": rng.choice(["app", "pse", "office"], n), "rate": rng.normal(4000, 50, n).round(2), "load_date": day}))
    return pd.concat(parts, ignore_index=True)


def spoil(rows, fault):
    """One bad load, as an edit of the clean one."""
    r = rows.copy()
    if fault == "empty":
        return r.iloc[:0]
    if fault == "partial":
        return r.iloc[: int(len(r) * 0.35)]
    if fault == "twice":
        return pd.concat([r, r])
    if fault == "yesterday":
        r["cut_on"] = r["cut_on"] - timedelta(days=1)
    elif fault == "balance_above":
        r.loc[r.index[::12], "balance"] = r["amount"] * 1.3
    elif fault == "negative_ratio":
        r.loc[r.index[0], "ratio"] = -1.3
    elif fault == "unit_error":
        r.loc[r.index[: int(len(r) * 0.6)], "amount"] *= 10
    elif fault == "no_document":
        r.loc[r.index[: int(len(r) * 0.3)], "document"] = None
    elif fault == "new_channel":
        r.loc[r.index[::8], "channel"] = "UNKNOWN"
    elif fault == "wrong_rate":
        r.loc[r.index[0], "rate"] *= 10
    return r


@pytest.fixture(scope="module")
def results(spark):
    """One table per fault, all validated together."""
    day = START + timedelta(days=FAULT_DAY)
    base = clean_days(1, DAYS)
    specs, rules, tables, arrivals, received = [], [], {}, [], []
    for fault in FAULTS:
        spec = TableSpec(fault, SPEC.columns, expected_at=390)
        specs.append(spec)
        rules += [Rule(f"{fault}-{k}", fault, k, s, p) for k, s, p in RULES]
        frame = pd.concat([base[base["load_date"] != day], spoil(base[base["load_date"] == day], fault)])
        if fault == "never_arrives":
            frame = base[base["load_date"] != day]
        tables[fault] = spark.createDataFrame(frame)
        for i in range(DAYS):
            d, names = START + timedelta(days=i), SPEC.column_names
            bad = d == day
            arrivals.append((d, fault, None if bad and fault == "never_arrives" else 395, 630))
            if bad and fault == "late_arrival":  # first missing, then it arrives two hours late
                arrivals[-1] = (d, fault, 510, 630)
            if not (bad and fault == "never_arrives"):
                received.append((d, fault, [n for n in names if not (bad and fault == "dropped_column" and n == "channel")]))
    catalog = Catalog(tuple(specs))
    catalog = Catalog(tuple(specs), tuple(validate_rule(r, catalog) for r in rules))
    v = validate(catalog, tables, spark.createDataFrame(arrivals, "load_date date, table string, arrived_minute int, now_minute int"),
                 spark.createDataFrame(received, "load_date date, table string, columns array<string>"))
    checks = [r for r in v.checks.where(F.col("load_date") == F.lit(day)).collect()]
    return day, checks, incidents(v.observations).collect()


@pytest.mark.parametrize("fault,expected", FAULTS.items())
def test_each_fault_is_detected_and_its_incident_closes(results, fault, expected):
    day, checks, found = results
    seen = {c.rule_type: c.status for c in checks if c.table == fault}
    if fault == "late_arrival":
        assert seen[expected] == "warn"
        return
    assert seen[expected] == "fail"
    (inc,) = [i for i in found if i.table == fault and i.opened_date == day]
    assert expected in {c.rule_type for c in inc.checks}
    assert inc.resolution == "automatic" and inc.resolved_date == day + timedelta(days=1)


def test_normal_days_almost_never_alert(spark):
    """120 normal days of six tables, after 70 days of history: incidents in less than 1.5 % of the loads."""
    specs, rules, tables, days = [], [], {}, 190
    for seed, base in enumerate((45, 60, 90, 200, 350, 20), 10):
        spec = TableSpec(f"t{seed}", SPEC.columns, expected_at=390)
        specs.append(spec)
        rules += [Rule(f"{spec.name}-{k}", spec.name, k, s, p) for k, s, p in RULES]
        tables[spec.name] = spark.createDataFrame(clean_days(seed, days, base))
    catalog = Catalog(tuple(specs))
    catalog = Catalog(tuple(specs), tuple(validate_rule(r, catalog) for r in rules))
    calendar = [(START + timedelta(days=i), s.name) for s in specs for i in range(days)]
    arrivals = spark.createDataFrame([(d, t, 395, 630) for d, t in calendar], "load_date date, table string, arrived_minute int, now_minute int")
    received = spark.createDataFrame([(d, t, SPEC.column_names) for d, t in calendar], "load_date date, table string, columns array<string>")
    v = validate(catalog, tables, arrivals, received)
    false = [i for i in incidents(v.observations).collect() if i.opened_date >= START + timedelta(days=70)]
    assert len(false) / (120 * 6) < 0.015, [(i.table, i.opened_date, i.title) for i in false]
