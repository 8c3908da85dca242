import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loadwatch.model import SEVERITY_WEIGHT, Catalog, Field, TableSpec, specs_frame
from loadwatch.operators import incidents as inc
from loadwatch.plans.escalation import CAUSES, escalation_reports, with_causes

START = date(2026, 1, 1)
SEVERITIES = list(SEVERITY_WEIGHT)


def check(severity, order, message="m"):
    w = SEVERITY_WEIGHT[severity]
    return (-w, order, f"c{order}", f"name {order}", severity, w, "range", message)


def walk(events):
    """The incident of one table, step by step."""
    found, current = [], None
    for e in sorted(events, key=lambda e: (e["seq"], e["day"], e["minute"], e["turn"])):
        at = (e["day"], e["minute"])
        if e["kind"] == "observe" and e["checks"]:
            main = sorted(e["checks"])[0]
            if current is None:
                current = {"opened": at, "title": main[3], "weight": main[5], "loads": 1, "day": e["day"], "run": e["run"],
                           "status": "open", "resolved": None, "how": None}
                found.append(current)
            elif current["day"] != e["day"]:
                current["loads"] += 1
                current["day"] = e["day"]
                current["run"] = e["run"] or current["run"]
            current["weight"] = max(current["weight"], main[5])
            current["evidence"] = [c[2] for c in sorted(e["checks"])]
        elif current is not None and e["kind"] == "escalate":
            current["status"] = "escalated"
        elif current is not None and e["kind"] in ("observe", "resolve"):
            current.update(status="resolved", resolved=max(at, current["opened"]), how="manual" if e["kind"] == "resolve" else "automatic")
            current = None
    return found


@pytest.fixture(scope="module")
def random_events():
    rng = random.Random(7)
    tables = {}
    for t in range(30):
        events, days = [], [START + timedelta(days=i) for i in range(14)]
        for seq, batch in enumerate((days, rng.sample(days, 4)), 1):  # the second publication repeats some days, out of order
            for d in sorted(batch):
                for minute in ([420, 500] if rng.random() < 0.3 else [420]):  # missing first, then it arrives
                    fails = [check(rng.choice(SEVERITIES), i) for i in range(5) if rng.random() < 0.25]
                    events.append({"seq": seq, "day": d, "minute": minute, "turn": 0, "kind": "observe", "checks": fails,
                                   "run": rng.choice([None, f"run-{seq}"])})
                if rng.random() < 0.15:
                    events.append({"seq": seq, "day": d, "minute": 1000, "turn": 1, "kind": rng.choice(["escalate", "resolve"]), "checks": [], "run": None})
        tables[f"t{t:02d}"] = events
    return tables


@pytest.fixture(scope="module")
def frames(spark, random_events):
    obs = [(e["seq"], e["day"], e["minute"], t, e["run"], sorted(e["checks"])) for t, es in random_events.items() for e in es if e["kind"] == "observe"]
    acts = [(e["seq"], e["day"], e["minute"], t, e["kind"], "", "ana") for t, es in random_events.items() for e in es if e["kind"] != "observe"]
    return spark.createDataFrame(obs, inc.OBSERVATION_SCHEMA), spark.createDataFrame(acts, inc.ACTION_SCHEMA)


@pytest.fixture(scope="module")
def specs(spark, random_events):
    return specs_frame(spark, Catalog(tuple(TableSpec(t, (Field("id", "text"),), title=t, owner="team", owner_email="a@b.c", consumers=("x",))
                                            for t in sorted(random_events))))


@pytest.mark.parametrize("acted", [False, True])
def test_islands_equal_the_state_machine(frames, random_events, acted):
    obs, acts = frames
    got = {}
    for r in inc.incidents(obs, acts if acted else None).orderBy("incident_id").collect():
        got.setdefault(r.table, []).append(r)
    total = 0
    for t, events in random_events.items():
        expected = walk([e for e in events if acted or e["kind"] == "observe"])
        rows = sorted(got.get(t, []), key=lambda r: r.incident_id)
        assert len(rows) == len(expected), t
        for r, e in zip(rows, expected):
            total += 1
            resolved = (r.resolved_date, r.resolved_minute) if r.resolved_date else None
            assert (r.opened_date, r.opened_minute, r.title, SEVERITY_WEIGHT[r.severity], r.loads_failed, r.status, resolved, r.resolution) == \
                (*e["opened"], e["title"], e["weight"], e["loads"], e["status"], e["resolved"], e["how"])
            assert r.run_id == e["run"] and [c.check_id for c in r.checks] == e["evidence"]
    assert total > 60


def test_ids_follow_the_opening_order(frames, specs):
    rows = inc.incidents(frames[0], None, specs).orderBy("incident_id").collect()
    assert [r.incident_id for r in rows] == [f"INC-{i:04d}" for i in range(1, len(rows) + 1)]
    first = [(r.opened_date, r.opened_minute, r.table) for r in rows if r.opened_date < START + timedelta(days=3)][:20]
    assert first == sorted(first)


def test_closing_never_precedes_opening(frames, specs):
    found = inc.minutes_open(inc.incidents(*frames), F.lit(START + timedelta(days=30)), F.lit(0))
    assert found.where("minutes_open < 0").isEmpty()
    events = {}
    for r in inc.timeline(frames[0], specs, frames[1]).orderBy("incident_id", "position").collect():
        events.setdefault(r.incident_id, []).append(r)
    for story in events.values():
        assert story[0].kind == "detected"
        closing = [e for e in story if e.kind == "resolved"]
        assert len(closing) <= 1 and all((e.event_date, e.event_time) >= (story[0].event_date, story[0].event_time) for e in closing)


def observe(spark, *rows):
    return spark.createDataFrame([(0, START + timedelta(days=d), m, "t00", None, checks) for d, m, checks in rows], inc.OBSERVATION_SCHEMA)


def test_story_of_one_incident(spark, specs):
    obs = observe(spark, (0, 420, [check("high", 1, "few rows")]), (1, 420, [check("critical", 3, "copies"), check("high", 1)]), (2, 425, []))
    act = spark.createDataFrame([(0, START, 900, "t00", "escalate", "", "ana")], inc.ACTION_SCHEMA)
    story = [(r.kind, r.event_time) for r in inc.timeline(obs, specs, act).orderBy("position").collect()]
    assert story == [("detected", "07:00"), ("escalated", "15:00"), ("persists", "07:00"), ("escalated", "07:00"), ("resolved", "07:05")]
    (found,) = inc.incidents(obs, act).collect()
    assert (found.severity, found.title, found.loads_failed, found.status) == ("critical", "name 1", 2, "resolved")


def test_manual_resolution_splits_and_keeps_its_note(spark, specs):
    obs = observe(spark, (0, 420, [check("critical", 3)]), (1, 420, [check("critical", 3)]))
    act = spark.createDataFrame([(0, START, 900, "t00", "resolve", "Fixed at the source", "ana")], inc.ACTION_SCHEMA)
    rows = inc.incidents(obs, act).orderBy("incident_id").collect()
    assert [(r.status, r.resolution) for r in rows] == [("resolved", "manual"), ("open", None)]
    texts = [r.text for r in inc.timeline(obs, specs, act).orderBy("incident_id", "position").collect()]
    assert "Resolved (manual): Fixed at the source — ana" in texts and sum("Automatic notice" in t for t in texts) == 2


def test_list_and_retention(frames):
    found = inc.incidents(*frames).cache()
    rows = inc.incident_list(found, limit=None).collect()
    flags = [r.resolved_date is None for r in rows]
    assert flags == sorted(flags, reverse=True)
    opened = [(r.opened_date, r.opened_minute) for r in rows if r.resolved_date is None]
    assert opened == sorted(opened, reverse=True)
    assert inc.incident_list(found).count() == 40
    assert inc.incident_list(found, "escalated", None).where("status <> 'escalated'").isEmpty()
    kept = inc.keep_recent(found, F.lit(START + timedelta(days=130)), 120)
    assert kept.where(F.col("resolved_date") < F.lit(START + timedelta(days=10))).isEmpty() and kept.count() < found.count()


def test_recurrence_counts_failing_days_of_the_month_before(spark):
    found = spark.createDataFrame([("INC-0001", "t", START)], "incident_id string, table string, opened_date date")
    checks = spark.createDataFrame([(START - timedelta(days=d), "t", s) for d, s in ((0, "fail"), (1, "fail"), (1, "fail"), (30, "fail"), (31, "fail"), (5, "warn"))],
                                   "load_date date, table string, status string")
    assert inc.recurrence(found, checks).first().recurrence_30d == 2


def test_report_has_evidence_cause_examples_and_owner(spark, specs):
    low = (-3, 1, "volume", "Row volume", "high", 3, "volume_low", "rows: 9; usual: 20; change: -64%")
    obs = observe(spark, (0, 420, [check("critical", 3, "1 of 9 rows fail (11.11%)"), low, check("low", 9)]))
    found = inc.incidents(obs).withColumn("recurrence_30d", F.lit(2))
    examples = spark.createDataFrame([("t00", "c3", 1, "amount=-7,73")], "table string, check_id string, position int, shown string")
    (r,) = escalation_reports(found, specs, examples).collect()
    assert r.recipient == "a@b.c" and r.subject == f"[critical] t00: name 3 ({START})"
    assert r.cause == CAUSES["range"][0] and "amount=-7,73" in r.body and "It is the 3rd incident" in r.body and r.body.startswith("To: team")
    assert r.actions.split("\n") == [CAUSES["range"][1], CAUSES["volume_low"][1]]


def test_causes_tell_drops_from_copies_and_fall_back(spark):
    rows = [("volume_low", "c"), ("volume_high", "b"), ("unknown", "a")]
    got = [r.cause for r in with_causes(spark.createDataFrame(rows, "rule_type string, message string")).orderBy("message").collect()]
    assert got == [CAUSES["sql"][0], CAUSES["volume_high"][0], CAUSES["volume_low"][0]]


def test_incidents_kept_as_rows_leave_the_others_as_they_were(spark, specs):
    """Settled up to any day, numbers, incidents and stories are those of the whole log."""
    rng = random.Random(11)
    for _ in range(3):
        rows = []
        for d in range(40):
            for t in ("t00", "t01", "t02"):
                fails = [check(rng.choice(["low", "high", "critical"]), 1)] if rng.random() < 0.4 else []
                rows.append((d // 2, START + timedelta(days=d - (5 if rng.random() < 0.1 else 0)), 420 + rng.randrange(9), t, None, fails))
        obs = spark.createDataFrame(rows, inc.OBSERVATION_SCHEMA)
        acts = spark.createDataFrame([(r[0], r[1], 900, r[3], "resolve", "", "ana") for r in rows if rng.random() < 0.1], inc.ACTION_SCHEMA)
        whole = inc.incidents(obs, acts, specs)
        closed = inc.settled(obs, acts, F.lit(START + timedelta(days=20)))
        assert 0 < closed.count() < whole.count()
        left, left_acts = inc.after_closed(obs, closed), inc.after_closed(acts, closed, 1)
        needed = [r.seq for r in inc.still_needed(left, left_acts).collect()]
        few = left.where(F.col("seq").isin(needed) | (F.col("load_date") >= F.lit(START + timedelta(days=20))))
        got = inc.incidents(few, left_acts, specs, closed)
        assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
        story = inc.timeline(few, specs, left_acts, closed)
        assert story.exceptAll(inc.timeline(obs, specs, acts)).isEmpty() and few.count() < obs.count()
