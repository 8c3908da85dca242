"""The message sent to the owner of a table: a fixed template filled with the evidence of the incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwatch.functions.scalars import hhmm
from loadwatch.model import small_frame

# What most often lies behind each kind of failing check, and what the owner is asked to do first.
CAUSES = {
    "availability": ("No delivery was seen by the hour agreed; the job upstream may be late, stopped or failing.",
                     "Tell us when the delivery will come, and restart the job if it stopped."),
    "volume_low": ("Far fewer rows than usual: part of the data was probably left out on the way.",
                   "Compare the row count with the system of origin and send the missing part."),
    "volume_high": ("Far more rows than usual: the same data may have been sent twice, or several days together.",
                    "Look for a repeated run or a wider date filter, and send the day once."),
    "structure": ("The columns delivered are not those of the contract.",
                  "Restore the missing columns, or agree on the new layout with us."),
    "unique": ("Records that should exist once exist several times, as after a second run without a clean start.",
               "Take the extra copies out and check what happens when the job is run twice."),
    "same_day": ("The rows carry another date than the delivery; an old extract may have been sent.",
                 "Send the extract of the day named above."),
    "not_null": ("Mandatory cells are empty; the field may have been renamed or dropped in an earlier step.",
                 "Find the step that loses the value and deliver the rows again."),
    "range": ("Numbers lie outside what is possible for this field; a unit or a sign may have changed.",
              "Check units and formulas of the field and correct the rows listed."),
    "compare": ("Two fields of the same row do not agree with each other.",
                "Check which of the two fields is wrong in the rows listed."),
    "allowed_values": ("The field holds codes that nobody has told us about.",
                       "Say whether the new codes are meant; then we add them to the list, otherwise correct them."),
    "outlier": ("The daily figure moved much further than its own past suggests.",
                "Say whether something real explains it; if not, check units and filters."),
    "sql": ("Rows match a condition that must never hold for this table.",
            "Go through the rows listed and correct them, or tell us if the condition is out of date."),
}


def with_causes(checks: DataFrame) -> DataFrame:
    """Checks (rule_type) with their cause and action; an unknown kind takes those of a custom rule."""
    rows = [(k, *v) for k, v in CAUSES.items()]
    catalogue = small_frame(checks.sparkSession, rows, "cause_key string, cause string, action string")
    cause, action = CAUSES["sql"]
    return checks.withColumn("cause_key", F.col("rule_type")) \
        .join(catalogue, "cause_key", "left") \
        .withColumns({"cause": F.coalesce("cause", F.lit(cause)), "action": F.coalesce("action", F.lit(action))})


def _ordinal(n: Column) -> Column:
    text = n.cast("string")
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(text, end)


def escalation_reports(found: DataFrame, specs: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Recipient, subject, body, cause and actions of every incident.

    `found` has the incident columns plus recurrence_30d. `examples` has table, check_id, position and shown.
    """
    each = with_causes(found.select("incident_id", F.posexplode("checks").alias("rank", "check"))
                       .select("incident_id", "rank", "check.check_id", "check.name", "check.message", "check.rule_type"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "check_id", "name", "message", "cause", "action")))
    evidence = each.groupBy("incident_id").agg(listed.alias("list"))
    r = found.join(evidence, "incident_id", "left") \
        .join(specs.select("table", F.col("title").alias("table_title"), "owner", "owner_email", "consumers"), "table")
    r = r.withColumn("main", F.get("list", 0))
    if examples is None:
        r = r.withColumn("samples", F.lit(None).cast("array<string>"))
    else:
        few = examples.where(F.col("position") <= 3).groupBy("table", F.col("check_id").alias("main_id")) \
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "shown"))), lambda e: e["shown"]).alias("samples"))
        r = r.withColumn("main_id", F.col("main.check_id")).join(few, ["table", "main_id"], "left")
    cause = F.coalesce("main.cause", F.lit("No failing checks."))
    action = F.coalesce("main.action", F.lit("Validate by hand."))
    # The action of the main check, then those of the others that differ from it.
    others = F.filter(F.transform(F.slice("list", 2, F.greatest(F.size("list"), F.lit(1))), lambda c: c["action"]), lambda a: a != F.col("main.action"))
    actions = F.concat(F.array(action), F.coalesce(others, F.array().cast("array<string>")))
    findings = F.concat_ws("\n", F.transform("list", lambda c: F.concat(F.lit("* "), c["name"], F.lit(" -> "), c["message"])))
    sampled = F.when(F.size("samples") > 0, F.concat(
        F.lit("\n\nSome of the rows in question\n"), F.concat_ws("\n", F.transform("samples", lambda e: F.concat(F.lit("* "), e))))).otherwise(F.lit(""))
    again = F.when(F.col("recurrence_30d") > 0, F.concat(
        F.lit("\nIt is the "), _ordinal(F.col("recurrence_30d") + 1), F.lit(" incident of this table within 30 days."))).otherwise(F.lit(""))
    opened = F.col("opened_date").cast("string")
    body = F.concat(
        F.lit("To: "), "owner", F.lit("\nTable: "), "table", F.lit(" - "), "table_title", F.lit("\nLoad: "), opened, F.lit(", seen at "),
        hhmm(F.col("opened_minute")), F.lit("\nSeverity: "), "severity", F.lit("\nWho depends on it: "), F.concat_ws(", ", "consumers"), again,
        F.lit("\n\nPlease do this\n"), action, F.lit("\n\nWhy we write\n"), findings, F.lit("\n\nWhat may be behind it\n"), cause, sampled,
        F.lit("\n\nNothing has to be reported back: a later load without failing checks ends the incident."))
    subject = F.concat(F.lit("["), "severity", F.lit("] "), "table", F.lit(": "), "title", F.lit(" ("), opened, F.lit(")"))
    return r.select("incident_id", "table", F.col("owner_email").alias("recipient"), subject.alias("subject"),
                    body.alias("body"), cause.alias("cause"), F.concat_ws("\n", actions).alias("actions"))
