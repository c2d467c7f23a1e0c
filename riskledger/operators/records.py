"""Inspection records: soft deletes, windows, violation typing, accident roll-ups and nested assembly."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Violation type codes; injury degree codes.
TYPES = {"S": "Serious", "W": "Willful", "R": "Repeat", "O": "Other"}
DEGREES = {"1": "Fatality", "2": "Hospitalized", "3": "Non-hospitalized"}
FATAL = ["1", "Y", "True"]


def live(violations: DataFrame) -> DataFrame:
    """Without soft-deleted rows."""
    return violations.filter(~F.col("delete_flag").eqNullSafe("X"))


def in_window(df: DataFrame, column: str, as_of: datetime.date, years: int) -> DataFrame:
    """Rows of the last years * 365 days; 0 keeps all; a missing date counts as as_of."""
    if not years:
        return df
    return df.filter(F.coalesce(F.col(column), F.lit(as_of)) >= F.date_sub(F.lit(as_of), 365 * years))


def penalty(current: Column, initial: Column) -> Column:
    """Current, else initial, else 0; a written zero stays."""
    return F.coalesce(current.cast("double"), initial.cast("double"), F.lit(0.0))


def typed(violations: DataFrame) -> DataFrame:
    """With severity, penalty and willful / repeat flags."""
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return violations.withColumns({"severity": F.coalesce(kinds[F.col("viol_type")], F.lit("Other")), "penalty": penalty(F.col("current_penalty"), F.col("initial_penalty")), "is_repeat": F.col("viol_type") == "R", "is_willful": F.col("viol_type") == "W"})


def hazards(*columns: Column) -> Column:
    """The non-blank ones joined by ', ', else null."""
    joined = F.array_join(F.filter(F.array(*columns), lambda x: F.trim(x) != ""), ", ")
    return F.when(joined != "", joined)


def is_general_duty(standard: Column) -> Column:
    """P5: after dropping everything but letters and digits."""
    return F.regexp_replace(F.upper(standard), "[^A-Z0-9]", "").rlike("^(5A1|OSHACT$|SECTION5$|GENERALDUTY)")


def is_high_priority(v: DataFrame) -> Column:
    """On typed violations."""
    return F.coalesce(F.col("is_willful") | F.col("is_repeat") | (F.col("gravity").cast("int") >= 8) | (F.col("penalty") > 5000), F.lit(False))


def accident_rollup(injuries: DataFrame, accidents: DataFrame) -> DataFrame:
    """Per inspection its distinct accidents, fatal ones, injuries, and injuries that
    killed or put someone in hospital. An accident is fatal by its own flag or by any injury's degree."""
    degree = F.regexp_replace("degree_of_inj", r"\.0$", "")
    linked = injuries.filter((F.coalesce("rel_insp_nr", F.lit("")) != "") & (F.coalesce("summary_nr", F.lit("")) != ""))
    pairs = linked.groupBy("rel_insp_nr", "summary_nr").agg(F.count(F.lit(1)).alias("injuries"), F.max(degree == "1").alias("worst"), F.count_if(degree.isin("1", "2")).alias("severe_injuries"))
    flags = accidents.select("summary_nr", F.col("fatality").isin(FATAL).alias("flag"))
    fatal = F.coalesce(F.col("flag"), F.lit(False)) | F.coalesce(F.col("worst"), F.lit(False))
    return pairs.join(flags, "summary_nr", "left").groupBy(F.col("rel_insp_nr").alias("activity_nr")).agg(
        F.count(F.lit(1)).alias("accidents"), F.count_if(fatal).alias("fatalities"), F.sum("injuries").alias("injuries"), F.sum("severe_injuries").alias("severe_injuries")
    )


def violation_rollup(violations: DataFrame) -> DataFrame:
    """Live violations summed to the inspection, so that joins never multiply rows."""
    v = live(violations).withColumn("penalty", penalty(F.col("current_penalty"), F.col("initial_penalty")))
    kind = lambda k: F.count_if(F.col("viol_type") == k)
    return v.groupBy("activity_nr").agg(
        F.count(F.lit(1)).alias("n_violations"), kind("S").alias("serious"), kind("W").alias("willful"), kind("R").alias("repeat"),
        F.sum("penalty").alias("penalty"), F.max("penalty").alias("max_penalty"), F.sum("gravity").alias("gravity_sum"), F.count("gravity").alias("gravity_n"),
    )


def nested(inspections: DataFrame, violations: DataFrame, injuries: DataFrame, accidents: DataFrame) -> DataFrame:
    """One row per inspection with its violations and accidents as arrays of structs."""
    v = typed(live(violations)).withColumn("high_priority", is_high_priority(violations))
    v = v.groupBy("activity_nr").agg(F.array_sort(F.collect_list(F.struct("citation_id", "standard", "severity", "penalty", "is_repeat", "is_willful", "gravity", "high_priority"))).alias("violations"))
    fatal = F.col("fatality").isin(FATAL)
    links = injuries.groupBy("rel_insp_nr", "summary_nr").agg(F.max(F.regexp_replace("degree_of_inj", r"\.0$", "") == "1").alias("worst"), F.count(F.lit(1)).alias("n_injuries"))
    a = links.join(accidents, "summary_nr", "left").select(F.col("rel_insp_nr").alias("activity_nr"), F.struct("summary_nr", "event_date", (F.coalesce(fatal, F.lit(False)) | F.col("worst")).alias("fatal"), "n_injuries").alias("a"))
    a = a.groupBy("activity_nr").agg(F.array_sort(F.collect_list("a")).alias("accidents"))
    rows = inspections.join(v, "activity_nr", "left").join(a, "activity_nr", "left")
    rows = rows.withColumns({"violations": F.coalesce("violations", F.array().cast(v.schema["violations"].dataType)), "accidents": F.coalesce("accidents", F.array().cast(a.schema["accidents"].dataType))})
    return rows.withColumns({"total_penalty": F.aggregate("violations", F.lit(0.0), lambda s, x: s + x["penalty"]), "severe": (F.size("accidents") > 0) | F.col("insp_type").eqNullSafe("L")})


def decode(codes: DataFrame, column: str, labels: DataFrame, out: str) -> DataFrame:
    """A coded column through a small (code, label) table; 'n' and 'n.0' are one
    code, blank is 'Not reported', others 'Unknown (code n)'."""
    plain = F.regexp_replace(F.trim(column), r"\.0$", "")
    labels = F.broadcast(labels.select(F.col("code").alias("__code"), F.col("label").alias("__label")))  # a fixed code list
    got = codes.withColumn("__plain", plain).join(labels, F.col("__plain") == F.col("__code"), "left")
    name = F.when(F.coalesce("__plain", F.lit("")) == "", "Not reported").otherwise(F.coalesce("__label", F.concat(F.lit("Unknown (code "), "__plain", F.lit(")"))))
    return got.withColumn(out, name).drop("__plain", "__code", "__label")


def facts_of_records(records: DataFrame) -> DataFrame:
    """A3: nested records (see nested) as one row per inspection, with the columns of features.inspection_facts."""
    v = lambda test: F.size(F.filter("violations", test)).cast("long")
    graded = F.filter(F.transform("violations", lambda x: x["gravity"]), lambda g: g.isNotNull())
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    worst = F.coalesce(F.array_max(F.transform("violations", lambda x: x["penalty"])), F.lit(0.0))
    return records.withColumns({
        "estab": F.upper(F.coalesce("estab_name", F.lit("UNKNOWN"))), "n_violations": F.size("violations").cast("long"), "serious": v(lambda x: x["severity"] == "Serious"), "willful": v(lambda x: x["is_willful"]),
        "repeat": v(lambda x: x["is_repeat"]), "penalty": F.col("total_penalty"), "max_penalty": worst, "gravity_sum": add(graded), "gravity_n": F.size(graded).cast("long"),
        "fatalities": F.size(F.filter("accidents", lambda a: a["fatal"])).cast("long"), "injuries": F.aggregate("accidents", F.lit(0).cast("long"), lambda s, a: s + a["n_injuries"]), "accidents": F.size("accidents").cast("long"),
    })


def stitched(lines: DataFrame, keys: list[str], number: str, text: str) -> DataFrame:
    """Texts of each key joined in the order of their line numbers (junk: 0), empty ones left out."""
    rows = lines.withColumn("__n", F.coalesce(F.col(number).try_cast("double").cast("int"), F.lit(0))).filter(F.trim(text) != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", text))), lambda x: F.trim(x[text])), " ")
    return rows.groupBy(*keys).agg(joined.alias("narrative"))


def with_narratives(violations: DataFrame, narratives: DataFrame) -> DataFrame:
    """Typed violations with the narrative (activity_nr, citation_id, narrative) of those on general duty that have priority."""
    wanted = is_general_duty(F.col("standard")) & is_high_priority(violations)
    told = violations.join(narratives, ["activity_nr", "citation_id"], "left")
    return told.withColumn("narrative", F.when(wanted, F.col("narrative")))
