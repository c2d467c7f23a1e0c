"""What codes, sectors and features are called."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of two-digit sectors.
SECTOR_NAMES = {
    "11": "Agriculture", "21": "Mining", "22": "Utilities", "23": "Construction", "31": "Manufacturing", "32": "Manufacturing", "33": "Manufacturing", "42": "Wholesale Trade", "44": "Retail Trade", "45": "Retail Trade",
    "48": "Transportation", "49": "Transportation", "51": "Information", "52": "Finance", "53": "Real Estate", "54": "Professional Services", "55": "Management", "56": "Admin Services",
    "61": "Education", "62": "Health Care", "71": "Arts & Entertainment", "72": "Food Services", "81": "Other Services", "92": "Public Administration",
}

#: Codes of an injury's degree, nature, event and part of body, each numbered from 1.
DEGREES = ["Fatality", "Hospitalized", "Non-hospitalized"]
NATURES = "Amputation,Asphyxia,Bruise/Contusion,Burn (Chemical),Burn/Scald (Heat),Concussion,Cut/Laceration,Dermatitis,Dislocation,Electric Shock,Foreign Body in Eye,Fracture,Freezing/Frostbite,Hearing Loss,Heat Exhaustion,Hernia,Poisoning,Puncture,Radiation Effects,Strain/Sprain,Other,Cancer".split(",")
EVENTS = [
    "Fall from elevation", "Fall on same level", "Struck by flying/falling object", "Caught in/between", "Struck by object", "Repetitive motion", "Electrical shock", "Explosion/fire", "Temperature extremes",
    "Chemical/harmful substance contact", "Transportation accident", "Other", "Contact with hazardous substance",
]
BODY_PARTS = [
    "Abdomen", "Arm (multiple)", "Back", "Body System", "Chest", "Ear(s)", "Elbow(s)", "Eye(s)", "Face", "Finger(s)", "Foot/Ankle", "Hand(s)", "Head", "Hip(s)", "Knee(s)", "Legs", "Lower Arm", "Lower Leg",
    "Multiple", "Neck", "Shoulder", "Upper Arm", "Upper Leg", "Wrist(s)",
]
#: How drivers are called in texts; other names lose their underscores.
DRIVER_LABELS = {
    "n_inspections": "inspection frequency", "n_violations": "violation volume", "serious_rate": "serious violations", "willful_rate": "willful violations", "repeat_rate": "repeat violations", "total_penalty": "total penalties",
    "avg_penalty": "average penalty per violation", "max_penalty": "largest single penalty", "recent_ratio": "recent activity concentration", "severe_rate": "severe workplace incidents", "violations_per_inspection": "violations per inspection", "accident_rate": "linked accidents",
    "fatality_rate": "fatalities", "injury_rate": "reported injuries", "avg_gravity": "average violation gravity", "penalty_per_inspection": "penalties per inspection", "clean_ratio": "clean inspection ratio",
    "relative_violation_rate": "violation rate relative to industry peers", "relative_penalty": "penalty level relative to industry peers", "relative_serious_ratio": "serious violation ratio relative to peers", "relative_willful_repeat": "willful and repeat rate relative to peers",
}


def labelled(names: Mapping[str, str], code: Column, other: Column) -> Column:
    """The name of a code, or other."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[code], other)


def sector_label(code: Column) -> Column:
    """By the first two digits of an industry code."""
    return labelled(SECTOR_NAMES, F.substring(code, 1, 2), F.lit("Unknown"))


def driver_label(feature: Column) -> Column:
    """H17."""
    return labelled(DRIVER_LABELS, feature, F.regexp_replace(feature, "_", " "))
