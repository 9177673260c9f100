"""Small fixed dimensions: states with their zones, months, noise words."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: State names in the order in which a location is searched for them.
STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh",
    "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha",
    "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Delhi",
    "Andaman and Nicobar", "Chandigarh", "Dadra", "Daman", "Jammu and Kashmir", "Ladakh", "Lakshadweep", "Puducherry",
]
#: The longer names of a second list, in its order.
LONG_STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand",
    "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim",
    "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Andaman and Nicobar Islands", "Chandigarh",
    "Dadra and Nagar Haveli", "Daman and Diu", "Delhi", "Jammu and Kashmir", "Ladakh", "Lakshadweep", "Puducherry",
]
#: Zones by index, and the states of each.
ZONES = ["Western Ghats", "Deccan Plateau", "Northeast India", "Indo-Gangetic Plain", "Western Himalaya", "Semi-Arid", "Coasts", "Andaman & Nicobar", "Unknown"]
ZONE_STATES = [
    ["Kerala", "Goa"],
    ["Maharashtra", "Dadra", "Karnataka", "Telangana", "Andhra Pradesh", "Tamil Nadu", "Chhattisgarh", "Bihar", "Madhya Pradesh", "Odisha", "Jharkhand"],
    ["Arunachal Pradesh", "Assam", "Meghalaya", "Nagaland", "Manipur", "Mizoram", "Tripura", "Sikkim"],
    ["Uttar Pradesh", "Delhi", "Haryana", "Punjab", "Chandigarh", "West Bengal"],
    ["Uttarakhand", "Himachal Pradesh", "Jammu and Kashmir", "Ladakh"],
    ["Rajasthan", "Gujarat"],
    ["Puducherry", "Daman"],
    ["Andaman and Nicobar"],
]
#: Other spellings of these states.
STATE_ALIASES = {"Dadar": "Dadra", "Dadra and Nagar Haveli": "Dadra", "Daman and Diu": "Daman", "Andaman and Nicobar Islands": "Andaman and Nicobar"}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Words that text recognition makes of image noise (before and after refinement).
NOISE_WORDS = [
    "mmm", "mma", "emma", "amas", "commas", "maa", "eee", "rre", "rrr", "ttt", "sss", "ccc", "vvv", "bbb", "nnn", "aaa", "uuu", "iii",
    "peeee", "perre", "teper", "mcedaet", "met", "tea", "ieee", "peere", "peer",
]
REFINED_NOISE = ["ee", "eee", "bo", "me", "cm", "gemma", "mma", "cma", "ey", "se", "mer", "conga", "pees", "aman", "te", "iam", "nae", "mgs", "gal", "en"]


def state_zones(spark: SparkSession) -> DataFrame:
    """(state, zone, zone_idx), other spellings included."""
    rows = [(s, z, i) for i, z in enumerate(ZONES[:-1]) for s in ZONE_STATES[i]]
    index = {s: (z, i) for s, z, i in rows}
    return spark.createDataFrame(rows + [(a, *index[s]) for a, s in STATE_ALIASES.items()], "state string, zone string, zone_idx int")


def month_name(number: Column) -> Column:
    """English name of a month number; null outside 1 to 12."""
    return F.create_map(*chain(*((F.lit(i), F.lit(m)) for i, m in enumerate(MONTHS, 1))))[number.cast("int")]
