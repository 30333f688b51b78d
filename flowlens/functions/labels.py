"""Label algebra: `[20YY|]BASE[|SUBTYPE]` as column expressions, so filters on labels reach the scan.

Several reports of the domain use their own idea of what is benign; each has a function of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_YEAR = r"^(20\d{2})\|(?s)(.*)$"


def label_year(label: Column) -> Column:
    """The year tag as text, or null."""
    found = F.regexp_extract(F.trim(label), _YEAR, 1)
    return F.when(found != "", found)


def label_rest(label: Column) -> Column:
    """The label without its year tag, trimmed."""
    text = F.trim(label)
    return F.trim(F.when(text.rlike(_YEAR), F.regexp_extract(text, _YEAR, 2)).otherwise(text))


def base_label(label: Column) -> Column:
    """Upper case without year; benign subtypes are just BENIGN."""
    rest = F.upper(label_rest(label))
    return F.when((rest == "BENIGN") | F.startswith(rest, F.lit("BENIGN|")), "BENIGN").otherwise(rest)


def normal_label(label: Column) -> Column:
    """Upper case; the year tag and a benign subtype stay, an empty subtype goes."""
    rest, year = F.upper(label_rest(label)), label_year(label)
    subtype = F.trim(F.substring(rest, 8, 1_000_000))
    benign = F.when(F.startswith(rest, F.lit("BENIGN|")), F.when(subtype == "", "BENIGN").otherwise(F.concat(F.lit("BENIGN|"), subtype)))
    text = F.coalesce(benign, rest)
    return F.when(year.isNotNull(), F.concat(year, F.lit("|"), text)).otherwise(text)


def is_benign(label: Column) -> Column:
    return base_label(label) == "BENIGN"


def is_benign_second_token(label: Column) -> Column:
    """Benign only if the second |-token is BENIGN; an untagged BENIGN is not."""
    return F.upper(F.trim(F.split_part(label, F.lit("|"), F.lit(2)))) == "BENIGN"


def is_benign_exact(label: Column) -> Column:
    return F.upper(F.trim(label)) == "BENIGN"


def is_benign_lower(label: Column) -> Column:
    return F.lower(label) == "benign"


def is_benign_suffix(label: Column) -> Column:
    return F.endswith(label, F.lit("|BENIGN"))


def with_year_tag(label: Column, year: Column) -> Column:
    """Puts the year in front of labels that have none; an unknown year ('0000' or null) changes nothing."""
    tagged = F.trim(label).rlike(r"^20\d{2}\|")
    return F.when(~tagged & year.isNotNull() & (year != "0000"), F.concat_ws("|", year, F.trim(label))).otherwise(F.trim(label))


def year_of_path(path: Column) -> Column:
    """From a file name's `2017_` or `2019_`, else a path component, else '0000'."""
    name = F.substring_index(path, "/", -1)
    by_name = F.regexp_extract(name, r"^(2017|2019)_", 1)
    by_folder = F.regexp_extract(path, r"(?:^|/)(2017|2019)(?:/|$)", 1)
    return F.when(by_name != "", by_name).when(by_folder != "", by_folder).otherwise("0000")
