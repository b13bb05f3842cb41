"""Text functions as column expressions: canonical SQL, labels, signatures, locators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REF = r"\{\{\s*ref\(\s*(['\"])([A-Za-z0-9_.-]+)\1\s*\)\s*\}\}"
SOURCE = r"\{\{\s*source\(\s*(['\"])([A-Za-z0-9_.-]+)\1\s*,\s*(['\"])([A-Za-z0-9_.-]+)\3\s*\)\s*\}\}"
TEMPLATE = r"\{[\{%#]"


def canonical_text(text: Column) -> Column:
    """Lower case, every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def label_name(label: Column) -> Column:
    """Lower-case letters and digits, everything else one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def relation_name(*parts: Column) -> Column:
    """Parts joined by dots; empty and null ones are left out."""
    return F.concat_ws(".", *[F.when(p != "", p) for p in parts])


def day_windows(sql: Column) -> Column:
    """The distinct numbers N of `interval 'N days'`, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(r"interval '(\d+) days'"), F.lit(1)))


def has_template(sql: Column) -> Column:
    return sql.rlike(TEMPLATE)


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def after_first_dot(text: Column) -> Column:
    return F.regexp_replace(text, r"^[^.]*\.", "")


def percent(ratio: Column) -> Column:
    return F.format_string("%.0f%%", ratio * 100)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def location_matches(locator: Column, path: Column, locators: Column, assets: Column, uris: Column) -> Column:
    """Whether a manifest location is met by a finding, by one of four rules.

    The locator and an evidence locator contain one another; its first segment, as an asset
    id or as written, occurs among the asset ids; a model file's path ends an evidence URI.
    An empty locator meets every finding that has evidence.
    """
    own, texts = location_needles(locator, path), location_hays(locators, assets, uris)
    met = any_of(
        F.exists(texts["locator"], lambda x: F.contains(x, own["locator"]) | F.contains(own["locator"], x)),
        F.exists(texts["asset"], lambda x: F.contains(x, own["asset"])),
        F.exists(texts["written"], lambda x: F.contains(x, own["written"])),
        F.exists(texts["uri"], lambda x: F.endswith(x, own["uri"])),
    )
    return F.coalesce(met, F.lit(False))


def location_needles(locator: Column, path: Column) -> dict[str, Column]:
    """What has to occur in a text of location_hays, by rule; null where a rule doesn't hold for the location."""
    locator = F.lower(locator)
    segment = F.substring_index(locator, "/", 1)
    as_asset = F.replace(F.replace(segment, F.lit("dashboard="), F.lit("dashboard.")), F.lit("model="), F.lit("model."))
    return {"locator": locator, "asset": as_asset, "written": segment, "uri": F.when(F.endswith(path, F.lit(".sql")), path)}


def location_hays(locators: Column, assets: Column, uris: Column) -> dict[str, Column]:
    """A finding's texts, by rule."""
    joined = F.lower(F.concat_ws(" ", assets))
    return {"locator": F.transform(locators, F.lower), "asset": F.array(joined), "written": F.array(F.replace(joined, F.lit("."), F.lit("="))), "uri": uris}
