"""Whether the loaders have read what a manifest says was planted: one check for each of its items, on raw metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlap, relational
from ..schemas import require_none
from ..sources import querylog
from .audit import Estate
from .scoring import load_manifest


def _named(locator: str, part: str) -> str | None:
    found = [x.split("=", 1)[1] for x in locator.split("/") if x.startswith(f"{part}=")]
    return found[0] if found else None


def verify(spark: SparkSession, estate: Estate, manifest_path: str) -> DataFrame:
    """(id, type, passed) of every manifest item, and of the log's bounds.

    Raises where an item names nothing that was read: then there is nothing to verify.
    """
    items: dict[tuple[str, str, str], list[str]] = {}
    for r in load_manifest(spark, manifest_path).orderBy("place").collect():
        items.setdefault((r.id, r.type, r.expected), []).append(r.locator or "")
    found = _Found(estate)
    rows = [(i, kind, found.holds(kind, locators, expected == "defects")) for (i, kind, expected), locators in items.items()]
    if estate.log is not None:
        rows.append(("log", "query_log_bounds", found.log_in_bounds()))
    out = spark.createDataFrame(rows, "id string, type string, passed boolean")
    named = spark.createDataFrame([(i,) for i, _, _ in items], "id string")
    checked = out.filter("id <> 'log'").select("id")
    require_none(named.exceptAll(checked).union(checked.exceptAll(named)), "items and checks that don't correspond")
    return out


class _Found:
    """What the loaders have read, by name. Metadata: a row for each asset."""

    def __init__(self, estate: Estate):
        self.estate, self.as_of = estate, estate.as_of
        self.tiles = {r.tile_id: r for r in estate.tiles.collect()}
        self.models = {r.name: r for r in estate.models.collect()}
        self.read = {r[0] for r in estate.edges.select("source_id").distinct().collect()}
        signature = estate.tiles.select("dashboard_id", F.struct(F.col("title"), F.col("query_sql")).cast("string").alias("signature"))
        self.shared = {(r.left_id, r.right_id): r.ratio for r in overlap.set_overlap_pairs(signature, "dashboard_id", "signature", 0.01).collect()}
        self.missing = {(r.parent_id, r.column_name) for r in estate.lineage.unresolved.filter("reason_code = 'missing_upstream_column'").join(estate.lineage.columns.select(F.col("id").alias("target_id"), "parent_id"), "target_id").collect()}
        star = estate.lineage.columns.filter("asset_kind = 'model' and star_expanded")
        self.unread = {r.parent_id: r.unused for r in relational.unused_columns(star, estate.lineage.edges, "parent_id", "id", "name", "source_id", 1).collect()}

    def last(self, dashboard: str | None):
        """The dashboard's last time in the log, None if it has none."""
        if self.estate.log is None or dashboard is None:
            return None
        return querylog.log_totals(querylog.of_dashboard(self.estate.log, dashboard)).first().last_at

    def log_in_bounds(self) -> bool:
        """Whether the log has rows, none after the export, and none of dashboards that the export doesn't know."""
        totals = querylog.log_totals(self.estate.log).first()
        unknown = relational.unmatched(self.estate.log.select(F.col("dashboard_id").alias("id")), self.estate.dashboards, ["id"])
        return totals.log_rows > 0 and totals.last_at <= self.as_of and unknown.isEmpty()

    def holds(self, kind: str, locators: list[str], planted: bool) -> bool:
        check = getattr(self, f"_{kind}", None)
        return check is not None and check(locators, planted)

    def _orphaned_model(self, locators, planted) -> bool:
        name = _named(locators[0], "model")
        return name in self.models and (self.models[name].id not in self.read) == planted

    def _stale_asset(self, locators, planted) -> bool:
        at = self.last(_named(locators[0], "dashboard_id"))
        return at is not None and ((self.as_of - at).days >= 120) == planted

    def _duplicate_dashboard(self, locators, planted) -> bool:
        pair = tuple(sorted(_named(x, "dashboard") or "" for x in locators))
        return pair in self.shared and (self.shared[pair] >= 0.8) == planted

    def _broken_lineage(self, locators, planted) -> bool:
        """The model selects a column that the relation it reads doesn't declare."""
        model = self.models.get(_named(locators[0], "model"))
        if model is None:
            return False
        own = {c.lower() for parent, c in self.missing if parent == model.id}
        declared = set().union(*[self._columns_of(s) for s in model.source_ids])
        return bool(own - declared) == planted and not own & declared

    def _columns_of(self, source_id: str) -> set[str]:
        row = relational.exactly_one(self.estate.sources, F.col("id") == source_id)
        return {c.lower() for c in row["columns"]}

    def _unused_column_propagation(self, locators, planted) -> bool:
        """The model's star brings in ten columns or more that nothing reads."""
        model = self.models.get(_named(locators[0], "model"))
        return model is not None and (self.unread.get(model.id, 0) >= 10) == planted

    def _metric_definition_conflict(self, locators, planted) -> bool:
        models = [_named(x, "model") for x in locators]
        if all(models):
            return all(n in self.models for n in models) and (len({self.models[n].resolved_sql for n in models}) > 1) == planted
        own = [self.tiles.get(_named(x, "tile")) for x in locators]
        if None in own:
            return False
        same_label = len({t.metric_labels[0].lower() for t in own}) == 1
        same_sql = len({" ".join(t.query_sql.lower().split()) for t in own}) == 1
        return (same_label and not same_sql) == planted
