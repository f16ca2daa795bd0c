"""Shared domain frames built from the driver tables (lazy DataFrames)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nutriyield.operators import composition as C
from nutriyield.operators import supply as S
from nutriyield.operators import trips as TR
from nutriyield.sources import driver as D
from nutriyield.sources import literals as L
from nutriyield.session import cut_lineage


class Inputs:
    """Domain inputs of one scale-factor folder; each property is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str, ship_from: str | None = None, ship_to: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = D.Tables(spark, sf_dir)
        self.ship_from, self.ship_to = ship_from, ship_to

    def window(self, ship_from: str | None, ship_to: str | None) -> "Inputs":
        """Same inputs with the regional estimates limited to a ship-date window
        (pushed to the lineitem scan).  Only for queries whose result depends on
        that window alone."""
        w = Inputs(self.spark, self.sf_dir, ship_from, ship_to)
        # same tables and the same (materialised) nutrient dimension
        w.t, w.__dict__["nutrients"] = self.t, self.nutrients
        return w

    @cached_property
    def rdi(self) -> DataFrame:
        return L.rdi_df(self.spark)

    @cached_property
    def catch_groups(self) -> DataFrame:
        return L.catch_groups_df(self.spark)

    @cached_property
    def fao(self) -> DataFrame:
        return C.fao_composition(D.fao_raw(self.t))

    @cached_property
    def nutrients(self) -> DataFrame:
        """Nutrient table keyed by ``grouped_taxa``.

        A small per-taxon dimension derived from the part and supplier scans and
        referenced several times by most plans: it is computed once and written
        to the shared checkpoint folder (reliable, survives executor loss), so
        later references scan that file instead of repeating its shuffles."""
        return cut_lineage(C.nutrients_table(D.predictions(self.t), D.species(self.t), self.fao)
                           .withColumnRenamed("interagency_code", "grouped_taxa"))

    @cached_property
    def region_stats(self) -> DataFrame:
        return S.region_yields(D.region_parts(self.t, self.ship_from, self.ship_to), self.nutrients)

    @cached_property
    def region_stats_adj(self) -> DataFrame:
        adj_inputs = self if self.ship_to else self.window(self.ship_from, D.ADJUST_BEFORE)
        return S.edible_adjusted(adj_inputs.region_stats, D.edible_portions(self.t), D.ADJUST_BEFORE)

    @cached_property
    def population(self) -> DataFrame:
        return S.wra_population(D.census(self.t))

    @cached_property
    def trips(self) -> DataFrame:
        # the region fill needs trip heads only; the nested catch joins afterwards
        return D.attach_catch(TR.fill_region_by_tracker(D.trip_heads(self.t)), D.trip_catch(self.t))

    @cached_property
    def windowed_trips(self) -> DataFrame:
        """Trips of the study window with their nested catch: the one place that nests lineitem."""
        # region fill over all trips (the mode needs every trip of a tracker),
        # then the head-only filters, then nest only the kept orders' lines
        return D.attach_catch(self._window_heads, D.trip_catch(self.t, self._window_heads))

    @cached_property
    def _window_heads(self) -> DataFrame:
        return TR.trip_window(TR.fill_region_by_tracker(D.trip_heads(self.t)), D.TRIP_START, D.TRIP_END, D.REGIONS)

    def kobo_trips_of(self, wanted: Column) -> DataFrame:
        """``kobo_trips`` of the landings with a trip head for which ``wanted`` holds.

        All heads of such a landing stay, as a landing's attributes are chosen among
        them; the lines of the others are never nested.  The heads are written once:
        both nesting and the attributes read them."""
        heads = self._window_heads
        some = heads.where(wanted).select("landing_id").distinct()
        heads = cut_lineage(heads.join(some, "landing_id", "left_semi"))
        trips = D.attach_catch(heads, D.trip_catch(self.t, heads))
        return TR.trip_yields(trips, D.TRIP_START, D.TRIP_END, D.REGIONS)

    @cached_property
    def kobo_trips(self) -> DataFrame:
        return TR.trip_yields(self.windowed_trips, D.TRIP_START, D.TRIP_END, D.REGIONS)

    @cached_property
    def catch_data(self) -> DataFrame:
        """Revenue records of the trips kept in ``kobo_trips``: those with a catch row.

        One trip is one row of ``windowed_trips``, so the test stays inside the row."""
        return D.revenue_records(self.windowed_trips.where(F.size(TR.catch_rows(F.col("landing_catch"))) > 0))

    def total_label(self, df: DataFrame, col: str, label: str) -> DataFrame:
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(label)))
