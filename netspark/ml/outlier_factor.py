"""Local outlier factor (Breunig et al. 2000) on a metric index."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators.metric_index import MetricIndex, nearest_links, nearest_lists
from netspark.session import cut_lineage

NEIGHBOURS = 20
AUTO_OFFSET = -1.5
_TINY = 1e-10


def _density(links: DataFrame, radius: DataFrame) -> DataFrame:
    """(id, lrd): inverse mean reachability distance."""
    known = radius.select(F.col("id").alias("right_id"), "k_distance")
    reach = F.greatest(F.col("distance"), F.col("k_distance"))
    return (
        links.join(known, "right_id")
        .groupBy("id")
        .agg((F.lit(1.0) / (F.avg(reach) + F.lit(_TINY))).alias("lrd"))
    )


def _factors(links: DataFrame, own: DataFrame, known: DataFrame) -> DataFrame:
    """(id, raw): minus the mean density of the neighbours over the own density."""
    near = links.join(
        known.select(F.col("id").alias("right_id"), F.col("lrd").alias("near")), "right_id"
    )
    return (
        near.groupBy("id")
        .agg(F.avg("near").alias("near"))
        .join(own, "id")
        .select("id", (-F.col("near") / F.col("lrd")).alias("raw"))
    )


@dataclass(frozen=True)
class OutlierFactor:
    """Training rows with their k-distance and density, as tables."""

    index: MetricIndex
    known: DataFrame
    k: int
    offset: float = AUTO_OFFSET
    #: Neighbours of the training vectors, so that scoring searches for other vectors only.
    lists: DataFrame | None = None

    @staticmethod
    def fit(train: DataFrame, *, k: int = NEIGHBOURS, **options) -> OutlierFactor:
        """``train`` has ``id`` and ``vector``; pass a table or a checkpoint, it is read often."""
        train = train.select("id", "vector")
        index = MetricIndex.build(train, neighbours=k + 1)
        lists = cut_lineage(nearest_lists(train, index, **options))
        links = cut_lineage(nearest_links(train, index, k=k, skip_self=True, lists=lists, **options))
        radius = links.groupBy("id").agg(F.max("distance").alias("k_distance"))
        known = cut_lineage(radius.join(_density(links, radius), "id"))
        training = _factors(links, known.select("id", "lrd"), known)
        return OutlierFactor(index, cut_lineage(known.join(training, "id")), k, lists=lists)

    def raw_scores(self, rows: DataFrame, **options) -> DataFrame:
        """(id, raw) of rows that were not trained on; an equal training row counts."""
        links = cut_lineage(nearest_links(rows, self.index, k=self.k, lists=self.lists, **options))
        own = _density(links, self.known)
        return _factors(links, own, self.known)

    def scores(self, rows: DataFrame, **options) -> DataFrame:
        return self.raw_scores(rows, **options).select(
            "id", (F.col("raw") - F.lit(self.offset)).alias("score")
        )

    def with_offset(self, offset: float) -> OutlierFactor:
        return replace(self, offset=offset)
