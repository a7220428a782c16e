"""Pattern list, series and samples for a filtered set of logs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalars import width_name
from timberline.operators.filters import Moment, filter_logs
from timberline.operators.patterns import (
    PatternModel,
    assign_patterns,
    list_patterns,
    mine_patterns,
    pattern_samples,
    pattern_series,
)
from timberline.operators.stats import labelled
from timberline.settings import MiningConfig


@dataclass(frozen=True)
class PatternReport:
    """A mined set of logs and the questions that follow from it.

    The same filter holds for the list, the series and the samples, and the pattern ids
    are the same in all three.
    """

    logs: DataFrame
    model: PatternModel
    patterns: DataFrame
    analysed: DataFrame

    @property
    def active_masks(self) -> tuple[str, ...]:
        return self.model.masks

    def assigned(self) -> DataFrame:
        return assign_patterns(self.logs, self.model)


def pattern_report(
    logs: DataFrame,
    start: Moment = "",
    end: Moment = "",
    service: str = "",
    severity: str = "",
    min_count: int = 2,
    limit: int = 50,
    masks: Iterable[str] | None = None,
    config: MiningConfig = MiningConfig(),
) -> PatternReport:
    """Mine the filtered logs and list their largest patterns.

    All matching logs are mined. ``analysed`` counts the records looked at, those with a
    body and not.
    """
    chosen = filter_logs(logs, start=start, end=end, service=service, severity=severity)
    model = mine_patterns(chosen, masks, config)
    bodies = model.patterns.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    analysed = chosen.agg(F.count(F.lit(1)).alias("logs_analysed")).withColumn(
        "bodies_analysed", bodies
    )
    return PatternReport(chosen, model, list_patterns(model, min_count, limit), analysed)


def pattern_timeseries(
    report: PatternReport, width: str = "1h", pattern_id: str | None = None
) -> DataFrame:
    """Labelled series, with the width that was used."""
    series = labelled(pattern_series(report.assigned(), width, pattern_id))
    return series.withColumn("bucket", F.lit(width_name(width)))


def pattern_sample_report(
    report: PatternReport, n: int = 10, pattern_id: str | None = None
) -> DataFrame:
    """Newest lines per pattern; the totals are those of the mined patterns."""
    return pattern_samples(report.assigned(), n, pattern_id, totals=report.model.patterns)
