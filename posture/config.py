"""Settings of one assessment run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from posture import fixed_values as fixed


@dataclass(frozen=True)
class AssessmentConfig:
    """All knobs of a run.

    ``as_of`` (UTC) stands in for "now", so a run can be repeated later on the
    same tables. ``concurrent_passes`` is the number of sources measured at the same
    time.
    """

    as_of: datetime = field(default_factory=lambda: datetime.now(UTC))
    lookback_days: int = 90
    complete_at: float = 0.80
    production_patterns: tuple[str, ...] = fixed.PRODUCTION_CATALOGS
    excluded_schemas: tuple[str, ...] = fixed.EXCLUDED_SCHEMAS
    system_catalogs: tuple[str, ...] = fixed.SYSTEM_CATALOGS
    schema_services: tuple[str, ...] = fixed.SCHEMA_SERVICES
    sql_products: tuple[str, ...] = fixed.SQL_PRODUCTS
    exclude_principals: tuple[str, ...] = ()
    rank_before_live_filter: bool = False
    concurrent_passes: int = 8
    run_id: str | None = None

    def __post_init__(self):
        if not 0 < self.complete_at <= 1:
            raise ValueError(f"complete_at must be above 0 and at most 1: {self.complete_at}")
        if self.lookback_days < 1:
            raise ValueError(f"lookback_days must be at least 1: {self.lookback_days}")
        if self.as_of.tzinfo is None:
            object.__setattr__(self, "as_of", self.as_of.replace(tzinfo=UTC))
        if self.run_id is None:
            stamp = self.as_of.astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")
            object.__setattr__(self, "run_id", f"posture-{stamp}")

    def window_start(self, days: int | None = None) -> datetime:
        """First instant of the activity window of ``days`` (default: the lookback)."""
        return self.as_of - timedelta(days=self.lookback_days if days is None else days)
