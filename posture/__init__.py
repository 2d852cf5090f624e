"""Posture assessment of a data platform as Spark jobs over its telemetry tables."""

from posture.config import AssessmentConfig

__all__ = ["AssessmentConfig"]
