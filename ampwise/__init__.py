"""Telemetry ageing analytics expressed as Spark DataFrame operators."""

from ampwise.schema import Params

__all__ = ["Params"]
