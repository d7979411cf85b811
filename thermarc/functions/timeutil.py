"""Time zones: conversion once, daylight-saving anomalies."""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.errors import ConfigError


def get_zone(name: str) -> ZoneInfo:
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise ConfigError("unknown time zone", zone=name) from e


def ensure_utc(t: datetime) -> datetime:
    if t.tzinfo is None:
        raise ConfigError("a time without a zone", time=t.isoformat())
    return t.astimezone(UTC)


def localize_to_utc(t: datetime, zone: str, fold: int = 0) -> datetime:
    return t.replace(tzinfo=get_zone(zone), fold=fold).astimezone(UTC)


def to_utc(local: Column, zone: str) -> Column:
    """A naive local time in UTC; of an hour that occurs twice, the first."""
    get_zone(zone)
    return F.to_utc_timestamp(local, zone)


def is_nonexistent(local: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.to_utc_timestamp(local, zone), zone) != local


def is_ambiguous(local: Column, zone: str) -> Column:
    """Zones that shift by an hour: the same local time comes again an hour later."""
    return F.from_utc_timestamp(F.to_utc_timestamp(local, zone) + F.expr("interval 1 hour"), zone) == local


def dst_anomalies(df: DataFrame, ts: str, zone: str) -> DataFrame:
    kind = F.when(is_nonexistent(F.col(ts), zone), "nonexistent").when(is_ambiguous(F.col(ts), zone), "ambiguous")
    return df.withColumn("anomaly", kind).where("anomaly is not null")
