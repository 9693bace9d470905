"""When a recurring sync is due."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800}


@dataclass(frozen=True)
class At:
    """Times of day: hours and minutes as lists ("0,30"), "*" for all; weekdays from 0 (Monday)."""

    hour: str = "*"
    minute: str = "0"
    weekday: str = "*"

    @staticmethod
    def _parse(text: str, size: int) -> list[int]:
        if text.strip() in ("", "*"):
            return list(range(size))
        out = sorted({int(x) for x in text.split(",")})
        if not out or out[0] < 0 or out[-1] >= size:
            raise ValueError(f"out of range: {text!r}")
        return out

    def following(self, now: datetime) -> datetime:
        hours, minutes, days = self._parse(self.hour, 24), self._parse(self.minute, 60), self._parse(self.weekday, 7)
        day = now.replace(hour=0, minute=0, second=0, microsecond=0)
        for k in range(9):
            date = day + timedelta(days=k)
            if date.weekday() not in days:
                continue
            for h in hours:
                for m in minutes:
                    t = date.replace(hour=h, minute=m)
                    if t > now:
                        return t
        raise ValueError("never due")


@dataclass(frozen=True)
class Frequency:
    value: float
    unit: str = "minute"

    @property
    def seconds(self) -> float:
        return self.value * UNITS[self.unit.rstrip("s").lower()]


@dataclass
class Schedule:
    frequency: Frequency | None = None
    at: At | None = None
    next_run: datetime | None = field(default=None)

    def validate(self) -> None:
        if not self.frequency and not self.at:
            raise ValueError("a schedule needs a frequency or times")
        if self.frequency and self.frequency.unit.rstrip("s").lower() not in UNITS:
            raise ValueError(f"unknown unit {self.frequency.unit!r}")
        if self.at:
            self.at.following(datetime(2000, 1, 1))

    def following(self, now: datetime) -> datetime:
        return now + timedelta(seconds=self.frequency.seconds) if self.frequency else self.at.following(now)

    def is_due(self, now: datetime) -> bool:
        return self.next_run is None or now >= self.next_run


def schedule_id(path: str) -> str:
    """An id from the last four parts of a path, without its extension."""
    parts = [p for p in path.rsplit(".", 1)[0].replace("://", "/").split("/") if p]
    return ":".join(parts[-4:])


def after_error(now: datetime, errors: int) -> datetime | None:
    """When to try again after the n-th recent error; none after four."""
    return now + timedelta(minutes=errors % 5) if errors < 4 else None
