"""Paged services: fetching every page of a day, with retries."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from email.utils import parsedate_to_datetime


class IncompletePages(RuntimeError):
    """The pages don't hold the records that the service announced."""


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Seconds to wait, from a number or an HTTP date; None if it is neither."""
    if value is None or not value.strip():
        return None
    text = value.strip()
    if text.isdigit():
        return float(text)
    try:
        at = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return max(0.0, (at - (now or datetime.now(UTC))).total_seconds())


@dataclass
class Response:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


@dataclass
class PagedClient:
    """``send(day, page, size)`` gives a Response or raises OSError. 429 and 5xx answers and failed sends are tried again:
    after what the service asks for, else after a time that doubles up to ``longest``, with jitter."""

    send: Callable[[date, int, int], Response]
    page_size: int = 200
    attempts: int = 5
    first_wait: float = 0.5
    longest: float = 30.0
    sleep: Callable[[float], None] = time.sleep
    jitter: random.Random = field(default_factory=lambda: random.Random(0))
    retries: int = 0

    def wait(self, attempt: int) -> float:
        return min(self.longest, self.first_wait * 2**attempt) * (0.5 + self.jitter.random() / 2)

    def page(self, day: date, number: int) -> bytes:
        why = ""
        for attempt in range(self.attempts):
            asked = None
            try:
                got = self.send(day, number, self.page_size)
                if got.status == 200:
                    return got.body
                if got.status != 429 and got.status < 500:
                    raise ValueError(f"page {number} of {day}: status {got.status}")
                why, asked = f"status {got.status}", retry_after({k.lower(): v for k, v in got.headers.items()}.get("retry-after"))
            except OSError as e:
                why = str(e)
            if attempt + 1 < self.attempts:
                self.retries += 1
                self.sleep(self.wait(attempt) if asked is None else asked)
        raise ConnectionError(f"page {number} of {day} failed {self.attempts} times: {why}")

    def day(self, day: date) -> list[tuple[int, bytes]]:
        """All pages; the records of all must be as many as the service says."""
        out, number, pages, total, seen = [], 1, 1, 0, 0
        while number <= pages:
            body = self.page(day, number)
            head = json.loads(body)
            pages, total = int(head["total_pages"]), int(head["total_records"])
            seen += len(head["data"])
            out.append((number, body))
            number += 1
        if seen != total:
            raise IncompletePages(f"{day}: {seen} records on {len(out)} pages, {total} announced")
        return out
