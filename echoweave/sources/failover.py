"""Keys of a remote service: which to use next, and what an answer means for it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Fixed value: a key whose daily quota is used up rests for six hours.
DAILY_REST = 6 * 3600.0


@dataclass
class Keys:
    """Sticky by (tier, priority): a key is used until it is limited, then the next of its tier; an overloaded service moves to the next tier."""

    keys: list[tuple[str, int, int]]  # id, tier, priority
    rest_until: dict[str, float] = field(default_factory=dict)
    floor: int = 0

    def current(self, now: float) -> str | None:
        able = [k for k in self.keys if k[1] >= self.floor and self.rest_until.get(k[0], 0.0) <= now]
        return min(able, key=lambda k: (k[1], k[2]))[0] if able else None

    def answer(self, key: str, status: int, body: str, now: float) -> str:
        """What to do: 'ok', 'retry' (with whatever current() gives now) or 'raise'."""
        if status < 300:
            return "ok"
        if status == 429:
            m = re.search(r'"retryDelay"\s*:\s*"(?:(\d+)h)?(?:(\d+)m)?(?:([\d.]+)s)?"', body)
            wait = sum(float(x or 0) * s for x, s in zip(m.groups(), (3600, 60, 1), strict=True)) if m else 60.0
            self.rest_until[key] = now + (DAILY_REST if "PerDay" in body else wait)
            return "retry"
        if status >= 500:
            self.floor = max(self.floor, next(k[1] for k in self.keys if k[0] == key) + 1)
            return "retry"
        return "raise"
