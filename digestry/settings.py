"""Parameters of one run. The current time is a parameter, never read from the clock."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from digestry import rules


@dataclass(frozen=True)
class Settings:
    as_of: datetime = datetime(2024, 1, 31, tzinfo=timezone.utc)

    # Selection.
    threshold: int = 40
    fallback_threshold: int = 20
    per_domain: int = 3
    per_channel: int = 2
    total: int = 8

    # Rules. They are configuration: written by people, sent with the plan.
    domains: tuple[str, ...] = rules.DOMAINS
    domain_keywords: tuple[tuple[str, tuple[str, ...]], ...] = rules.DOMAIN_KEYWORDS
    search_keywords: tuple[tuple[str, tuple[str, ...]], ...] = rules.SEARCH_KEYWORDS
    channels: tuple[tuple[str, str], ...] = rules.CHANNELS
    feeds: tuple[dict, ...] = field(default=rules.FEEDS, hash=False)
    whitelist: tuple[str, ...] = rules.WHITELIST
    spam_keywords: tuple[str, ...] = rules.SPAM_KEYWORDS

    # Base address of the reaction links.
    feedback_base: str = "http://localhost:9002"

    # Physical limits; results do not depend on them.
    fold_rows: int = 256          # most titles one task compares for one briefing in one array
    head_rows: int = 64           # best rows of a briefing tried before the complete path
    rank_group_rows: int = 1_000_000   # most rows one task sorts for one briefing
    pairs_per_task: int = 200_000      # most title pairs one task resolves for one briefing
    pair_budget: int = 5_000_000       # candidate title pairs of a briefing looked at without further question
    pairs_per_title: int = 500         # beyond that, most candidate pairs per title of a briefing

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    @property
    def all_keywords(self) -> tuple[str, ...]:
        """Keywords of all domains; one listed under two domains counts twice."""
        return tuple(k for _, words in self.domain_keywords for k in words)
