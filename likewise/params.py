"""Engine parameters: what to learn from, how to rank, which rules apply by default."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any

# Defaults of the engine's parameters.
NUM_RESULTS = 20
MAX_CORRELATORS_PER_EVENT_TYPE = 50
RANKING_DURATION = "3650 days"

#: Must-match clauses take two bits of a bigint for each event type.
MAX_EVENT_TYPES = 31

# Ranking types and the item column each one fills by default.
RANKING_NAMES = {
    "popular": "popRank",
    "trending": "trendRank",
    "hot": "hotRank",
    "userDefined": "userRank",
    "random": "uniqueRank",
}

# What a model consists of and how results are ordered.
RECS_MODELS = ("all", "collabFiltering", "backfill")


@dataclass(frozen=True)
class Indicator:
    """Limits for one event type. The first indicator is the primary one.

    Nothing is cut unless a caller asks for it: without ``max_items_per_user`` all
    interactions are counted, without ``max_query_events`` a user's whole history is used.
    """

    name: str
    max_items_per_user: int | None = None
    max_correlators: int = MAX_CORRELATORS_PER_EVENT_TYPE
    min_llr: float | None = None
    max_query_events: int | None = None


@dataclass(frozen=True)
class Ranking:
    """One ranking of all items; ``end`` is the moment its window closes."""

    type: str = "popular"
    name: str | None = None
    event_names: tuple[str, ...] | None = None
    end: datetime | str | None = None
    duration: str = RANKING_DURATION

    def __post_init__(self) -> None:
        if self.type not in RANKING_NAMES:
            raise ValueError(f"ranking type {self.type!r} is none of {list(RANKING_NAMES)}")

    @property
    def column(self) -> str:
        return self.name or RANKING_NAMES[self.type]


@dataclass(frozen=True)
class FieldRule:
    """bias > 0 boosts items having a value, < 0 requires one, 0 excludes them."""

    name: str
    values: tuple[str, ...]
    bias: float


@dataclass(frozen=True)
class EngineParams:
    """Everything that is decided once per engine rather than per query."""

    indicators: tuple[Indicator, ...]
    recs_model: str = "all"
    min_events_per_user: int | None = None
    event_window: str | None = None
    dedup_events: bool = False
    compact_properties: bool = False
    blacklist_events: tuple[str, ...] | None = None
    num: int = NUM_RESULTS
    user_bias: float = 1.0
    item_bias: float = 1.0
    return_self: bool = False
    fields: tuple[FieldRule, ...] = ()
    rankings: tuple[Ranking, ...] = ()
    available_date_name: str | None = None
    expire_date_name: str | None = None
    date_name: str | None = None
    catalog_only: bool = False
    max_write_tasks: int | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        if not self.indicators:
            raise ValueError("name at least one event type")
        if len(self.indicators) > MAX_EVENT_TYPES:
            raise ValueError(f"name at most {MAX_EVENT_TYPES} event types")
        if self.recs_model not in RECS_MODELS:
            raise ValueError(f"recs_model {self.recs_model!r} is none of {list(RECS_MODELS)}")

    @classmethod
    def of(cls, *event_names: str, **kwargs: Any) -> EngineParams:
        """The short form: event names in order of importance, defaults for their limits."""
        return cls(tuple(Indicator(name) for name in event_names), **kwargs)

    @property
    def event_names(self) -> list[str]:
        return [i.name for i in self.indicators]

    @property
    def primary(self) -> str:
        return self.indicators[0].name

    def with_events(self, present: Collection[str]) -> EngineParams:
        """The parameters with only the event types that occur, in their order.

        So the first type that has events is the primary one. If none has, all stay.
        """
        kept = tuple(i for i in self.indicators if i.name in present)
        return replace(self, indicators=kept or self.indicators)

    @property
    def blacklisting_events(self) -> list[str]:
        if self.blacklist_events is None:
            return [self.primary]
        return list(self.blacklist_events)

    @property
    def active_rankings(self) -> list[Ranking]:
        """Configured order, the first of each type; popularity if none is configured."""
        chosen: dict[str, Ranking] = {}
        for ranking in self.rankings or (Ranking(),):
            chosen.setdefault(ranking.type, ranking)
        return [
            r if r.event_names else replace(r, event_names=(self.primary,))
            for r in chosen.values()
        ]

    @property
    def rank_columns(self) -> list[str]:
        return [r.column for r in self.active_rankings]

    @property
    def date_columns(self) -> list[str]:
        names = [self.date_name, self.available_date_name, self.expire_date_name]
        return list(dict.fromkeys(n for n in names if n))

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> EngineParams:
        """Read an existing engine configuration (parsed JSON, camelCase names)."""
        source = config.get("datasource", {}).get("params", {})
        algo = config["algorithms"][0]["params"]
        if algo.get("indicators"):
            indicators = tuple(
                Indicator(
                    name=i["name"],
                    max_items_per_user=i.get("maxItemsPerUser"),
                    max_correlators=i.get(
                        "maxCorrelatorsPerItem", MAX_CORRELATORS_PER_EVENT_TYPE
                    ),
                    min_llr=i.get("minLLR"),
                    max_query_events=i.get("maxItemsPerUser"),
                )
                for i in algo["indicators"]
            )
        else:
            indicators = tuple(
                Indicator(
                    name=name,
                    max_items_per_user=algo.get("maxEventsPerEventType"),
                    max_correlators=algo.get(
                        "maxCorrelatorsPerEventType", MAX_CORRELATORS_PER_EVENT_TYPE
                    ),
                    max_query_events=algo.get("maxQueryEvents"),
                )
                for name in algo.get("eventNames") or ()
            )
        window = source.get("eventWindow") or {}
        blacklist = algo.get("blacklistEvents")
        return cls(
            indicators=indicators,
            recs_model=algo.get("recsModel", "all"),
            min_events_per_user=source.get("minEventsPerUser"),
            event_window=window.get("duration"),
            dedup_events=bool(window.get("removeDuplicates", False)),
            compact_properties=bool(window.get("compressProperties", False)),
            blacklist_events=None if blacklist is None else tuple(blacklist),
            num=algo.get("num", NUM_RESULTS),
            user_bias=algo.get("userBias", 1.0),
            item_bias=algo.get("itemBias", 1.0),
            return_self=algo.get("returnSelf", False),
            fields=tuple(
                FieldRule(f["name"], tuple(f["values"]), float(f["bias"]))
                for f in algo.get("fields") or ()
            ),
            rankings=tuple(
                Ranking(
                    type=r.get("type", "popular"),
                    name=r.get("name"),
                    event_names=tuple(r["eventNames"]) if r.get("eventNames") else None,
                    end=r.get("offsetDate") or r.get("endDate"),
                    duration=r.get("duration", RANKING_DURATION),
                )
                for r in algo.get("rankings") or ()
            ),
            available_date_name=algo.get("availableDateName"),
            expire_date_name=algo.get("expireDateName"),
            date_name=algo.get("dateName"),
            max_write_tasks=algo.get("numESWriteConnections"),
            seed=algo.get("seed", 0) or 0,
        )
