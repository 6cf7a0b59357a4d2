"""[S6, X1, X2] The stages by name, what each waits for, and when a cycle is due."""

from __future__ import annotations

from datetime import datetime, timedelta

STAGES = {"ingest": [], "scores": ["ingest"], "topics": ["ingest"], "topic_labels": ["topics"], "events": ["topic_labels"], "centroids": ["topics"], "summaries": ["events", "centroids"], "coverage": ["events"], "fact_checks": ["centroids", "events"], "graph": ["ingest"]}


def order(stages: dict[str, list[str]] = STAGES) -> list[str]:
    """The stages, each after those it waits for; ties by name."""
    out: list[str] = []
    while len(out) < len(stages):
        ready = sorted(s for s, before in stages.items() if s not in out and set(before) <= set(out))
        if not ready:
            raise ValueError("the stages wait for each other")
        out += ready
    return out


def due(now: datetime, last: datetime | None, kind: str) -> bool:
    """fast: every three hours; cluster: once a day, from 22 h on; graph: every three days. A cycle that never ran is due (cluster: from 22 h on)."""
    if kind == "cluster":
        return now.hour >= 22 and (last is None or last.date() < now.date())
    return last is None or now - last >= {"fast": timedelta(hours=3), "graph": timedelta(days=3)}[kind]
