"""Relations, vocabularies and parameters of the memory engine."""

from __future__ import annotations

from dataclasses import dataclass

FRAGMENT = (
    "id long, agent_id string, session_id string, content string, block_id string, tier string, importance double, confidence double, "
    "state string, ttl_seconds int, created_at timestamp, updated_at timestamp, last_accessed_at timestamp, tags array<string>, access_count long"
)

# States a memory may be in, those recall may return, and the allowed transitions.
STATES = ("raw", "unverified", "verified", "promoted", "contradicted", "quarantined")
RETRIEVABLE = ("unverified", "verified", "promoted")
TRANSITIONS = (
    ("raw", "unverified"), ("raw", "contradicted"), ("unverified", "verified"), ("unverified", "contradicted"),
    ("verified", "promoted"), ("verified", "contradicted"), ("verified", "quarantined"), ("promoted", "contradicted"),
    ("promoted", "quarantined"), ("contradicted", "unverified"), ("quarantined", "unverified"),
)

# Kinds of a memory, tags of a finished one, publishers by trust, half-lives in hours by scope.
KINDS = ("decision", "todo", "bug", "fix", "preference", "snippet", "api", "note")
RETIRED_TAGS = ("superseded", "resolved")
TRUST = {"system": 4, "verified_agent": 3, "raw_agent": 2, "external": 1, "unknown": 0}
HALF_LIFE_HOURS = {"working": 48.0, "session": 168.0, "episodic": 720.0}


@dataclass(frozen=True)
class Recall:
    """Weights and thresholds of retrieval."""

    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6
    rrf_k: int = 60
    relative_floor: float = 0.3
    absolute_floor: float = 0.1
    pinned: float = 0.9
    per_document: int = 2
    hop_decay: float = 0.5
    contradiction: float = 0.6
    half_life_days: float = 30.0
    lexical_share: float = 0.1


@dataclass(frozen=True)
class Policy:
    """Top-k, graph depth and least confidence of a retrieval policy."""

    top_k: int
    graph_depth: int
    min_confidence: float


POLICIES = {"fast": Policy(5, 0, 0.25), "balanced": Policy(10, 1, 0.40), "deep": Policy(15, 2, 0.55)}
