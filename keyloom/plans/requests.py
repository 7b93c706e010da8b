"""Checked requests for a search, an alignment or a question, and the ranking policy. Small driver-side values."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession

DENSE = ("visual_dense", "ocr_dense", "asr_dense", "summary_dense")
LEXICAL = ("ocr_bm25", "asr_bm25", "summary_bm25")


def _text(value: str, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text that is not blank")
    return " ".join(value.split())


@dataclass(frozen=True)
class ObjectConstraint:
    label: str
    op: str = "gte"
    count: int = 1
    min_confidence: float = 0.5
    mode: str = "HARD"

    def __post_init__(self):
        if self.op not in ("eq", "gte", "lte") or self.mode not in ("HARD", "SOFT"):
            raise ValueError("op is eq, gte or lte; mode is HARD or SOFT")
        if isinstance(self.count, bool) or self.count < 0 or not 0 <= self.min_confidence <= 1:
            raise ValueError("count is a number from 0, min_confidence from 0 to 1")


@dataclass(frozen=True)
class SearchRequest:
    """A known-item query with at most one paraphrase."""

    query_id: str
    text: str
    paraphrase: str | None = None
    constraints: tuple[ObjectConstraint, ...] = ()
    branches: tuple[str, ...] = (*DENSE, *LEXICAL)

    def __post_init__(self):
        object.__setattr__(self, "text", _text(self.text, "text"))
        unknown = set(self.branches) - {*DENSE, *LEXICAL}
        if unknown or "visual_dense" not in self.branches:
            raise ValueError(f"branches must hold visual_dense and be known: {sorted(unknown)}")
        if self.paraphrase is not None:
            other = _text(self.paraphrase, "paraphrase")
            same = sorted(other.casefold().split()) == sorted(self.text.casefold().split())
            object.__setattr__(self, "paraphrase", None if same else other)

    def variants(self) -> list[tuple[str, str]]:
        return [("q0", self.text)] + ([("q1", self.paraphrase)] if self.paraphrase else [])

    def invocations(self, k: int = 50) -> list[tuple[str, str, int]]:
        """(branch, variant, k): dense branches take all variants, lexical ones the original only."""
        return [
            (branch, variant, k)
            for branch in self.branches
            for variant, _ in self.variants()
            if branch in DENSE or variant == "q0"
        ]


@dataclass(frozen=True)
class AlignmentRequest:
    """At least two different events in order."""

    query_id: str
    events: tuple[str, ...]
    gap: float = 0.001
    k: int = 10

    def __post_init__(self):
        events = tuple(_text(e, "event") for e in self.events)
        if len(events) < 2 or len({e.casefold() for e in events}) < len(events):
            raise ValueError("at least two events, all different")
        if not 0.001 <= self.gap <= 0.01:
            raise ValueError("gap must be from 0.001 to 0.01")
        object.__setattr__(self, "events", events)


@dataclass(frozen=True)
class RankingPolicy:
    weights: Mapping[str, float] = field(default_factory=lambda: {b: 1.0 for b in (*DENSE, *LEXICAL)})
    variants: Mapping[str, float] = field(default_factory=lambda: {"q0": 1.0, "q1": 1.0})
    rrf_k: int = 60
    frames_per_interval: int = 50
    name: str = "baseline"
    status: str = "experimental"
    interval_rrf_k: int = 60
    summary_weight: float = 0.1
    summary_max_boost: float = 0.2
    object_soft_boost: float = 0.05
    object_max_boost: float = 0.2

    def __post_init__(self):
        for key in ("weights", "variants"):  # a policy in use is never changed
            object.__setattr__(self, key, MappingProxyType(dict(getattr(self, key))))
        numbers = [*self.weights.values(), *self.variants.values(), self.summary_weight, self.summary_max_boost, self.object_soft_boost, self.object_max_boost]
        if any(isinstance(x, bool) or not math.isfinite(x) or x < 0 for x in numbers):
            raise ValueError("weights and boosts are finite numbers from 0")
        if any(isinstance(x, bool) or x < 1 for x in (self.rrf_k, self.interval_rrf_k, self.frames_per_interval)):
            raise ValueError("k and frames of an interval are whole numbers from 1")
        if any(w < 0 for w in self.weights.values()) or not any(w > 0 for w in self.weights.values()):
            raise ValueError("weights must not be negative and one must be positive")
        if not set(self.variants) <= {"q0", "q1"}:
            raise ValueError("variants are q0 and q1")

    def positive(self) -> dict[str, float]:
        return {b: w for b, w in sorted(self.weights.items()) if w > 0}


def query_table(spark: SparkSession, requests: Sequence[SearchRequest]) -> DataFrame:
    """(query_id, variant_id, text) of a batch of requests."""
    rows = [(r.query_id, variant, text) for r in requests for variant, text in r.variants()]
    return spark.createDataFrame(rows, "query_id string, variant_id string, text string")


FILE = re.compile(r"([A-Za-z0-9][A-Za-z0-9_-]*-(kis|qa|trake))(\.txt|\.csv)?", re.IGNORECASE)


def submission_name(name: str, kind: str | None = None) -> str:
    """The CSV name of a query file, whose kind must be `kind`, if one is given."""
    found = FILE.fullmatch(name)
    if not found or (kind and found[2].lower() != kind):
        raise ValueError(f"not a query file{f' of kind {kind}' if kind else ''}: {name!r}")
    return f"{found[1]}.csv"


def policy_from(settings: Mapping[str, str], prefix: str = "") -> RankingPolicy:
    """A ranking policy from named settings, such as those of the environment; what is not named keeps its default."""
    get = lambda name, kind, default: kind(settings.get(f"{prefix}RANKING_{name}", default))
    plain = get("FUSION_DEFAULT_WEIGHT", float, 1.0)
    return RankingPolicy(
        weights={b: get(f"FUSION_{b.upper()}_WEIGHT", float, plain) for b in (*DENSE, *LEXICAL)},
        variants={v: get(f"QUERY_{v.upper()}_WEIGHT", float, 1.0) for v in ("q0", "q1")},
        rrf_k=get("NORMALIZATION_RRF_K", int, 60),
        frames_per_interval=get("ASR_MAX_FRAMES_PER_INTERVAL", int, 50),
        name=get("POLICY_NAME", str, "baseline"),
        status=get("POLICY_STATUS", str, "experimental"),
        interval_rrf_k=get("ASR_INTERVAL_RRF_K", int, 60),
        summary_weight=get("SUMMARY_WEIGHT", float, 0.1),
        summary_max_boost=get("SUMMARY_MAX_BOOST", float, 0.2),
        object_soft_boost=get("OBJECT_SOFT_BOOST", float, 0.05),
        object_max_boost=get("OBJECT_MAX_TOTAL_BOOST", float, 0.2),
    )


def warnings(policy: RankingPolicy, methods: Mapping[str, str], counts: Mapping[str, int], failed: Sequence[tuple[str, str, str]]) -> list[str]:
    """How a query was answered, as key=value texts, each once: methods, policy, counts, and (branch, variant, code) of branches
    that did not succeed."""
    lines = [f"{k}={v}" for k, v in methods.items()]
    lines += [f"ranking_policy={policy.name}:{policy.status}", "branch_latency_method=max_variant_latency", f"normalization_rrf_k={policy.rrf_k}"]
    lines.append("query_variant_weights=" + ",".join(f"{k}:{v}" for k, v in sorted(policy.variants.items())))
    lines += [f"summary_weight={policy.summary_weight}", f"summary_max_boost={policy.summary_max_boost}", f"summary_fallback_rrf_k={policy.rrf_k}"]
    lines += [f"object_soft_boost_per_constraint={policy.object_soft_boost}", f"object_max_total_boost={policy.object_max_boost}"]
    lines += [f"asr_{k}={v}" for k, v in sorted(counts.items())]
    lines += [f"branch={b};query_variant_id={v};code={c}" for b, v, c in failed]
    return list(dict.fromkeys(lines))
