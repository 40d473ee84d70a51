"""Tunables of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CompareOptions:
    threshold: float = 0.05
    alpha: float = 0.05
    noisy_cv: float = 0.25


@dataclass(frozen=True)
class MergeOptions:
    similarity: float = 0.55
    window: int = 3


@dataclass(frozen=True)
class ChunkPolicy:
    chunk_bytes: int = 120 * 1024
    file_bytes: int = 80 * 1024
    file_context_bytes: int = 64 * 1024
    chunk_context_bytes: int = 256 * 1024
    related_bytes: int = 32 * 1024
    chunk_related_bytes: int = 128 * 1024


@dataclass(frozen=True)
class ScoreOptions:
    per_confirmation: float = 1.0
    per_refutation: float = 2.0
    half_life_days: float = 60.0
    unparsed_decay: float = 0.1
    keep: int = 100
    least: float = 0.1


@dataclass(frozen=True)
class GuidanceOptions:
    """Entries of a block of guidance, and its bytes."""

    keep: int = 8
    limit: int = 1500


@dataclass(frozen=True)
class EvaluationOptions:
    """Confidence from which on a judged finding counts as shipped."""

    floor: float = 0.55
