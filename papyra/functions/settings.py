"""Policies and job settings from JSON, checked before anything runs with them."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from . import policy as P


class PolicyError(RuntimeError):
    """A policy or job setting that cannot be used."""


@dataclass(frozen=True)
class Policy:
    """What an installation may tune; the defaults are those of ``functions.policy``."""

    sentences_per_block: int = P.SENTENCES_PER_BLOCK
    tokens_per_block: int = P.TOKENS_PER_BLOCK
    hub_degree: int = P.HUB_DEGREE
    min_confidence: int = P.MIN_CONFIDENCE
    predicate_boost: float = P.PREDICATE_BOOST
    merge_similarity: float = P.MERGE_SIMILARITY
    fingerprint_similarity: float = P.FINGERPRINT_SIMILARITY
    top_hypotheses: int = P.TOP_HYPOTHESES
    leads: int = P.LEADS
    allowed_domains: tuple[str, ...] = tuple(P.ALLOWED_DOMAINS)


@dataclass(frozen=True)
class JobSettings:
    """What a job may tune for itself; unknown keys of older jobs are left out."""

    domain: str = P.ALLOWED_DOMAINS[0]
    focus_areas: tuple[str, ...] = ()
    seeds: tuple[str, ...] = ()
    stoplist: tuple[str, ...] = ()
    preferred_predicates: tuple[str, ...] = ()
    excluded_entities: tuple[str, ...] = ()


# Where a policy file holds each setting.
PLACES = {
    "sentences_per_block": "algorithm.slicing.sentences_per_block",
    "tokens_per_block": "algorithm.slicing.max_tokens_per_block",
    "hub_degree": "algorithm.path_reasoning_defaults.hub_degree_threshold",
    "min_confidence": "algorithm.path_reasoning_defaults.min_confidence",
    "predicate_boost": "algorithm.path_reasoning_defaults.preferred_predicate_boost_factor",
    "merge_similarity": "algorithm.graph_merging.similarity_threshold",
    "fingerprint_similarity": "algorithm.deduplication_defaults.similarity_threshold",
    "top_hypotheses": "algorithm.decision_thresholds.top_k_hypotheses_to_store",
    "leads": "query_orchestrator.top_k_hypotheses",
    "allowed_domains": "algorithm.domain_resolution.allowed_domains",
}
JOB_PLACES = {
    "domain": "domain",
    "focus_areas": "query_config.focus_areas",
    "seeds": "path_reasoning_config.seeds",
    "stoplist": "path_reasoning_config.stoplist",
    "preferred_predicates": "hypothesis_config.preferred_predicates",
    "excluded_entities": "graph_config.excluded_entities",
}


def _value(values: dict, name: str, place: str):
    """The setting under its own name, else at its place in nested values, else None."""
    if name in values:
        return values[name]
    at = values
    for part in place.split("."):
        if not isinstance(at, dict) or part not in at:
            return None
        at = at[part]
    return at


def _read(kind: type, values: dict, places: dict[str, str]):
    if not isinstance(values, dict):
        raise PolicyError("settings must be an object")
    got = {}
    for f in fields(kind):
        v = _value(values, f.name, places[f.name])
        if v is None:
            continue
        if isinstance(f.default, tuple):
            if not isinstance(v, (list, tuple)) or not all(isinstance(x, str) for x in v):
                raise PolicyError(f"{f.name} must be a list of texts")
            v = tuple(v)
        elif isinstance(f.default, str):
            if not isinstance(v, str):
                raise PolicyError(f"{f.name} must be a text")
        elif isinstance(v, bool) or not isinstance(v, (int, float)) or (isinstance(f.default, int) and v != int(v)):
            raise PolicyError(f"{f.name} must be a number{' without fraction' if isinstance(f.default, int) else ''}")
        else:
            v = type(f.default)(v)
        got[f.name] = v
    return kind(**got)


def policy_of(values: dict) -> Policy:
    """A policy from values by name or nested as in a policy file; what is not given keeps its default."""
    p = _read(Policy, values, PLACES)
    if not p.allowed_domains:
        raise PolicyError("at least one domain must be allowed")
    for name in ("sentences_per_block", "tokens_per_block"):
        if getattr(p, name) < 1:
            raise PolicyError(f"{name} must be at least 1")
    for name in ("merge_similarity", "fingerprint_similarity"):
        if not 0 <= getattr(p, name) <= 1:
            raise PolicyError(f"{name} must be between 0 and 1")
    return p


def job_settings(values: dict | None) -> JobSettings:
    return _read(JobSettings, values or {}, JOB_PLACES)


def load_policy(spark: SparkSession, path: str) -> Policy:
    """The policy in a JSON file, in any store that Spark reads."""
    try:
        return policy_of(json.loads(spark.read.text(path, wholetext=True).first()[0]))
    except PolicyError:
        raise
    except Exception as e:  # a missing, empty or broken file alike
        raise PolicyError(f"no policy could be read from {path}: {e}") from e
