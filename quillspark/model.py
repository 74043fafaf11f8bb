"""Schemas of the records that the engine reads and writes, and the engine's thresholds."""

from __future__ import annotations

import dataclasses

PAPER = (
    "paper_id string, title string, authors array<string>, year int, venue string, abstract string, abstract_length int, "
    "citations int, source string, doi string, arxiv_id string, oa_status string, pdf_url string, url string"
)
#: ``pos`` is the row's place in its input, which decides ties; a DataFrame has no order of its own.
LANDED_PAPER = PAPER + ", pos bigint"
SEED = "node_id string, name string, level int, category string, description string, aliases array<string>, keywords array<string>"
TEMPLATE = (
    "struct<signal_chain: array<string>, control_architecture: string, optimization_target: string, constraint_type: array<string>, "
    "abstract_pattern: string, mathematical_core: string, domain_abstraction: string>"
)
NODE = f"id string, type string, title string, year int, knowledge_level array<string>, structure_template {TEMPLATE}, created_at timestamp, seq bigint"
PROMOTION = "struct<is_causal: boolean, conditions_met: array<string>, confidence: double, last_evaluated: timestamp, promotion_path: map<string, boolean>>"
HISTORY = "array<struct<action: string, timestamp: timestamp, details: map<string, string>>>"
EDGE = (
    f"id string, source_id string, target_id string, base_type string, base_score double, causal_promotion {PROMOTION}, "
    f"mechanism_description string, history {HISTORY}, created_at timestamp, seq bigint"
)
EVOLUTION = "id bigint, timestamp timestamp, trigger_paper string, change_type string, description string, details map<string, string>"
POLICY_CHANGE = "id bigint, timestamp timestamp, change_description string, old_policy string, new_policy string"
EVENT = "t timestamp, e string, p string, rest map<string, string>"


@dataclasses.dataclass(frozen=True)
class Policy:
    """Thresholds of the double loop and of distillation (fixed values)."""

    cold_start_nodes: int = 10
    cold_start_threshold: float = 0.6
    threshold: float = 0.5
    max_impact_ratio: float = 0.3
    require_two_conditions: bool = True
    consecutive_trigger_limit: int = 2
    window: int = 5
    merge_jaccard: float = 0.7
    min_nodes_per_level: int = 2


@dataclasses.dataclass(frozen=True)
class Profile:
    """How much a run takes on, by memory tier (fixed values)."""

    tier: str
    batch: int
    top_n: int
    searches: int

    @staticmethod
    def for_memory(megabytes: float) -> "Profile":
        if megabytes < 512:
            return Profile("low", 4, 5, 2)
        return Profile("mid", 8, 8, 4) if megabytes < 2048 else Profile("high", 15, 15, 8)
