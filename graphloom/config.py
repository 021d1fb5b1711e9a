"""Settings and vocabularies of the knowledge-graph operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Years, thresholds and limits; every operator takes what it needs from here as parameters."""

    concept: str = "natural language processing"
    year_from: int = 2018
    year_to: int = 2024
    max_year: int = 2025
    holdout_year: int = 2026
    min_abstract_words: int = 20
    max_entity_words: int = 6
    max_label_words: int = 8
    cutoffs: tuple[int, ...] = (2020, 2021, 2022, 2023)
    final_year: int = 2024
    train_cutoffs: tuple[int, ...] = (2020, 2021)
    val_cutoffs: tuple[int, ...] = (2022,)
    test_cutoffs: tuple[int, ...] = (2023,)
    negative_ratio: int = 1
    negative_attempts: int = 50
    seed: int = 42
    embedding_dim: int = 64
    walk_length: int = 30
    walks_per_node: int = 10
    walk_window: int = 5
    lr_c: float = 0.1
    lr_iterations: int = 2000
    merge_similarity: float = 0.90
    neighbours: int = 30
    top_gaps: int = 50
    recent_window: int = 2
    precision_ks: tuple[int, ...] = (10, 20, 50)
    target_total: int = 15000
    cap_increment: int = 500
    request_interval: float = 2.0
    extract_batch: int = 20
    max_tokens: int = 2000
    max_tokens_limit: int = 8000
    max_attempts: int = 3
    aliases: dict = field(default_factory=lambda: dict(ALIASES))


# Vocabularies that decide results.

BANNED_RELATIONS = (
    "is", "has", "had", "includes", "is_a", "authored", "presented_at", "is_organized", "managed_by", "selected_by",
    "held", "affected_by", "moved_to", "increased_by", "increases_by", "reached", "sent_out_for", "kept_at", "removed",
)

GENERIC_TERMS = (
    "methods", "models", "results", "techniques", "tools", "task", "tasks", "system", "systems", "approach",
    "approaches", "issues", "examples",
)

VAGUE_QUALIFIERS = ("various", "several", "these", "those", "many", "some", "certain")

ALIASES = {
    "bert model": "bert",
    "bert-based model": "bert",
    "bidirectional encoder representations from transformers": "bert",
    "gpt model": "gpt",
    "transformer model": "transformer",
}

UPPER_VOCAB = ("bert", "gpt", "lstm", "cnn", "rnn", "nlp")

STRIP_SUFFIXES = (" model", " method", " approach", " framework", " algorithm")

GENERIC_HEAD_WORDS = (
    "model", "models", "method", "methods", "algorithm", "algorithms", "technique", "techniques", "approach",
    "approaches", "system", "systems", "network", "networks", "architecture", "architectures",
)

INVALID_PREFIXES = ("each", "more than", "number of", "case", "test case", "study", "results", "findings", "performance")

CONFIDENCE_BANDS = ((0.9, "HIGH"), (0.75, "MEDIUM"))

API_FIELDS = ("title", "abstract", "year", "citationCount", "referenceCount", "externalIds", "authors.name")
