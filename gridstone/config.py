"""Protocol parameters and fixed values.

The values in the FIXED VALUES block below must equal the reference's for
results to agree (budget levels, effort names, token caps, prompts, estimate
tables, recoverable errors, band edges).  They are stated plainly and in their
natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    """Utility = alpha * correct - beta * cost - gamma * latency."""

    alpha: float = 1.0
    beta: float = 5.0
    gamma: float = 0.02


# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference)
# ---------------------------------------------------------------------------

BUDGET_LEVELS = (0, 256, 1024, 4096)

EFFORT_BY_BUDGET = {0: "minimal", 256: "brief", 1024: "medium", 4096: "deep"}

MAX_OUTPUT_TOKENS_BY_BUDGET = {0: 256, 256: 600, 1024: 1200, 4096: 2400}

BUDGET_PROMPTS = {
    0: "Answer directly. Do not include hidden reasoning. Keep the response concise.",
    256: "Use brief reasoning, then provide the final answer clearly.",
    1024: "Use a moderate amount of reasoning and check the answer before finalizing.",
    4096: "Think carefully and deeply. Explore edge cases, verify the result, then provide the final answer.",
}

REASONING_MODE_BY_BUDGET = {0: "minimal", 4096: "deep"}

PROMPT_TEMPLATE_VERSION = "v2"

REPAIR_BUDGET = 1024

DEFAULT_COST_PER_1K = 0.0006

# Model aliases: alias, model id, tier, price per 1000 tokens; and what all of them share.
MODEL_ALIASES = (
    ("qwen-flash", "qwen3.5-flash-2026-02-23", "cheap", 0.0003),
    ("qwen-plus", "qwen3.5-plus-2026-02-15", "mid", 0.0012),
    ("qwen-max", "qwen3-max-2026-01-23", "strong", 0.0040),
)
ALIAS_PROVIDER, DEFAULT_BACKEND, MOCK = "qwen", "openai-compatible", "mock"

# Tier inference from a model name, tried in this order.
TIER_NAME_TOKENS = (
    ("cheap", ("flash", "cheap", "mini")),
    ("mid", ("plus", "mid")),
    ("strong", ("max", "strong", "pro")),
)

# Router estimate tables (threshold router).
TIER_COST_BASE = {"cheap": 0.00025, "mid": 0.0012, "strong": 0.004}
TIER_COST_DEFAULT = 0.0008
TIER_LATENCY_BASE = {"cheap": 4.0, "mid": 9.0, "strong": 3.0}
TIER_LATENCY_DEFAULT = 5.0
TASK_LATENCY_MULTIPLIER = {"gsm8k": 1.0, "math": 1.2, "humaneval": 1.6}
TASK_LATENCY_DEFAULT = 1.0
TIER_ACCURACY_BASE = {"cheap": 0.72, "mid": 0.84, "strong": 0.9}
TIER_ACCURACY_DEFAULT = 0.78
BUDGET_ACCURACY_BONUS = {0: 0.0, 256: 0.04, 1024: 0.08, 4096: 0.1}
BUDGET_ACCURACY_BONUS_DEFAULT = 0.08
TASK_ACCURACY_PENALTY = {"gsm8k": 0.0, "math": 0.05, "humaneval": 0.1}
TASK_ACCURACY_PENALTY_DEFAULT = 0.02

# Joint policy engine estimate tables.
JOINT_MODEL_ACCURACY = (0.45, 0.65, 0.78)
JOINT_BUDGET_BONUS = {0: 0.0, 256: 0.05, 1024: 0.10, 4096: 0.13}
JOINT_DIFFICULTY_PENALTY = {"easy": 0.0, "medium": 0.12, "hard": 0.22}
JOINT_CODE_PENALTY = 0.05
JOINT_MODEL_COST_FACTOR = (0.0, 0.0003, 0.0008)
BUDGET_HINT_PENALTY = 0.03

# Difficulty label score.
DIFFICULTY_TASK_BONUS = {"gsm8k": 0.0, "math": 15.0, "humaneval": 30.0, "custom": 5.0}
DIFFICULTY_TASK_BONUS_DEFAULT = 5.0

# Safe fallback: error types that trigger the fallback budget.
RECOVERABLE_ERRORS = ("parse_error", "execution_error", "timeout", "empty_output", "malformed_answer")

# Confidence band edges (right-closed) and names.
CONFIDENCE_BANDS = ((-0.001, 0.25, "very_low"), (0.25, 0.5, "low"), (0.5, 0.75, "medium"), (0.75, 1.0, "high"))

# Uncertainty-aware router.
DEFAULT_CONFIDENCE_THRESHOLD = 0.55
THRESHOLD_SWEEP = (0.55, 0.65, 0.75, 0.85)

# Ablation buckets by policy family.
ABLATION_GROUPS = {
    "phase2_threshold": "surface_only_threshold",
    "phase2_logreg_joint": "joint_linear_router",
    "phase2_mlp_factorized": "factorized_router",
    "phase2_uncertainty_aware": "factorized_plus_uncertainty",
    "joint_aggregate_utility": "aggregate_utility_baseline",
    "joint_safe_fallback": "aggregate_safe_fallback",
    "model_only": "model_only_baseline",
    "budget_only": "budget_only_baseline",
    "fixed_model_budget": "fixed_model_budget",
}

# Surface features.
MATH_SYMBOLS = "+-*/=^"
PUNCTUATION = ",.;:!?()[]{}"
SURFACE_CODE_MARKERS = ("def ", "class ", "return", "assert", "```", "import ")
PROBE_CODE_MARKERS = ("def ", "assert", "return", "import ", "```")

# Sample domains.
TASK_TYPES = ("gsm8k", "math", "humaneval")
SPLITS = ("train", "dev", "test")

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Protocol:
    weights: Weights = field(default_factory=Weights)
    budgets: tuple[int, ...] = BUDGET_LEVELS
    recoverable_errors: tuple[str, ...] = RECOVERABLE_ERRORS
    confidence_threshold: float = DEFAULT_CONFIDENCE_THRESHOLD
