"""Values of the oracle's SQL, stated on their own so that a wrong constant of the engine shows as a difference.

FIXED VALUES: they must equal the reference's for results to agree.
"""

BUDGET_LEVELS = (0, 256, 1024, 4096)
ALPHA, BETA, GAMMA = 1.0, 5.0, 0.02
TIER_COST_BASE = {"cheap": 0.00025, "mid": 0.0012, "strong": 0.004}
TIER_LATENCY_BASE = {"cheap": 4.0, "mid": 9.0, "strong": 3.0}
TASK_LATENCY_MULTIPLIER = {"gsm8k": 1.0, "math": 1.2, "humaneval": 1.6}
TIER_ACCURACY_BASE = {"cheap": 0.72, "mid": 0.84, "strong": 0.9}
BUDGET_ACCURACY_BONUS = {0: 0.0, 256: 0.04, 1024: 0.08, 4096: 0.1}
TASK_ACCURACY_PENALTY = {"gsm8k": 0.0, "math": 0.05, "humaneval": 0.1}
JOINT_MODEL_ACCURACY = (0.45, 0.65, 0.78)
JOINT_BUDGET_BONUS = {0: 0.0, 256: 0.05, 1024: 0.10, 4096: 0.13}
JOINT_DIFFICULTY_PENALTY = {"easy": 0.0, "medium": 0.12, "hard": 0.22}
JOINT_MODEL_COST_FACTOR = (0.0, 0.0003, 0.0008)
DIFFICULTY_TASK_BONUS = {"gsm8k": 0.0, "math": 15.0, "humaneval": 30.0, "custom": 5.0}
DIFFICULTY_TASK_BONUS_DEFAULT = 5.0
MATH_SYMBOLS = "+-*/=^"
PUNCTUATION = ",.;:!?()[]{}"
SURFACE_CODE_MARKERS = ("def ", "class ", "return", "assert", "```", "import ")
PROBE_CODE_MARKERS = ("def ", "assert", "return", "import ", "```")
ABLATION_GROUPS = {
    "phase2_threshold": "surface_only_threshold", "phase2_logreg_joint": "joint_linear_router", "phase2_mlp_factorized": "factorized_router",
    "phase2_uncertainty_aware": "factorized_plus_uncertainty", "joint_aggregate_utility": "aggregate_utility_baseline",
    "joint_safe_fallback": "aggregate_safe_fallback", "model_only": "model_only_baseline", "budget_only": "budget_only_baseline", "fixed_model_budget": "fixed_model_budget"}
