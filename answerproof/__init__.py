"""Audit stored model responses against reference answers, as PySpark jobs.

Everything is a function from DataFrame to DataFrame (or Column to Column). Most run nothing until the
caller asks for an action; those that settle counts or check keys first say so. See README.md.
"""

from answerproof.config import RULES_ONLY, Thresholds
from answerproof.operators.decide import flag_pairs, label_pairs, preflight
from answerproof.operators.resample import bootstrap_rate_ci
from answerproof.plans.jobs import audit_set, build_prompt_set, label_responses, report

__all__ = [
    "RULES_ONLY",
    "Thresholds",
    "audit_set",
    "bootstrap_rate_ci",
    "build_prompt_set",
    "flag_pairs",
    "label_pairs",
    "label_responses",
    "preflight",
    "report",
]
