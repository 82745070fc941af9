"""Decision thresholds and the fixed word lists the rules depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Phrases that claim the answer does not exist or cannot be had.
UNAVAILABILITY_CUES = (
    "no specific",
    "not available",
    "not publicly available",
    "no publicly available",
    "does not exist",
    "doesn't exist",
    "no such",
    "cannot be found",
    "can't be found",
    "not listed",
    "unlisted",
    "unavailable",
    "there is no",
    "there's no",
    "none exists",
)

# Words that carry no content when two answers are compared.
ANSWER_STOPWORDS = (
    "the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "with", "by",
    "is", "are", "was", "were", "be", "been", "being", "it", "its", "that", "this",
    "as", "at", "from", "into", "within", "over", "under", "between", "during",
    "does", "do", "did", "what", "which", "who", "whom", "when", "where", "why", "how",
)

# True-ish spellings of a label column.
TRUE_WORDS = ("true", "1", "yes", "y")

# Cell texts the analysis readers treat as missing.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Default stop words of the keyword report. Libraries disagree on "the" English list, so the
# report takes it as a parameter; this is the one used when the caller passes none.
KEYWORD_STOPWORDS = (
    "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as",
    "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him",
    "himself", "his", "how", "if", "in", "into", "is", "it", "its", "itself", "just", "me",
    "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only",
    "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should",
    "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up",
    "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why",
    "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
)


@dataclass(frozen=True)
class Thresholds:
    """Per-run settings. They become literals when a plan is built. Names and defaults are fixed values."""

    # What to do when an enabled score is missing: fail the job, or go on without it.
    strict_dependencies: bool = True

    allow_token_subsequence: bool = True
    enable_embeddings: bool = True
    enable_nli: bool = True

    subseq_min_gold_chars: int = 4
    subseq_max_answer_chars: int = 5000

    numeric_rel_tol: float = 0.005
    numeric_abs_tol: float = 0.05
    numeric_alt_markers: tuple[str, ...] = ("or", "either")

    jaccard_min: float = 0.40
    weak_signals_required: int = 2

    embed_min_similarity: float = 0.72
    embed_require_shared_content_tokens: bool = True
    embed_min_shared_content_tokens: int = 1
    embed_disable_for_very_short_gold_tokens: int = 1

    nli_min_tokens: int = 3
    nli_contradiction_veto: float = 0.75
    nli_entailment_veto_floor: float = 0.30

    atomic_gold_max_tokens: int = 2
    atomic_resp_max_tokens: int = 5
    atomic_gold_max_chars: int = 48

    unavailability_cues: tuple[str, ...] = UNAVAILABILITY_CUES


#: Deterministic rules only: no score tables are read.
RULES_ONLY = Thresholds(enable_embeddings=False, enable_nli=False)
