"""Default policy: thresholds, word lists, patterns and tables as frozen values."""

from __future__ import annotations

# They must equal those of the system whose results are matched.

SENTENCES_PER_BLOCK = 4
TOKENS_PER_BLOCK = 250
CHARS_PER_TOKEN = 3.5
SPAN_CHARS = 3000
FALLBACK_CHARS = 5250
HEADING_CHARS = 80
NODE_MIN_LENGTH = 2
TRIPLE_PART_CHARS = 300

HUB_DEGREE = 25
MIN_CONFIDENCE = 2
PREDICATE_BOOST = 1.2
MERGE_SIMILARITY = 0.85
CLOSEST_SIMILARITY = 0.7
FINGERPRINT_SIMILARITY = 0.95

CONFIDENCE_NORM = 10
HIGH_CONFIDENCE = 0.7
DOMINANT_GAP = 0.3
LOW_DIVERSITY_PAIRS = 2
DIVERSITY_RATIO = 0.3
SPARSE_DENSITY = 0.05
PATH_SUPPORT = 2
STABILITY_CYCLES = 4
ABSOLUTE_GROWTH = 0.5
RELATIVE_GROWTH = 0.1
TOP_HYPOTHESES = 5
LEADS = 2
SNIPPET_CHARS = 300
PREVIEW_OVER, PREVIEW_HEAD, PREVIEW_TAIL = 1000, 300, 100

REGION_MARKERS = {
    "abstract": "abstract",
    "introduction": "introduction",
    "conclusion": "conclusion",
    "conclusions": "conclusion",
    "results": "results",
    "result": "results",
    "method": "methods",
    "methods": "methods",
    "methodology": "methods",
    "discussion": "discussion",
}
WHITELISTED_REGIONS = ["abstract", "introduction", "conclusion", "results", "methods"]
EXCLUDED_REGIONS = ["references", "bibliography", "acknowledgments", "appendix", "author_contributions"]
REFINED_TYPES = ["pdf_text", "user_text"]

PREDICATE_MAP = {
    "use": "used_for",
    "utilize": "used_for",
    "apply": "used_for",
    "evaluate": "evaluated_by",
    "measure": "measured_by",
    "show": "demonstrates",
    "demonstrate": "demonstrates",
    "lead": "causes",
    "cause": "causes",
    "result": "results_in",
    "improve": "improves",
    "increase": "increases",
    "decrease": "decreases",
    "compare": "compares",
    "propose": "proposes",
    "introduce": "introduces",
    "develop": "develops",
    "train": "training",
    "generate": "generates",
    "produce": "produces",
    "suggest": "suggests",
    "find": "finds",
    "observe": "observes",
    "relate": "related_to",
    "associate": "related_to",
    "contain": "contains",
    "include": "includes",
}
FALLBACK_PREDICATE = "related_to"

GENERIC_PREDICATES = [
    "related to", "mentions", "about", "involves", "concerns", "associated with", "connected to", "linked to",
]

NOISE_WORDS = [
    "the", "a", "an", "of", "and", "or", "to", "in", "is", "are", "be", "by", "for", "with", "as", "from", "on",
    "at", "this", "that", "which", "who", "what", "where", "when", "why", "how", "",
]
NOISE_PATTERNS = [
    r"^(19|20)\d{2}$",
    r"^(doi:|10\.\d+/.*)",
    r"^(ISBN|isbn)[\s-]?(?:10|13)?[\s-]?[\d\s-]+$",
    r"^(ISSN|issn)[\s-]?\d{4}[\s-]?\d{4}$",
    r"^https?://|^www\.",
    r"^arxiv:\d+\.\d+$",
    r"^(PMID|pmid):\d+$",
    r"^\d+$",
    r"^[a-f0-9\-]{20,}$",
    r"^[^\w\s]$",
    r"^\.{2,}$",
    r"^[_\-\s]*$",
    r"^[0-9\.\-]+$",
    r"^[0-9\.\-]+%$",
]

OBJECT_WORDS = [
    "model", "method", "dataset", "algorithm", "hypothesis", "system", "generation", "training", "evaluation",
    "experiment", "metric", "result",
]
LEADING_FILLER = r"^(ensuring that|ensuring|ensures that|that|to )\b"
CONTRAST_TAIL = r"rather than.*$"
OF_PREFIX = r"^of\s+"
OBJECT_TAIL_PUNCTUATION = r"[.,;:\)]+$"

#: attribute: (pattern, group of the value); tried in this order.
METADATA_PATTERNS = {
    "doi": r"^(?:doi:|10\.\d+/.*)$",
    "issn": r"^(?:ISSN|issn)[\s-]?(\d{4})[\s-]?(\d{4})$",
    "arxiv_id": r"^(?:arxiv:)?(\d+\.\d+)$",
    "pmid": r"^(?:PMID|pmid):?(\d+)$",
    "url": r"^(https?://\S+)$",
}
METADATA_EDGES = {
    "year": "has_year",
    "doi": "has_doi",
    "issn": "has_issn",
    "arxiv_id": "has_arxiv",
    "pmid": "has_pmid",
    "url": "has_url",
}

META_LINES = ["here is", "clean text:", "cleaned text:", "the following", "refinement:"]

DECISIONS = [
    "halt_confident", "halt_no_hypothesis", "insufficient_signal", "fetch_more_literature",
    "strategic_download_targeted", "verification_found", "verification_not_found",
]

#: (weight, largest expected change) of each measurement that signals compare.
SIGNAL_WEIGHTS = {
    "passed_hypothesis_count": (1.0, 100.0),
    "mean_confidence": (0.8, 20.0),
    "graph_density": (0.5, 0.2),
    "filtered_to_total_ratio": (0.3, 0.5),
}
SIGNAL_POSITIVE, SIGNAL_NEGATIVE = 1.0, -1.0
REPUTATION = {1: 10, -1: -20, 0: 0}

#: (phase, status or None) -> prompt key; an unknown status falls back to (phase, None).
PROMPTS = {
    ("CREATION", None): "presentation_creation.txt",
    ("INGESTION", None): "presentation_ingestion.txt",
    ("TRIPLES", None): "presentation_triples.txt",
    ("GRAPH", None): "presentation_graph.txt",
    ("PATHREASONING", None): "presentation_path_reasoning.txt",
    ("DECISION", None): "presentation_decision.txt",
    ("DECISION", "haltconfident"): "presentation_decision_haltconfident.txt",
    ("DECISION", "nohypo"): "presentation_decision_nohypo.txt",
    ("DECISION", "found"): "presentation_decision_found.txt",
    ("DECISION", "notfound"): "presentation_decision_notfound.txt",
    ("DECISION", "insufficientsignal"): "presentation_decision_insufficientsignal.txt",
    ("FETCH", None): "presentation_fetch.txt",
    ("DOWNLOAD", None): "presentation_download.txt",
}

#: status -> status after the stage that it starts, and the manual triggers.
STAGE_AFTER = {
    "READY_TO_INGEST": "INGESTED",
    "INGESTED": "TRIPLES_EXTRACTED",
    "TRIPLES_EXTRACTED": "STRUCTURAL_GRAPH_BUILT",
    "STRUCTURAL_GRAPH_BUILT": "GRAPH_SANITIZED",
    "GRAPH_SANITIZED": "GRAPH_SEMANTIC_MERGED",
    "GRAPH_SEMANTIC_MERGED": "PATH_REASONING_DONE",
    "PATH_REASONING_DONE": "RUNNING_HANDLERS",
    "DOWNLOAD_QUEUED": "READY_TO_INGEST",
}
# Retries of a stage at most, and seconds until the next try (None: 1, 2, 4, ...).
STAGE_RETRIES = {
    "EXTRACTING": (3, 20),
    "READY_TO_INGEST": (3, None),
    "INGESTED": (3, None),
    "TRIPLES_EXTRACTED": (2, 10),
    "STRUCTURAL_GRAPH_BUILT": (2, 10),
    "GRAPH_SANITIZED": (3, 60),
    "GRAPH_SEMANTIC_MERGED": (2, None),
    "PATH_REASONING_DONE": (3, 30),
    "RUNNING_HANDLERS": (3, 30),
    "FETCH_QUEUED": (3, None),
    "DOWNLOAD_QUEUED": (3, None),
}
MANUAL_TRIGGERS = {
    "READY_TO_INGEST": "ingest",
    "TRIPLES_EXTRACTED": "structural_graph",
    "GRAPH_SEMANTIC_MERGED": "path_reasoning",
    "FETCH_QUEUED": "fetch",
    "DOWNLOAD_QUEUED": "download",
}
ALLOWED_DOMAINS = ["biomedical", "computer science", "None"]
