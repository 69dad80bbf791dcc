"""Fixed values of the packet data model: enums, limits, word lists, prices."""

APP_NAME = "Sessionloom"
MARKER = "sessionloom"
SCHEMA_VERSION = "sessionloom.packet/v1"
RULE_PREFIX = "SL"

# Enumerations (fixed values).
STATUSES = [
    "draft", "ready_for_export", "awaiting_approval", "dispatched",
    "awaiting_outcome", "needs_clarification", "completed", "abandoned",
]
LEVELS = ["draft", "valid", "verified", "ready"]
TASK_TYPES = ["implementation", "debugging", "review", "docs", "analysis", "generic"]
CODE_TASK_TYPES = ["implementation", "debugging", "review"]
READY_STATUSES = ["ready_for_export", "awaiting_approval", "dispatched", "awaiting_outcome"]
SEVERITIES = ["info", "warning", "error", "critical"]
CONTEXT_KINDS = ["file", "directory", "command", "doc", "test", "symbol", "diff", "log", "issue"]
QUALIFYING_KINDS = ["file", "test", "diff", "log", "issue"]
PATH_REF_KINDS = ["file", "test", "diff", "log"]
FILE_KINDS = ["file", "directory"]
CONSTRAINT_TYPES = ["product", "technical", "policy", "deadline", "style", "safety"]
CONSTRAINT_SOURCES = ["user", "repo", "ticket", "tool", "policy"]
ATTEMPT_RESULTS = ["succeeded", "failed", "partial", "blocked", "abandoned", "unknown"]
CRITERION_STATUSES = ["unmet", "met", "unknown"]
CRITERION_SOURCES = ["user", "ticket", "derived"]
QUESTION_STATUSES = ["open", "answered", "waived"]
WARNING_SOURCES = ["schema", "lint", "policy", "repo", "adapter"]
ARTIFACT_KINDS = ["transcript", "issue", "diff", "log", "note", "image", "test-report"]
ROLES = ["user", "assistant", "system", "tool"]
TARGETS = ["claude-code", "codex", "cursor", "generic"]

# Legal status transitions (fixed values).
TRANSITIONS = {
    "draft": ["ready_for_export", "needs_clarification", "abandoned"],
    "ready_for_export": ["awaiting_approval", "dispatched", "needs_clarification", "abandoned"],
    "awaiting_approval": ["ready_for_export", "dispatched", "abandoned"],
    "dispatched": ["awaiting_outcome", "needs_clarification", "abandoned"],
    "awaiting_outcome": ["completed", "ready_for_export", "needs_clarification", "abandoned"],
    "needs_clarification": ["draft", "ready_for_export", "abandoned"],
    "completed": [],
    "abandoned": [],
}

# Identifier and commit patterns (fixed values). Java's `$` also matches before
# a final line break, so full-input anchors are written `\z`.
ID_PATTERN = r"\A[a-z0-9][a-z0-9._-]{1,127}\z"
COMMIT_PATTERN = r"\A[a-f0-9]{7,40}\z"
WARNING_CODE_PATTERN = r"\A[A-Z0-9_]{4,32}\z"
DIGEST_PATTERN = r"\A[A-Za-z0-9:+._-]{8,256}\z"
DATE_TIME_PATTERN = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
    r"([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)\z"
)

# Secret detectors (fixed values), longest prefix first.
SECRET_PREFIXES = [
    "sk-ant-", "xoxb-", "xoxp-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_",
    "AKIA", "ASIA", "sk-",
]
SECRET_KEYWORDS = ["password", "secret", "token", "key", "auth"]
PREFIX_MIN_LENGTH = 16
ENTROPY_MIN_LENGTH = 20
ENTROPY_THRESHOLD = 4.0
KEYWORD_WINDOW = 40
REDACTED = "[REDACTED]"

# Outcome word lists (fixed values); the first class with a hit wins.
FAILURE_HINTS = ["fail(?:ed|ing|ure)", "error", "exception", "crash(?:ed)?", "red", "aborted"]
INCOMPLETE_HINTS = ["in progress", "todo", "blocked", "partial", "skipped", "pending"]
SUCCESS_HINTS = [
    "passes?", "passed", "tests? pass(?:ing|ed)?", "merged", "succeeded", "success", "green",
]
SUCCESS_OPEN_HINTS = ["all checks pass"]

# Limit markers (fixed values); MARKER_SPAN bounds the length of any match.
LIMIT_MARKERS = [
    "rate.?limit", "usage limit", "context.?(?:window|limit) (?:exceeded|reached)",
    "please try again later",
]
MARKER_SPAN = 64

# USD per 1,000 tokens (fixed values).
PRICES = [
    ("anthropic", "claude-sonnet-4-5", 0.003, 0.015),
    ("openai", "gpt-4o-mini", 0.00015, 0.0006),
]
COST_SPREAD = (0.75, 1.25)

# Log metadata keys that may be written (fixed values).
LOG_KEYS = [
    "command", "subcommand", "mode", "exit_code", "duration_ms", "packet_id", "artifact_id",
    "artifact_type", "path", "paths", "size_bytes", "digest", "digests", "llm_provider",
    "llm_calls_live", "llm_calls_cached", "tokens_in", "tokens_out", "estimated_cost_usd_min",
    "estimated_cost_usd_max", "fell_back_to_full", "rule_code", "rule_codes", "severity",
    "blocking", "count", "counts", "shape", "git_branch", "git_commit", "target", "unsafe",
    "meta",
]

# Narrative defaults (fixed values).
DEFAULT_OBJECTIVE = "Continue prior work captured in transcript."
DEFAULT_STATE = "No assistant activity captured yet."
DEFAULT_NEXT = "Resume from the most recent assistant turn captured in the transcript."
UNTITLED = "Untitled handoff"
TRUNCATED = "… [truncated]"
TOOL_OUTPUT_CAP = 500
TAIL_TURNS = 12
RECENT_ATTEMPTS = 5
EVIDENCE_CAP = 240
CACHE_BUDGET_BYTES = 200 * 1024 * 1024

# Rows of one list that meet in one window or are joined at once; a longer list
# is worked on in buckets of this size, whose results are then put together.
PART_ITEMS = 4096
