"""Fixed detection values: regexes, lexicons, guard names and message texts.

Everything in the FIXED VALUES block below must equal the screening rules
this engine reproduces, character for character, or verdicts change.  The
rest of the module only derives dialect-specific forms from them:

* ``java(p)`` - the form for Spark (``java.util.regex``).  ``(?U)`` makes
  ``\\d \\s \\w \\b`` Unicode-aware, as the rules expect for text strings;
  ``(?i)`` is added where matching ignores case and ``(?d)`` where ``.``
  must stop only at ``\\n``.
* ``re2(p)`` - the form for the DuckDB oracle (RE2, ASCII classes).
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES (must match the reference rules exactly)
# --------------------------------------------------------------------------

# Personal-data patterns, in the default detection order.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}"
SSN = r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"
CREDIT_CARD = (
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}"
    r"|6(?:011|5[0-9]{2})[0-9]{12})\b"
)
IP_ADDRESS = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)

PII_PATTERNS: dict[str, str] = {
    "email": EMAIL,
    "phone": PHONE,
    "ssn": SSN,
    "credit_card": CREDIT_CARD,
    "ip_address": IP_ADDRESS,
}

# Order used by the redactor when no order is configured (longest first).
SAFE_REDACT_ORDER = ["credit_card", "ssn", "email", "phone", "ip_address"]

INJECTION_KEYWORDS: list[str] = [
    "ignore previous instructions",
    "ignore all previous",
    "disregard above",
    "forget everything",
    "you are now",
    "act as",
    "pretend you are",
    "new instructions",
    "system prompt",
    "reveal your instructions",
    "override",
    "bypass",
    "jailbreak",
    "do anything now",
    "developer mode",
]

TOXIC_KEYWORDS: dict[str, list[str]] = {
    "hate_speech": ["racial slur", "ethnic slur"],
    "harassment": ["kill yourself", "die in a fire", "hope you die"],
    "violence": ["how to murder", "how to kill", "make a bomb", "build explosives"],
    "self_harm": ["how to commit suicide", "best way to end my life", "ways to hurt myself"],
    "sexual_content": ["explicit sexual", "pornographic"],
}

BLOCKED_TOPIC_KEYWORDS: dict[str, list[str]] = {
    "illegal_activities": ["how to hack", "steal money", "launder money", "forge documents"],
    "weapons_manufacturing": ["build a gun", "3d print weapon", "make ammunition"],
    "drug_synthesis": [
        "synthesize methamphetamine",
        "cook meth",
        "make fentanyl",
        "grow marijuana illegally",
    ],
}

# Hallucination markers (matched ignoring case).
STATISTIC = (
    r"\b\d+(?:\.\d+)?%\s+of\b|\bstudies\s+show\b|\baccording\s+to\s+research\b"
    r"|\bscientists\s+have\s+proven\b|\bit\s+is\s+a\s+fact\s+that\b"
)
ASSERTION = (
    r"\bdefinitely\b|\balways\b|\bnever\b|\bevery\s+single\b|\bwithout\s+exception\b"
    r"|\bundeniably\b|\bguaranteed\b"
)
CITATION = r"\(\w+\s+et\s+al\.,?\s*\d{4}\)|Journal\s+of\s+\w+|published\s+in\s+\d{4}"

# Content-filter markers (matched ignoring case).
HARMFUL_INSTRUCTION = (
    r"(?:step\s*\d+|first|then|next|finally).*?(?:mix|combine|inject|insert|attach|connect)"
)
SYSTEM_LEAK = (
    r"my\s+(?:system\s+)?(?:prompt|instructions)\s+(?:are|say|tell)"
    r"|I\s+(?:was|am)\s+(?:programmed|instructed|told)\s+to"
    r"|(?:system|initial)\s+(?:prompt|instruction|message)"
)

# Invisible and direction-override characters that count as Unicode tricks:
# U+200B U+200C U+200D U+2060 U+FEFF and U+202A U+202B U+202C U+202D U+202E.
UNICODE_TRICK_CHARS = "\u200b\u200c\u200d\u2060\ufeff\u202a\u202b\u202c\u202d\u202e"

# Code points for which Python's str.isspace() is true.
PY_SPACE_CLASS = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# Guard names as they appear in results.
PII_DETECTOR = "PIIDetectorGuard"
PROMPT_INJECTION = "PromptInjectionGuard"
TOXIC_CONTENT = "ToxicContentGuard"
TOPIC_RESTRICTION = "TopicRestrictionGuard"
PII_REDACTOR = "PIIRedactorGuard"
HALLUCINATION = "HallucinationGuard"
CONTENT_FILTER = "ContentFilterGuard"
OUTPUT_VALIDATOR = "OutputValidatorGuard"

# Messages.
MSG_PII_FAIL = "PII detected: "
MSG_PII_PASS = "No PII detected in input"
MSG_INJ_FAIL = "Potential prompt injection detected"
MSG_INJ_PASS = "No prompt injection detected"
MSG_INJ_PATTERNS = "Injection patterns detected: "
MSG_INJ_UNICODE = "Unicode obfuscation characters detected"
MSG_INJ_SPECIAL = "High special character density: "
MSG_TOXIC_FAIL = "Toxic content detected in categories: "
MSG_TOXIC_PASS = "No toxic content detected"
MSG_TOPIC_FAIL = "Blocked topic detected: "
MSG_TOPIC_PASS = "No restricted topics detected"
MSG_REDACT_FAIL = "PII redacted from output: "
MSG_REDACT_PASS = "No PII found in output"
MSG_HALL_FAIL = "Potential hallucination indicators detected in output"
MSG_HALL_PASS = "No significant hallucination indicators detected"
MSG_HALL_STATS = "Unattributed statistics found: "
MSG_HALL_ASSERT = "Overconfident assertions: "
MSG_HALL_CITE = "Unverified citations: "
MSG_FILTER_FAIL = "Inappropriate content detected in LLM output"
MSG_FILTER_PASS = "Output content passes filter checks"
MSG_FILTER_HARMFUL = "Potentially harmful instructions detected"
MSG_FILTER_LEAK = "System prompt/instruction leakage detected"
MSG_VALID_FAIL = "Output validation failed: "
MSG_VALID_PASS = "Output passes all validation checks"
MSG_VALID_EMPTY = "Output is empty or contains only whitespace"
MSG_VALID_JSON = "Output is not valid JSON"
MSG_VALID_MISSING = "Missing required properties: "
MSG_GUARD_ERROR = "Guard execution error: "
SUMMARY_INPUT_BLOCKED = "Request blocked by input guardrails"
SUMMARY_INPUT_ONLY = "Input validation completed successfully"
SUMMARY_LLM_FAILED = "LLM generation failed: "
SUMMARY_OUTPUT_BLOCKED = "Response blocked by output guardrails"
SUMMARY_WARNINGS = "Request processed with warnings"
SUMMARY_OK = "Request processed successfully"

# Vault placeholder shape: <PII_{TYPE}_{8 hex}>.
TOKEN_PREFIX = "<PII_"
TOKEN_SUFFIX = ">"
TOKEN_HEX = 8

# --------------------------------------------------------------------------
# Derived forms
# --------------------------------------------------------------------------

_SPECIAL = set(r"\^$.|?*+()[]{}-/")


def escape_literal(phrase: str) -> str:
    """Backslash-escape regex metacharacters (valid in Java and RE2)."""
    return "".join("\\" + c if c in _SPECIAL else c for c in phrase)


def alternation(phrases: list[str]) -> str:
    return "|".join(escape_literal(p) for p in phrases)


def java(pattern: str, ignore_case: bool = False, unix_lines: bool = False) -> str:
    flags = "U" + ("i" if ignore_case else "") + ("d" if unix_lines else "")
    return f"(?{flags}){pattern}"


def re2(pattern: str, ignore_case: bool = False) -> str:
    # RE2 classes are ASCII and its `.` already stops only at \n.
    return ("(?i)" if ignore_case else "") + pattern


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal (standard '' escaping)."""
    return "'" + s.replace("'", "''") + "'"
