"""Screening policy: per-guard switches, thresholds, actions and type lists.

A policy is a plain nested dict built on the driver; guards fold its values
into literals when the plan is built, so it never travels with the data.
``overlay`` merges an override dict into a base dict (override wins on
scalars and lists, dicts merge recursively).  Per-tenant policies that must
vary by row live in a small DataFrame instead (see ``sources.tenants``).
"""

from __future__ import annotations

from typing import Any

from guardspark.functions import patterns as P

# FIXED VALUES: the shipped settings; they must equal the screening rules' own.
DEFAULT_POLICY: dict[str, Any] = {
    "pii_vault": {
        "enabled": True,
        # The shipped file lists email, phone, ssn, credit_card, ip_address,
        # which tokenizes part of a 16-digit card as a phone; the vault uses
        # the same safe (longest-first) order as the redactor by default.
        "detect_types": list(P.SAFE_REDACT_ORDER),
    },
    "input_guards": {
        "pii_detector": {
            "enabled": True,
            "confidence_threshold": 0.8,
            "action": "warn",
            "detect_types": list(P.PII_PATTERNS),
        },
        "prompt_injection": {
            "enabled": True,
            "confidence_threshold": 0.7,
            "action": "block",
            "max_prompt_length": 10000,
        },
        "toxic_content": {
            "enabled": True,
            "confidence_threshold": 0.75,
            "action": "block",
            "categories": [
                "hate_speech",
                "harassment",
                "violence",
                "self_harm",
                "sexual_content",
            ],
        },
        "topic_restriction": {
            "enabled": True,
            "action": "warn",
            "blocked_topics": ["illegal_activities", "weapons_manufacturing", "drug_synthesis"],
        },
    },
    "output_guards": {
        "pii_redactor": {
            "enabled": True,
            "redaction_char": "*",
            # The shipped file lists email, phone, ssn, credit_card, ip_address;
            # that order redacts a 16-digit card as a phone first.  The safe
            # (longest-first) order is the default here; pass the other one
            # through ``overlay`` to reproduce it.
            "redact_types": list(P.SAFE_REDACT_ORDER),
        },
        "hallucination_detector": {
            "enabled": True,
            "confidence_threshold": 0.6,
            "action": "warn",
        },
        "content_filter": {
            "enabled": True,
            "confidence_threshold": 0.75,
            "action": "block",
        },
        "output_validator": {
            "enabled": True,
            "max_output_length": 50000,
            "action": "block",
            "enforce_schema": True,
        },
    },
}

def _copy(value: Any) -> Any:
    # Dicts and lists are copied; anything else (numbers, strings, Columns
    # of a per-row policy) is shared.
    if isinstance(value, dict):
        return {k: _copy(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_copy(v) for v in value]
    return value


def overlay(base: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """Recursive dict merge; ``override`` wins on scalars and lists."""
    out = _copy(base)
    for key, value in override.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = overlay(out[key], value)
        else:
            out[key] = _copy(value)
    return out


def _code_defaults() -> dict[str, dict[str, Any]]:
    """Settings of a guard whose section (or a key in it) is missing: the
    shipped ones, but for the detector (it blocks) and the vault (off)."""
    out: dict[str, dict[str, Any]] = {}
    for stage in ("input_guards", "output_guards"):
        out |= _copy(DEFAULT_POLICY[stage])
    out["pii_detector"]["action"] = "block"
    # an empty type list means all types to the vault, and none to the detector
    out["pii_vault"] = {"enabled": False, "detect_types": list(P.PII_PATTERNS)}
    return out


CODE_DEFAULTS = _code_defaults()


def guard_conf(policy: dict[str, Any] | None, name: str) -> dict[str, Any]:
    """Settings for one guard: its policy section over the code defaults."""
    policy = DEFAULT_POLICY if policy is None else policy
    section: dict[str, Any] = {}
    if name == "pii_vault":
        section = policy.get("pii_vault", {}) or {}
    else:
        for stage in ("input_guards", "output_guards"):
            found = (policy.get(stage) or {}).get(name)
            if found is not None:
                section = found
                break
    conf = dict(CODE_DEFAULTS[name])
    conf.update(section)
    if name == "pii_vault" and not conf.get("detect_types"):
        conf["detect_types"] = list(P.PII_PATTERNS)
    return conf
