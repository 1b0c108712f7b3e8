"""Policy overlay and per-guard settings (A5 merge, section defaults)."""

from guardspark import policy as PL


def test_overlay_merges_dicts_and_replaces_lists():
    base = {"a": {"x": 1, "lst": [1, 2]}, "b": 2}
    out = PL.overlay(base, {"a": {"lst": [3]}, "c": 4})
    assert out == {"a": {"x": 1, "lst": [3]}, "b": 2, "c": 4}
    assert base["a"]["lst"] == [1, 2]  # base untouched


def test_shipped_vs_code_defaults():
    assert PL.guard_conf(None, "pii_detector")["action"] == "warn"  # shipped file
    assert PL.guard_conf({}, "pii_detector")["action"] == "block"  # section missing
    assert PL.guard_conf({}, "pii_vault")["enabled"] is False
    assert PL.guard_conf(None, "pii_vault")["enabled"] is True


def test_vault_empty_types_mean_all():
    conf = PL.guard_conf({"pii_vault": {"enabled": True, "detect_types": []}}, "pii_vault")
    assert conf["detect_types"] == ["email", "phone", "ssn", "credit_card", "ip_address"]
    det = PL.guard_conf({"input_guards": {"pii_detector": {"detect_types": []}}}, "pii_detector")
    assert det["detect_types"] == []  # the detector then detects nothing


def test_disabled_guard_left_out():
    from guardspark.plans import chain

    pol = PL.overlay(PL.DEFAULT_POLICY, {"input_guards": {"toxic_content": {"enabled": False}}})
    names = [g.name for g in chain.input_guards(pol)]
    assert "ToxicContentGuard" not in names and len(names) == 3
