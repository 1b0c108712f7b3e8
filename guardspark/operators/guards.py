"""The eight guards (C1-C8) as column expressions.

A guard has two halves:

* ``stages(text)`` - the expensive *facts* (regex counts, match lists,
  lengths), as named columns.  Most guards have one stage; the redactor has
  one per type because each type is counted on the text the previous type
  left behind.
* ``score(text, fact)`` - the cheap arithmetic that turns facts into one
  result struct.  ``fact(name)`` returns the column holding a fact.

Facts are materialised in their own ``select`` before scoring, so a count
used by the confidence, the message and the labels is computed once (the
optimizer does not inline a non-trivial expression that is used twice).

Thresholds and actions may be Python values or Columns (per-tenant policy).
Confidence arithmetic is IEEE double, in the order the rules add terms.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardspark.functions import lexicon as L
from guardspark.functions import patterns as P
from guardspark.functions import pii
from guardspark.functions import text as TX
from guardspark.operators import result as R

Fact = Callable[[str], Column]


def _c(x: Any) -> Column:
    return x if isinstance(x, Column) else R.lit(x)


def _meets(conf: Column, threshold: Any) -> Column:
    """``conf >= threshold``; a null threshold of a per-row policy is met."""
    test = conf >= _c(threshold)
    return F.coalesce(test, F.lit(True)) if isinstance(threshold, Column) else test


def _action(action: Any) -> Column:
    """The configured action; a null one of a per-row policy blocks."""
    return F.coalesce(action, F.lit("block")) if isinstance(action, Column) else _c(action)


def _d(x: float) -> Column:
    return R.lit(float(x))


def _sum(cols: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in cols:
        out = out + c
    return out


def _labels(pairs: list[tuple[Column, str | Column]]) -> Column:
    """Labels whose condition holds, in order."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(cond, _c(lab)) for cond, lab in pairs]))


class Guard:
    name: str = ""
    key: str = ""

    def __init__(self, conf: dict[str, Any]):
        self.conf = conf
        self.enabled = bool(conf.get("enabled", True))

    def stages(self, text: Column, fact: Fact) -> list[dict[str, Column]]:
        raise NotImplementedError

    def score(self, text: Column, fact: Fact) -> Column:
        raise NotImplementedError

    def modified_text(self, fact: Fact) -> Column | None:
        """Text handed to later guards, when the guard rewrites it."""
        return None


# --------------------------------------------------------------------- input


class PIIDetector(Guard):
    """Personal-data detector."""

    name = P.PII_DETECTOR
    key = "pii"

    @property
    def types(self) -> list[str]:
        return [t for t in self.conf.get("detect_types", []) if t in P.PII_PATTERNS]

    def stages(self, text, fact):
        return [{f"n_{t}": pii.count(text, t) for t in self.types}]

    def score(self, text, fact):
        counts = [(t, fact(f"n_{t}")) for t in self.types]
        if not counts:
            return R.passing(self.name, P.MSG_PII_PASS)
        total = _sum([n for _, n in counts])
        conf = F.least(_d(1.0), _d(0.7) + total.cast("double") * _d(0.1))
        found = _labels([(n > 0, t) for t, n in counts])
        fail = (total > 0) & _meets(conf, self.conf["confidence_threshold"])
        return F.when(
            fail,
            R.make(
                self.name,
                False,
                _action(self.conf["action"]),
                "high",
                F.concat(F.lit(P.MSG_PII_FAIL), R.join_labels(found)),
                conf,
                found,
                total,
            ),
        ).otherwise(R.passing(self.name, P.MSG_PII_PASS))


INJECTION_REGEX = L.phrase_regex(P.INJECTION_KEYWORDS)


class PromptInjection(Guard):
    """Prompt-injection heuristics."""

    name = P.PROMPT_INJECTION
    key = "inj"

    def stages(self, text, fact):
        return [
            {
                "len": F.length(text),
                "hits": F.when(
                    L.any_phrase_of(F.lower(text), P.INJECTION_KEYWORDS),
                    F.regexp_extract_all(F.lower(text), F.lit(INJECTION_REGEX), F.lit(0)),
                ).otherwise(F.array().cast("array<string>")),
                "tricks": TX.has_unicode_tricks(text),
                "special": TX.special_char_count(text),
            }
        ]

    def score(self, text, fact):
        n, hits, tricks, special = fact("len"), fact("hits"), fact("tricks"), fact("special")
        max_len = self.conf["max_prompt_length"]
        k = F.size(hits)
        ratio = F.when(n == 0, _d(0.0)).otherwise(special.cast("double") / n.cast("double"))
        too_long = n > F.lit(max_len)
        dense = ratio > _d(0.4)
        conf = F.least(
            _d(1.0),
            F.when(too_long, _d(0.3)).otherwise(_d(0.0))
            + F.when(k > 0, F.least(_d(0.9), _d(0.4) + k.cast("double") * _d(0.2))).otherwise(
                _d(0.0)
            )
            + F.when(tricks, _d(0.3)).otherwise(_d(0.0))
            + F.when(dense, _d(0.2)).otherwise(_d(0.0)),
        )
        reasons = _labels(
            [
                (
                    too_long,
                    F.concat(
                        F.lit("Prompt exceeds maximum length ("),
                        n.cast("string"),
                        F.lit(f" > {max_len})"),
                    ),
                ),
                (
                    k > 0,
                    F.concat(F.lit(P.MSG_INJ_PATTERNS), R.py_list_repr(F.slice(hits, 1, 5))),
                ),
                (tricks, P.MSG_INJ_UNICODE),
                (dense, F.concat(F.lit(P.MSG_INJ_SPECIAL), TX.ratio_2dp(special, n))),
            ]
        )
        fail = _meets(conf, self.conf["confidence_threshold"])
        return F.when(
            fail,
            R.make(
                self.name, False, _action(self.conf["action"]), "critical", P.MSG_INJ_FAIL, conf, reasons
            ),
        ).otherwise(R.passing(self.name, P.MSG_INJ_PASS, conf))


class _LexiconGuard(Guard):
    lexicon: dict[str, list[str]] = {}
    list_key = ""

    @property
    def categories(self) -> list[str]:
        return [c for c in self.conf.get(self.list_key, []) if c in self.lexicon]

    def stages(self, text, fact):
        return [
            {
                f"n_{c}": n
                for c, n in L.category_counts(F.lower(text), self.lexicon, self.categories)
            }
        ]

    def counts(self, fact) -> list[tuple[str, Column]]:
        return [(c, fact(f"n_{c}")) for c in self.categories]


class ToxicContent(_LexiconGuard):
    """Toxic-language lexicon."""

    name = P.TOXIC_CONTENT
    key = "tox"
    lexicon = P.TOXIC_KEYWORDS
    list_key = "categories"

    def score(self, text, fact):
        counts = self.counts(fact)
        if not counts:
            return R.passing(self.name, P.MSG_TOXIC_PASS)
        total = _sum([n for _, n in counts])
        cats = _sum([F.when(n > 0, 1).otherwise(0) for _, n in counts])
        conf = F.least(
            _d(1.0),
            _d(0.6) + cats.cast("double") * _d(0.15) + total.cast("double") * _d(0.05),
        )
        found = _labels([(n > 0, c) for c, n in counts])
        fail = (cats > 0) & _meets(conf, self.conf["confidence_threshold"])
        return F.when(
            fail,
            R.make(
                self.name,
                False,
                _action(self.conf["action"]),
                "high",
                F.concat(F.lit(P.MSG_TOXIC_FAIL), R.join_labels(found)),
                conf,
                found,
                total,
            ),
        ).otherwise(R.passing(self.name, P.MSG_TOXIC_PASS))


class TopicRestriction(_LexiconGuard):
    """C4: blocked topics; any hit fails (no threshold)."""

    name = P.TOPIC_RESTRICTION
    key = "top"
    lexicon = P.BLOCKED_TOPIC_KEYWORDS
    list_key = "blocked_topics"

    def score(self, text, fact):
        counts = self.counts(fact)
        if not counts:
            return R.passing(self.name, P.MSG_TOPIC_PASS)
        total = _sum([n for _, n in counts])
        conf = F.least(_d(1.0), _d(0.75) + total.cast("double") * _d(0.1))
        found = _labels([(n > 0, c) for c, n in counts])
        return F.when(
            total > 0,
            R.make(
                self.name,
                False,
                _action(self.conf["action"]),
                "high",
                F.concat(F.lit(P.MSG_TOPIC_FAIL), R.join_labels(found)),
                conf,
                found,
                total,
            ),
        ).otherwise(R.passing(self.name, P.MSG_TOPIC_PASS))


# -------------------------------------------------------------------- output


class PIIRedactor(Guard):
    """Redact each type in order; counts are taken on the running text."""

    name = P.PII_REDACTOR
    key = "red"

    @property
    def types(self) -> list[str]:
        return [t for t in self.conf.get("redact_types", []) if t in P.PII_PATTERNS]

    def stages(self, text, fact):
        char = self.conf.get("redaction_char", "*")
        out: list[dict[str, Column]] = []
        current = text
        for i, t in enumerate(self.types):
            out.append({f"n{i}": pii.count(current, t)})
            n = fact(f"n{i}")
            out.append({f"t{i}": F.when(n > 0, pii.redact(current, t, char)).otherwise(current)})
            current = fact(f"t{i}")
        return out

    def modified_text(self, fact):
        return fact(f"t{len(self.types) - 1}") if self.types else None

    def score(self, text, fact):
        counts = [(t, fact(f"n{i}")) for i, t in enumerate(self.types)]
        if not counts:
            return R.passing(self.name, P.MSG_REDACT_PASS)
        total = _sum([n for _, n in counts])
        found = _labels([(n > 0, t) for t, n in counts])
        return F.when(
            total > 0,
            R.make(
                self.name,
                True,
                "redact",
                "medium",
                F.concat(F.lit(P.MSG_REDACT_FAIL), R.join_labels(found)),
                0.9,
                found,
                total,
                self.modified_text(fact),
            ),
        ).otherwise(R.passing(self.name, P.MSG_REDACT_PASS))


class Hallucination(Guard):
    """Statistic, assertion and citation markers."""

    name = P.HALLUCINATION
    key = "hal"

    def stages(self, text, fact):
        return [
            {
                "stat": L.marker_count(text, L.STATISTIC),
                "assert": L.marker_count(text, L.ASSERTION),
                "cite": L.marker_count(text, L.CITATION),
            }
        ]

    def score(self, text, fact):
        s, a, c = fact("stat"), fact("assert"), fact("cite")
        conf = F.least(
            _d(1.0),
            F.when(s > 0, F.least(_d(0.5), _d(0.2) + s.cast("double") * _d(0.15))).otherwise(
                _d(0.0)
            )
            + F.when(a > 0, F.least(_d(0.5), _d(0.15) + a.cast("double") * _d(0.1))).otherwise(
                _d(0.0)
            )
            + F.when(c > 0, F.least(_d(0.5), _d(0.25) + c.cast("double") * _d(0.2))).otherwise(
                _d(0.0)
            ),
        )
        indicators = _labels(
            [
                (s > 0, F.concat(F.lit(P.MSG_HALL_STATS), s.cast("string"))),
                (a > 0, F.concat(F.lit(P.MSG_HALL_ASSERT), a.cast("string"))),
                (c > 0, F.concat(F.lit(P.MSG_HALL_CITE), c.cast("string"))),
            ]
        )
        fail = _meets(conf, self.conf["confidence_threshold"])
        return F.when(
            fail,
            R.make(
                self.name,
                False,
                _action(self.conf["action"]),
                "medium",
                P.MSG_HALL_FAIL,
                conf,
                indicators,
            ),
        ).otherwise(R.passing(self.name, P.MSG_HALL_PASS, conf))


class ContentFilter(Guard):
    """Toxic lexicon (every category), harmful steps, system-prompt leaks."""

    name = P.CONTENT_FILTER
    key = "cf"

    def stages(self, text, fact):
        cats = list(P.TOXIC_KEYWORDS)
        facts = {
            f"n_{c}": n for c, n in L.category_counts(F.lower(text), P.TOXIC_KEYWORDS, cats)
        }
        facts["harm"] = L.marker_found(text, L.HARMFUL_INSTRUCTION)
        facts["leak"] = L.marker_found(text, L.SYSTEM_LEAK)
        return [facts]

    def score(self, text, fact):
        counts = [(c, fact(f"n_{c}")) for c in P.TOXIC_KEYWORDS]
        harm, leak = fact("harm"), fact("leak")
        conf = _d(0.0)
        for _, n in counts:
            conf = conf + F.when(n > 0, _d(0.5)).otherwise(_d(0.0))
        conf = conf + F.when(harm, _d(0.3)).otherwise(_d(0.0))
        conf = F.least(_d(1.0), conf + F.when(leak, _d(0.5)).otherwise(_d(0.0)))
        violations = _labels(
            [
                (
                    n > 0,
                    F.concat(
                        F.lit(f"Toxic content ({c}): "), n.cast("string"), F.lit(" matches")
                    ),
                )
                for c, n in counts
            ]
            + [(harm, P.MSG_FILTER_HARMFUL), (leak, P.MSG_FILTER_LEAK)]
        )
        fail = _meets(conf, self.conf["confidence_threshold"])
        return F.when(
            fail,
            R.make(
                self.name, False, _action(self.conf["action"]), "high", P.MSG_FILTER_FAIL, conf, violations
            ),
        ).otherwise(R.passing(self.name, P.MSG_FILTER_PASS, conf))


class OutputValidator(Guard):
    """Blank / too long, then the JSON contract when a schema is given.

    The schema arrives per row as ``output_type`` (STRING) and
    ``output_required`` (ARRAY<STRING>) columns, and ``output_schema_given``
    (BOOLEAN) says that the request has one: a schema of neither type nor
    required keys still asks for valid JSON.  Without the flag a schema is given
    when either of the two is set.  ``output_error`` says why a schema cannot be applied:
    valid JSON then ends in the fail-closed result (E3).
    """

    name = P.OUTPUT_VALIDATOR
    key = "val"

    def __init__(
        self,
        conf,
        type_col: Column | None = None,
        required_col: Column | None = None,
        given_col: Column | None = None,
        error_col: Column | None = None,
    ):
        super().__init__(conf)
        self.given_col = given_col
        self.error_col = error_col
        self.type_col = type_col if type_col is not None else F.lit(None).cast("string")
        self.required_col = (
            required_col if required_col is not None else F.lit(None).cast("array<string>")
        )

    def schema_given(self) -> Column:
        implied = self.type_col.isNotNull() | (F.coalesce(F.size(self.required_col), F.lit(0)) > 0)
        return implied if self.given_col is None else F.coalesce(self.given_col, implied)

    def stages(self, text, fact):
        from guardspark.functions import jsoncheck as J

        facts = {"blank": TX.is_blank(text), "len": F.length(text)}
        if self.conf.get("enforce_schema", True):
            check = self.schema_given()
            facts["valid"] = F.when(check, J.is_valid(text))
            facts["root"] = F.when(check, J.root_type(text))
            # keys matter to a valid object with required ones alone
            needed = (F.size(self.required_col) > 0) & fact("valid") & (fact("root") == "dict")
            return [facts, {"keys": F.when(needed, J.object_keys(text))}]
        return [facts]

    def score(self, text, fact):
        from guardspark.functions import jsoncheck as J

        max_len = self.conf["max_output_length"]
        n = fact("len")
        first = F.when(fact("blank"), F.lit(P.MSG_VALID_EMPTY)).when(
            n > F.lit(max_len),
            F.concat(
                F.lit("Output exceeds maximum length ("),
                n.cast("string"),
                F.lit(f" > {max_len})"),
            ),
        )
        items = [first]
        if self.conf.get("enforce_schema", True):
            schema_issue = J.contract_violation(
                fact("valid"), fact("root"), fact("keys"), self.type_col, self.required_col
            )
            items.append(F.when(self.schema_given(), schema_issue))
        violations = F.array_compact(F.array(*items))
        broken = F.lit(False)
        if self.error_col is not None and self.conf.get("enforce_schema", True):
            broken = self.error_col.isNotNull() & self.schema_given() & F.coalesce(fact("valid"), F.lit(False))
        return F.when(broken, R.error(self.name, "TypeError", self.error_col if self.error_col is not None else F.lit(""))).when(
            F.size(violations) > 0,
            R.make(
                self.name,
                False,
                _action(self.conf["action"]),
                "medium",
                F.concat(F.lit(P.MSG_VALID_FAIL), F.array_join(violations, "; ")),
                1.0,
                violations,
            ),
        ).otherwise(R.passing(self.name, P.MSG_VALID_PASS))
