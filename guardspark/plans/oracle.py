"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each SQL text recomputes a query from the same parquet tables with DuckDB
functions only.  Patterns come from ``functions.patterns`` in their RE2 form;
the guard arithmetic, labels and messages are restated in SQL.  RE2 classes
are ASCII where Java's ``(?U)`` classes are Unicode; the shipped tables give
identical matches either way (checked per document at sf0.01 and sf0.1).
"""

from __future__ import annotations

from guardspark import policy as PL
from guardspark.functions import patterns as P
from guardspark.plans import catalog as C
from guardspark.sources import requests as RQ

S = P.sql_str


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def phrase(key: str) -> str:
    k = len(RQ.FIXTURE_PHRASES)
    arr = "[" + ", ".join(S(p) for p in RQ.FIXTURE_PHRASES) + "]"
    return f"{arr}[((({key}) % {k}) + {k}) % {k} + 1]"


def with_phrase(text: str, key: str) -> str:
    p = phrase(key)
    return f"(CASE WHEN {p} = '' THEN {text} ELSE {text} || ' ' || {p} END)"


def count(t: str, regex: str, ic: bool = False) -> str:
    return f"len(regexp_extract_all({t}, {S(P.re2(regex, ic))}))"


def pii_count(t: str, typ: str) -> str:
    return count(t, P.PII_PATTERNS[typ])


def pii_re(typ: str) -> str:
    return S(P.re2(P.PII_PATTERNS[typ]))


def replace_matches(t: str, regex_sql: str, fn) -> str:
    z = "z"
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, {regex_sql}), "
        f"regexp_extract_all({t}, {regex_sql})), lambda {z}: {z}[1] || "
        f"CASE WHEN {z}[2] IS NULL THEN '' ELSE {fn(z + '[2]')} END), '')"
    )


def labels(pairs: list[tuple[str, str]]) -> str:
    if not pairs:
        return "[]::VARCHAR[]"
    items = ", ".join(f"CASE WHEN {c} THEN {lab} END" for c, lab in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def join(lst: str, sep: str) -> str:
    return f"array_to_string({lst}, {S(sep)})"


def struct_fields(name, passed, action, severity, message, confidence, labs, match_count) -> dict:
    return {
        "guard_name": S(name),
        "passed": passed,
        "action": action,
        "severity": severity,
        "message": message,
        "confidence": confidence,
        "labels": labs,
        "match_count": match_count,
    }


def passing(name: str, message: str, confidence: str = "0.0::DOUBLE") -> dict:
    return struct_fields(
        name, "true", "'pass'", "'low'", S(message), confidence, "[]::VARCHAR[]", "NULL::INTEGER"
    )


def choose(cond: str, a: dict, b: dict) -> dict:
    return {k: f"(CASE WHEN {cond} THEN {a[k]} ELSE {b[k]} END)" for k in a}


FIELDS = ["guard_name", "passed", "action", "severity", "message", "confidence", "labels", "match_count"]


# ---------------------------------------------------------------- guards
# Each guard: facts(t, p) -> list of stages [(name, expr)], score(t, p) -> fields.


def _sum(xs: list[str]) -> str:
    return "(" + " + ".join(xs) + ")" if xs else "0"


class PII:
    def __init__(self, conf):
        self.conf = conf
        self.types = [t for t in conf.get("detect_types", []) if t in P.PII_PATTERNS]

    def facts(self, t, p):
        return [[(f"{p}n_{x}", pii_count(t, x)) for x in self.types]]

    def score(self, t, p):
        if not self.types:
            return passing(P.PII_DETECTOR, P.MSG_PII_PASS)
        ns = [f"{p}n_{x}" for x in self.types]
        total = _sum(ns)
        conf = f"least({d(1)}, {d(0.7)} + ({total}) * {d(0.1)})"
        labs = labels([(f"{p}n_{x} > 0", S(x)) for x in self.types])
        fail = f"({total} > 0 AND {conf} >= {d(self.conf['confidence_threshold'])})"
        f = struct_fields(
            P.PII_DETECTOR, "false", S(self.conf["action"]), "'high'",
            f"{S(P.MSG_PII_FAIL)} || {join(labs, ', ')}", conf, labs, f"({total})::INTEGER",
        )
        return choose(fail, f, passing(P.PII_DETECTOR, P.MSG_PII_PASS))


INJ = P.alternation(P.INJECTION_KEYWORDS)
SPACE_CLASS = P.PY_SPACE_CLASS
ALNUM_SPACE = r"[\p{L}\p{N}" + SPACE_CLASS + "]"
TRICKS = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in P.UNICODE_TRICK_CHARS) + "]"


def special_count(t: str) -> str:
    return f"length(regexp_replace({t}, {S(ALNUM_SPACE)}, '', 'g'))"


def ratio_2dp(s: str, n: str) -> str:
    # DuckDB's printf formats the double itself, as the rules do
    return f"printf('%.2f', ({s})::DOUBLE / ({n})::DOUBLE)"


class Injection:
    def __init__(self, conf):
        self.conf = conf

    def facts(self, t, p):
        return [[
            (f"{p}len", f"length({t})"),
            (f"{p}hits", f"regexp_extract_all(lower({t}), {S(P.re2(INJ, True))})"),
            (f"{p}tricks", f"regexp_matches({t}, {S(TRICKS)})"),
            (f"{p}special", special_count(t)),
        ]]

    def score(self, t, p):
        n, hits, tricks, sp = f"{p}len", f"{p}hits", f"{p}tricks", f"{p}special"
        mx = self.conf["max_prompt_length"]
        k = f"len({hits})"
        ratio = f"(CASE WHEN {n} = 0 THEN {d(0)} ELSE {sp}::DOUBLE / {n}::DOUBLE END)"
        too_long, dense = f"({n} > {mx})", f"({ratio} > {d(0.4)})"
        conf = (
            f"least({d(1)}, (CASE WHEN {too_long} THEN {d(0.3)} ELSE {d(0)} END)"
            f" + (CASE WHEN {k} > 0 THEN least({d(0.9)}, {d(0.4)} + {k} * {d(0.2)}) ELSE {d(0)} END)"
            f" + (CASE WHEN {tricks} THEN {d(0.3)} ELSE {d(0)} END)"
            f" + (CASE WHEN {dense} THEN {d(0.2)} ELSE {d(0)} END))"
        )
        rep = (
            f"'[' || array_to_string(list_transform(list_slice({hits}, 1, 5), "
            f"lambda x: '''' || x || ''''), ', ') || ']'"
        )
        labs = labels([
            (too_long, f"'Prompt exceeds maximum length (' || {n}::VARCHAR || ' > {mx})'"),
            (f"{k} > 0", f"{S(P.MSG_INJ_PATTERNS)} || {rep}"),
            (tricks, S(P.MSG_INJ_UNICODE)),
            (dense, f"{S(P.MSG_INJ_SPECIAL)} || {ratio_2dp(sp, n)}"),
        ])
        fail = f"({conf} >= {d(self.conf['confidence_threshold'])})"
        f = struct_fields(
            P.PROMPT_INJECTION, "false", S(self.conf["action"]), "'critical'",
            S(P.MSG_INJ_FAIL), conf, labs, "NULL::INTEGER",
        )
        return choose(fail, f, passing(P.PROMPT_INJECTION, P.MSG_INJ_PASS, conf))


class _Lex:
    lexicon: dict = {}
    key = ""

    def __init__(self, conf):
        self.conf = conf
        self.cats = [c for c in conf.get(self.key, []) if c in self.lexicon]

    def facts(self, t, p):
        return [[
            (f"{p}n_{c}", count(f"lower({t})", P.alternation(self.lexicon[c]), True))
            for c in self.cats
        ]]


class Toxic(_Lex):
    lexicon = P.TOXIC_KEYWORDS
    key = "categories"

    def score(self, t, p):
        if not self.cats:
            return passing(P.TOXIC_CONTENT, P.MSG_TOXIC_PASS)
        ns = [f"{p}n_{c}" for c in self.cats]
        total = _sum(ns)
        cats = _sum([f"(CASE WHEN {x} > 0 THEN 1 ELSE 0 END)" for x in ns])
        conf = f"least({d(1)}, {d(0.6)} + {cats} * {d(0.15)} + {total} * {d(0.05)})"
        labs = labels([(f"{p}n_{c} > 0", S(c)) for c in self.cats])
        fail = f"({cats} > 0 AND {conf} >= {d(self.conf['confidence_threshold'])})"
        f = struct_fields(
            P.TOXIC_CONTENT, "false", S(self.conf["action"]), "'high'",
            f"{S(P.MSG_TOXIC_FAIL)} || {join(labs, ', ')}", conf, labs, f"({total})::INTEGER",
        )
        return choose(fail, f, passing(P.TOXIC_CONTENT, P.MSG_TOXIC_PASS))


class Topic(_Lex):
    lexicon = P.BLOCKED_TOPIC_KEYWORDS
    key = "blocked_topics"

    def score(self, t, p):
        if not self.cats:
            return passing(P.TOPIC_RESTRICTION, P.MSG_TOPIC_PASS)
        total = _sum([f"{p}n_{c}" for c in self.cats])
        conf = f"least({d(1)}, {d(0.75)} + {total} * {d(0.1)})"
        labs = labels([(f"{p}n_{c} > 0", S(c)) for c in self.cats])
        f = struct_fields(
            P.TOPIC_RESTRICTION, "false", S(self.conf["action"]), "'high'",
            f"{S(P.MSG_TOPIC_FAIL)} || {join(labs, ', ')}", conf, labs, f"({total})::INTEGER",
        )
        return choose(f"({total} > 0)", f, passing(P.TOPIC_RESTRICTION, P.MSG_TOPIC_PASS))


class Redactor:
    def __init__(self, conf):
        self.conf = conf
        self.types = [t for t in conf.get("redact_types", []) if t in P.PII_PATTERNS]

    def facts(self, t, p):
        ch = self.conf.get("redaction_char", "*")
        stages, cur = [], t
        for i, x in enumerate(self.types):
            stages.append([(f"{p}n{i}", pii_count(cur, x))])
            red = replace_matches(cur, pii_re(x), lambda m: f"repeat({S(ch)}, length({m}))")
            stages.append([(f"{p}t{i}", f"CASE WHEN {p}n{i} > 0 THEN {red} ELSE {cur} END")])
            cur = f"{p}t{i}"
        return stages

    def final_text(self, t, p):
        return f"{p}t{len(self.types) - 1}" if self.types else t

    def score(self, t, p):
        if not self.types:
            return passing(P.PII_REDACTOR, P.MSG_REDACT_PASS)
        total = _sum([f"{p}n{i}" for i in range(len(self.types))])
        labs = labels([(f"{p}n{i} > 0", S(x)) for i, x in enumerate(self.types)])
        f = struct_fields(
            P.PII_REDACTOR, "true", "'redact'", "'medium'",
            f"{S(P.MSG_REDACT_FAIL)} || {join(labs, ', ')}", d(0.9), labs, f"({total})::INTEGER",
        )
        return choose(f"({total} > 0)", f, passing(P.PII_REDACTOR, P.MSG_REDACT_PASS))


class Halluc:
    def __init__(self, conf):
        self.conf = conf

    def facts(self, t, p):
        return [[
            (f"{p}s", count(t, P.STATISTIC, True)),
            (f"{p}a", count(t, P.ASSERTION, True)),
            (f"{p}c", count(t, P.CITATION, True)),
        ]]

    def score(self, t, p):
        s, a, c = f"{p}s", f"{p}a", f"{p}c"
        conf = (
            f"least({d(1)}, (CASE WHEN {s} > 0 THEN least({d(0.5)}, {d(0.2)} + {s} * {d(0.15)}) ELSE {d(0)} END)"
            f" + (CASE WHEN {a} > 0 THEN least({d(0.5)}, {d(0.15)} + {a} * {d(0.1)}) ELSE {d(0)} END)"
            f" + (CASE WHEN {c} > 0 THEN least({d(0.5)}, {d(0.25)} + {c} * {d(0.2)}) ELSE {d(0)} END))"
        )
        labs = labels([
            (f"{s} > 0", f"{S(P.MSG_HALL_STATS)} || {s}::VARCHAR"),
            (f"{a} > 0", f"{S(P.MSG_HALL_ASSERT)} || {a}::VARCHAR"),
            (f"{c} > 0", f"{S(P.MSG_HALL_CITE)} || {c}::VARCHAR"),
        ])
        fail = f"({conf} >= {d(self.conf['confidence_threshold'])})"
        f = struct_fields(
            P.HALLUCINATION, "false", S(self.conf["action"]), "'medium'", S(P.MSG_HALL_FAIL),
            conf, labs, "NULL::INTEGER",
        )
        return choose(fail, f, passing(P.HALLUCINATION, P.MSG_HALL_PASS, conf))


class Filter:
    def __init__(self, conf):
        self.conf = conf

    def facts(self, t, p):
        out = [
            (f"{p}n_{c}", count(f"lower({t})", P.alternation(ph), True))
            for c, ph in P.TOXIC_KEYWORDS.items()
        ]
        out.append((f"{p}harm", f"regexp_matches({t}, {S(P.re2(P.HARMFUL_INSTRUCTION, True))})"))
        out.append((f"{p}leak", f"regexp_matches({t}, {S(P.re2(P.SYSTEM_LEAK, True))})"))
        return [out]

    def score(self, t, p):
        terms = [f"(CASE WHEN {p}n_{c} > 0 THEN {d(0.5)} ELSE {d(0)} END)" for c in P.TOXIC_KEYWORDS]
        terms.append(f"(CASE WHEN {p}harm THEN {d(0.3)} ELSE {d(0)} END)")
        terms.append(f"(CASE WHEN {p}leak THEN {d(0.5)} ELSE {d(0)} END)")
        conf = f"least({d(1)}, {d(0)} + " + " + ".join(terms) + ")"
        labs = labels(
            [
                (f"{p}n_{c} > 0", f"'Toxic content ({c}): ' || {p}n_{c}::VARCHAR || ' matches'")
                for c in P.TOXIC_KEYWORDS
            ]
            + [(f"{p}harm", S(P.MSG_FILTER_HARMFUL)), (f"{p}leak", S(P.MSG_FILTER_LEAK))]
        )
        fail = f"({conf} >= {d(self.conf['confidence_threshold'])})"
        f = struct_fields(
            P.CONTENT_FILTER, "false", S(self.conf["action"]), "'high'", S(P.MSG_FILTER_FAIL),
            conf, labs, "NULL::INTEGER",
        )
        return choose(fail, f, passing(P.CONTENT_FILTER, P.MSG_FILTER_PASS, conf))


JSON_TYPE_NAMES = (
    "CASE json_type({t}) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' "
    "WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' "
    "WHEN 'DOUBLE' THEN 'float' ELSE 'int' END"
)


def plain_json(t: str) -> str:
    """The text with the literals NaN and -Infinity (which the data hold outside
    strings alone) as plain numbers, so that every JSON function reads them."""
    return f"regexp_replace({t}, '-?Infinity|NaN', '1.5', 'g')"


TYPE_ACCEPTS = {
    "object": ["dict"], "array": ["list"], "string": ["str"],
    "number": ["int", "float", "bool"], "boolean": ["bool"],
}


def json_violation(valid: str, root: str, keys: str, expected: str, required: str) -> str:
    ok = "true"
    for t, acc in TYPE_ACCEPTS.items():
        lst = ", ".join(S(a) for a in acc)
        ok = f"(CASE WHEN {expected} = {S(t)} THEN {root} IN ({lst}) ELSE {ok} END)"
    missing = (
        f"list_filter(coalesce({required}, []::VARCHAR[]), "
        f"lambda q: NOT coalesce(list_contains({keys}, q), false))"
    )
    return (
        f"(CASE WHEN NOT {valid} THEN {S(P.MSG_VALID_JSON)} "
        f"WHEN {expected} IS NOT NULL AND {expected} <> '' AND NOT {ok} THEN "
        f"'Output type mismatch: expected ' || {expected} || ', got ' || {root} "
        f"WHEN {root} = 'dict' AND len({missing}) > 0 THEN "
        f"{S(P.MSG_VALID_MISSING)} || array_to_string({missing}, ', ') END)"
    )


def is_blank(t: str) -> str:
    return f"(length(regexp_replace({t}, {S('[' + SPACE_CLASS + ']')}, '', 'g')) = 0)"


class Validator:
    def __init__(self, conf, type_col=None, req_col=None, given_col=None):
        self.conf = conf
        self.type_col = type_col
        self.req_col = req_col
        self.given_col = given_col

    def given(self):
        return "false" if self.type_col is None else self.given_col

    def facts(self, t, p):
        out = [(f"{p}blank", is_blank(t)), (f"{p}len", f"length({t})")]
        if self.type_col is not None:
            j = plain_json(t)
            root = JSON_TYPE_NAMES.format(t=j)
            out += [
                (f"{p}valid", f"coalesce(json_valid({j}), false)"),
                (f"{p}root", f"CASE WHEN coalesce(json_valid({j}), false) THEN {root} END"),
                (
                    f"{p}keys",
                    f"CASE WHEN coalesce(json_valid({j}), false) AND json_type({j}) = 'OBJECT' "
                    f"THEN json_keys({j}) END",
                ),
            ]
        return [out]

    def score(self, t, p):
        mx = self.conf["max_output_length"]
        first = (
            f"CASE WHEN {p}blank THEN {S(P.MSG_VALID_EMPTY)} WHEN {p}len > {mx} THEN "
            f"'Output exceeds maximum length (' || {p}len::VARCHAR || ' > {mx})' END"
        )
        items = [first]
        if self.type_col is not None:
            v = json_violation(f"{p}valid", f"{p}root", f"{p}keys", self.type_col, self.req_col)
            items.append(f"CASE WHEN {self.given()} THEN {v} END")
        viol = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
        f = struct_fields(
            P.OUTPUT_VALIDATOR, "false", S(self.conf["action"]), "'medium'",
            f"{S(P.MSG_VALID_FAIL)} || array_to_string({viol}, '; ')", d(1), viol, "NULL::INTEGER",
        )
        return choose(f"len({viol}) > 0", f, passing(P.OUTPUT_VALIDATOR, P.MSG_VALID_PASS))


def input_guards():
    return [
        PII(PL.guard_conf(None, "pii_detector")),
        Injection(PL.guard_conf(None, "prompt_injection")),
        Toxic(PL.guard_conf(None, "toxic_content")),
        Topic(PL.guard_conf(None, "topic_restriction")),
    ]


def output_guards(type_col=None, req_col=None, given_col=None):
    return [
        Redactor(PL.guard_conf(None, "pii_redactor")),
        Halluc(PL.guard_conf(None, "hallucination_detector")),
        Filter(PL.guard_conf(None, "content_filter")),
        Validator(PL.guard_conf(None, "output_validator"), type_col, req_col, given_col),
    ]


# ------------------------------------------------------------ plan helpers


def layered(base_sql: str, layers: list[list[tuple[str, str]]]) -> str:
    """Nest one SELECT per layer of (name, expr) pairs over ``base_sql``."""
    sql = base_sql
    for i, layer in enumerate(layers):
        if not layer:
            continue
        cols = ", ".join(f"{e} AS {n}" for n, e in layer)
        sql = f"SELECT *, {cols} FROM ({sql}) AS l{i}"
    return sql


def guard_layers(guards, t: str, prefix: str):
    """Fact layers, score fields per guard, and the final text column."""
    layers: list[list[tuple[str, str]]] = []
    scores = []
    cur = t
    for i, g in enumerate(guards):
        p = f"{prefix}{i}_"
        layers.extend(g.facts(cur, p))
        scores.append((p, g.score(cur, p)))
        if isinstance(g, Redactor):
            cur = g.final_text(cur, p)
    score_layer = [(f"{p}{k}", v) for p, fs in scores for k, v in fs.items()]
    layers.append(score_layer)
    return layers, [p for p, _ in scores], cur


def flat(p: str, out_prefix: str = "") -> str:
    cols = []
    for k in FIELDS:
        v = f"{p}{k}"
        if k == "labels":
            v = f"array_to_string({v}, '|')"
        cols.append(f"{v} AS {out_prefix}{k}")
    return ", ".join(cols)


def single_guard(base_sql: str, key_cols: str, guard, t: str = "t", extra: str = "") -> str:
    layers, ps, cur = guard_layers([guard], t, "g")
    inner = layered(base_sql, layers)
    ex = f", {extra.format(final=cur)}" if extra else ""
    return f"SELECT {key_cols}, {flat(ps[0])}{ex} FROM ({inner}) AS q"


def chain_rows(
    base_sql: str, keys: list[str], guards, t: str, prefix: str, extra: list[str] = (),
    null_error: bool = True,
) -> tuple[str, str]:
    """(inner SQL with guard fields, exploded SQL: one row per kept result)."""
    layers, ps, cur = guard_layers(guards, t, prefix)
    inner = layered(base_sql, layers)
    parts = []
    for i, p in enumerate(ps):
        conds = [f"{q}action <> 'block'" for q in ps[:i]]
        if i == 0 and null_error:
            err = struct_fields(
                guards[0].name if hasattr(guards[0], "name") else _NAMES[type(guards[0])],
                "false", "'block'", "'critical'", S(P.MSG_GUARD_ERROR + "TypeError"), d(1),
                "['object of type ''NoneType'' has no len()']", "NULL::INTEGER",
            )
            fields = choose(f"{t} IS NULL", err, {k: f"{p}{k}" for k in FIELDS})
            cols = ", ".join(
                f"{('array_to_string(' + v + ', ' + S('|') + ')') if k == 'labels' else v} AS {k}"
                for k, v in fields.items()
            )
        else:
            cols = flat(p)
            if null_error:
                conds.append(f"{t} IS NOT NULL")
        where = f" WHERE {' AND '.join(conds)}" if conds else ""
        ex = "".join(f", {e}" for e in extra)
        parts.append(f"SELECT {', '.join(keys)}{ex}, {i} AS pos, {cols} FROM inner_q{where}")
    return inner, " UNION ALL ".join(parts), cur


_NAMES = {
    PII: P.PII_DETECTOR, Injection: P.PROMPT_INJECTION, Toxic: P.TOXIC_CONTENT,
    Topic: P.TOPIC_RESTRICTION, Redactor: P.PII_REDACTOR, Halluc: P.HALLUCINATION,
    Filter: P.CONTENT_FILTER, Validator: P.OUTPUT_VALIDATOR,
}


def chain_sql(base_sql, keys, guards, t, prefix, extra=(), null_error=True, final_as=None):
    inner, union, cur = chain_rows(base_sql, keys, guards, t, prefix, list(extra), null_error)
    if final_as:
        inner = f"SELECT *, {cur} AS {final_as} FROM ({inner}) AS f"
    return f"WITH inner_q AS ({inner}) {union}"


# ----------------------------------------------------------------- queries

DOC_PROMPTS = f"SELECT doc_id, {with_phrase('text', 'doc_id')} AS t FROM documents"
DOCS_RAW = "SELECT doc_id, text AS t FROM documents"


def q_single(guard, raw=False, extra=""):
    return single_guard(DOCS_RAW if raw else DOC_PROMPTS, "doc_id", guard, "t", extra)


def json_outputs() -> str:
    k = len(C.JSON_CASES)
    alter = {
        "as_is": "props",
        "wrap_array": "'[' || props || ']'",
        "value_only": "regexp_extract(props, ':\\s*(-?[0-9.]+)', 1)",
        "trailing_junk": "props || ' trailing'",
        "quoted": "'\"' || replace(props, '\"', chr(39)) || '\"'",
        "truncated": "substring(props, 1, length(props) - 1)",
        "not_a_number": "'{\"extra\": NaN, \"props\": ' || props || '}'",
    }

    def type_of(t):
        return S(t) if t is not None else "NULL::VARCHAR"

    def names(r):
        return "[" + ", ".join(S(x) for x in r) + "]::VARCHAR[]"

    txt, typ, req, giv = [], [], [], []
    for i, (given, t, r, how) in enumerate(C.JSON_CASES):
        txt.append(f"WHEN {i} THEN {alter[how]}")
        typ.append(f"WHEN {i} THEN {type_of(t)}")
        req.append(f"WHEN {i} THEN {names(r)}")
        giv.append(f"WHEN {i} THEN {str(given).lower()}")
    idx = f"(event_id % {k})"
    rows = "".join(
        f" UNION ALL SELECT {i}::BIGINT, {S(x)}, {type_of(t)}, {names(r)}, {str(g).lower()}"
        for i, x, g, t, r in C.JSON_ROWS
    )
    return (
        f"SELECT event_id, CASE {idx} {' '.join(txt)} END AS t, "
        f"CASE {idx} {' '.join(typ)} END AS output_type, "
        f"CASE {idx} {' '.join(req)} END AS output_required, "
        f"CASE {idx} {' '.join(giv)} END AS given FROM events{rows}"
    )


def q_output_validate():
    g = Validator(PL.guard_conf(None, "output_validator"), "output_type", "output_required", "given")
    return single_guard(json_outputs(), "event_id", g)


def q_json_contract():
    j = plain_json("t")
    root = JSON_TYPE_NAMES.format(t=j)
    base = (
        f"SELECT *, coalesce(json_valid({j}), false) AS valid, "
        f"CASE WHEN coalesce(json_valid({j}), false) THEN {root} END AS root_type, "
        f"CASE WHEN coalesce(json_valid({j}), false) AND json_type({j}) = 'OBJECT' "
        f"THEN json_keys({j}) END AS keys FROM ({json_outputs()}) AS j"
    )
    v = json_violation("valid", "root_type", "keys", "output_type", "output_required")
    return f"SELECT event_id, valid, root_type, {v} AS violation FROM ({base}) AS b"


def q_text_profile():
    sp = "[" + SPACE_CLASS + "]"
    norm = f"regexp_replace(regexp_replace(text, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0B}}]+', ' ', 'g'), '^{sp}+|{sp}+$', '', 'g')"
    clean = (
        "regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}\\p{Pc}\\s\\x{85}\\x{A0}\\x{1680}"
        "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}.,!?;:''\"-]', '', 'g')"
    )
    n = C.TRUNCATE_AT
    return (
        f"SELECT doc_id, {norm} AS normalized, lower(text) AS lowered, {clean} AS cleaned, "
        f"CASE WHEN length(text) <= {n} THEN text ELSE substring(text, 1, {n}) || '...' END "
        f"AS truncated, greatest(1, length(text) // 4)::INTEGER AS approx_tokens FROM documents"
    )


def q_unicode_tricks():
    return f"SELECT doc_id, regexp_matches(t, {S(TRICKS)}) AS has_tricks FROM ({DOC_PROMPTS}) AS b"


def q_special_ratio():
    return (
        f"SELECT doc_id, n_special, n AS n_chars, CASE WHEN n = 0 THEN 0.0::DOUBLE "
        f"ELSE n_special::DOUBLE / n::DOUBLE END AS ratio FROM (SELECT doc_id, "
        f"{special_count('t')}::INTEGER AS n_special, length(t)::INTEGER AS n FROM ({DOC_PROMPTS}) AS b) AS s"
    )


def pii_values_sql(keys: str) -> str:
    parts = []
    for typ in P.PII_PATTERNS:
        parts.append(
            f"SELECT {keys}, {S(typ)} AS pii_type, "
            f"unnest(generate_series(0, len(m) - 1))::INTEGER AS pos, unnest(m) AS value "
            f"FROM (SELECT {keys}, regexp_extract_all(text, {pii_re(typ)}) AS m FROM documents) AS x "
            f"WHERE len(m) > 0"
        )
    return " UNION ALL ".join(parts)


def q_pii_type_counts():
    return (
        f"SELECT pii_type, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs "
        f"FROM ({pii_values_sql('doc_id')}) AS v GROUP BY pii_type"
    )


def q_lexicon_hits():
    rows = []
    for lex, cats in (("toxic", P.TOXIC_KEYWORDS), ("topic", P.BLOCKED_TOPIC_KEYWORDS)):
        for c, ph in cats.items():
            rows.append((lex, c, count("lower(t)", P.alternation(ph), True)))
    rows.append(("injection", "injection", count("lower(t)", INJ, True)))
    parts = [
        f"SELECT doc_id, {S(lex)} AS lexicon, {S(c)} AS category, {e} AS hits FROM ({DOC_PROMPTS}) AS b"
        for lex, c, e in rows
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS u WHERE hits > 0"


def q_marker_counts():
    return (
        f"SELECT doc_id, {count('t', P.STATISTIC, True)} AS n_statistic, "
        f"{count('t', P.ASSERTION, True)} AS n_assertion, {count('t', P.CITATION, True)} AS n_citation, "
        f"regexp_matches(t, {S(P.re2(P.HARMFUL_INSTRUCTION, True))}) AS harmful_instruction, "
        f"regexp_matches(t, {S(P.re2(P.SYSTEM_LEAK, True))}) AS system_leak FROM ({DOC_PROMPTS}) AS b"
    )


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def token_sql(typ: str, value: str, rid: str, secret: str) -> str:
    """First 8 digits of HMAC-SHA256(secret, request id, U+0001, value).  The
    shipped tables hold no two values whose first 8 digits clash."""
    key = secret.encode().ljust(64, b"\x00")
    message = f"encode({rid}::VARCHAR || chr(1) || {value})"
    inner = f"sha256({_blob(bytes(b ^ 0x36 for b in key))} || {message})"
    digest = f"sha256({_blob(bytes(b ^ 0x5C for b in key))} || unhex({inner}))"
    return f"({S(P.TOKEN_PREFIX + typ.upper() + '_')} || left({digest}, 8) || {S(P.TOKEN_SUFFIX)})"


def tokenize_layers(t: str, rid: str, types: list[str], secret: str, prefix: str = "v"):
    """Layers adding ``{prefix}m{k}`` (matches) and ``{prefix}t{k}`` (text)."""
    layers, cur = [], t
    for k, typ in enumerate(types):
        layers.append([(f"{prefix}m{k}", f"regexp_extract_all({cur}, {pii_re(typ)})")])
        rep = replace_matches(cur, pii_re(typ), lambda m, _t=typ: token_sql(_t, m, rid, secret))
        layers.append([(f"{prefix}t{k}", f"CASE WHEN len({prefix}m{k}) > 0 THEN {rep} ELSE {cur} END")])
        cur = f"{prefix}t{k}"
    return layers, cur


def pairs_sql(rid: str, types: list[str], secret: str, prefix: str = "v") -> str:
    parts = [
        f"list_transform({prefix}m{k}, lambda x: {{'token': {token_sql(typ, 'x', rid, secret)}, "
        f"'pii_type': {S(typ)}, 'value': x}})"
        for k, typ in enumerate(types)
    ]
    return "list_distinct(flatten([" + ", ".join(parts) + "]))" if parts else "[]"


VAULT_TYPES = PL.guard_conf(None, "pii_vault")["detect_types"]


def tokenized_docs(types=None) -> str:
    layers, cur = tokenize_layers("text", "doc_id", types or VAULT_TYPES, C.VAULT_SECRET)
    inner = layered("SELECT doc_id, text FROM documents", layers)
    return f"SELECT *, {cur} AS tokenized_text FROM ({inner}) AS tk"


def q_vault_tokenize(types=None):
    pairs = pairs_sql("doc_id", types or VAULT_TYPES, C.VAULT_SECRET)
    return (
        f"SELECT doc_id, tokenized_text, len({pairs})::INTEGER AS n_tokens, "
        f"len({pairs}) > 0 AS has_pii FROM ({tokenized_docs(types)}) AS t"
    )


def q_vault_table():
    parts = []
    for k, typ in enumerate(VAULT_TYPES):
        parts.append(
            f"SELECT doc_id, {token_sql(typ, 'value', 'doc_id', C.VAULT_SECRET)} AS token, "
            f"{S(typ)} AS pii_type, value FROM (SELECT doc_id, unnest(vm{k}) AS value "
            f"FROM ({tokenized_docs()}) AS t) AS u"
        )
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ") AS a"


def q_vault_type_counts():
    tok = "'<PII_[A-Z_]+_[0-9a-f]{8}>'"
    return (
        f"SELECT lower(regexp_extract(token, '^<PII_(.*)_[^_]*>$', 1)) AS pii_type, "
        f"count(*) AS n_occurrences, count(DISTINCT token) AS n_tokens, count(DISTINCT doc_id) AS n_docs "
        f"FROM (SELECT doc_id, unnest(regexp_extract_all(tokenized_text, {tok})) AS token "
        f"FROM ({tokenized_docs()}) AS t) AS u GROUP BY 1"
    )


def q_input_chain(base=DOC_PROMPTS):
    return chain_sql(base, ["doc_id"], input_guards(), "t", "i")


def assistant_outputs() -> str:
    return (
        "SELECT conv_id, turn, "
        + with_phrase("text", "conv_id + turn")
        + " AS t FROM conversations WHERE role = 'assistant'"
    )


def q_output_chain():
    return chain_sql(
        assistant_outputs(), ["conv_id", "turn"], output_guards(), "t", "o",
        extra=["final_text"], final_as="final_text",
    )


def q_fail_closed():
    base = f"SELECT doc_id, {with_phrase('text', 'doc_id')} AS t FROM {beside(13, text='NULL::VARCHAR')} AS dd"
    return q_input_chain(base)


# Verdicts ------------------------------------------------------------------


def _results_summary(layers_ps, t, null_error=True):
    """Per-row: number of kept results, their actions joined, any block/warn."""
    ps = layers_ps
    kept = []
    for i, p in enumerate(ps):
        conds = [f"{q}action <> 'block'" for q in ps[:i]]
        kept.append((conds, p))
    n_terms, act_items = [], []
    for conds, p in kept:
        c = " AND ".join(conds) if conds else "true"
        n_terms.append(f"(CASE WHEN {c} THEN 1 ELSE 0 END)")
        act_items.append(f"CASE WHEN {c} THEN {p}action END")
    acts = f"list_filter([{', '.join(act_items)}], lambda x: x IS NOT NULL)"
    n = "(" + " + ".join(n_terms) + ")"
    if null_error:
        n = f"(CASE WHEN {t} IS NULL THEN 1 ELSE {n} END)"
        acts = f"(CASE WHEN {t} IS NULL THEN ['block'] ELSE {acts} END)"
    return n, acts


def rej_sql(t: str) -> str:
    return (
        f"(CASE WHEN {t} IS NULL THEN 'missing' WHEN length({t}) < 1 THEN 'too_short' "
        f"WHEN length({t}) > {RQ.MAX_REQUEST_CHARS} THEN 'too_long' END)"
    )


CONTRACT_FAILED = "Request validation failed: "


def input_only_sql(base: str, keys: str) -> str:
    layers, ps, _ = guard_layers(input_guards(), "t", "i")
    inner = layered(base, layers)
    n, acts = _results_summary(ps, "t")
    rej = rej_sql("t")
    return (
        f"SELECT {keys}, rej IS NULL AND NOT list_contains(acts, 'block') AS allowed, "
        f"CASE WHEN rej IS NOT NULL OR list_contains(acts, 'block') THEN 'block' "
        f"WHEN list_contains(acts, 'warn') THEN 'warn' ELSE 'pass' END AS overall_action, "
        f"CASE WHEN rej IS NOT NULL THEN {S(CONTRACT_FAILED)} || rej "
        f"WHEN list_contains(acts, 'block') THEN {S(P.SUMMARY_INPUT_BLOCKED)} ELSE "
        f"{S(P.SUMMARY_INPUT_ONLY)} END AS summary, n_in::INTEGER AS n_input_results, "
        f"0 AS n_output_results, array_to_string(acts, '|') AS input_actions, "
        f"'' AS output_actions, NULL::VARCHAR AS output_text "
        f"FROM (SELECT *, {rej} AS rej, CASE WHEN {rej} IS NULL THEN {n} ELSE 0 END AS n_in, "
        f"CASE WHEN {rej} IS NULL THEN {acts} ELSE []::VARCHAR[] END AS acts FROM ({inner}) AS q) AS r"
    )


def q_input_only():
    return input_only_sql(DOC_PROMPTS, "doc_id")


def full_verdict_sql(
    prompts: str, keys: str, response_of: str, secret: str, contract: bool = False, twice: str = "false"
) -> str:
    """E4.  ``prompts`` has keys, rid, t (input), asked; ``response_of`` is an
    SQL expression of ``san`` (sanitized input) and ``resp`` (joined reply).
    With ``contract`` it has output_type, output_required and given; ``twice``
    says of a row that it has more than one response."""
    layers, ps, _ = guard_layers(input_guards(), "t", "i")
    inner = layered(prompts, layers)
    n_in, acts_in = _results_summary(ps, "t")
    rej = rej_sql("t")
    step1 = (
        f"SELECT *, {rej} AS rej, CASE WHEN {rej} IS NULL THEN {n_in} ELSE 0 END AS n_in, "
        f"CASE WHEN {rej} IS NULL THEN {acts_in} ELSE []::VARCHAR[] END AS acts_in FROM ({inner}) AS a"
    )
    wants = "(rej IS NULL AND NOT list_contains(acts_in, 'block') AND coalesce(asked, false))"
    step2 = f"SELECT *, {wants} AS wants, CASE WHEN {wants} THEN t END AS tv FROM ({step1}) AS b"
    vl, vcur = tokenize_layers("tv", "rid", VAULT_TYPES, secret)
    step3 = layered(step2, vl)
    pairs = pairs_sql("rid", VAULT_TYPES, secret)
    step4 = f"SELECT *, {vcur} AS san, {pairs} AS pairs FROM ({step3}) AS c"
    step5 = f"SELECT *, CASE WHEN wants THEN {response_of} END AS o FROM ({step4}) AS e"
    outs = output_guards("output_type", "output_required", "given") if contract else output_guards()
    olayers, ops, ocur = guard_layers(outs, "o", "o")
    oinner = layered(step5, olayers)
    n_out, acts_out = _results_summary(ops, "o", null_error=False)
    restored = (
        f"CASE WHEN len(pairs) > 0 THEN list_reduce(pairs, lambda acc, x: "
        f"replace(acc, x.token, x.value), {ocur}) ELSE {ocur} END"
    )
    step6 = (
        f"SELECT *, (wants AND o IS NOT NULL) AS has_resp, "
        f"CASE WHEN wants AND o IS NOT NULL THEN {n_out} ELSE 0 END AS n_out, "
        f"CASE WHEN wants AND o IS NOT NULL THEN {acts_out} ELSE []::VARCHAR[] END AS acts_out, "
        f"{restored} AS restored FROM ({oinner}) AS g"
    )
    in_block = "list_contains(acts_in, 'block')"
    out_block = "list_contains(acts_out, 'block')"
    warned = "(list_contains(acts_in, 'warn') OR list_contains(acts_out, 'warn'))"
    asked = "coalesce(asked, false)"
    return (
        f"SELECT {keys}, "
        f"CASE WHEN rej IS NOT NULL THEN false WHEN {in_block} THEN false WHEN NOT {asked} THEN true "
        f"WHEN NOT has_resp THEN false "
        f"WHEN {out_block} THEN false ELSE true END AS allowed, "
        f"CASE WHEN rej IS NOT NULL OR {in_block} THEN 'block' WHEN NOT {asked} THEN (CASE WHEN list_contains(acts_in, 'warn') "
        f"THEN 'warn' ELSE 'pass' END) WHEN NOT has_resp THEN 'block' WHEN {out_block} THEN 'block' "
        f"WHEN {warned} THEN 'warn' ELSE 'pass' END AS overall_action, "
        f"CASE WHEN rej IS NOT NULL THEN {S(CONTRACT_FAILED)} || rej "
        f"WHEN {in_block} THEN {S(P.SUMMARY_INPUT_BLOCKED)} WHEN NOT {asked} THEN "
        f"{S(P.SUMMARY_INPUT_ONLY)} WHEN {twice} THEN 'LLM generation failed: DuplicateResponse' WHEN NOT has_resp THEN {S(P.SUMMARY_LLM_FAILED + 'ResponseMissing')} "
        f"WHEN {out_block} THEN {S(P.SUMMARY_OUTPUT_BLOCKED)} WHEN {warned} THEN {S(P.SUMMARY_WARNINGS)} "
        f"ELSE {S(P.SUMMARY_OK)} END AS summary, "
        f"n_in::INTEGER AS n_input_results, n_out::INTEGER AS n_output_results, "
        f"array_to_string(acts_in, '|') AS input_actions, array_to_string(acts_out, '|') AS output_actions, "
        f"CASE WHEN has_resp AND NOT {out_block} THEN restored END AS output_text FROM ({step6}) AS h"
    )


def conversation_prompts() -> str:
    return (
        "SELECT conv_id, user_turn, conv_id::VARCHAR || ':' || user_turn::VARCHAR AS rid, "
        + with_phrase("prompt", "conv_id + user_turn")
        + " AS t, true AS asked, CASE WHEN response IS NULL THEN NULL ELSE "
        + with_phrase("response", "conv_id + assistant_turn")
        + f" END AS resp FROM ({q_turn_pairs()}) AS tp"
    )


def q_request_verdict():
    return full_verdict_sql(conversation_prompts(), "conv_id, user_turn", "resp", C.VAULT_SECRET)


def q_request_verdict_join(in_time: str = "true"):
    n = "(conv_id + user_turn)"
    replies = f"resp IS NOT NULL AND {n} % 5 <> 0 AND {in_time}"
    prompts = (
        f"SELECT conv_id, user_turn, rid, t, {n} % 11 <> 0 AS asked, "
        f"CASE WHEN {replies} AND {n} % 7 <> 0 THEN resp END AS resp, ({replies} AND {n} % 7 = 0) AS twice, "
        f"CASE WHEN {n} % 3 = 0 THEN 'object' END AS output_type, []::VARCHAR[] AS output_required, "
        f"{n} % 3 = 0 AS given FROM ({conversation_prompts()}) AS cp"
    )
    return full_verdict_sql(prompts, "conv_id, user_turn", "resp", C.VAULT_SECRET, True, "(wants AND twice)")


def q_request_verdict_streams():
    return q_request_verdict_join("(conv_id + user_turn) % 13 <> 0")


def q_request_verdict_echo():
    prompts = f"SELECT doc_id, doc_id AS rid, {with_phrase('text', 'doc_id')} AS t, true AS asked FROM documents"
    return full_verdict_sql(prompts, "doc_id", "'You said: ' || san", C.VAULT_SECRET)


def q_custom_guard():
    word, stars = "the", "***"
    base = "SELECT doc_id, text AS t FROM documents"
    n = "(length(t) - length(replace(t, 'the', ''))) // 3"
    mod = f"replace(t, {S(word)}, {S(stars)})"
    g0 = (
        f"CASE WHEN {n} = 0 THEN 'WordRedactGuard' ELSE 'WordRedactGuard' END AS guard_name, true AS passed, "
        f"CASE WHEN {n} = 0 THEN 'pass' ELSE 'redact' END AS action, "
        f"CASE WHEN {n} = 0 THEN 'low' ELSE 'medium' END AS severity, "
        f"CASE WHEN {n} = 0 THEN 'Word not found' ELSE 'Redacted word: the' END AS message, "
        f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, "
        f"CASE WHEN {n} = 0 THEN '' ELSE 'the' END AS labels, "
        f"CASE WHEN {n} = 0 THEN NULL ELSE ({n})::INTEGER END AS match_count"
    )
    cur = f"CASE WHEN {n} = 0 THEN t ELSE {mod} END"
    pii = PII(PL.guard_conf(None, "pii_detector"))
    layers, ps, _ = guard_layers([pii], "u", "c")
    inner = layered(f"SELECT doc_id, t, {cur} AS u FROM ({base}) AS b", layers)
    return (
        f"SELECT doc_id, u AS final_text, 0 AS pos, {g0} FROM ({inner}) AS q "
        f"UNION ALL SELECT doc_id, u AS final_text, 1 AS pos, {flat(ps[0])} FROM ({inner}) AS q2"
    )


def _native_guard(name: str, hit: str, action: str, message: str) -> dict:
    """Fields of a native user guard: an error where its condition is null."""
    err = struct_fields(
        name, "false", "'block'", "'critical'", "'Guard execution error: UndecidedCondition'", d(1),
        "['the condition is null']", "NULL::INTEGER",
    )
    fail = struct_fields(name, "false", S(action), "'high'", S(message), d(1), "[]::VARCHAR[]", "NULL::INTEGER")
    return choose(f"({hit}) IS NULL", err, choose(hit, fail, passing(name, "")))


def q_custom_guard_native():
    hit = "CASE WHEN length(t) % 7 <> 0 THEN contains(t, '!!') END"
    rule = _native_guard("ShoutGuard", hit, "warn", "Shouting")
    layers, ps, _ = guard_layers([PII(PL.guard_conf(None, "pii_detector"))], "t", "c")
    inner = layered(layered(DOCS_RAW, [[(f"r_{k}", v) for k, v in rule.items()]]), layers)
    return (
        f"SELECT doc_id, 0 AS pos, {flat('r_')} FROM ({inner}) AS q UNION ALL "
        f"SELECT doc_id, 1 AS pos, {flat(ps[0])} FROM ({inner}) AS q2 WHERE r_action <> 'block'"
    )


def q_chain_block_then_redact():
    rule = _native_guard("LengthGuard", "length(t) % 2 = 0", "block", "Even length")
    red = Redactor(PL.guard_conf(None, "pii_redactor"))
    layers, ps, cur = guard_layers([red], "t", "b")
    inner = layered(layered(DOCS_RAW, [[(f"r_{k}", v) for k, v in rule.items()]]), layers)
    final = f"CASE WHEN r_action = 'block' THEN t ELSE {cur} END AS final_text"
    return (
        f"SELECT doc_id, {final}, 0 AS pos, {flat('r_')} FROM ({inner}) AS q UNION ALL "
        f"SELECT doc_id, {final}, 1 AS pos, {flat(ps[0])} FROM ({inner}) AS q2 WHERE r_action <> 'block'"
    )


def q_block_rate_stream():
    return (
        f"SELECT w.* FROM ({q_block_rate_window()}) AS w "
        "WHERE window_end <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"
    )


def q_pii_by_source_bound():
    return (
        "SELECT pii_type, source, count(*) AS n_matches, true AS within_bound "
        f"FROM ({pii_values_sql('doc_id, source')}) AS v GROUP BY pii_type, source"
    )


def _conversation_events_parts():
    """Input and output event rows of the conversation verdicts."""
    layers, ps, _ = guard_layers(input_guards(), "t", "i")
    inner = layered(conversation_prompts(), layers)
    in_rows = []
    for i, p in enumerate(ps):
        conds = [f"{rej_sql('t')} IS NULL"] + [f"{q}action <> 'block'" for q in ps[:i]]
        where = f" WHERE {' AND '.join(conds)}"
        in_rows.append(
            f"SELECT conv_id, user_turn, 'input' AS stage, {i} AS pos, {p}guard_name AS guard_name, "
            f"{p}passed AS passed, {p}action AS action, {p}severity AS severity, "
            f"{p}confidence AS confidence, array_to_string({p}labels, '|') AS labels, "
            f"{p}match_count AS match_count FROM ({inner}) AS q{where}"
        )
    blocked_in = " OR ".join(f"{q}action = 'block'" for q in ps)
    step = (
        f"SELECT *, CASE WHEN {rej_sql('t')} IS NULL AND NOT ({blocked_in}) THEN resp END AS o "
        f"FROM ({inner}) AS s"
    )
    olayers, ops, _ = guard_layers(output_guards(), "o", "o")
    oinner = layered(step, olayers)
    out_rows = []
    for i, p in enumerate(ops):
        conds = ["o IS NOT NULL"] + [f"{q}action <> 'block'" for q in ops[:i]]
        out_rows.append(
            f"SELECT conv_id, user_turn, 'output' AS stage, {i} AS pos, {p}guard_name AS guard_name, "
            f"{p}passed AS passed, {p}action AS action, {p}severity AS severity, "
            f"{p}confidence AS confidence, array_to_string({p}labels, '|') AS labels, "
            f"{p}match_count AS match_count FROM ({oinner}) AS r WHERE {' AND '.join(conds)}"
        )
    return " UNION ALL ".join(in_rows + out_rows)


def q_guard_events():
    return _conversation_events_parts()


def q_guard_rollup():
    return (
        "SELECT guard_name, action, severity, count(*) AS n_runs, "
        "round(avg(confidence), 6) AS avg_confidence, "
        "sum(CASE WHEN passed THEN 0 ELSE 1 END)::BIGINT AS n_failed "
        f"FROM ({_conversation_events_parts()}) AS e GROUP BY CUBE (guard_name, action, severity)"
    )


def q_pii_by_source():
    return (
        "SELECT pii_type, source, count(*) AS n_matches, count(DISTINCT value) AS n_distinct_values "
        f"FROM ({pii_values_sql('doc_id, source')}) AS v GROUP BY pii_type, source"
    )


def q_toxic_eval():
    g = Toxic(PL.guard_conf(None, "toxic_content"))
    s = single_guard(DOC_PROMPTS, "doc_id", g)
    return (
        "SELECT tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE END AS precision, "
        "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE END AS recall FROM ("
        "SELECT sum(CASE WHEN f AND y THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN f AND NOT y THEN 1 ELSE 0 END)::BIGINT AS fp, "
        "sum(CASE WHEN NOT f AND y THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN NOT f AND NOT y THEN 1 ELSE 0 END)::BIGINT AS tn "
        f"FROM (SELECT NOT g.passed AS f, l.toxic = 1 AS y FROM ({s}) AS g JOIN labels l USING (doc_id)) AS j) AS c"
    )


def q_request_reader():
    bad = "CASE k WHEN 2 THEN 'broken_json' WHEN 5 THEN 'input_text_type' WHEN 6 THEN 'context_type' END"
    return (
        "SELECT doc_id, CASE WHEN k <> 2 THEN doc_id::VARCHAR END AS request_id, "
        f"CASE WHEN {bad} IS NULL THEN text END AS input_text, CASE WHEN k = 1 THEN source END AS context_source, "
        "k IN (1, 3, 4, 7) AS process_with_llm, CASE WHEN k = 3 THEN 'object' END AS output_type, "
        "CASE k WHEN 3 THEN 'a,b' WHEN 4 THEN 'a' ELSE '' END AS output_required, k IN (3, 4, 7) AS output_schema_given, "
        f"CASE WHEN k = 4 THEN {S(LIST_TYPE_ERROR)} END AS output_error, {bad} AS reader_error "
        "FROM (SELECT *, doc_id % 8 AS k FROM documents) AS d"
    )


LIST_TYPE_ERROR = "unhashable type: 'list'"


def q_verdict_sink():
    base = "SELECT event_id AS doc_id, ts, " + with_phrase("concat_ws(' ', event_type, props)", "event_id") + " AS t FROM events"
    cols = "doc_id AS event_id, ts::DATE::VARCHAR AS day"
    return f"SELECT event_id, day, allowed, overall_action, summary, input_actions FROM ({input_only_sql(base, cols)}) AS v"


def q_toxic_curve():
    g = Toxic(PL.guard_conf(None, "toxic_content") | {"confidence_threshold": 0.0})
    s = single_guard(DOC_PROMPTS, "doc_id", g)
    return (
        "SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE END AS precision, "
        "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE END AS recall FROM ("
        "SELECT threshold, n_flagged, tp, n_flagged - tp AS fp, "
        "(SELECT sum(toxic) FROM labels JOIN documents USING (doc_id))::BIGINT - tp AS fn FROM ("
        "SELECT threshold, (sum(n) OVER w)::BIGINT AS n_flagged, (sum(pos) OVER w)::BIGINT AS tp FROM ("
        "SELECT confidence AS threshold, count(*) AS n, sum(toxic) AS pos "
        f"FROM (SELECT g.confidence, l.toxic FROM ({s}) AS g JOIN labels l USING (doc_id)) AS j GROUP BY confidence) AS c "
        "WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS a) AS b"
    )


def q_request_quarantine():
    odd = "CASE (doc_id // 17) % 3 WHEN 0 THEN '' WHEN 1 THEN rpad(text, 50001, 'x') END"
    return (
        "SELECT doc_id, CASE WHEN r IS NULL THEN 'accepted' ELSE 'quarantined' END AS status, r AS reason "
        "FROM (SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'too_short' "
        f"WHEN length(text) > 50000 THEN 'too_long' END AS r FROM {beside(17, text=odd)} AS b) AS c"
    )


def q_verdict_flat():
    base = DOC_PROMPTS
    layers, ps, _ = guard_layers(input_guards(), "t", "i")
    inner = layered(base, layers)
    blocked = " OR ".join(f"{p}action = 'block'" for p in ps)
    parts = []
    for i, p in enumerate(ps):
        conds = [f"{rej_sql('t')} IS NULL"] + [f"{q}action <> 'block'" for q in ps[:i]]
        where = f" WHERE {' AND '.join(conds)}"
        parts.append(
            f"SELECT doc_id, NOT ({blocked}) AS allowed, CASE WHEN {blocked} THEN 'block' "
            f"WHEN {_kept_warn(ps)} THEN 'warn' ELSE 'pass' END AS overall_action, {i} AS pos, "
            f"{flat(p)} FROM ({inner}) AS q{where}"
        )
    return " UNION ALL ".join(parts)


def _kept_warn(ps) -> str:
    terms = []
    for i, p in enumerate(ps):
        conds = [f"{q}action <> 'block'" for q in ps[:i]] + [f"{p}action = 'warn'"]
        terms.append("(" + " AND ".join(conds) + ")")
    return "(" + " OR ".join(terms) + ")"


def q_turn_pairs(base: str = "conversations"):
    return (
        "SELECT conv_id, user_turn, prompt, CASE WHEN r = 'assistant' THEN n END AS assistant_turn, "
        "CASE WHEN r = 'assistant' THEN x END AS response FROM ("
        "SELECT conv_id, turn AS user_turn, role, text AS prompt, lead(turn) OVER w AS n, "
        f"lead(role) OVER w AS r, lead(text) OVER w AS x FROM {base} WHERE conv_id IS NOT NULL AND turn IS NOT NULL "
        "WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) AS l WHERE role = 'user' "
        f"UNION ALL SELECT conv_id, turn, text, NULL, NULL FROM {base} "
        "WHERE role = 'user' AND (conv_id IS NULL OR turn IS NULL)"
    )


def q_turn_pairs_beside():
    base = (
        "(SELECT conv_id, turn, role, text FROM conversations "
        "UNION ALL SELECT -conv_id - 1, turn, role, text FROM conversations WHERE conv_id % 7 = 0 "
        "UNION ALL SELECT -conv_id - 1, turn, role, coalesce(text, '') || ' again' FROM conversations WHERE conv_id % 7 = 0 "
        "UNION ALL SELECT NULL, turn, role, text FROM conversations WHERE conv_id % 13 = 0 "
        "UNION ALL SELECT conv_id, NULL, role, text FROM conversations WHERE conv_id % 17 = 0) AS c"
    )
    return q_turn_pairs(base)


# Tier settings, restated: thresholds and actions of the three tiers with a policy row.
TENANT_TIERS = """(VALUES ('strict', 0.7::DOUBLE, 'block', 0.6::DOUBLE, 'block', 'block'),
 ('standard', 0.8::DOUBLE, 'warn', 0.7::DOUBLE, 'block', 'warn'),
 ('lenient', 0.9::DOUBLE, 'warn', 0.9::DOUBLE, 'warn', 'warn'))
 AS tp(tenant_tier, pii_threshold, pii_action, injection_threshold, toxic_action, topic_action)"""


def beside(every: int, **columns: str) -> str:
    """Documents and, under the id -doc_id - 1, every n-th one changed."""
    cols = ["text", "source"]
    changed = ", ".join(f"{columns.get(c, c)} AS {c}" for c in cols)
    return (
        f"(SELECT doc_id, text, source FROM documents UNION ALL "
        f"SELECT -doc_id - 1 AS doc_id, {changed} FROM documents WHERE doc_id % {every} = 0)"
    )


def q_tenant_policy():
    n = "TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)"
    default = ", ".join(
        f"coalesce({c}, {v}) AS {c}"
        for c, v in (
            ("pii_threshold", d(0.8)), ("pii_action", "'warn'"), ("injection_threshold", d(0.7)),
            ("toxic_action", "'block'"), ("topic_action", "'warn'"),
        )
    )
    base = (
        f"SELECT doc_id, t, tenant_tier, {default} FROM (SELECT doc_id, {with_phrase('text', 'doc_id')} AS t, "
        f"CASE WHEN {n} < 7 THEN 'strict' WHEN {n} < 14 THEN 'standard' WHEN {n} < 18 THEN 'lenient' "
        f"WHEN {n} >= 18 THEN 'trial' END AS tenant_tier FROM {beside(10, source="'partner'")} AS dd) AS b "
        f"LEFT JOIN {TENANT_TIERS} USING (tenant_tier)"
    )

    pii_c = dict(PL.guard_conf(None, "pii_detector"))
    inj_c = dict(PL.guard_conf(None, "prompt_injection"))
    tox_c = dict(PL.guard_conf(None, "toxic_content"))
    top_c = dict(PL.guard_conf(None, "topic_restriction"))
    guards = [_TenantPII(pii_c), _TenantInj(inj_c), _TenantToxic(tox_c), _TenantTopic(top_c)]
    layers, ps, _ = guard_layers(guards, "t", "i")
    inner = layered(base, layers)
    n, acts = _results_summary(ps, "t")
    rej = rej_sql("t")
    return (
        "SELECT doc_id, rej IS NULL AND NOT list_contains(acts, 'block') AS allowed, "
        "CASE WHEN rej IS NOT NULL OR list_contains(acts, 'block') THEN 'block' "
        "WHEN list_contains(acts, 'warn') THEN 'warn' ELSE 'pass' END AS overall_action, "
        f"CASE WHEN rej IS NOT NULL THEN {S(CONTRACT_FAILED)} || rej "
        f"WHEN list_contains(acts, 'block') THEN {S(P.SUMMARY_INPUT_BLOCKED)} ELSE "
        f"{S(P.SUMMARY_INPUT_ONLY)} END AS summary, n_in::INTEGER AS n_input_results, "
        "0 AS n_output_results, array_to_string(acts, '|') AS input_actions, "
        "'' AS output_actions, tenant_tier "
        f"FROM (SELECT *, {rej} AS rej, CASE WHEN {rej} IS NULL THEN {n} ELSE 0 END AS n_in, "
        f"CASE WHEN {rej} IS NULL THEN {acts} ELSE []::VARCHAR[] END AS acts FROM ({inner}) AS q) AS r"
    )


class _TenantPII(PII):
    def score(self, t, p):
        c = dict(self.conf)
        return _swap(PII(c).score(t, p), c["confidence_threshold"], "pii_threshold", self.conf["action"])


class _TenantInj(Injection):
    def score(self, t, p):
        return _swap(Injection(self.conf).score(t, p), self.conf["confidence_threshold"], "injection_threshold", None)


class _TenantToxic(Toxic):
    def score(self, t, p):
        return _swap(Toxic(self.conf).score(t, p), None, None, self.conf["action"], "toxic_action")


class _TenantTopic(Topic):
    def score(self, t, p):
        return _swap(Topic(self.conf).score(t, p), None, None, self.conf["action"], "topic_action")


def _swap(fields, threshold, threshold_col, action, action_col=None):
    """Per-tenant twin: thresholds and actions read from the tier columns."""
    out = {}
    for k, v in fields.items():
        if threshold is not None and threshold_col:
            v = v.replace(f">= {d(threshold)}", f">= {threshold_col}")
        out[k] = v
    if action is not None:
        col = action_col or "pii_action"
        out["action"] = out["action"].replace(S(action), col)
    return out


def _event_guard_rows() -> str:
    base = (
        "SELECT event_id AS doc_id, ts, "
        + with_phrase("concat_ws(' ', event_type, props)", "event_id")
        + " AS t FROM events"
    )
    layers, ps, _ = guard_layers(input_guards(), "t", "i")
    inner = layered(base, layers)
    parts = []
    for i, p in enumerate(ps):
        conds = [f"{q}action <> 'block'" for q in ps[:i]]
        where = f" WHERE {' AND '.join(conds)}" if conds else ""
        parts.append(f"SELECT ts, {p}guard_name AS guard_name, {p}action AS action FROM ({inner}) AS q{where}")
    return " UNION ALL ".join(parts)


_WINDOWED = (
    "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, "
    "time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end, guard_name, "
    "count(*) AS n_runs, sum(CASE WHEN action = 'block' THEN 1 ELSE 0 END)::BIGINT AS n_blocks"
)


def q_block_rate_window():
    return f"{_WINDOWED} FROM ({_event_guard_rows()}) AS e GROUP BY 1, 2, 3"


def q_block_rate_late():
    """The last quarter of the time comes first; all other rows of windows that have closed are late."""
    quarter = "((epoch_us(ts) - epoch_us(t0)) * 4 // (epoch_us(t1) - epoch_us(t0) + 1))"
    return (
        f"SELECT * FROM ({_WINDOWED}, sum(CASE WHEN {quarter} < 3 THEN 1 ELSE 0 END)::BIGINT AS n_late "
        f"FROM ({_event_guard_rows()}) AS e, (SELECT min(ts) AS t0, max(ts) AS t1 FROM events) AS b GROUP BY 1, 2, 3) AS w "
        "WHERE window_end <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"
    )


ORACLE_SQL: dict[str, str] = {
    "request_quarantine": q_request_quarantine(),
    "verdict_flat": q_verdict_flat(),
    "turn_pairs": q_turn_pairs_beside(),
    "tenant_policy_verdict": q_tenant_policy(),
    "text_profile": q_text_profile(),
    "pii_redact": q_single(
        Redactor(PL.guard_conf(None, "pii_redactor")),
        extra="CASE WHEN g0_action = 'redact' THEN {final} END AS modified_text",
    ),
    "pii_redact_file_order": q_single(
        Redactor(
            PL.guard_conf(
                PL.overlay(
                    PL.DEFAULT_POLICY,
                    {"output_guards": {"pii_redactor": {"redact_types": C.FILE_REDACT_ORDER}}},
                ),
                "pii_redactor",
            )
        ),
        extra="CASE WHEN g0_action = 'redact' THEN {final} END AS modified_text",
    ),
    "unicode_tricks": q_unicode_tricks(),
    "special_char_ratio": q_special_ratio(),
    "pii_matches": pii_values_sql("doc_id"),
    "pii_type_counts": q_pii_type_counts(),
    "lexicon_hits": q_lexicon_hits(),
    "marker_counts": q_marker_counts(),
    "json_contract": q_json_contract(),
    "pii_detect": q_single(PII(PL.guard_conf(None, "pii_detector")), raw=True),
    "injection_detect": q_single(Injection(PL.guard_conf(None, "prompt_injection"))),
    "toxic_detect": q_single(Toxic(PL.guard_conf(None, "toxic_content"))),
    "topic_detect": q_single(Topic(PL.guard_conf(None, "topic_restriction"))),
    "hallucination_detect": q_single(Halluc(PL.guard_conf(None, "hallucination_detector"))),
    "content_filter": q_single(Filter(PL.guard_conf(None, "content_filter"))),
    "output_validate": q_output_validate(),
    "vault_tokenize": q_vault_tokenize(),
    "vault_tokenize_file_order": q_vault_tokenize(C.FILE_REDACT_ORDER),
    "vault_table": q_vault_table(),
    "vault_roundtrip": "SELECT doc_id, text AS restored_text FROM documents",
    "vault_type_counts": q_vault_type_counts(),
    "input_guard_chain": q_input_chain(),
    "output_guard_chain": q_output_chain(),
    "fail_closed": q_fail_closed(),
    "request_verdict": q_request_verdict(),
    "request_verdict_join": q_request_verdict_join(),
    "request_verdict_echo": q_request_verdict_echo(),
    "input_only_verdict": q_input_only(),
    "custom_guard": q_custom_guard(),
    "custom_guard_native": q_custom_guard_native(),
    "chain_block_then_redact": q_chain_block_then_redact(),
    "guard_events": q_guard_events(),
    "guard_rollup": q_guard_rollup(),
    "pii_by_source": q_pii_by_source(),
    "pii_by_source_approx": q_pii_by_source_bound(),
    "toxic_eval": q_toxic_eval(),
    "stream_screen": q_input_only(),
    "stream_verdict": q_request_verdict_echo(),
    "block_rate_window": q_block_rate_window(),
    "block_rate_stream": q_block_rate_stream(),
    "block_rate_late": q_block_rate_late(),
    "lexicon_table_hits": q_lexicon_hits(),
    "request_reader": q_request_reader(),
    "request_reader_stream": q_request_reader(),
    "verdict_sink": q_verdict_sink(),
    "toxic_curve": q_toxic_curve(),
    "pii_sketch_merge": (
        "SELECT pii_type, source, count(*) AS n_matches, true AS merged_is_one_pass, true AS within_bound "
        f"FROM ({pii_values_sql('doc_id, source')}) AS v GROUP BY pii_type, source"
    ),
    "request_verdict_streams": q_request_verdict_streams(),
    "vault_stream": q_vault_table(),
    "vault_stream_roundtrip": "SELECT doc_id, text AS restored_text FROM documents",
}

ORACLE_SQL["toxic_detect_table"] = ORACLE_SQL["toxic_detect"]
ORACLE_SQL["pii_matches_chunked"] = ORACLE_SQL["pii_matches"]
