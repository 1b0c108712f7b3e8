"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads the shipped tables and returns a
DataFrame of flat columns (nested results are flattened so that a value
comparison sees every field).  Lexicon, marker and Unicode queries append
the fixture phrase chosen by ``id % k`` (``sources.requests``), because the
tables hold no such text of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark import policy as PL
from guardspark.functions import jsoncheck as J
from guardspark.functions import lexicon as L
from guardspark.functions import patterns as P
from guardspark.functions import text as TX
from guardspark.operators import audit as A
from guardspark.operators import guards as G
from guardspark.operators import lexicon_table as LX
from guardspark.operators import longtext as LONG
from guardspark.operators import result as R
from guardspark.operators import vault as V
from guardspark.plans import chain, custom
from guardspark.plans import verdict as VD
from guardspark.session import checkpoint_root, read_table
from guardspark.sources import reader as RD
from guardspark.sources import requests as RQ
from guardspark.sources import tenants as TN
from guardspark.streaming import late as LT
from guardspark.streaming import responses as RS
from guardspark.streaming import sinks as SK
from guardspark.streaming import stream as ST

Query = Callable[[SparkSession, str], DataFrame]

VAULT_SECRET = "guardspark-fixture-secret"
TRUNCATE_AT = 100

# Output contracts for the JSON queries, keyed by event_id % len(...):
# (schema given, output_type, output_required, how the props text is altered).
JSON_CASES: list[tuple[bool, str | None, list[str], str]] = [
    (True, "object", ["k"], "as_is"),
    (True, "object", ["k", "name"], "as_is"),
    (True, "array", [], "as_is"),
    (True, "object", ["k"], "wrap_array"),
    (True, "number", [], "value_only"),
    (True, "object", [], "trailing_junk"),
    (True, "string", [], "quoted"),
    (True, None, ["k"], "truncated"),
    (True, "integer", [], "as_is"),
    (True, None, [], "truncated"),  # a schema of neither type nor required keys
    (False, None, [], "truncated"),  # no schema: no JSON check
    (True, "object", ["extra"], "not_a_number"),
]

# Outputs that no table holds, beside the derived ones: ids below 0.
JSON_ROWS: list[tuple[int, str, bool, str | None, list[str]]] = [
    (-1, " \n\t ", True, "object", ["k"]),
    (-2, "true", True, "boolean", []),
    (-3, "1.5e3", True, "boolean", []),
    (-4, "1.5e3", True, "number", []),
    (-5, "NaN", True, "number", []),
    (-6, '{"a": [1, -Infinity]}', True, "object", ["a"]),
    (-7, '{"a": 1, "a": 2}', True, "object", ["a"]),
    (-8, "not json", True, None, []),
    (-9, "not json", False, None, []),
    (-10, "x" * 50_001, False, None, []),
    # texts that end the array they are read in, with a mark of their own
    (-11, '1,"\ue000\ue001"] not json at all', True, "number", []),
    (-12, f'1,"{hashlib.sha256(b"1").hexdigest()}"] not json at all', True, "number", []),
    (-13, '1,"x"]', True, "number", []),
    (-14, '{"k": 1}]', True, "object", ["k"]),
]


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _doc_prompts(spark, sf_dir, add_phrase=True, keep=()):
    return RQ.prompts(_docs(spark, sf_dir), add_phrase=add_phrase, keep=keep)


_apply_guard = chain.apply_guard


def _guard_query(guard: G.Guard, keep_modified: bool = False) -> Query:
    def q(spark, sf_dir):
        df = _doc_prompts(spark, sf_dir)
        df = _apply_guard(df, "input_text", guard)
        extra = [F.col("r.modified_text").alias("modified_text")] if keep_modified else []
        return df.select(F.col("request_id").alias("doc_id"), *R.flatten(F.col("r")), *extra)

    return q


def pii_detect(spark, sf_dir):
    """C1 with the shipped policy (threshold 0.8, warn): one hit passes."""
    df = _doc_prompts(spark, sf_dir, add_phrase=False)
    df = _apply_guard(df, "input_text", G.PIIDetector(PL.guard_conf(None, "pii_detector")))
    return df.select(F.col("request_id").alias("doc_id"), *R.flatten(F.col("r")))


injection_detect = _guard_query(G.PromptInjection(PL.guard_conf(None, "prompt_injection")))
toxic_detect = _guard_query(G.ToxicContent(PL.guard_conf(None, "toxic_content")))
topic_detect = _guard_query(G.TopicRestriction(PL.guard_conf(None, "topic_restriction")))
hallucination_detect = _guard_query(
    G.Hallucination(PL.guard_conf(None, "hallucination_detector"))
)
content_filter = _guard_query(G.ContentFilter(PL.guard_conf(None, "content_filter")))
pii_redact = _guard_query(G.PIIRedactor(PL.guard_conf(None, "pii_redactor")), keep_modified=True)

# The shipped file's redaction order (email, phone, ssn, credit_card,
# ip_address): a 16-digit card is first redacted as a phone number.
FILE_REDACT_ORDER = ["email", "phone", "ssn", "credit_card", "ip_address"]
pii_redact_file_order = _guard_query(
    G.PIIRedactor(
        PL.guard_conf(
            PL.overlay(PL.DEFAULT_POLICY, {"output_guards": {"pii_redactor": {"redact_types": FILE_REDACT_ORDER}}}),
            "pii_redactor",
        )
    ),
    keep_modified=True,
)


def _json_outputs(spark, sf_dir) -> DataFrame:
    """Output texts with contracts, derived from ``events.props``."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "props")
    idx = F.pmod(F.col("event_id"), F.lit(len(JSON_CASES))).cast("int")
    props = F.col("props")
    alter = {
        "as_is": props,
        "wrap_array": F.concat(F.lit("["), props, F.lit("]")),
        "value_only": F.regexp_extract(props, r":\s*(-?[0-9.]+)", 1),
        "trailing_junk": F.concat(props, F.lit(" trailing")),
        "quoted": F.concat(F.lit('"'), F.regexp_replace(props, '"', "'"), F.lit('"')),
        "truncated": F.expr("substring(props, 1, length(props) - 1)"),
        "not_a_number": F.concat(F.lit('{"extra": NaN, "props": '), props, F.lit("}")),
    }
    cases = [
        F.struct(
            alter[how].alias("output_text"),
            F.lit(t).cast("string").alias("output_type"),
            F.array(*[F.lit(x) for x in r]).cast("array<string>").alias("output_required"),
            F.lit(given).alias("output_schema_given"),
        )
        for given, t, r, how in JSON_CASES
    ]
    derived = ev.select("event_id", F.get(F.array(*cases), idx).alias("c")).select("event_id", "c.*")
    fixed = spark.createDataFrame(
        [(i, x, t, r, g) for i, x, g, t, r in JSON_ROWS],
        "event_id long, output_text string, output_type string, output_required array<string>, output_schema_given boolean",
    )
    return derived.unionByName(fixed)


def output_validate(spark, sf_dir):
    """C8 on derived JSON outputs with per-row contracts."""
    df = _json_outputs(spark, sf_dir)
    g = G.OutputValidator(
        PL.guard_conf(None, "output_validator"),
        F.col("output_type"),
        F.col("output_required"),
        F.col("output_schema_given"),
    )
    df = _apply_guard(df, "output_text", g)
    return df.select("event_id", *R.flatten(F.col("r")))


def json_contract(spark, sf_dir):
    """Validity, root type and the first contract failure."""
    t = F.col("output_text")
    df = _json_outputs(spark, sf_dir).select("*", J.is_valid(t).alias("valid"), J.root_type(t).alias("__root"))
    needed = F.col("valid") & (F.col("__root") == "dict") & (F.size("output_required") > 0)
    df = df.select("*", F.when(needed, J.object_keys(t)).alias("__keys"))
    return df.select(
        "event_id",
        "valid",
        F.when(F.col("valid"), F.col("__root")).alias("root_type"),
        J.contract_violation(
            F.col("valid"), F.col("__root"), F.col("__keys"), F.col("output_type"),
            F.col("output_required"),
        ).alias("violation"),
    )


def text_profile(spark, sf_dir):
    """B1-B4, B6 on every document."""
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id",
        TX.normalize_whitespace(t).alias("normalized"),
        TX.to_lowercase(t).alias("lowered"),
        TX.remove_special_characters(t).alias("cleaned"),
        TX.truncate(t, TRUNCATE_AT).alias("truncated"),
        TX.approx_tokens(t).alias("approx_tokens"),
    )


def unicode_tricks(spark, sf_dir):
    """B7."""
    df = _doc_prompts(spark, sf_dir)
    return df.select(
        F.col("request_id").alias("doc_id"),
        TX.has_unicode_tricks(F.col("input_text")).alias("has_tricks"),
    )


def special_char_ratio(spark, sf_dir):
    """B8 with the count and length it comes from."""
    df = _doc_prompts(spark, sf_dir)
    t = F.col("input_text")
    df = df.select("request_id", TX.special_char_count(t).alias("n_special"), F.length(t).alias("n"))
    return df.select(
        F.col("request_id").alias("doc_id"),
        "n_special",
        F.col("n").alias("n_chars"),
        F.when(F.col("n") == 0, 0.0)
        .otherwise(F.col("n_special").cast("double") / F.col("n").cast("double"))
        .alias("ratio"),
    )


def pii_matches(spark, sf_dir):
    """B9 long form: one row per match."""
    return A.pii_values(_docs(spark, sf_dir), "text", ["doc_id"])


#: Chunks of this many characters, so that many of the tables' texts are cut.
QUERY_CHUNK = 1000


def pii_matches_chunked(spark, sf_dir):
    """B9 with each text cut into chunks that several tasks walk."""
    return LONG.pii_values(_docs(spark, sf_dir), "text", ["doc_id"], chunk_chars=QUERY_CHUNK)


def pii_type_counts(spark, sf_dir):
    """B9 counts per type over the corpus."""
    vals = A.pii_values(_docs(spark, sf_dir), "text", ["doc_id"])
    return vals.groupBy("pii_type").agg(
        F.count(F.lit(1)).alias("n_matches"), F.count_distinct("doc_id").alias("n_docs")
    )


def lexicon_hits(spark, sf_dir):
    """B10 long form: (doc, lexicon, category, hits) for every category hit."""
    lexicons = {
        "toxic": P.TOXIC_KEYWORDS,
        "topic": P.BLOCKED_TOPIC_KEYWORDS,
        "injection": {"injection": P.INJECTION_KEYWORDS},
    }
    # the lowered text and one gate a lexicon, each computed once per row
    df = _doc_prompts(spark, sf_dir).select("request_id", F.lower("input_text").alias("low"))
    low = F.col("low")
    df = df.select("*", *[L.any_phrase(low, cats, list(cats)).alias(f"may_{lex}") for lex, cats in lexicons.items()])
    none = F.lit(0).cast("long")
    entries = [
        F.struct(
            F.lit(lex).alias("lexicon"),
            F.lit(c).alias("category"),
            F.when(F.col(f"may_{lex}"), L.phrase_count(low, phrases)).otherwise(none).alias("hits"),
        )
        for lex, cats in lexicons.items()
        for c, phrases in cats.items()
    ]
    hits = F.filter(F.array(*entries), lambda e: e["hits"] > 0)
    return df.select(F.col("request_id").alias("doc_id"), F.inline(hits))


def lexicon_table_hits(spark, sf_dir):
    """B10 with the lexicons as a table (anchor index): the rows of ``lexicon_hits``."""
    lexicon = LX.from_lists(spark, toxic=P.TOXIC_KEYWORDS, topic=P.BLOCKED_TOPIC_KEYWORDS, injection={"injection": P.INJECTION_KEYWORDS})
    df = _doc_prompts(spark, sf_dir)
    return LX.lexicon_hits(df, "request_id", "input_text", lexicon).withColumnRenamed("request_id", "doc_id")


def toxic_detect_table(spark, sf_dir):
    """C3 with its phrases as a table."""
    lexicon = LX.from_lists(spark, toxic=P.TOXIC_KEYWORDS)
    df = _doc_prompts(spark, sf_dir)
    df = LX.guard_result(df, "request_id", "input_text", G.ToxicContent, PL.guard_conf(None, "toxic_content"), lexicon)
    return df.select(F.col("request_id").alias("doc_id"), *R.flatten(F.col("r")))


def marker_counts(spark, sf_dir):
    """B11."""
    df = _doc_prompts(spark, sf_dir)
    t = F.col("input_text")
    return df.select(
        F.col("request_id").alias("doc_id"),
        L.marker_count(t, L.STATISTIC).alias("n_statistic"),
        L.marker_count(t, L.ASSERTION).alias("n_assertion"),
        L.marker_count(t, L.CITATION).alias("n_citation"),
        L.marker_found(t, L.HARMFUL_INSTRUCTION).alias("harmful_instruction"),
        L.marker_found(t, L.SYSTEM_LEAK).alias("system_leak"),
    )


def _tokenized(spark, sf_dir, types=None):
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    types = types or PL.guard_conf(None, "pii_vault")["detect_types"]
    return V.tokenize(docs, "text", "doc_id", types, VAULT_SECRET)


def _tokenized_texts(df):
    return df.select(
        "doc_id", "tokenized_text", F.size("vault_pairs").alias("n_tokens"),
        V.has_pii(F.col("vault_pairs")).alias("has_pii"),
    )


def vault_tokenize(spark, sf_dir):
    """D1."""
    return _tokenized_texts(_tokenized(spark, sf_dir))


def vault_tokenize_file_order(spark, sf_dir):
    """D1 in the shipped file's type order: a card is tokenized as a phone
    number and the digits behind it."""
    return _tokenized_texts(_tokenized(spark, sf_dir, FILE_REDACT_ORDER))


def vault_table(spark, sf_dir):
    """D2."""
    return V.vault_table(_tokenized(spark, sf_dir), "doc_id").withColumnRenamed(
        "request_id", "doc_id"
    )


def vault_roundtrip(spark, sf_dir):
    """D3 across jobs: tokenized texts and the vault are stored in the shared
    folder (``vault.store``); a later job restores every text from them."""
    import uuid

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    types = PL.guard_conf(None, "pii_vault")["detect_types"]
    root = f"{checkpoint_root(spark)}/vault_roundtrip-{uuid.uuid4().hex[:12]}"
    tokenized, _ = V.store(docs, "text", "doc_id", types, VAULT_SECRET, root)
    texts = tokenized.select("request_id", F.col("tokenized_text").alias("text"))
    restored = V.restore(texts, f"{root}/vault")
    return restored.select(F.col("request_id").alias("doc_id"), F.col("text").alias("restored_text"))


def vault_type_counts(spark, sf_dir):
    """Tokens found in tokenized texts, by the type named in the token."""
    df = _tokenized(spark, sf_dir)
    toks = df.select(
        "doc_id",
        F.explode(F.regexp_extract_all("tokenized_text", F.lit(V.TOKEN_REGEX), F.lit(0))).alias(
            "token"
        ),
    )
    return toks.groupBy(V.token_type(F.col("token")).alias("pii_type")).agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.count_distinct("token").alias("n_tokens"),
        F.count_distinct("doc_id").alias("n_docs"),
    )


def _explode_results(df: DataFrame, keys: list[str], col: str, extra=()) -> DataFrame:
    return df.select(*keys, *extra, R.explode_flat(F.col(col)))


def input_guard_chain(spark, sf_dir):
    """E1 over documents (shipped policy)."""
    df = chain.input_chain(_doc_prompts(spark, sf_dir))
    return _explode_results(df.withColumnRenamed("request_id", "doc_id"), ["doc_id"], "input_results")


def _assistant_outputs(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    key = F.col("conv_id") + F.col("turn")
    return conv.select(
        "conv_id", "turn", RQ.with_phrase(F.col("text"), key).alias("output_text")
    )


def output_guard_chain(spark, sf_dir):
    """E2 over assistant turns: results and the final (redacted) text."""
    df = chain.output_chain(_assistant_outputs(spark, sf_dir))
    return _explode_results(df, ["conv_id", "turn"], "output_results", extra=["final_text"])


def _beside(docs: DataFrame, every: int, **columns) -> DataFrame:
    """The documents and, beside them, a copy of each ``every``-th one under
    the id ``-doc_id - 1`` with the given columns changed."""
    extra = docs.where(F.col("doc_id") % every == 0).withColumns(columns)
    return docs.unionByName(extra.withColumn("doc_id", -F.col("doc_id") - 1))


def fail_closed(spark, sf_dir):
    """Rows without a text (beside the documents) get the fail-closed
    block as their only result."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    docs = _beside(docs, 13, text=F.lit(None).cast("string"))
    df = chain.input_chain(RQ.prompts(docs))
    return _explode_results(df.withColumnRenamed("request_id", "doc_id"), ["doc_id"], "input_results")


def _verdict_cols(keys: list[str]) -> list:
    return [
        *keys,
        "allowed",
        "overall_action",
        "summary",
        F.size("input_results").alias("n_input_results"),
        F.size("output_results").alias("n_output_results"),
        F.array_join(F.transform("input_results", lambda r: r["action"]), "|").alias(
            "input_actions"
        ),
        F.array_join(F.transform("output_results", lambda r: r["action"]), "|").alias(
            "output_actions"
        ),
        "output_text",
    ]


def input_only_verdict(spark, sf_dir):
    """E5."""
    v = VD.input_only_verdict(_doc_prompts(spark, sf_dir))
    return v.select(*_verdict_cols([F.col("request_id").alias("doc_id")]))


def _conversation_requests(spark, sf_dir):
    """User turns as requests; the paired reply travels in the same row."""
    pairs = RQ.turn_pairs(read_table(spark, sf_dir, "conversations"))
    ukey = F.col("conv_id") + F.col("user_turn")
    akey = F.col("conv_id") + F.col("assistant_turn")
    return pairs.select(
        F.concat_ws(":", "conv_id", "user_turn").alias("request_id"),
        "conv_id",
        "user_turn",
        RQ.with_phrase(F.col("prompt"), ukey).alias("input_text"),
        F.lit(True).alias("process_with_llm"),
        F.when(F.col("response").isNotNull(), RQ.with_phrase(F.col("response"), akey)).alias(
            "reply_text"
        ),
    )


def _verdicts_conversations(spark, sf_dir, restore=True):
    prompts = _conversation_requests(spark, sf_dir)
    return VD.request_verdict(prompts, "reply_text", None, secret=VAULT_SECRET, restore=restore)


def request_verdict(spark, sf_dir):
    """E4 on conversations: each user turn, its reply as the model output."""
    v = _verdicts_conversations(spark, sf_dir)
    return v.select(*_verdict_cols(["conv_id", "user_turn"]))


def _asked_and_answered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Requests and, apart from them, their responses: the replies of ``conversations`` keyed by
    request id.  Every 5th request has no response, every 7th has two, and every
    3rd asks for a JSON object, which a plain reply breaks."""
    requests = _conversation_requests(spark, sf_dir)
    n = F.col("conv_id") + F.col("user_turn")
    prompts = requests.drop("reply_text").withColumns(
        {
            "process_with_llm": n % 11 != 0,
            "output_type": F.when(n % 3 == 0, "object"),
            "output_required": F.array().cast("array<string>"),
            "output_schema_given": n % 3 == 0,
        }
    )
    reply = F.col("reply_text")
    replies = requests.where(reply.isNotNull() & (n % 5 != 0)).select(
        "request_id", "conv_id", "user_turn", F.explode(F.when(n % 7 == 0, F.array(reply, reply)).otherwise(F.array(reply))).alias("output_text")
    )
    return prompts, replies


def request_verdict_join(spark, sf_dir):
    """E4 with a response table: missing, repeated and contract-breaking responses
    (``_asked_and_answered``)."""
    prompts, replies = _asked_and_answered(spark, sf_dir)
    v = VD.request_verdict(prompts, replies, None, secret=VAULT_SECRET)
    return v.select(*_verdict_cols(["conv_id", "user_turn"]))


def request_verdict_echo(spark, sf_dir):
    """E4 on documents with an echo model: the model sees tokenized input,
    the final text has the personal data restored."""
    prompts = RQ.prompts(_docs(spark, sf_dir), process_with_llm=True)
    v = VD.request_verdict(
        prompts, lambda s: F.concat(F.lit("You said: "), s), None, secret=VAULT_SECRET
    )
    return v.select(*_verdict_cols([F.col("request_id").alias("doc_id")]))


def custom_guard(spark, sf_dir):
    """A user guard (pandas UDF) ahead of the PII detector."""
    df = _doc_prompts(spark, sf_dir, add_phrase=False)
    guards = [custom.WordRedactGuard("the"), *chain.input_guards(None)[:1]]
    df = chain.run_chain(df, "input_text", guards, "results", "final_text", prefix="cu")
    return _explode_results(
        df.withColumnRenamed("request_id", "doc_id"), ["doc_id"], "results", extra=["final_text"]
    )


UNDECIDED_EVERY = 7


def custom_guard_native(spark, sf_dir):
    """A native user guard whose condition is null for some texts (it
    blocks there), ahead of the PII detector."""
    df = _doc_prompts(spark, sf_dir, add_phrase=False)
    rule = custom.column_guard(
        "ShoutGuard",
        lambda t: F.when(F.length(t) % UNDECIDED_EVERY != 0, t.contains("!!")),
        action="warn",
        message="Shouting",
    )
    df = chain.run_chain(df, "input_text", [rule, *chain.input_guards(None)[:1]], "results", prefix="cn")
    return _explode_results(df.withColumnRenamed("request_id", "doc_id"), ["doc_id"], "results")


def chain_block_then_redact(spark, sf_dir):
    """A guard that blocks ahead of the redactor: the final text of a
    blocked row is the one before the block."""
    df = _doc_prompts(spark, sf_dir, add_phrase=False)
    rule = custom.column_guard("LengthGuard", lambda t: F.length(t) % 2 == 0, message="Even length")
    guards = [rule, G.PIIRedactor(PL.guard_conf(None, "pii_redactor"))]
    df = chain.run_chain(df, "input_text", guards, "results", "final_text", prefix="cb")
    return _explode_results(
        df.withColumnRenamed("request_id", "doc_id"), ["doc_id"], "results", extra=["final_text"]
    )


def guard_events(spark, sf_dir):
    """F1 from the conversation verdicts."""
    v = _verdicts_conversations(spark, sf_dir, restore=False)
    return A.guard_events(v, ["conv_id", "user_turn"])


def guard_rollup(spark, sf_dir):
    """F2 over the conversation guard events."""
    return A.guard_rollup(guard_events(spark, sf_dir))


def pii_by_source(spark, sf_dir):
    """F3."""
    vals = A.pii_values(_docs(spark, sf_dir), "text", ["doc_id", "source"])
    return A.pii_by_source(vals)


def pii_by_source_approx(spark, sf_dir):
    """F3, sketch form (HyperLogLog++) beside the exact one: whether the
    sketch's distinct values are within three of its standard errors (and one
    value) of the exact count."""
    vals = A.pii_values(_docs(spark, sf_dir), "text", ["doc_id", "source"])
    both = A.pii_by_source(vals).join(A.pii_by_source_approx(vals).drop("n_matches"), ["pii_type", "source"])
    exact, sketch = F.col("n_distinct_values"), F.col("approx_distinct_values")
    return both.select(
        "pii_type",
        "source",
        "n_matches",
        (F.abs(exact - sketch) <= 3 * A.SKETCH_ERROR * exact + 1).alias("within_bound"),
    )


def pii_sketch_merge(spark, sf_dir):
    """F3 from sketches kept by source and day (the day follows from the id here): whether the
    merged days give the estimate of one pass, and lie within three standard errors (and one value) of the exact count."""
    docs = _docs(spark, sf_dir).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 7).cast("int")))
    vals = A.pii_values(docs, "text", ["doc_id", "source", "day"])
    path = _scratch(spark, "pii-sketches")
    A.pii_sketches(vals).write.partitionBy("day").parquet(path)
    merged = A.merged_sketches(spark.read.parquet(path))
    once = A.merged_sketches(A.pii_sketches(vals.withColumn("day", F.lit(0)))).select(
        "pii_type", "source", F.col("approx_distinct_values").alias("one_pass")
    )
    exact = A.pii_by_source(vals).drop("n_matches")
    keys = ["pii_type", "source"]
    approx, n = F.col("approx_distinct_values"), F.col("n_distinct_values")
    return merged.join(once, keys).join(exact, keys).select(
        *keys,
        "n_matches",
        (approx == F.col("one_pass")).alias("merged_is_one_pass"),
        (F.abs(approx - n) <= 3 * A.MERGED_ERROR * n + 1).alias("within_bound"),
    )


def toxic_curve(spark, sf_dir):
    """F4 at every threshold: the toxic guard's confidence (0 where it finds nothing) against ``labels.toxic``."""
    df = _doc_prompts(spark, sf_dir)
    conf = PL.guard_conf(None, "toxic_content") | {"confidence_threshold": 0.0}
    df = _apply_guard(df, "input_text", G.ToxicContent(conf))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = df.select(F.col("request_id").alias("doc_id"), F.col("r.confidence").alias("score")).join(labels, "doc_id")
    return A.quality_curve(scored, "score", "toxic")


def toxic_eval(spark, sf_dir):
    """the toxic guard against ``labels.toxic``."""
    df = _doc_prompts(spark, sf_dir)
    df = _apply_guard(df, "input_text", G.ToxicContent(PL.guard_conf(None, "toxic_content")))
    pred = df.select(F.col("request_id").alias("doc_id"), (~F.col("r.passed")).alias("flagged"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    joined = pred.join(labels, "doc_id")
    return A.with_rates(joined.agg(*A.confusion(F.col("flagged"), F.col("toxic"))))


def request_quarantine(spark, sf_dir):
    """A2 on document prompts, with empty, missing and too long texts beside
    the documents."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    fill = F.rpad("text", RQ.MAX_REQUEST_CHARS + 1, "x")
    odd = (F.col("doc_id") / 17).cast("long") % 3
    docs = _beside(docs, 17, text=F.when(odd == 0, F.lit("")).when(odd == 1, fill))
    df = RQ.check_contract(RQ.prompts(docs, add_phrase=False))
    return df.select(F.col("request_id").alias("doc_id"), "status", "reason")


def verdict_flat(spark, sf_dir):
    """A3: nested verdicts written as parquet, read back flat."""
    import uuid

    v = VD.input_only_verdict(_doc_prompts(spark, sf_dir))
    path = f"{checkpoint_root(spark)}/verdicts-{uuid.uuid4().hex[:12]}"
    v.select("request_id", "allowed", "overall_action", "summary", "input_results").write.parquet(
        path
    )
    stored = spark.read.parquet(path)
    return _explode_results(
        stored.withColumnRenamed("request_id", "doc_id"),
        ["doc_id"],
        "input_results",
        extra=["allowed", "overall_action"],
    )


def _request_lines(spark, sf_dir) -> DataFrame:
    """(doc_id, line): the documents as JSON lines of a request each.  By id: plain; with context; cut off behind;
    with an output schema; with a list as its type; a number as text; a list as context; a word as boolean and an empty schema."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    rid = F.col("doc_id").cast("string").alias("request_id")
    text = F.col("text").alias("input_text")
    schema = lambda kind, *required: F.struct(kind.alias("type"), F.array(*map(F.lit, required)).alias("required")).alias("output_schema")
    context = F.struct(F.col("source").alias("source")).alias("context")
    asks = F.lit(True).alias("process_with_llm")
    empty = F.from_json(F.lit("{}"), "struct<type:string>").alias("output_schema")
    bodies = [
        F.to_json(F.struct(rid, text)),
        F.to_json(F.struct(rid, text, context, asks)),
        F.expr("substring(to_json(struct(doc_id, text)), 1, length(to_json(struct(doc_id, text))) - 1)"),
        F.to_json(F.struct(rid, text, asks, schema(F.lit("object"), "a", "b"))),
        F.to_json(F.struct(rid, text, asks, schema(F.array(F.lit("object")), "a"))),
        F.to_json(F.struct(rid, F.col("doc_id").alias("input_text"))),
        F.to_json(F.struct(rid, text, F.array("source").alias("context"))),
        F.to_json(F.struct(rid, text, F.lit("Yes").alias("process_with_llm"), empty)),
    ]
    line = F.lit(None).cast("string")
    for k, body in enumerate(bodies):
        line = F.when(F.col("doc_id") % len(bodies) == k, body).otherwise(line)
    return docs.select("doc_id", line.alias("line"))


def _read_request_columns(requests: DataFrame) -> DataFrame:
    return RD.contract(requests).select(
        "doc_id",
        "request_id",
        "input_text",
        F.try_variant_get("context", "$.source", "string").alias("context_source"),
        "process_with_llm",
        "output_type",
        F.array_join("output_required", ",").alias("output_required"),
        "output_schema_given",
        "output_error",
        "reader_error",
    )


def request_reader(spark, sf_dir):
    """A1/A2 from JSON lines, broken and wrongly typed ones among them."""
    return _read_request_columns(RD.parse_requests(_request_lines(spark, sf_dir)))


def request_reader_stream(spark, sf_dir):
    """The same from a stream of the lines."""
    run = _scratch(spark, "request-lines")
    lines = _request_lines(spark, sf_dir)
    lines.write.parquet(run)
    stream = spark.readStream.schema(lines.schema).parquet(run)
    return spark.read.parquet(ST.run_available_now(_read_request_columns(RD.parse_requests(stream)), "request_reader"))


def verdict_sink(spark, sf_dir):
    """A3 by day: event verdicts are written, one day is written again from a rerun, and all are read back."""
    screened = VD.input_only_verdict(_event_screen(spark, sf_dir)).withColumn("day", F.to_date("ts"))
    kept = screened.select(F.col("request_id").alias("event_id"), "day", "allowed", "overall_action", "summary", "input_results")
    path = _scratch(spark, "verdict-sink")
    SK.write_verdicts(kept, path)
    stored = SK.read_verdicts(spark, path, kept.schema)
    first = stored.agg(F.min("day")).first()[0]
    if first is not None:
        SK.write_verdicts(kept.where(F.col("day") == F.lit(first)), path)
    actions = F.array_join(F.transform("input_results", lambda r: r["action"]), "|").alias("input_actions")
    day = F.col("day").cast("string").alias("day")
    return SK.read_verdicts(spark, path, kept.schema).select("event_id", day, "allowed", "overall_action", "summary", actions)


def turn_pairs(spark, sf_dir):
    """A4.  Beside the conversations stand copies of some: with each row repeated under another
    text (every 7th), without a conversation (every 13th), without turn numbers (every 17th)."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    other = -F.col("conv_id") - 1
    again = F.concat(F.coalesce("text", F.lit("")), F.lit(" again"))
    repeated = conv.where("conv_id % 7 = 0").select(other.alias("conv_id"), "turn", "role", F.explode(F.array("text", again)).alias("text"))
    stray = conv.where("conv_id % 13 = 0").select(F.lit(None).cast("long").alias("conv_id"), "turn", "role", "text")
    unnumbered = conv.where("conv_id % 17 = 0").withColumn("turn", F.lit(None).cast(conv.schema["turn"].dataType))
    return RQ.turn_pairs(conv.unionByName(repeated).unionByName(stray).unionByName(unnumbered))


def tier_of(source: str) -> F.Column:
    """Tier of a request by the number in its source's name: src0-src6 strict,
    src7-src13 standard, src14-src17 lenient; others "trial", which has no policy
    row, and none without a number."""
    n = F.regexp_extract(F.col(source), r"([0-9]+)$", 1).try_cast("int")
    return F.when(n < 7, "strict").when(n < 14, "standard").when(n < 18, "lenient").when(n >= 18, "trial")


def tenant_policy_verdict(spark, sf_dir):
    """A5: per-tenant thresholds and actions from a policy table; tiers without
    a row and sources without a tier get the default policy."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    docs = _beside(docs, 10, source=F.lit("partner"))
    prompts = RQ.prompts(docs, keep=("source",)).withColumn("tenant_tier", tier_of("source"))
    v = TN.tenant_input_verdict(prompts, TN.policy_table(spark))
    return v.select(*_verdict_cols([F.col("request_id").alias("doc_id")])[:-1], "tenant_tier")


def stream_screen(spark, sf_dir):
    """H1: the input-only verdict as a file-source stream, run to completion."""
    schema = read_table(spark, sf_dir, "documents").schema
    stream = ST.read_table_stream(spark, sf_dir, "documents", schema)
    screened = ST.screen_stream(RQ.prompts(stream))
    flat = screened.select(*_verdict_cols([F.col("request_id").alias("doc_id")]))
    path = ST.run_available_now(flat, "stream_screen")
    return spark.read.parquet(path)


def stream_verdict(spark, sf_dir):
    """H1 in full: the echo verdict (E4) as a stream, run to completion."""
    schema = read_table(spark, sf_dir, "documents").schema
    stream = RQ.prompts(ST.read_table_stream(spark, sf_dir, "documents", schema), process_with_llm=True)
    v = ST.verdict_stream(stream, lambda s: F.concat(F.lit("You said: "), s), secret=VAULT_SECRET)
    return spark.read.parquet(
        ST.run_available_now(v.select(*_verdict_cols([F.col("request_id").alias("doc_id")])), "stream_verdict")
    )


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: A moment after all event times: one row of it in either stream lets the watermark pass the rest.
LAST_MOMENT = "2200-01-01 00:00:00"


def request_verdict_streams(spark, sf_dir):
    """E4 on two streams: the requests and responses of ``request_verdict_join`` with event times, each
    written to a folder and read as a stream.  Every 13th response comes after the time
    a request waits, so that request fails as unanswered."""
    prompts, replies = _asked_and_answered(spark, sf_dir)
    n = F.col("conv_id") + F.col("user_turn")
    asked_at = F.timestamp_seconds(F.lit(1_700_000_000) + n * 60)
    answered_at = asked_at + F.when(n % 13 == 0, F.expr("INTERVAL 11 MINUTES")).otherwise(F.expr("INTERVAL 30 SECONDS"))
    prompts = prompts.withColumn("ts", asked_at)
    replies = replies.withColumn("ts", answered_at).select("request_id", "ts", "output_text")
    run = _scratch(spark, "verdict-streams")
    streams = {}
    for name, rows in (("requests", prompts), ("responses", replies)):
        last = spark.range(1).select(F.lit("last").alias("request_id"), F.lit(LAST_MOMENT).cast("timestamp").alias("ts"))
        rows.unionByName(last, allowMissingColumns=True).write.parquet(f"{run}/{name}")
        streams[name] = spark.readStream.schema(rows.schema).parquet(f"{run}/{name}")
    v = RS.verdicts(streams["requests"], streams["responses"], secret=VAULT_SECRET)
    return spark.read.parquet(ST.run_available_now(v.select(*_verdict_cols(["conv_id", "user_turn"])), "verdict_streams"))


def _vault_sink(spark, sf_dir) -> SK.VaultSink:
    """The documents' texts tokenized as a stream into a vault sink."""
    schema = read_table(spark, sf_dir, "documents").schema
    types = tuple(PL.guard_conf(None, "pii_vault")["detect_types"])
    sink = SK.VaultSink(_scratch(spark, "vault-stream"), types, VAULT_SECRET, request_id="doc_id")
    sink.run(ST.read_table_stream(spark, sf_dir, "documents", schema).select("doc_id", "text"))
    return sink


def vault_stream(spark, sf_dir):
    """D1/D2 on a stream: the vault that the sink has written."""
    rows = _vault_sink(spark, sf_dir).vault(spark)
    return rows.select(F.col("request_id").cast("long").alias("doc_id"), "token", "pii_type", "value")


def vault_stream_roundtrip(spark, sf_dir):
    """Texts restored from the two tables that the stream sink has written."""
    sink = _vault_sink(spark, sf_dir)
    texts = sink.tokenized(spark).withColumnRenamed("tokenized_text", "text")
    restored = V.detokenize_join(texts, sink.vault(spark))
    return restored.select(F.col("request_id").cast("long").alias("doc_id"), F.col("text").alias("restored_text"))


def _event_prompts(ev: DataFrame) -> DataFrame:
    text = RQ.with_phrase(F.concat_ws(" ", "event_type", "props"), F.col("event_id"))
    return ev.select(F.col("event_id").alias("request_id"), "ts", text.alias("input_text"))


def _event_screen(spark, sf_dir):
    return _event_prompts(read_table(spark, sf_dir, "events"))


def _guard_event_rows(screened: DataFrame) -> DataFrame:
    return screened.select("ts", R.explode_flat(F.col("input_results"))).select(
        "ts", "guard_name", "action"
    )


def block_rate_stream(spark, sf_dir):
    """H2 as a stream: windows close by watermark (10 minutes) and are appended
    once final; those still open at the end stay in state.  One micro-batch
    takes the table, so the watermark then stands at its last event less 10
    minutes: the rows are the windows of ``block_rate_window`` that end by then."""
    schema = read_table(spark, sf_dir, "events").schema
    stream = ST.read_table_stream(spark, sf_dir, "events", schema, bytes_per_batch=None)
    screened = chain.input_chain(_event_prompts(stream))
    path = ST.run_available_now(ST.block_rates(_guard_event_rows(screened)), "block_rate_stream")
    return spark.read.parquet(path)


def block_rate_late(spark, sf_dir):
    """H2 with late rows accounted for.  The events come in four batches, the last quarter of their
    time first, so that most rows of the others are behind the watermark: per
    window the watermark has passed, all runs and blocks, and how many of the runs came late."""
    ev = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "props")
    us = F.unix_micros("ts")
    bounds = ev.agg(F.min(us).alias("first"), F.max(us).alias("last")).first()
    quarter = F.floor((us - bounds["first"]) * 4 / (bounds["last"] - bounds["first"] + 1)) if bounds["first"] is not None else F.lit(3)
    run, files = _scratch(spark, "late-events"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in (3, 2, 1, 0):
        ev.where(quarter == k).repartition(files).write.mode("append").parquet(run)
    per_batch = max(1, -(-len(spark.read.schema(ev.schema).parquet(run).inputFiles()) // 4))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", per_batch).parquet(run)
    LT.use_rocksdb(spark)
    rates = LT.block_rates_with_late(_guard_event_rows(chain.input_chain(_event_prompts(stream))))
    rows = spark.read.parquet(ST.run_available_now(rates, "block_rate_late"))
    start, end = (F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end"))
    return rows.groupBy(start, end, "guard_name").agg(
        F.sum("n_runs").alias("n_runs"),
        F.sum("n_blocks").alias("n_blocks"),
        F.sum(F.when(F.col("status") == "late", F.col("n_runs")).otherwise(0)).alias("n_late"),
    )


def block_rate_window(spark, sf_dir):
    """H2, batch twin: runs and blocks per 5-minute window and guard."""
    df = chain.input_chain(_event_screen(spark, sf_dir))
    return ST.block_rates(_guard_event_rows(df))


QUERIES: dict[str, Query] = {
    "request_quarantine": request_quarantine,
    "request_reader": request_reader,
    "request_reader_stream": request_reader_stream,
    "verdict_flat": verdict_flat,
    "verdict_sink": verdict_sink,
    "turn_pairs": turn_pairs,
    "tenant_policy_verdict": tenant_policy_verdict,
    "text_profile": text_profile,
    "pii_redact": pii_redact,
    "pii_redact_file_order": pii_redact_file_order,
    "unicode_tricks": unicode_tricks,
    "special_char_ratio": special_char_ratio,
    "pii_matches": pii_matches,
    "pii_matches_chunked": pii_matches_chunked,
    "pii_type_counts": pii_type_counts,
    "lexicon_hits": lexicon_hits,
    "lexicon_table_hits": lexicon_table_hits,
    "marker_counts": marker_counts,
    "json_contract": json_contract,
    "pii_detect": pii_detect,
    "injection_detect": injection_detect,
    "toxic_detect": toxic_detect,
    "toxic_detect_table": toxic_detect_table,
    "topic_detect": topic_detect,
    "hallucination_detect": hallucination_detect,
    "content_filter": content_filter,
    "output_validate": output_validate,
    "vault_tokenize": vault_tokenize,
    "vault_tokenize_file_order": vault_tokenize_file_order,
    "vault_table": vault_table,
    "vault_roundtrip": vault_roundtrip,
    "vault_type_counts": vault_type_counts,
    "vault_stream": vault_stream,
    "vault_stream_roundtrip": vault_stream_roundtrip,
    "input_guard_chain": input_guard_chain,
    "output_guard_chain": output_guard_chain,
    "fail_closed": fail_closed,
    "request_verdict": request_verdict,
    "request_verdict_join": request_verdict_join,
    "request_verdict_streams": request_verdict_streams,
    "request_verdict_echo": request_verdict_echo,
    "input_only_verdict": input_only_verdict,
    "custom_guard": custom_guard,
    "custom_guard_native": custom_guard_native,
    "chain_block_then_redact": chain_block_then_redact,
    "guard_events": guard_events,
    "guard_rollup": guard_rollup,
    "pii_by_source": pii_by_source,
    "pii_by_source_approx": pii_by_source_approx,
    "pii_sketch_merge": pii_sketch_merge,
    "toxic_eval": toxic_eval,
    "toxic_curve": toxic_curve,
    "stream_screen": stream_screen,
    "stream_verdict": stream_verdict,
    "block_rate_window": block_rate_window,
    "block_rate_stream": block_rate_stream,
    "block_rate_late": block_rate_late,
}
