"""Hook events to verdicts. Every step is row-local, so the same functions serve a batch table
and a stream in append mode."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskloom.functions.expr import each, let, record, staged
from riskloom.functions.regex import extract, located, matches
from riskloom.functions.text import INVISIBLE, collapse_spaces, fold_content, js_trim, nfkc
from riskloom.operators.injection import content_hits, hidden_spans, with_languages
from riskloom.operators.intent import first_per_rule, prompt_hits
from riskloom.operators.repos import (
    DISABLE_RLS,
    DROP_POLICY,
    EVIDENCE_CHARS,
    GRANT_ANON,
    PERMISSIVE_POLICY,
    SECURITY_DEFINER,
)
from riskloom.operators.secrets import masked, secret_values
from riskloom.plans.findings import rule_of
from riskloom.rules import catalog
from riskloom.rules import guard as rules
from riskloom.sources.captures import hook_payloads
from riskloom.sources.tables import dimension

_RISK = "array<struct<rule_id:string,quote:string,source:string>>"


def capabilities(spark: SparkSession) -> DataFrame:
    """21 rows, one per host and moment."""
    return dimension(
        spark,
        rules.CAPABILITIES,
        "host string, moment string, event_name string, can_note boolean, can_block boolean",
    )


# ---- reading payloads -----------------------------------------------------------------------


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _string(v: Column, path: str) -> Column:
    """The member as text when it is a non-empty JSON string, else null."""
    return let(
        _get(v, path),
        lambda m: F.when(
            F.schema_of_variant(m) == "STRING",
            F.nullif(F.try_variant_get(m, "$", "string"), F.lit("")),
        ),
    )


def _strings(v: Column, *paths: str) -> Column:
    return F.coalesce(*[_string(v, p) for p in paths])


def _member(v: Column, *paths: str) -> Column:
    """The first member that is present and not JSON null."""
    return F.coalesce(
        *[let(_get(v, p), lambda m: F.when(~F.is_variant_null(m), m)) for p in paths]
    )


def _leaves(value) -> str:
    """The leaves of a JSON value in document order, one per line, at any depth."""
    out, todo = [], [value]
    while todo:
        item = todo.pop()
        if isinstance(item, dict):
            todo += reversed(item.values())
        elif isinstance(item, list):
            todo += reversed(item)
        else:
            out.append("" if item is None else str(item).lower() if isinstance(item, bool) else str(item))
    return "\n".join(out)


def _number(text: str) -> str:
    """A fraction as scripts print it: without one if it is whole."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)


def _member_of(payload: str, paths: str):
    """The value at the first of the comma-separated dotted paths that is there and not null."""
    try:
        root = json.loads(payload, parse_int=str, parse_float=_number)
    except (ValueError, RecursionError):
        return payload if paths == "" else None
    for path in paths.split(","):
        value = root
        for name in path.split(".") if path else ():
            value = value.get(name) if isinstance(value, dict) else None
        if value is not None:
            return value
    return None


@F.arrow_udf(StringType())
def _flattened(payloads: pa.Array, paths: pa.Array, only_lists: pa.Array) -> pa.Array:
    # A variant keeps members in key order; the order of the document is only in its text.
    out = []
    for payload, path, lists in zip(payloads.to_pylist(), paths.to_pylist(), only_lists.to_pylist(), strict=True):
        value = None if payload is None or path is None else _member_of(payload, path)
        out.append(None if value is None or (lists and not isinstance(value, list)) else _leaves(value))
    return pa.array(out, pa.string())


def flatten_payload(payload: Column, paths: Column | str = "", only_lists: bool = False) -> Column:
    """The leaves of a payload, or of the first member of ``paths`` it has, in document order; null without one.

    ``payload`` is JSON text; text that is no JSON is its own only leaf. Rows with a null payload are not parsed.
    """
    return _flattened(payload, F.lit(paths) if isinstance(paths, str) else paths, F.lit(only_lists))


def detect_host(e: Column) -> Column:
    """The host from the payload's shape. Cursor's own fields are tested before event names,
    because its event names are Copilot's."""
    event = F.coalesce(_strings(e, "$.hook_event_name", "$.event", "$.eventName"), F.lit(""))

    def has(name: str) -> Column:
        return _get(e, "$." + name).isNotNull()

    cursor_fields = has("conversation_id") | has("generation_id") | has("workspace_roots")
    top_level_shell = has("sandbox") & _string(e, "$.command").isNotNull()
    return let(
        event,
        lambda name: F.when(_string(e, "$.moment").isNotNull(), "opencode")
        .when(cursor_fields | top_level_shell, "cursor")
        .when(name == "", "cursor")
        .when(matches(name, r"^(BeforeAgent|BeforeTool|AfterTool)$"), "gemini")
        .when(matches(name, r"^pre_(user_prompt|run_command|write_code)$"), "windsurf")
        .when(matches(name, r"^(before|after|pre|post|user)[A-Z]", False), "copilot")
        .when(has("prompt_id") | has("permission_mode"), "claude-code")
        .otherwise("codex"),
    )


def pending_content(args: Column, edits: Column) -> Column:
    """The text a write tool is about to put on disk, whatever the host wraps it in. ``edits`` is the text
    of its edit list."""
    nested = _string(args, "$.input")
    return F.coalesce(
        _strings(args, *["$." + n for n in rules.DIRECT_CONTENT]),
        let(edits, lambda t: F.when(js_trim(t) != "", t)),
        let(nested, lambda t: F.when(js_trim(t) != "", t)),
    )


PAIR = ["claude-code", "codex"]  # these two share one shape


def _step(e: Column, host: Column, event: Column, tool: Column) -> Column:
    """What an event is, in its host's vocabulary: prompt, shell, write, any action, content."""
    shell, write = matches(tool, rules.SHELL_TOOL), matches(tool, rules.WRITE_TOOL)
    shell_or_write = F.when(shell, "shell").otherwise("write")
    unnamed = event == ""

    def is_(pattern: str) -> Column:
        return matches(event, pattern)

    pair = (
        F.when(is_("UserPromptSubmit"), "prompt")
        .when(is_("PreToolUse"), F.when(shell, "shell").when(write, "write"))
        .when(is_("PostToolUse"), "content")
    )
    cursor = (
        F.when(is_("beforeSubmitPrompt") | (unnamed & F.col("_prompt").isNotNull()), "prompt")
        .when(is_("beforeShellExecution") | (unnamed & F.col("_command").isNotNull()), "shell")
        .when(
            is_("preToolUse"),
            F.when(F.coalesce("_command", "_arg_command").isNotNull(), "shell").otherwise("write"),
        )
        .when(is_("postToolUse|afterFileEdit|beforeReadFile") | unnamed, "content")
    )
    copilot = F.when(is_("preToolUse"), shell_or_write).when(is_("postToolUse"), "content")
    gemini = (
        F.when(is_("BeforeAgent"), "prompt")
        .when(is_("BeforeTool"), shell_or_write)
        .when(is_("AfterTool"), "content")
    )
    windsurf = (
        F.when(is_("pre_user_prompt"), "prompt")
        .when(is_("pre_run_command"), "shell")
        .when(is_("pre_write_code"), "write")
    )
    own = F.col("_moment")
    opencode = F.when(own.isin("prompt", "content"), own).when(own == "action", "any")
    return (
        F.when(host.isin(PAIR), pair)
        .when(host == "cursor", cursor)
        .when(host == "copilot", copilot)
        .when(host == "gemini", gemini)
        .when(host == "windsurf", windsurf)
        .otherwise(opencode)
    )


def normalize_hook_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``host, moment, prompt, command, file_path, content, received, source``.

    Built in stages so that each value is looked up once: names first, then the step, then the
    fields of that step.
    """
    keys = [c for c in raw.columns if c != payload]
    c, e, host = F.col, F.col("event"), F.col("host")
    tops = "prompt message command file_path path content new_content url source filePath moment".split()
    args = "command file_path path absolute_path content new_string url".split()

    named = hook_payloads(raw, payload).withColumn("host", detect_host(e)).withColumns(
        {
            "_event": F.coalesce(
                _string(e, "$.hook_event_name"),
                F.when(host.isin("cursor", "copilot", "windsurf"), _string(e, "$.event")),
                F.when(host == "gemini", _string(e, "$.eventName")),
                F.lit(""),
            ),
            "_tool": F.coalesce(
                _string(e, "$.tool_name"),
                F.when(host.isin("copilot", "gemini"), _string(e, "$.toolName")),
                F.lit(""),
            ),
            "_args": F.when(host == "copilot", _member(e, "$.tool_input", "$.args", "$.arguments"))
            .when(host == "gemini", _member(e, "$.tool_input", "$.toolInput", "$.args"))
            .otherwise(_get(e, "$.tool_input")),
            **{"_" + n: _string(e, "$." + n) for n in tops},
        }
    )
    stepped = named.withColumns(
        {"_arg_" + n: _string(c("_args"), "$." + n) for n in args}
    ).withColumn("_step", _step(e, host, c("_event"), c("_tool")))

    step = c("_step")
    results = (
        F.when(host == "cursor", "tool_response,content,tool_output")
        .when(host == "copilot", "tool_response,result")
        .when(host == "gemini", "tool_response,toolResponse,result")
        .when(host == "opencode", "received")
        .otherwise("tool_response")
    )
    edit_lists = ",".join(f"tool_input.{name}" for name in rules.EDIT_LISTS)
    writes = step.isin("write", "any") & host.isin(PAIR)
    answered = stepped.withColumns(
        {
            "_received": F.when(
                step == "content", F.coalesce(flatten_payload(F.when(step == "content", c(payload)), results), F.lit(""))
            ),
            "_edits": flatten_payload(F.when(writes, c(payload)), edit_lists, only_lists=True),
        }
    )
    prompt = F.when(host == "gemini", F.coalesce("_prompt", "_message")).otherwise(c("_prompt"))
    command = (
        F.when(host.isin("windsurf", "opencode"), c("_command"))
        .when(host == "cursor", F.coalesce("_command", "_arg_command"))
        .otherwise(c("_arg_command"))
    )
    file_path = (
        F.when(host == "opencode", c("_filePath"))
        .when(host == "windsurf", F.coalesce("_file_path", "_path"))
        .when(host == "cursor", F.coalesce("_arg_file_path", "_file_path"))
        .when(host == "gemini", F.coalesce("_arg_file_path", "_arg_absolute_path", "_arg_path"))
        .otherwise(F.coalesce("_arg_file_path", "_arg_path"))
    )
    content = (
        F.when(host == "opencode", c("_content"))
        .when(host == "windsurf", F.coalesce("_content", "_new_content"))
        .when(host == "cursor", F.coalesce("_arg_content", "_content", "_arg_new_string"))
        .when(host == "copilot", c("_arg_content"))
        .when(host == "gemini", F.coalesce("_arg_content", "_arg_new_string"))
        .otherwise(pending_content(c("_args"), c("_edits")))
    )
    source = (
        F.when(host.isin(PAIR), F.coalesce("_arg_file_path", "_arg_url", "_tool"))
        .when(host == "cursor", F.coalesce("_file_path", "_url", F.nullif("_tool", F.lit("")), F.lit("tool result")))
        .when(host == "opencode", c("_source"))
        .otherwise(c("_tool"))
    )
    # A tool result without text is no moment, except on the host that names its moments itself.
    empty = (step == "content") & (c("_received") == "") & (host != "opencode")
    moment = (
        F.when(empty, F.lit(None))
        .when(step.isin("shell", "write", "any"), "action")
        .otherwise(step)
    )
    return staged(
        answered,
        keys,
        host=host,
        moment=moment.cast("string"),
        prompt=F.when(step == "prompt", prompt),
        command=F.when(step.isin("shell", "any"), command),
        file_path=F.when(step.isin("write", "any"), file_path),
        content=F.when(step.isin("write", "any"), content),
        received=F.when(step == "content", c("_received")),
        source=F.when((step == "content") & ~empty, source),
    )


# ---- risks ----------------------------------------------------------------------------------


def _risk(rule_id: Column, quote: Column, source: Column) -> Column:
    return record(rule_id=rule_id, quote=quote, source=source)


def command_risks(command: Column) -> Column:
    found = [
        F.when(
            matches(command, pattern, fold),
            _risk(
                F.lit(rule),
                F.left(extract(command, pattern, 0, fold), F.lit(rules.COMMAND_QUOTE_CHARS)),
                F.lit("shell command"),
            ),
        )
        for rule, pattern, fold in rules.COMMAND_RULES
    ]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def is_client_path(path: Column) -> Column:
    return matches(path, rules.CLIENT_PATH) & ~matches(path, rules.SQL_FILE)


def _secret_risks(path: Column, content: Column) -> Column:
    real_env = matches(path, rules.ENV_FILE) & ~matches(path, rules.ENV_SAMPLE)

    def line_no(s: Column) -> Column:
        prefix = F.left(content, F.instr(content, s["value"]) - 1)
        return F.length(prefix) - F.length(F.translate(prefix, "\n", "")) + 1

    placed = F.transform(
        secret_values(content), lambda s: record(id=s["id"], value=s["value"], line=line_no(s))
    )
    # In a real .env only a key the bundler publishes is a finding.
    published = F.filter(
        placed,
        lambda s: ~real_env
        | matches(F.get(F.split(content, "\n"), s["line"] - 1), rules.PUBLIC_PREFIX),
    )
    return F.transform(
        published,
        lambda s: _risk(s["id"], masked(s["value"]), F.concat_ws(":", path, s["line"].cast("string"))),
    )


def _migration_risks(path: Column, content: Column) -> Column:
    shown = F.when(matches(path, rules.SQL_FILE), path).otherwise(F.concat(path, F.lit(" (inline SQL)")))

    def events(pattern: str, groups: int, id_of, limit: int | None = None) -> Column:
        def one(m: Column) -> Column:
            flat = collapse_spaces(m["match"])
            quote = flat if limit is None else F.left(flat, F.lit(limit))
            return _risk(id_of(m), quote, F.concat_ws(":", shown, m["line"].cast("string")))

        return F.transform(located(content, pattern, groups), one)

    def with_table(prefix: str, group: str):
        return lambda m: F.concat(F.lit(prefix), F.lower(m[group]))

    return F.concat(
        events(DISABLE_RLS, 1, with_table("rls_turned_off_", "g1")),
        events(DROP_POLICY, 1, with_table("policy_dropped_", "g1")),
        events(PERMISSIVE_POLICY, 0, lambda m: F.lit("permissive_policy"), EVIDENCE_CHARS),
        events(SECURITY_DEFINER, 0, lambda m: F.lit("security_definer")),
        events(GRANT_ANON, 3, with_table("grant_anon_", "g2"), EVIDENCE_CHARS),
    )


def write_risks(path: Column, content: Column) -> Column:
    """Secrets and migration rules over a pending file, each rule once."""
    none = F.array().cast(_RISK)
    secrets = F.when(~matches(path, rules.FIXTURE), _secret_risks(path, content)).otherwise(none)
    sql = F.when(
        matches(path, rules.SQL_FILE) | matches(content, rules.DDL_TEXT),
        _migration_risks(path, content),
    ).otherwise(none)
    scanned = path.isNotNull() & content.isNotNull() & ~matches(path, rules.NOT_SOURCE)
    return F.when(scanned, first_per_rule(F.concat(secrets, sql), "rule_id")).otherwise(none)


def write_advice(writes: DataFrame, spark: SparkSession) -> DataFrame:
    """``(…, rule_id, quote, source, risk, why, instead)`` of pending writes with ``file_path`` and ``content``:
    what is wrong, why, and what to do instead. A value in a sample file is a risk of its own kind, and a file that
    browsers get says so. The rule texts are joined by broadcast; nothing else leaves the row.
    """
    keys = [c for c in writes.columns if c != "content"]
    found = writes.select(*keys, each(write_risks(F.col("file_path"), F.col("content"))))
    texts = dimension(spark, catalog.RULES, catalog.SCHEMA).select(F.col("rule").alias("_rule"), "label", F.col("why").alias("_why"))
    named = found.withColumn("_rule", rule_of(F.col("rule_id"))).join(F.broadcast(texts), "_rule", "left")
    sample = matches(F.col("file_path"), rules.ENV_SAMPLE)
    advice = None
    for start, text in rules.ADVICE:
        is_it = F.col("rule_id").startswith(start)
        advice = F.when(is_it, text) if advice is None else advice.when(is_it, text)
    advice = advice.when(sample, rules.SAMPLE_ADVICE).otherwise(rules.SECRET_ADVICE)
    of_sql = F.lit(False)
    for start, _ in rules.ADVICE:
        of_sql = of_sql | F.col("rule_id").startswith(start)
    label = F.coalesce("label", "rule_id")
    return named.select(
        *keys,
        "rule_id",
        "quote",
        "source",
        F.when(sample & ~of_sql, F.concat(label, F.lit(rules.SAMPLE_RISK))).otherwise(label).alias("risk"),
        F.concat_ws(" ", "_why", F.when(is_client_path(F.col("file_path")), rules.CLIENT_NOTE)).alias("why"),
        advice.alias("instead"),
    )


def _prompt_risks(normal: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.transform(prompt_hits(normal), lambda h: _risk(h["rule_id"], null, null))


def _content_risks(source: Column) -> Column:
    return F.transform(
        content_hits(*map(F.col, ("_normal", "_flat", "_spans", "_languages"))),
        lambda h: _risk(h["rule_id"], h["quote"], F.coalesce(source, F.lit("a tool result"))),
    )


def decide_action(moment: Column, can_block: Column, block: bool = False) -> Column:
    blocking = F.when(can_block, "deny").otherwise("note") if block else F.lit("note")
    return (
        F.when(moment == "action", F.when(can_block, "ask").otherwise("note"))
        .when(moment == "prompt", blocking)
        .otherwise("note")
    )


def verdicts(raw: DataFrame, spark: SparkSession, payload: str = "payload", block: bool = False) -> DataFrame:
    """One row per event with a moment: host, moment, action and its risks (maybe none).

    A moment the host cannot act on has no risks. The capability table is joined by broadcast;
    nothing else leaves the row.
    """
    keys = [c for c in raw.columns if c != payload]
    none = F.array().cast(_RISK)
    spans = F.nullif(F.array_join(hidden_spans(F.coalesce("received", F.lit(""))), "\u0001"), F.lit(""))
    text = F.when(F.col("moment") == "prompt", F.col("prompt")).when(
        F.col("moment") == "content", F.col("received")
    )
    served = capabilities(spark).select(
        "host", "moment", "can_block", F.col("event_name").isNotNull().alias("_served")
    )
    prepared = (
        normalize_hook_events(raw, payload)
        .filter(F.col("moment").isNotNull())
        .join(F.broadcast(served), ["host", "moment"], "left")
        .withColumn("_text", text)
        .withColumn("_joined", F.when(F.col("moment") == "content", spans))
        .withColumns({"_nfkc": nfkc(F.col("_text")), "_spans": nfkc(F.col("_joined"))})
        .withColumn("_normal", F.when(F.col("moment") == "content", fold_content(F.col("_nfkc"))))
    )
    prepared = with_languages(prepared)
    visible = F.regexp_replace(F.regexp_replace(F.col("_nfkc"), INVISIBLE, ""), r"[ \t]+", " ")
    risks = (
        F.when(F.col("moment") == "prompt", let(visible, _prompt_risks))
        .when(
            F.col("moment") == "action",
            F.concat(
                F.when(F.col("command").isNotNull(), command_risks(F.col("command"))).otherwise(none),
                write_risks(F.col("file_path"), F.col("content")),
            ),
        )
        .when(
            F.col("moment") == "content",
            _content_risks(F.col("source")),
        )
    )
    return prepared.select(
        *keys,
        "host",
        "moment",
        decide_action(F.col("moment"), F.col("can_block"), block).alias("action"),
        F.when(F.col("_served"), F.coalesce(risks, none)).otherwise(none).alias("risks"),
    )


def verdict_risks(df: DataFrame) -> DataFrame:
    """One row per event and risk."""
    keys = [c for c in df.columns if c != "risks"]
    return df.select(*keys, each(F.col("risks")))
