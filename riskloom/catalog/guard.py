"""Hook event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog import seeds
from riskloom.catalog.registry import expression, literal, query, values
from riskloom.operators import guard as G
from riskloom.rules import catalog, secrets
from riskloom.rules import guard as rules
from riskloom.sources.captures import hook_payloads
from riskloom.sources.scratch import new_path
from riskloom.sources.tables import table
from riskloom.streaming import guard_stream as stream

expression("event_json", "SELECT event_id, ts, payload, CASE WHEN json_valid(payload) AND json_type(payload) IN ('OBJECT', 'ARRAY') THEN json(payload) ELSE json_object('prompt', payload) END AS j FROM hook_events")
expression(
    "event_host",
    r"""SELECT *, CASE WHEN json_extract_string(j, '$.moment') IS NOT NULL THEN 'opencode'
    WHEN json_exists(j, '$.conversation_id') OR json_exists(j, '$.generation_id') OR json_exists(j, '$.workspace_roots')
        OR (json_exists(j, '$.sandbox') AND json_extract_string(j, '$.command') IS NOT NULL) THEN 'cursor'
    WHEN ev = '' THEN 'cursor' WHEN lower(ev) IN ('beforeagent', 'beforetool', 'aftertool') THEN 'gemini'
    WHEN regexp_matches(ev, '(?i)^pre_(user_prompt|run_command|write_code)$') THEN 'windsurf'
    WHEN regexp_matches(ev, '^(before|after|pre|post|user)[A-Z]') THEN 'copilot'
    WHEN json_exists(j, '$.prompt_id') OR json_exists(j, '$.permission_mode') THEN 'claude-code' ELSE 'codex' END AS host
    FROM (SELECT *, coalesce(json_extract_string(j, '$.hook_event_name'), json_extract_string(j, '$.event'), json_extract_string(j, '$.eventName'), '') AS ev FROM event_json)""",
)


def _events(spark, sf):
    return seeds.hook_events(spark, sf)


@query("scan_hook_events", "SELECT event_id, ts, json_extract_string(j, '$.prompt') AS prompt FROM event_json")
def _(spark, sf):
    return hook_payloads(_events(spark, sf)).select(
        "event_id", "ts", F.try_variant_get("event", "$.prompt", "string").alias("prompt")
    )


@query("detect_host", "SELECT event_id, host FROM event_host")
def _(spark, sf):
    return hook_payloads(_events(spark, sf)).select("event_id", G.detect_host(F.col("event")).alias("host"))


# The twin reads each payload as the specification does: host, event and tool names, then the step, then its fields.
def _name_like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {literal('(?i)' + pattern)})"


def _text(*paths: str) -> str:
    """The first of the members that is a JSON string and not empty."""
    return "coalesce(" + ", ".join(
        f"CASE WHEN json_type(j, '$.{p}') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.{p}'), '') END" for p in paths
    ) + ", NULL)"


def _present(*paths: str) -> str:
    """The first member that is there and not null, as JSON."""
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{p}') <> 'NULL' THEN json_extract(j, '$.{p}') END" for p in paths) + ", NULL)"


def _leaves_sql(member: str) -> str:
    return (
        f"(SELECT string_agg(coalesce(t.atom ->> '$', ''), chr(10) ORDER BY t.id) FROM json_tree({member}) t "
        "WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"
    )


_SHELL, _WRITE = _name_like("tool", rules.SHELL_TOOL), _name_like("tool", rules.WRITE_TOOL)
_STEP = f"""CASE
    WHEN host IN ('claude-code', 'codex') THEN CASE WHEN {_name_like('ev', 'UserPromptSubmit')} THEN 'prompt'
        WHEN {_name_like('ev', 'PreToolUse')} THEN CASE WHEN {_SHELL} THEN 'shell' WHEN {_WRITE} THEN 'write' END
        WHEN {_name_like('ev', 'PostToolUse')} THEN 'content' END
    WHEN host = 'cursor' THEN CASE WHEN {_name_like('ev', 'beforeSubmitPrompt')} OR (ev = '' AND {_text('prompt')} IS NOT NULL) THEN 'prompt'
        WHEN {_name_like('ev', 'beforeShellExecution')} OR (ev = '' AND {_text('command')} IS NOT NULL) THEN 'shell'
        WHEN {_name_like('ev', 'preToolUse')} THEN CASE WHEN {_text('command', 'tool_input.command')} IS NOT NULL THEN 'shell' ELSE 'write' END
        WHEN ev = '' OR {_name_like('ev', 'postToolUse|afterFileEdit|beforeReadFile')} THEN 'content' END
    WHEN host = 'copilot' THEN CASE WHEN {_name_like('ev', 'preToolUse')} THEN CASE WHEN {_SHELL} THEN 'shell' ELSE 'write' END
        WHEN {_name_like('ev', 'postToolUse')} THEN 'content' END
    WHEN host = 'gemini' THEN CASE WHEN {_name_like('ev', 'BeforeAgent')} THEN 'prompt'
        WHEN {_name_like('ev', 'BeforeTool')} THEN CASE WHEN {_SHELL} THEN 'shell' ELSE 'write' END
        WHEN {_name_like('ev', 'AfterTool')} THEN 'content' END
    WHEN host = 'windsurf' THEN CASE WHEN {_name_like('ev', 'pre_user_prompt')} THEN 'prompt'
        WHEN {_name_like('ev', 'pre_run_command')} THEN 'shell' WHEN {_name_like('ev', 'pre_write_code')} THEN 'write' END
    ELSE CASE {_text('moment')} WHEN 'prompt' THEN 'prompt' WHEN 'content' THEN 'content' WHEN 'action' THEN 'any' END END"""
_RESULT = f"""CASE host WHEN 'cursor' THEN {_present('tool_response', 'content', 'tool_output')} WHEN 'copilot' THEN {_present('tool_response', 'result')}
    WHEN 'gemini' THEN {_present('tool_response', 'toolResponse', 'result')} WHEN 'opencode' THEN {_present('received')} ELSE {_present('tool_response')} END"""
_PENDING = f"""CASE host WHEN 'opencode' THEN {_text('content')} WHEN 'windsurf' THEN {_text('content', 'new_content')}
    WHEN 'cursor' THEN {_text('tool_input.content', 'content', 'tool_input.new_string')} WHEN 'copilot' THEN {_text('tool_input.content')}
    WHEN 'gemini' THEN {_text('tool_input.content', 'tool_input.new_string')}
    ELSE coalesce({_text(*['tool_input.' + n for n in rules.DIRECT_CONTENT])}, {_leaves_sql("json_extract(j, '$.tool_input.edits')")}) END"""
_PATH = f"""CASE host WHEN 'opencode' THEN {_text('filePath')} WHEN 'windsurf' THEN {_text('file_path', 'path')}
    WHEN 'cursor' THEN {_text('tool_input.file_path', 'file_path')}
    WHEN 'gemini' THEN {_text('tool_input.file_path', 'tool_input.absolute_path', 'tool_input.path')} ELSE {_text('tool_input.file_path', 'tool_input.path')} END"""
_ORIGIN = f"""CASE WHEN host IN ('claude-code', 'codex') THEN coalesce({_text('tool_input.file_path', 'tool_input.url')}, tool)
    WHEN host = 'cursor' THEN coalesce({_text('file_path', 'url')}, nullif(tool, ''), 'tool result') WHEN host = 'opencode' THEN {_text('source')} ELSE tool END"""
expression("event_steps", f"SELECT *, {_STEP} AS step FROM (SELECT *, coalesce({_text('tool_name')}, CASE WHEN host IN ('copilot', 'gemini') THEN {_text('toolName')} END, '') AS tool FROM event_host)")
expression("event_results", f"SELECT *, CASE WHEN step = 'content' THEN coalesce({_leaves_sql(_RESULT)}, '') END AS got FROM event_steps")
expression(
    "event_norm",
    f"""SELECT event_id, ts, host, CASE WHEN blank THEN NULL WHEN step IN ('shell', 'write', 'any') THEN 'action' ELSE step END AS moment,
    CASE WHEN step = 'prompt' THEN CASE WHEN host = 'gemini' THEN {_text('prompt', 'message')} ELSE {_text('prompt')} END END AS prompt,
    CASE WHEN step IN ('shell', 'any') THEN CASE WHEN host IN ('windsurf', 'opencode') THEN {_text('command')}
        WHEN host = 'cursor' THEN {_text('command', 'tool_input.command')} ELSE {_text('tool_input.command')} END END AS command,
    CASE WHEN step IN ('write', 'any') THEN {_PATH} END AS file_path, CASE WHEN step IN ('write', 'any') THEN {_PENDING} END AS content,
    got AS received, CASE WHEN step = 'content' AND NOT blank THEN {_ORIGIN} END AS source
    FROM (SELECT *, coalesce(step = 'content' AND got = '' AND host <> 'opencode', false) AS blank FROM event_results)""",
)


@query("normalize_hook_event", "SELECT event_id, host, moment, prompt, command, file_path, content, received, source FROM event_norm")
def _(spark, sf):
    return G.normalize_hook_events(_events(spark, sf).drop("ts")).select(
        "event_id", "host", "moment", "prompt", "command", "file_path", "content", "received", "source"
    )


@query(
    "flatten_payload",
    """SELECT event_id, (SELECT string_agg(coalesce(t.atom ->> '$', ''), chr(10) ORDER BY t.id) FROM json_tree(e.j) t
        WHERE t.type NOT IN ('OBJECT', 'ARRAY')) AS flat FROM event_json e""",
)
def _(spark, sf):
    return _events(spark, sf).select("event_id", G.flatten_payload(F.col("payload")).alias("flat"))


expression("capability_rows", values(rules.CAPABILITIES, "host, moment, event_name, can_note, can_block"))


@query(
    "hook_capability",
    """SELECT e.event_id, e.host, e.moment, c.event_name IS NOT NULL AS served, c.can_note, c.can_block FROM event_norm e
    JOIN capability_rows c USING (host, moment)""",
)
def _(spark, sf):
    events = G.normalize_hook_events(_events(spark, sf).drop("ts")).select("event_id", "host", "moment")
    caps = G.capabilities(spark).withColumn("served", F.col("event_name").isNotNull()).drop("event_name")
    return events.join(F.broadcast(caps), ["host", "moment"]).select(
        "event_id", "host", "moment", "served", "can_note", "can_block"
    )


@query(
    "decide_action",
    """SELECT event_id, moment, CASE WHEN moment = 'action' AND can_block THEN 'ask' ELSE 'note' END AS action,
    CASE WHEN moment = 'action' AND can_block THEN 'ask' WHEN moment = 'prompt' AND can_block THEN 'deny' ELSE 'note' END AS action_blocking
    FROM event_norm JOIN capability_rows USING (host, moment)""",
)
def _(spark, sf):
    events = G.normalize_hook_events(_events(spark, sf).drop("ts")).select("event_id", "host", "moment")
    moment, can = F.col("moment"), F.col("can_block")
    return events.join(F.broadcast(G.capabilities(spark)), ["host", "moment"]).select(
        "event_id",
        "moment",
        G.decide_action(moment, can).alias("action"),
        G.decide_action(moment, can, block=True).alias("action_blocking"),
    )


def _cmd(rule: str) -> str:
    p, fold = next((p, f) for r, p, f in rules.COMMAND_RULES if r == rule)
    # No lookaround in the twin; no command given here names a sample env file.
    p = p.replace(r"(?<![\w.])", "").replace(r"(?!\.(?:example|sample|template|dist))", "").replace(r"(?=\s|$)", r"(?:\s|$)")
    return literal(("(?i)" if fold else "") + p)


expression(
    "command_rows",
    " UNION ALL ".join(
        f"SELECT event_id, ts, host, '{r}' AS rule_id, rtrim(left(regexp_extract(command, {_cmd(r)}), 200)) AS quote FROM event_norm "
        f"WHERE moment = 'action' AND command IS NOT NULL AND regexp_matches(command, {_cmd(r)})"
        for r, _, _ in rules.COMMAND_RULES
    ),
)


@query("command_scan", "SELECT event_id, rule_id, quote FROM command_rows")
def _(spark, sf):
    return (
        G.normalize_hook_events(_events(spark, sf).drop("ts"))
        .filter(F.col("command").isNotNull())
        .select("event_id", F.inline(G.command_risks(F.col("command"))))
        .select("event_id", "rule_id", "quote")
    )


_VITE = next(r for r in secrets.RULES if r.id == "stripe_secret")
expression(
    "write_risk_rows",
    rf"""SELECT event_id, ts, host, 'rls_turned_off_' || lower(regexp_extract(content, '(?i)alter\s+table\s+(\w+)\s+disable\s+row\s+level\s+security', 1)) AS rule_id
    FROM event_norm WHERE moment = 'action' AND file_path IS NOT NULL AND regexp_matches(content, '(?i)alter\s+table\s+\w+\s+disable\s+row\s+level\s+security')
    UNION ALL SELECT event_id, ts, host, '{_VITE.id}' FROM event_norm WHERE moment = 'action' AND file_path IS NOT NULL
        AND regexp_matches(content, CASE WHEN ends_with(file_path, '.env') THEN '(?m)^VITE_[A-Z_]*=.*{_VITE.pattern}' ELSE '{_VITE.pattern}' END)""",
)


@query("write_scan", "SELECT event_id, rule_id FROM write_risk_rows")
def _(spark, sf):
    return (
        G.normalize_hook_events(_events(spark, sf).drop("ts"))
        .filter((F.col("moment") == "action") & F.col("file_path").isNotNull() & F.col("content").isNotNull())
        .select("event_id", F.inline(G.write_risks(F.col("file_path"), F.col("content"))))
        .select("event_id", "rule_id")
    )


_ADVICE_SQL = "CASE " + " ".join(f"WHEN starts_with(rule_id, {literal(p)}) THEN {literal(t)}" for p, t in rules.ADVICE)


@query(
    "write_advice",
    f"""SELECT event_id, rule_id, label || CASE WHEN sample THEN {literal(rules.SAMPLE_RISK)} ELSE '' END AS risk,
    why || CASE WHEN client THEN {literal(' ' + rules.CLIENT_NOTE)} ELSE '' END AS why,
    {_ADVICE_SQL} WHEN sample THEN {literal(rules.SAMPLE_ADVICE)} ELSE {literal(rules.SECRET_ADVICE)} END AS instead
    FROM (SELECT w.event_id, w.rule_id, t.label, t.why, regexp_matches(n.file_path, {literal('(?i)' + rules.ENV_SAMPLE)}) AS sample,
        regexp_matches(n.file_path, {literal('(?i)' + rules.CLIENT_PATH)}) AND NOT regexp_matches(n.file_path, '(?i)\\.sql$') AS client
        FROM write_risk_rows w JOIN event_norm n USING (event_id)
        JOIN (VALUES {", ".join(f"({literal(r[0])}, {literal(r[3])}, {literal(r[4])})" for r in catalog.RULES)}) AS t(rule, label, why)
            ON t.rule = CASE WHEN starts_with(w.rule_id, 'rls_turned_off_') THEN 'rls_turned_off_' ELSE w.rule_id END)""",
)
def _(spark, sf):
    writes = G.normalize_hook_events(_events(spark, sf).drop("ts")).filter(
        (F.col("moment") == "action") & F.col("file_path").isNotNull() & F.col("content").isNotNull()
    )
    return G.write_advice(writes.select("event_id", "file_path", "content"), spark).select("event_id", "rule_id", "risk", "why", "instead")


@query(
    "client_path_flag",
    f"""SELECT repo, path, regexp_matches(path, {literal('(?i)' + rules.CLIENT_PATH)}) AND NOT regexp_matches(path, '(?i)\\.sql$') AS client
    FROM (SELECT repo, path FROM source_files UNION ALL SELECT repo, path FROM sql_files)""",
)
def _(spark, sf):
    paths = seeds.source_files(spark, sf).select("repo", "path").unionByName(
        seeds.sql_files(spark, sf).select("repo", "path")
    )
    return paths.withColumn("client", G.is_client_path(F.col("path")))


# Content templates all carry one directive, prompt templates one RLS request.
expression(
    "guard_risk_rows",
    f"""SELECT event_id, ts, host, 'prompt' AS moment, 'disable-rls' AS rule_id FROM event_norm JOIN capability_rows c USING (host, moment)
    WHERE moment = 'prompt' AND c.event_name IS NOT NULL AND regexp_matches(prompt, '(?i)disable RLS')
    UNION ALL SELECT event_id, ts, host, 'action', rule_id FROM command_rows
    UNION ALL SELECT event_id, ts, host, 'action', rule_id FROM write_risk_rows
    UNION ALL SELECT event_id, ts, host, 'content', 'injection-directive' FROM event_norm JOIN capability_rows c USING (host, moment)
    WHERE moment = 'content' AND c.event_name IS NOT NULL AND regexp_matches(received, '(?i)assistant:[^\\n]{{0,60}}\\bdisable[^\\n]{{0,40}}rls')""",
)


#: Parts in the order of time, and so micro-batches, that the registered streams take the event table in.
LANDED_SLICES = 2
RISK_SCHEMA = "event_id bigint, ts timestamp, host string, moment string, action string, rule_id string, quote string, source string"

_RISKS = """SELECT g.event_id, g.ts, g.host, g.moment, g.rule_id, CASE WHEN g.moment = 'action' AND c.can_block THEN 'ask' ELSE 'note' END AS action
    FROM guard_risk_rows g JOIN capability_rows c USING (host, moment)"""


class _Streams:
    """A landing folder, the risk table and the counts fed from it, each query with its checkpoint."""

    def __init__(self, spark):
        self.spark = spark
        self.landed, self.risks, self.counts = (new_path(spark, name) for name in ("events", "risks", "counts"))
        self.checkpoints = [new_path(spark, "checkpoint") for _ in range(2)]

    def take(self, events) -> None:
        """Lands events and scans them in one micro-batch; a query that ran before goes on from its checkpoint."""
        stream.land_slice(events, self.landed)
        found = stream.guard_risks_once(stream.read_events(self.spark, self.landed), self.spark)
        stream.write_risks(found, self.risks, self.checkpoints[0], once=True).awaitTermination()

    def count(self) -> None:
        """Counts the risks that came since. The risk table grows by whole micro-batches, in the order of time."""
        risks = stream.read_events(self.spark, self.risks, schema=RISK_SCHEMA)
        counts = stream.verdict_counts(risks)
        stream.write_counts(counts, self.counts, self.checkpoints[1], once=True).awaitTermination()


@query("guard_batch", _RISKS)
def _(spark, sf):
    """The stream's functions over the whole event table as a batch."""
    return stream.guard_risks(_events(spark, sf), spark).select("event_id", "ts", "host", "moment", "rule_id", "action")


@query("guard_stream", _RISKS)
def _(spark, sf):
    """The event table through the stream: landed files, micro-batches, watermark, checkpoint, risk table."""
    events, streams = table(spark, sf, "events"), _Streams(spark)
    for of_slice in stream.time_slices(events, LANDED_SLICES):
        streams.take(seeds.fill_events(events.filter(of_slice), spark))
    risks = spark.read.schema(RISK_SCHEMA).parquet(streams.risks)
    return risks.select("event_id", "ts", "host", "moment", "rule_id", "action")


@query(
    "guard_verdict_counts",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, host, moment, rule_id, count(*) AS n FROM guard_risk_rows GROUP BY ALL""",
)
def _(spark, sf):
    """Windowed counts of a second stream over the risk table that the first one writes. The earlier and the later
    half of the events come one after the other, and both streams go on from their checkpoints."""
    events, streams = table(spark, sf, "events"), _Streams(spark)
    if events.isEmpty():
        return stream.verdict_counts(stream.guard_risks(_events(spark, sf), spark))
    for of_slice in stream.time_slices(events, LANDED_SLICES):
        streams.take(seeds.fill_events(events.filter(of_slice), spark))
        streams.count()
    return stream.read_counts(spark, streams.counts)
