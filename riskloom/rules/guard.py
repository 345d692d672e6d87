"""Hook events: hosts, what each can do at each moment, path classes and command rules."""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------------

# (host, moment, event name or None, can add a note, can block)
CAPABILITIES = [
    ("claude-code", "prompt", "UserPromptSubmit", True, True),
    ("claude-code", "action", "PreToolUse", True, True),
    ("claude-code", "content", "PostToolUse", True, False),
    ("codex", "prompt", "UserPromptSubmit", True, True),
    ("codex", "action", "PreToolUse", True, True),
    ("codex", "content", "PostToolUse", True, True),
    ("cursor", "prompt", "beforeSubmitPrompt", False, True),
    ("cursor", "action", "beforeShellExecution", True, True),
    ("cursor", "content", "postToolUse", True, False),
    ("copilot", "prompt", None, False, False),
    ("copilot", "action", "preToolUse", False, True),
    ("copilot", "content", "postToolUse", True, False),
    ("gemini", "prompt", "BeforeAgent", True, True),
    ("gemini", "action", "BeforeTool", False, True),
    ("gemini", "content", "AfterTool", True, True),
    ("windsurf", "prompt", "pre_user_prompt", False, True),
    ("windsurf", "action", "pre_run_command", False, True),
    ("windsurf", "content", None, False, False),
    ("opencode", "prompt", "chat.message", True, True),
    ("opencode", "action", "tool.execute.before", True, True),
    ("opencode", "content", "tool.execute.after", True, True),
]

WRITE_TOOL = r"^(write|edit|create|apply_patch|multiedit|notebookedit|str_replace|replace|write_file|developer__write|developer__edit)$"
SHELL_TOOL = r"^(bash|shell|powershell|runcommand|run_shell_command|terminal|developer__shell|execute)$"
DIRECT_CONTENT = ["content", "new_string", "new_str", "patch", "diff", "text"]
EDIT_LISTS = ["edits", "replacements", "changes"]

SQL_FILE = r"\.sql$"
DDL_TEXT = r"\b(alter|create)\s+table\b"
NOT_SOURCE = r"(^|[\\/])(\.git[\\/]|node_modules[\\/]|dist[\\/]|build[\\/]|\.next[\\/])"
ENV_FILE = r"(^|[\\/])\.env(\.[\w-]+)?$"
ENV_SAMPLE = r"(^|[\\/])\.env\.(example|sample|template|dist|defaults)$"
PUBLIC_PREFIX = r"^\s*(?:export\s+)?(NEXT_PUBLIC_|VITE_|PUBLIC_|REACT_APP_|EXPO_PUBLIC_|GATSBY_|NUXT_PUBLIC_|VUE_APP_)"
FIXTURE = r"(^|[\\/])(test|tests|__tests__|__mocks__|spec|fixtures?|examples?|e2e|cypress|playwright)[\\/]|\.(test|spec|fixture|stories)\.[jt]sx?$"
CLIENT_PATH = r"(^|[\\/])(src|app|components|pages|client|public|static|assets)[\\/]|\.(jsx|tsx|vue|svelte)$"

COMMAND_QUOTE_CHARS = 200
# (id, pattern, ignore case)
COMMAND_RULES = [
    ("cmd-disable-rls", r"disable\s+row\s+level\s+security", True),
    (
        "cmd-commit-env",
        r"\bgit\s+add\b[^\n&;|#]{0,60}(?<![\w.])\.env\b(?!\.(?:example|sample|template|dist))|\bgit\s+add\s+(?:-A\b|--all\b|\.(?=\s|$))",
        True,
    ),
    (
        "cmd-skip-verification",
        r"--no-verify\b|--insecure\b|\bNODE_TLS_REJECT_UNAUTHORIZED\s*=\s*0\b|curl[^\n]{0,40}\s-k\b",
        True,
    ),
    (
        "cmd-secret-to-network",
        r"\b(?:curl|wget|nc|http)\b[^\n]{0,120}\$\{?(?:[A-Z_]*(?:SECRET|TOKEN|KEY|PASSWORD)[A-Z_]*)\}?",
        False,
    ),
]

# ---- end of fixed values ------------------------------------------------------------------

#: What to do about a pending write, by the beginning of the risk's id.
ADVICE = [
    ("rls_turned_off_", "Keep row level security on and add a policy for the rows that this query needs."),
    ("policy_dropped_", "See which policies the table keeps before this runs; with none, nobody reads a row."),
    ("permissive_policy", "Say in the policy who may see a row; a condition that always holds protects nothing."),
    ("security_definer", "Let the function run as its caller, or fix its search path and check each argument."),
    ("grant_anon_", "Grant to signed-in users and let row level security choose the rows."),
]
SECRET_ADVICE = "Read the value from the server's environment; a key that was committed or deployed must be replaced."
SAMPLE_ADVICE = "Put a placeholder here: sample files are committed, so a real value is public and must be replaced."
SAMPLE_RISK = ", in a sample file that is committed"
CLIENT_NOTE = "The file is bundled and sent to browsers."
