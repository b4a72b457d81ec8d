"""The usage fact table. Instants are UTC wall clock (TIMESTAMP_NTZ), so no result depends on the session's time zone."""

USAGE = (
    "provider string, project string, session_id string, model string, started_at timestamp_ntz, input_tokens bigint, output_tokens bigint, "
    "cache_read_tokens bigint, cache_write_tokens bigint, cost_micros bigint, raw_bytes bigint, fingerprint string"
)
BUCKETS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
SUMS = (*BUCKETS, "cost_micros")

#: Ids of the tools in registry order, with display names (fixed values).
PROVIDERS = {
    "claude": "Claude Code",
    "codex": "Codex CLI",
    "gemini": "Gemini CLI",
    "antigravity": "Antigravity",
    "codebuddy": "CodeBuddy",
    "workbuddy": "WorkBuddy",
    "opencode": "OpenCode",
    "qoder": "Qoder",
    "openclaw": "OpenClaw",
    "deepseek": "DeepSeek Harness",
    "pi": "Pi",
    "trae": "Trae",
}
