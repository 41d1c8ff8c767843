"""Configuration files of coding agents: servers they start, what those may do, and secrets in them.

A small per-file function reads JSON with comments into rows of servers and settings; the rules are native.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.model import CRITICAL, HIGH, MEDIUM
from .rules import PLACEHOLDER, SECRETS

#: Path ends of the files, the least entropy and length of a secret, key names of secrets: fixed values.
FILES = (".mcp.json", ".cursor/mcp.json", ".vscode/mcp.json", ".roo/mcp.json", "claude_desktop_config.json", "mcp_config.json", "cline_mcp_settings.json", ".claude/settings.json", ".claude/settings.local.json", ".gemini/settings.json")
ENTROPY, LENGTH = 3.5, 12
SECRET_KEY = r"(?i)key|token|secret|passw|credential|auth"
REFERENCE = r"\$\{[^}]{1,200}\}|^\$[A-Za-z_]\w*$|%[A-Za-z_]\w*%"
#: Programs that fetch and run packages; packages that are places, pinned ones, and roots that are too broad: fixed values.
RUNNERS = ("npx", "bunx", "pnpm", "uvx", "pipx", "docker", "podman")
LOCAL = r"^(?:\.{1,2}[/\\]|/|~|[A-Za-z]:[/\\]|file:|git\+|github:|https?://)|\$\{"
PINNED = r"[^@]@v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.\-]+)?$|===?\s*[\w.\-+!]+$|@sha256:"
ROOTS = r"^(?:/|~/?|\$HOME|[A-Za-z]:[\\/]?|/home(?:/[^/\\]+)?|/Users(?:/[^/\\]+)?|/root|[A-Za-z]:[\\/]Users(?:[\\/][^/\\]+)?)$"
_COMMENT_OR_STRING = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_TRAILING = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)


def read_jsonc(text: str) -> dict | None:
    """The object of a JSON text that may have comments and trailing commas; None for anything else."""
    for attempt in (lambda t: t, lambda t: _TRAILING.sub(lambda m: m[1] or "", _COMMENT_OR_STRING.sub(lambda m: m[0] if m[0][0] == '"' else "", t))):
        try:
            data = json.loads(attempt(text))
        except (ValueError, RecursionError):
            continue
        return data if isinstance(data, dict) else None
    return None


SERVERS = "project string, path string, server string, command string, args array<string>, pairs array<struct<key:string,value:string>>, urls array<string>, approved array<string>"


def servers(files: DataFrame) -> DataFrame:
    """A row for each server of the configuration files in files(project, path, text), and one without a name for a file's own settings."""

    def strings(x: object) -> list[str]:
        return [str(v) for v in x] if isinstance(x, list) else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, text in zip(b["project"], b["path"], b["text"], strict=True):
                data = read_jsonc(text or "")
                if data is None:
                    continue
                found = {k: v for block in ("mcpServers", "servers") if isinstance(data.get(block), dict) for k, v in data[block].items() if isinstance(v, dict)}
                for name, s in found.items():
                    if s.get("disabled") is True:
                        continue
                    args = strings(s.get("args"))
                    pairs = [{"key": str(k), "value": v} for block in ("env", "headers") if isinstance(s.get(block), dict) for k, v in s[block].items() if isinstance(v, str)]
                    for i, a in enumerate(args):
                        if a.startswith("--"):
                            flag, eq, value = a.partition("=")
                            value = value if eq else args[i + 1] if i + 1 < len(args) and not args[i + 1].startswith("-") else ""
                            pairs.append({"key": flag.lstrip("-"), "value": value})
                    approved = [k for k in ("autoApprove", "alwaysAllow") if strings(s.get(k))] + (["trust"] if s.get("trust") is True else [])
                    rows.append((project, path, name, str(s.get("command") or ""), args, pairs, [s[k] for k in ("url", "serverUrl", "httpUrl") if isinstance(s.get(k), str)], approved))
                allowed = strings((data.get("permissions") or {}).get("allow")) if isinstance(data.get("permissions"), dict) else []
                own = [k for k in ("enableAllProjectMcpServers",) if data.get(k) is True] + [a for a in allowed if a in ("Bash", "Bash(*)", "*")]
                if own:
                    rows.append((project, path, None, "", [], [], [], own))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SERVERS.replace("struct<key:string,value:string>", "x").split(", ")])

    known = F.lit(False)
    for end in FILES:
        known = known | (F.col("path") == end) | F.endswith("path", F.lit("/" + end))
    return files.where(known).select("project", "path", "text").mapInPandas(run, SERVERS)


def agent_config(files: DataFrame) -> DataFrame:
    """Findings: hardcoded secrets, unpinned packages, plain HTTP to other hosts, broad file roots, automatic approval."""
    none = F.array().cast("array<struct<rule:string,severity:int,confidence:int,cwe:array<string>,detail:string>>")

    def said(rule: str, severity, confidence, cwe: tuple[str, ...], detail) -> Column:
        return F.struct(F.lit(f"agent-config.{rule}").alias("rule"), severity.cast("int").alias("severity"), confidence.cast("int").alias("confidence"), F.array(*map(F.lit, cwe)).alias("cwe"), detail.alias("detail"))

    def secret(p: Column) -> Column:
        value = p["value"]
        signed = reduce(lambda a, b: a | b, (F.rlike(value, F.lit(r.pattern)) for r in SECRETS[:-1]))
        likely = F.rlike(p["key"], F.lit(SECRET_KEY)) & (F.length(value) >= LENGTH) & (scoring.entropy(value) >= ENTROPY)
        open_ = ~F.rlike(value, F.lit(REFERENCE)) & ~F.rlike(value, F.lit(PLACEHOLDER)) & (signed | likely)
        return F.when(open_, said("mcp-hardcoded-secret", F.when(signed, CRITICAL).otherwise(HIGH), F.when(signed, 2).otherwise(1), ("CWE-798",), F.concat_ws(":", "server", p["key"], scoring.redacted(value))))

    runner = F.regexp_replace(F.lower(F.element_at(F.split("command", r"[\\/]"), -1)), r"\.(?:cmd|exe|bat|ps1)$", "")
    spec = F.try_element_at(F.filter("args", lambda a: ~F.startswith(a, F.lit("-")) & ~a.isin("run", "dlx", "exec")), F.lit(1))
    unpinned = runner.isin(*RUNNERS) & spec.isNotNull() & ~F.rlike(spec, F.lit(LOCAL)) & ~F.rlike(spec, F.lit(PINNED))
    package = F.when(unpinned, said("mcp-unpinned-package", F.lit(MEDIUM), F.lit(2), ("CWE-1357", "CWE-829"), F.concat_ws(" ", runner, spec)))
    far = lambda u: F.rlike(u, F.lit(r"(?i)^http://")) & ~F.rlike(u, F.lit(r"(?i)^http://(?:localhost|127\.|\[::1\]|0\.0\.0\.0)"))
    serves = F.exists(F.array_append("args", F.col("command")), lambda a: F.rlike(a, F.lit("(?i)filesystem")))

    def root(a: Column) -> Column:
        whole = F.rlike(a, F.lit(r"^(?:/|[A-Za-z]:[\\/]?)$"))
        return F.when(serves & F.rlike(a, F.lit(ROOTS)), said("mcp-broad-filesystem-root", F.when(whole, HIGH).otherwise(MEDIUM), F.lit(2), ("CWE-732", "CWE-552"), a))

    hits = [
        F.transform("pairs", secret), F.array(package), F.transform("urls", lambda u: F.when(far(u), said("mcp-plaintext-http", F.lit(MEDIUM), F.lit(2), ("CWE-319",), u))), F.transform("args", root),
        F.transform("approved", lambda w: said("agent-auto-approve", F.when(w.isin("Bash", "Bash(*)", "*"), HIGH).otherwise(MEDIUM), F.lit(2), ("CWE-862",), F.concat_ws(":", "server", w))),
    ]
    found = F.filter(F.concat(*(F.coalesce(h, none) for h in hits)), lambda x: x.isNotNull())
    rows = servers(files).select("project", "path", F.explode(found).alias("h"))
    return rows.select("project", "path", F.lit(None).cast("int").alias("start_line"), F.col("h.rule").alias("rule_id"), F.lit("agent-config").alias("scanner"), "h.severity", "h.confidence", F.lit(2).alias("likelihood"), "h.cwe", F.col("h.detail").alias("snippet"), F.array(F.lit("agent")).alias("tags"))
