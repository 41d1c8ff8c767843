"""Line rules: a rule set becomes one projection over windows of lines, not a join of lines with rules.

Each rule is (id, severity, CWEs, languages or suffixes, pattern, suppress, confidence). A line gives a
rule one finding at most, at its first window. Regular expressions are Java's, on windows of bounded
length. The literal patterns are fixed values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.model import CRITICAL, HIGH, INFO, LOW, MEDIUM
from ..sources.files import MAX_LINE, base_name, line_array, pieces, suffix, text_has

PYTHON, JS = ("Python",), ("JavaScript", "TypeScript")
CURL_PIPE = r"(?i)\b(?:curl|wget|fetch)\s+[^\s|][^\n|]*\|\s*(?:sudo\s+(?:-\S+\s+)*)?(?:ba|z)?sh\b"
TEST_PATH = r"(?i)(^|/)(tests?|testing|__tests__|fixtures?|specs?)/|(^|/)(test_[^/]*|[^/]*_test|conftest)\.[a-z0-9]+$"
WORKFLOW = r"(?i)(^|/)\.github/workflows/[^/]+\.ya?ml$|(^|/)\.gitlab-ci\.ya?ml$|(^|/)Jenkinsfile$|azure-pipelines\.ya?ml$|(^|/)\.circleci/config\.ya?ml$"
COMPOSE = r"(?i)(^|/)(docker-)?compose[^/]*\.ya?ml$"
HELM = r"(?i)(^|/)values[^/]*\.ya?ml$"
SECRET_ENV = r"(?i)(password|secret|token|api_key)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{8,}"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: int
    cwe: tuple[str, ...]
    pattern: str
    languages: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    kind: str = ""  # a class of file that file_kind() tells
    confidence: int = 1
    likelihood: int = 2
    suppress: str = ""
    absent: bool = False  # fires once a file where no line has the pattern

    @property
    def scanner(self) -> str:
        return "lang-sast" if self.id.startswith("lang.") else "business-logic" if self.id.startswith("logic.") else self.id.split(".")[0]


PATTERNS = (
    Rule("patterns.python-sql-fstring", HIGH, ("CWE-89",), r"(?i)f['\"](?>[^\n]*?\b(?:select|insert|update|delete)\b)(?>[^\n]*?\b(?:from|where|into|set|values)\b)(?>[^\n]*?\{)[^\n]*\}", PYTHON),
    Rule("patterns.python-sql-format", HIGH, ("CWE-89",), r"(?i)(execute|executemany)\s*\(\s*['\"](?>.*?\b(?:select|insert|update|delete|drop)\b).*?['\"]\s*(%|\+|\.format\()", PYTHON),
    Rule("patterns.js-sql-concat", HIGH, ("CWE-89",), r"(?i)(query|execute)\s*\(\s*[`'\"].*?(select|insert|update|delete).*?[`'\"]\s*\+|\$\{[^}]+\}.*?(from|where)", JS, confidence=0),
    Rule("patterns.python-shell-true", HIGH, ("CWE-78",), r"subprocess\.(?:call|run|Popen|check_output)\(.*shell\s*=\s*True", PYTHON),
    Rule("patterns.python-os-system", HIGH, ("CWE-78",), r"os\.system\(\s*(?:[^)]*[+%]|f['\"])", PYTHON),
    Rule("patterns.js-child-process-exec", HIGH, ("CWE-78",), r"child_process\.exec\(|\bexec\(\s*[`'\"].*?\$\{", JS),
    Rule("patterns.go-sql-sprintf", HIGH, ("CWE-89",), r"(?i)\.(Query|QueryRow|Exec|QueryContext|ExecContext)\w*\(\s*(fmt\.Sprintf\(|[^,)]*\+)", ("Go",)),
    Rule("patterns.go-command-injection", HIGH, ("CWE-78",), r'exec\.Command(?:Context)?\(\s*["`](?:/bin/)?(?:sh|bash|zsh)["`]\s*,\s*["`]-c["`]|exec\.Command(?:Context)?\(\s*["`]cmd(?:\.exe)?["`]\s*,\s*["`]/[cC]["`]', ("Go",)),
    Rule("patterns.go-weak-hash", MEDIUM, ("CWE-327",), r"\b(md5|sha1)\.(New|Sum)\(", ("Go",)),
    Rule("patterns.go-ssrf-request", MEDIUM, ("CWE-918",), r"(?i)http\.(Get|Post|Head)\(\s*(?![\"`])[^),]*\b(r\.|req\.|request\.|param|input|user|query)", ("Go",), confidence=0),
    Rule("patterns.python-eval-exec", HIGH, ("CWE-95",), r"(?<![\w.])(eval|exec)\s*\(\s*(?!['\"]\s*\))", PYTHON, confidence=0),
    Rule("patterns.python-yaml-load", HIGH, ("CWE-502",), r"yaml\.load\((?![^)]*Safe)", PYTHON),
    Rule("patterns.python-pickle-loads", HIGH, ("CWE-502",), r"\bpickle\.(loads|load)\(", PYTHON, confidence=0, suppress=r"pickle\.loads\(\s*pickle\.dumps"),
    Rule("patterns.js-innerhtml", MEDIUM, ("CWE-79",), r"\.innerHTML\s*=\s*[^'\"];?|dangerouslySetInnerHTML", JS, confidence=0),
    Rule("patterns.python-markup-dynamic", MEDIUM, ("CWE-79",), r"(?<![\w.])(?:Markup|mark_safe)\(\s*(?:[fF]['\"]|(['\"])[^'\"\n]*\1\s*(?:%|\+|\.format\())", PYTHON, confidence=0),
    Rule("patterns.template-unescaped-output", LOW, ("CWE-79",), r"\{\{[^}\n]*\|\s*safe\s*\}\}|\{%-?\s*autoescape\s+(?:false|off)\s*-?%\}", ("HTML",), confidence=0),
    Rule("patterns.python-xml-resolve-entities", MEDIUM, ("CWE-611",), r"XMLParser\([^)\n]*resolve_entities\s*=\s*True", PYTHON),
    Rule("patterns.python-open-redirect", MEDIUM, ("CWE-601",), r"(?<![\w.])(?:redirect|HttpResponseRedirect)\(\s*request\.(?:args|form|values|GET|POST)\b", PYTHON),
    Rule("patterns.python-weak-random-token", MEDIUM, ("CWE-330", "CWE-338"), r"(?i)(?:token|secret|passw|nonce|otp|salt|session|csrf|api_?key)\w*\s*=[^=\n#][^\n#]*(?<![\w.])random\.(?:random|randint|randrange|choice|choices|getrandbits|randbytes|sample)\(", PYTHON),
    Rule("patterns.weak-hash-md5-sha1", MEDIUM, ("CWE-327",), r"(?i)(hashlib\.(md5|sha1)\(|MessageDigest\.getInstance\(\s*['\"](MD5|SHA-?1)|createHash\(\s*['\"](md5|sha1)|hashlib\.new\(\s*(?:name\s*=\s*)?['\"](?:md4|md5|sha1|md5-sha1)['\"])", suppress=r"usedforsecurity\s*=\s*False"),
    Rule("patterns.tls-verify-disabled", HIGH, ("CWE-295",), r"(?i)(verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|CURLOPT_SSL_VERIFYPEER\s*,\s*(0|false))"),
    Rule("patterns.path-traversal-join", MEDIUM, ("CWE-22",), r"(?i)(open|readFile|sendFile|File)\(\s*(?>[^)]*?(?:request|req\.|params|input|argv))[^)]*\)", confidence=0),
    Rule("patterns.flask-debug-true", MEDIUM, ("CWE-489",), r"app\.run\([^)]*debug\s*=\s*True", PYTHON),
)

LANGUAGE = (
    Rule("lang.java.sql-stmt", HIGH, ("CWE-89",), r"Statement\s*\.\s*execute(?:Query|Update)?\s*\(\s*[^)]*\+", suffixes=(".java",)),
    Rule("lang.java.deser", HIGH, ("CWE-502",), r"ObjectInputStream\s*\(", suffixes=(".java",)),
    Rule("lang.php.shell", HIGH, ("CWE-78",), r"\b(?:shell_exec|system|passthru|exec)\s*\(", suffixes=(".php",)),
    Rule("lang.php.sql", HIGH, ("CWE-89",), r"mysql_query\s*\(\s*[^)]*\.", suffixes=(".php",)),
    Rule("lang.ruby.eval", HIGH, ("CWE-94",), r"\beval\s*\(", suffixes=(".rb",)),
    Rule("lang.ruby.system", MEDIUM, ("CWE-78",), r"\bsystem\s*\(", suffixes=(".rb",)),
    Rule("lang.rust.unwrap", LOW, ("CWE-754",), r"\.unwrap\s*\(\s*\)", suffixes=(".rs",)),
    Rule("lang.rust.unsafe", MEDIUM, ("CWE-119",), r"\bunsafe\s*\{", suffixes=(".rs",)),
    Rule("lang.cpp.strcpy", HIGH, ("CWE-120",), r"\bstrcpy\s*\(", suffixes=(".cpp",)),
    Rule("lang.cpp.system", HIGH, ("CWE-78",), r"\bsystem\s*\(", suffixes=(".cpp",)),
    Rule("lang.c.gets", CRITICAL, ("CWE-120",), r"\bgets\s*\(", suffixes=(".c",)),
    Rule("lang.c.sprintf", HIGH, ("CWE-120",), r"\bsprintf\s*\(", suffixes=(".c",)),
    Rule("lang.go.sql-sprintf", HIGH, ("CWE-89",), r"(?i)\.(Query|Exec)\w*\(\s*fmt\.Sprintf\(", suffixes=(".go",)),
    Rule("lang.go.unsafe", MEDIUM, ("CWE-119",), r"\bunsafe\.Pointer\b", suffixes=(".go",)),
    Rule("lang.csharp.sql-concat", HIGH, ("CWE-89",), r"(?i)SqlCommand\s*\([^)]*\+", suffixes=(".cs",)),
    Rule("lang.csharp.deser", HIGH, ("CWE-502",), r"BinaryFormatter\s*\(", suffixes=(".cs",)),
    Rule("lang.kotlin.runtime-exec", HIGH, ("CWE-78",), r"Runtime\.getRuntime\(\)\.exec\s*\(", suffixes=(".kt",)),
    Rule("lang.swift.shell", MEDIUM, ("CWE-78",), r"Process\s*\(\)\.launch", suffixes=(".swift",)),
    Rule("lang.shell.curl-pipe", HIGH, ("CWE-494",), CURL_PIPE, suffixes=(".sh",)),
    Rule("lang.shell.eval-var", HIGH, ("CWE-94",), r"\beval\s+[\"']?\$", suffixes=(".sh",)),
    Rule("lang.ps1.iex", HIGH, ("CWE-94",), r"\bIEX\s*\(", suffixes=(".ps1",)),
    Rule("lang.ps1.download", MEDIUM, ("CWE-494",), r"DownloadString\s*\(", suffixes=(".ps1",)),
)

_COMMENT = r"^\s*(?:#|//|/\*|\*)"
MALWARE = (
    Rule("malware.obfuscated-exec", CRITICAL, ("CWE-94", "CWE-506"), r"(?i)(?:base64|b64)(?:\.decode|decode)\s*\([^)]+\).*?(?:eval|exec)\(|(?:eval|exec)\s*\(\s*(?:base64|b64)(?:\.decode|decode)|(?:eval|exec)\s*\(\s*(?:bytes\.fromhex|zlib\.decompress|__import__\(['\"]zlib['\"]\))", PYTHON, confidence=2, suppress=_COMMENT),
    Rule("malware.python-backdoor-import", CRITICAL, ("CWE-94", "CWE-78"), r"(?i)__import__\s*\(\s*['\"](?:os|subprocess|pty)['\"]\s*\)\.(?:system|popen|call|run|spawn)|getattr\s*\(\s*__import__\s*\(\s*['\"]os['\"]", PYTHON, confidence=2, suppress=_COMMENT),
    Rule("malware.reverse-shell-bash", CRITICAL, ("CWE-94",), r"(?i)/dev/tcp/|bash\s+-i\s+>&\s*/dev/tcp/|\bnc\s+(?:-e|-c)\s+|\bnetcat\s+(?:-e|-c)\s+|python\s+-c\s+['\"](?>.*?socket).*subprocess", confidence=2, suppress=_COMMENT),
    Rule("malware.curl-pipe-shell", HIGH, ("CWE-494", "CWE-506"), CURL_PIPE + r"|\b(?:curl|wget)\s+[^\s|][^\n|]*\|\s*(?:python[0-9.]*|perl|ruby)\b", confidence=2, suppress=_COMMENT),
    Rule("malware.php-webshell", CRITICAL, ("CWE-94",), r"(?i)\b(?:eval|assert|preg_replace\s*\(\s*['\"]/.*?/e['\"])\s*\(\s*\$_(?:POST|GET|REQUEST|COOKIE)|\bsystem\s*\(\s*\$_(?:POST|GET|REQUEST)|\bpassthru\s*\(\s*\$_(?:POST|GET|REQUEST)", ("PHP",), confidence=2, suppress=_COMMENT),
    Rule("malware.js-atob-eval", CRITICAL, ("CWE-94",), r"(?i)(?:atob|Buffer\.from)\s*\([^)]+\).*?\beval\s*\(|\beval\s*\(\s*(?:atob|Buffer\.from|unescape|decodeURIComponent)\s*\(|new\s+Function\s*\(\s*(?:atob|unescape)", JS, confidence=2, suppress=_COMMENT),
    Rule("malware.cryptominer", HIGH, ("CWE-506",), r"(?i)stratum\+tcp://|\bcoinhive\b|\bcrypto[-_]?loot\b|\bxmrig\b|\bmonero\b.*(?:pool|miner|hash)|coinimp", confidence=2, suppress=_COMMENT),
    Rule("malware.data-exfil-env", HIGH, ("CWE-200", "CWE-522"), r"(?i)(?:requests|httpx|urllib)\.(?:post|put|get)\s*\(\s*['\"]https?://[^'\"]+['\"][^)]*(?:os\.environ|getenv|process\.env|ENV\[)|(?:curl|wget)\s[^\n]*(?:\$[A-Z_]+|process\.env\.|%[A-Z_]+%)", confidence=2, suppress=_COMMENT),
    Rule("malware.powershell-encoded", CRITICAL, ("CWE-94",), r"(?i)-(?:enc|encodedcommand|e)\s+[A-Za-z0-9+/=]{20,}|\bIEX\s*\(\s*(?:New-Object|(?:Net\.WebClient|System\.Net\.WebClient))", ("PowerShell",), confidence=2, suppress=_COMMENT),
    Rule("malware.suspicious-postinstall", HIGH, ("CWE-506",), r"(?i)\"(?:preinstall|install|postinstall|prepare)\"\s*:\s*\"(?:[^\"\\]|\\.)*(?:curl|wget|eval|base64|node\s+-e|powershell|https?://|\|\s*sh)(?:[^\"\\]|\\.)*\"", ("JSON",), confidence=2, suppress=_COMMENT),
)

INSTALL_SCRIPT = "malware.suspicious-postinstall"

IAC = (
    Rule("iac.docker-user-root", MEDIUM, ("CWE-250",), r"(?i)^\s*USER\s", kind="dockerfile", absent=True),
    Rule("iac.docker-latest-tag", LOW, ("CWE-1104",), r"(?i)^\s*FROM\s+\S+:latest\b|^\s*FROM\s+[^:@\s]+\s*$", kind="dockerfile"),
    Rule("iac.docker-add-remote", LOW, ("CWE-494",), r"(?i)^\s*ADD\s+https?://", kind="dockerfile"),
    Rule("iac.docker-curl-bash", MEDIUM, ("CWE-494",), CURL_PIPE, kind="dockerfile"),
    Rule("iac.k8s-privileged", HIGH, ("CWE-250",), r"(?i)privileged:\s*true", kind="kubernetes"),
    Rule("iac.k8s-run-as-root", MEDIUM, ("CWE-250",), r"(?i)runAsNonRoot:\s*false", kind="kubernetes"),
    Rule("iac.k8s-host-network", MEDIUM, ("CWE-668",), r"(?i)hostNetwork:\s*true", kind="kubernetes"),
    Rule("iac.tf-sg-open-world", HIGH, ("CWE-284",), r'cidr_blocks\s*=\s*\[[^\]]*"0\.0\.0\.0/0"', kind="terraform"),
    Rule("iac.tf-s3-public", HIGH, ("CWE-284",), r'acl\s*=\s*"public-read(-write)?"', kind="terraform"),
    Rule("iac.tf-unencrypted-storage", MEDIUM, ("CWE-311",), r"(?i)encrypted\s*=\s*false", kind="terraform"),
)

CONTAINER = (
    Rule("container.privileged", HIGH, ("CWE-250", "CWE-798"), r"(?i)privileged:\s*true", kind="compose"),
    Rule("container.host-network", HIGH, ("CWE-250", "CWE-798"), r"(?i)network_mode:\s*['\"]?host['\"]?", kind="compose"),
    Rule("container.image-latest", LOW, ("CWE-250", "CWE-798"), r"(?i)image:\s*\S+:latest", kind="compose"),
    Rule("container.env-secret", CRITICAL, ("CWE-250", "CWE-798"), SECRET_ENV, kind="compose"),
    Rule("container.k8s-image-latest", MEDIUM, ("CWE-250", "CWE-798"), r"(?i)image:\s*\S+:latest", kind="kubernetes"),
    Rule("container.k8s-image-no-digest", LOW, ("CWE-250", "CWE-798"), r"(?i)image:\s*[^\s@]+\s*$", kind="kubernetes", suppress=r"(?i)image:\s*\S+:latest"),
    Rule("container.helm-values-secret", HIGH, ("CWE-250", "CWE-798"), SECRET_ENV, kind="helm"),
    Rule("container.dockerfile-env-secret", HIGH, ("CWE-250", "CWE-798"), r"(?i)^\s*ENV\s+.*(PASSWORD|SECRET|TOKEN|API_KEY)\s*=", kind="dockerfile"),
)

CICD = (
    Rule("cicd.pull-request-target", HIGH, ("CWE-798",), r"pull_request_target\s*:", kind="workflow"),
    Rule("cicd.unpinned-action", MEDIUM, ("CWE-798",), r"uses:\s*[\w./-]+@(?![a-f0-9]{40}\b)(?:v[\w./-]+|[a-zA-Z][\w./-]*)", kind="workflow"),
    Rule("cicd.excessive-permissions", MEDIUM, ("CWE-798",), r"permissions:\s*write-all", kind="workflow"),
    Rule("cicd.script-injection", HIGH, ("CWE-94",), r"run:\s*[^\n]*\$\{\{\s*github\.(event\.(issue|comment|discussion)|head_ref)", kind="workflow"),
    Rule("cicd.hardcoded-secret", CRITICAL, ("CWE-798",), r"(?i)(password|secret|token|api_key)\s*:\s*['\"]?[A-Za-z0-9_./+=-]{8,}", kind="workflow"),
    Rule("cicd.curl-pipe-bash", HIGH, ("CWE-798",), CURL_PIPE, kind="workflow"),
    Rule("cicd.privileged-container", HIGH, ("CWE-250",), r"(?i)privileged:\s*true|options:\s*.*--privileged", kind="workflow"),
)

CLOUD = (
    Rule("cloud.public-s3-acl", HIGH, ("CWE-284",), r'acl\s*=\s*"public-read|public_access_block\s*\{[^}]*block_public_acls\s*=\s*false', kind="terraform"),
    Rule("cloud.open-security-group", HIGH, ("CWE-284",), r'0\.0\.0\.0/0|cidr\s*=\s*"0\.0\.0\.0/0"|source_ranges\s*=\s*\["0\.0\.0\.0/0"\]', kind="terraform"),
    Rule("cloud.unencrypted-rds", MEDIUM, ("CWE-284",), r"(?i)storage_encrypted\s*=\s*false|encrypt\s*=\s*false", kind="terraform"),
    Rule("cloud.azure-public-blob", HIGH, ("CWE-284",), r"allow_blob_public_access\s*=\s*true", kind="terraform"),
    Rule("cloud.gcp-public-bucket", HIGH, ("CWE-284",), r"allUsers|allAuthenticatedUsers", kind="terraform"),
)

_LOGIC = (".py", ".js", ".ts", ".java", ".php", ".rb")
LOGIC = (
    Rule("logic.price-from-request", HIGH, ("CWE-840",), r"(?i)(?:price|amount|total|cost)\s*=\s*(?:request|req|params|body|input)\b", suffixes=_LOGIC),
    Rule("logic.quantity-from-request", MEDIUM, ("CWE-840",), r"(?i)(?:quantity|qty|count)\s*=\s*(?:request|req|params|body|input)\b", suffixes=_LOGIC),
    Rule("logic.coupon-abuse", HIGH, ("CWE-840",), r"(?i)(?:coupon|discount|promo)[^;\n]{0,80}(?:100|999999|true\s*;\s*return\s*true)", suffixes=_LOGIC),
)

LLM = (
    Rule("llm.trust-remote-code", HIGH, ("CWE-494", "CWE-829"), r"trust_remote_code\s*=\s*True", confidence=2),
    Rule("llm.torch-load-pickle", HIGH, ("CWE-502",), r"torch\.load\((?![^)]*weights_only\s*=\s*True)", PYTHON),
    Rule("llm.model-download-http", MEDIUM, ("CWE-319", "CWE-494"), r"(?i)http://[^\s'\"]+\.(?:bin|pt|pth|onnx|safetensors|gguf|ckpt|h5|pkl)\b"),
    Rule("llm.agent-shell-tool", HIGH, ("CWE-250", "CWE-732"), r"\b(?:ShellTool|BashProcess|PythonREPLTool|TerminalTool)\s*\("),
    Rule("llm.unrestricted-tool-registration", HIGH, ("CWE-732",), r"(?i)allow_dangerous_(?:tools|requests|code)\s*=\s*True"),
    Rule("llm.secret-in-prompt", HIGH, ("CWE-522", "CWE-200"), r"(?i)(?:prompt|system|messages?)\s*[:=].{0,120}(?:api[_-]?key|password|secret)\s*[:=]\s*\S{6,}"),
    Rule("llm.prompt-injection", MEDIUM, ("CWE-74",), r"(?i)(?:prompt|messages?)\w*\s*=\s*f['\"].*\{\s*(?:request|user_input|input|query)\b", (*PYTHON, *JS), confidence=0),
)

#: Signatures of secrets: our own definitions, with the value in the first group. They read whole lines of histories, so
#: none may take more than one pass over a run of letters or recurse over the words of a line.
SECRETS = (
    Rule("secrets.aws-access-key-id", CRITICAL, ("CWE-798",), r"(?<![A-Z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Z0-9])", confidence=2),
    Rule("secrets.aws-secret-access-key", CRITICAL, ("CWE-798",), r"(?i)aws_?secret_?(?:access_?)?key\s*[:=]\s*['\"]?([A-Za-z0-9/+]{40})\b", confidence=2),
    Rule("secrets.private-key-block", CRITICAL, ("CWE-798",), r"(-----BEGIN (?! |[A-Z ]*  )(?:[A-Z ]*[A-Z] |)PRIVATE KEY-----)", confidence=2),
    Rule("secrets.github-token", CRITICAL, ("CWE-798",), r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b", confidence=2),
    Rule("secrets.google-api-key", HIGH, ("CWE-798",), r"\b(AIza[0-9A-Za-z_-]{35})", confidence=2),
    Rule("secrets.json-web-token", MEDIUM, ("CWE-798",), r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    Rule("secrets.url-credentials", HIGH, ("CWE-798",), r"[a-z][0-9+]*://[^\s/:@'\"]+:([^\s/@'\"]{3,})@"),
    Rule("secrets.generic-credential", HIGH, ("CWE-798",), r"(?i)(?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*['\"]?([A-Za-z0-9_/+=-]{8,})"),
)
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[_-]|xxxx|<[^>]+>|\$\{|dummy|redacted|sample"

ALL = (*PATTERNS, *LANGUAGE, *MALWARE, *IAC, *CONTAINER, *CICD, *CLOUD, *LOGIC, *LLM, *SECRETS)
#: The patterns tier leaves these languages alone unless a rule names them.
QUIET = ("JSON", "CSS", "HTML", "YAML", "Text", "Markdown")


def file_kind(path: Column, text: Column) -> Column:
    """A file's class for configuration rules: dockerfile, compose, workflow, terraform, kubernetes, helm or null."""
    head = F.substring(text, 1, 400)
    return (
        F.when(F.startswith(base_name(path), F.lit("Dockerfile")) | (base_name(path) == "Containerfile"), "dockerfile")
        .when(F.rlike(path, F.lit(COMPOSE)), "compose")
        .when(F.rlike(path, F.lit(WORKFLOW)), "workflow")
        .when(suffix(path).isin(".tf", ".hcl"), "terraform")
        .when(suffix(path).isin(".yml", ".yaml") & F.contains(head, F.lit("apiVersion:")) & F.contains(head, F.lit("kind:")), "kubernetes")
        .when(F.rlike(path, F.lit(HELM)), "helm")
    )


def _applies(rule: Rule) -> Column | None:
    """Where a rule looks, by language and file class; None for everywhere."""
    tests = []
    if rule.languages:
        tests.append(F.col("language").isin(*rule.languages))
    elif rule.scanner == "patterns":
        tests.append(F.col("language").isNotNull() & ~F.col("language").isin(*QUIET))
    if rule.suffixes:
        tests.append(F.col("suffix").isin(*rule.suffixes))
    if rule.kind:
        tests.append(F.col("kind") == rule.kind)
    return reduce(lambda a, b: a & b, tests) if tests else None


def _about(rules: Sequence[Rule]) -> Column:
    """A constant array of what findings of the rules say, in their order."""
    rows = [{"rule_id": r.id, "scanner": r.scanner, "severity": r.severity, "confidence": r.confidence, "likelihood": r.likelihood, "cwe": list(r.cwe)} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,scanner:string,severity:int,confidence:int,likelihood:int,cwe:array<string>>>")


def _matches(rules: Sequence[Rule], segment: Column, lowered: Column) -> Column:
    """An array of the numbers of the rules that match a segment and the values that they found. lowered: the segment in lower case.

    A rule looks for a literal that its matches must hold before it is tried.
    """
    where: dict = {}
    hits = []
    for i, r in enumerate(rules, 1):
        place = (r.languages, r.scanner == "patterns", r.suffixes, r.kind)
        if place not in where:
            where[place] = _applies(r)
        hit = F.rlike(segment, F.lit(r.pattern))
        asked = guards.guard(r.pattern, segment, lowered)
        hit = hit if asked is None else asked & hit
        hit = hit if where[place] is None else where[place] & hit
        if r.suppress:
            hit = hit & ~F.rlike(segment, F.lit(r.suppress))
        value = F.regexp_extract(segment, r.pattern, 1 if r.scanner == "secrets" else 0)
        if r.scanner == "secrets":
            hit = hit & ~F.rlike(value, F.lit(PLACEHOLDER))
        hits.append(F.when(hit, F.struct(F.lit(i).alias("rule"), value.alias("value"))))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _install_alone(rules: Sequence[Rule], hits: Column) -> Column:
    """Hits of a window where a suspicious install script is the one malware finding: it says what the others would."""
    install = [i for i, r in enumerate(rules, 1) if r.id == INSTALL_SCRIPT]
    others = [i for i, r in enumerate(rules, 1) if r.scanner == "malware" and r.id != INSTALL_SCRIPT]
    if not install or not others:
        return hits

    def alone(h: Column) -> Column:
        return F.when(F.exists(h, lambda x: x["rule"].isin(*install)), F.filter(h, lambda x: ~x["rule"].isin(*others))).otherwise(h)

    return F.flatten(F.transform(F.array(hits), alone))


def placed(files: DataFrame) -> DataFrame:
    """files with suffix and kind."""
    return files.withColumn("suffix", suffix(F.col("path"))).withColumn("kind", file_kind(F.col("path"), F.col("text")))


def match_rules(files: DataFrame, rules: Sequence[Rule] = ALL) -> DataFrame:
    """Findings of rules in files(project, path, language, size, text): one for each rule and line.

    Files of test code keep their findings one severity lower, at low confidence and tagged.
    """
    there = placed(files)
    found = [r for r in rules if not r.absent]

    about = _about(found)

    def in_window(w: Column) -> Column:
        return F.transform(_install_alone(found, _matches(found, w["segment"], w["lowered"])), lambda x: F.struct(x["rule"].alias("rule"), x["value"].alias("value"), w["offset"].alias("offset")))

    cut = F.transform(pieces(F.col("content")), lambda w: F.struct(w["offset"].alias("offset"), w["segment"].alias("segment"), F.lower(w["segment"]).alias("lowered")))
    rows = _lines_of(there, found).withColumn("windows", cut)
    rows = rows.select("project", "path", "line", "content", F.flatten(F.transform("windows", in_window)).alias("hits"))
    # a rule that several windows of a line match counts in the first; no shuffle
    names = F.transform("hits", lambda x: F.element_at(about, x["rule"])["rule_id"])
    first = F.when(F.size("hits") < 2, F.col("hits")).otherwise(F.filter("hits", lambda x, i: F.array_position(names, F.element_at(about, x["rule"])["rule_id"]) == i + 1))
    # an outer explode: before an inner one the optimizer tests the array, and runs all rules again for that
    rows = rows.select("project", "path", "line", "content", F.explode_outer(first).alias("f")).where(F.col("f.rule").isNotNull()).select("project", "path", "line", "content", F.element_at(about, F.col("f.rule")).alias("about"), "f.value", "f.offset")
    start = F.instr(F.substring("content", F.col("offset") + 1, F.lit(MAX_LINE)), F.col("value")) + F.col("offset")
    out = rows.select("project", "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "about.*", start.cast("int").alias("start_column"), (start + F.length("value")).cast("int").alias("end_column"), "value", F.substring(F.trim("content"), 1, 200).alias("snippet"))
    absent = [r for r in rules if r.absent]
    if absent:
        tests = [~text_has(F.col("text"), r.pattern) if (place := _applies(r)) is None else place & ~text_has(F.col("text"), r.pattern) for r in absent]
        lacking = F.filter(F.array(*(F.when(lacks, F.lit(i)) for i, lacks in enumerate(tests, 1))), lambda x: x.isNotNull())
        once = there.select("project", "path", F.explode(lacking).alias("__rule")).select("project", "path", F.element_at(_about(absent), F.col("__rule")).alias("f")).select("project", "path", "f.*", F.lit(1).alias("start_line"), F.lit("(directive absent)").alias("snippet"))
        out = out.unionByName(once, allowMissingColumns=True)
    return downgraded(out.withColumn("tags", F.array().cast("array<string>")))


def _lines_of(there: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Lines that one of the rules may match: most lines hold none of the signs and literals that matches need, and become no row.

    Literals are looked for in whole texts first; lines are asked only for those that their text holds.
    """
    signs, digits, exact, folded, always = set(), [], [], [], []
    for r in rules:
        where = _applies(r)
        some, lower = guards.literals(r.pattern)
        if first := guards.signs(r.pattern):
            signs.update(first)
        elif some:
            (folded if lower else exact).extend((where, x) for x in some)
        elif must := guards.digits(r.pattern):
            digits.append(must)
        else:
            always.append(where)

    def held(asked: list, text: Column) -> Column:
        """The literals that the text holds, of those of rules that look in the file."""
        tests = [(F.rlike(text, F.lit(rf"\Q{x}\E")), where, x) for where, x in asked]
        kept = [F.when(test if where is None else where & test, F.lit(x)) for test, where, x in tests]
        return F.array_distinct(F.filter(F.array(*kept), lambda x: x.isNotNull())) if kept else F.array().cast("array<string>")

    anywhere = reduce(lambda a, b: a | b, (F.lit(True) if w is None else F.coalesce(w, F.lit(False)) for w in always), F.lit(False))
    there = there.withColumn("__lowered", F.lower("text")) if folded else there
    there = there.withColumns({"__exact": held(exact, F.col("text")), "__folded": held(folded, F.col("__lowered")), "__always": anywhere})
    first = [*(["[" + "".join("\\" + c for c in sorted(signs)) + "]"] if signs else []), *dict.fromkeys(digits)]

    def may(content: Column) -> Column:
        out = F.col("__always")
        if first:
            out = out | (F.regexp_instr(content, F.lit("|".join(first))) > 0)
        if exact:
            out = out | F.exists("__exact", lambda x: F.contains(content, x))
        if folded:
            out = out | (F.size("__folded") > 0) & F.exists(F.array(F.lower(content)), lambda low: F.exists("__folded", lambda x: F.contains(low, x)))
        return out

    numbered = F.transform(line_array(F.col("text")), lambda c, i: F.struct((i + 1).alias("line"), c.alias("content")))
    rows = there.select("project", "path", "language", "suffix", "kind", F.explode_outer(F.filter(numbered, lambda x: may(x["content"]))).alias("__line"))
    return rows.where(F.col("__line").isNotNull()).select("project", "path", "language", "suffix", "kind", "__line.*")


def downgraded(findings: DataFrame) -> DataFrame:
    """Findings in test code one severity lower, at low confidence; secrets there are LOW at most, and files
    that tools run by themselves keep what malware rules say."""
    test = F.rlike("path", F.lit(TEST_PATH))
    run = (F.col("scanner") == "malware") & base_name(F.col("path")).isin("conftest.py", "setup.py")
    test = test & ~run
    lower = F.when(F.col("scanner") == "secrets", F.least(F.col("severity"), F.lit(LOW))).otherwise(F.greatest(F.col("severity") - 1, F.lit(INFO)))
    return (
        findings.withColumn("tags", F.when(test, F.array_append("tags", F.lit("test-context"))).otherwise(F.col("tags")))
        .withColumn("severity", F.when(test, lower).otherwise(F.col("severity")))
        .withColumn("confidence", F.when(test, F.lit(0)).otherwise(F.col("confidence")))
    )


def unsafe_pattern(pattern: str) -> str | None:
    """Why a custom rule's pattern is refused: a repeat inside a repeat, a back-reference, or too long; else None."""
    import re

    if len(pattern) > 500:
        return "longer than 500 characters"
    try:
        re.compile(pattern)
    except re.error as e:
        return f"not a regular expression: {e}"
    if re.search(r"\\[1-9]", pattern):
        return "back-reference"
    depth: list[bool] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = pattern.find("]", i + 2) if "]" in pattern[i + 2 :] else len(pattern)
        elif c == "(":
            depth.append(False)
        elif c == ")" and depth:
            inner = depth.pop()
            repeated = pattern[i + 1 : i + 2] in ("*", "+") or pattern[i + 1 : i + 2] == "{"
            if inner and repeated:
                return "a repeat inside a repeat"
            if depth:
                depth[-1] = depth[-1] or inner or repeated
        elif c in "*+" and depth:
            depth[-1] = True
        i += 1
    return None


def custom_rules(rows: Sequence[dict]) -> tuple[Rule, ...]:
    """Rules from dicts (id, pattern, severity, cwe, languages); ValueError for a pattern that may not end."""
    from ..functions.model import SEVERITIES, parse_enum

    out = []
    for r in rows:
        if why := unsafe_pattern(r["pattern"]):
            raise ValueError(f"rule {r['id']}: {why}")
        out.append(Rule(f"custom.{r['id']}", parse_enum(r.get("severity", "MEDIUM"), SEVERITIES), tuple(r.get("cwe", ())), r["pattern"], tuple(r.get("languages", ()))))
    return tuple(out)
