"""Flow-sensitive taint in Python files, by the standard library's parser in one pass a file.

A file becomes rows of three kinds: findings, parameters that reach a sink, and calls that pass a source
straight on. The cross-file tier is then a Spark join of the last two on the function's name. Values know
whether a source reached them, the classes they were cleaned for, and whether only literals made them.
Analysis of a file is bounded in steps; a file beyond the bound, or not parsed, is reported as skipped.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import HIGH, INFO, LOW, MEDIUM

STEPS = 400_000
ALL = frozenset(["*"])
#: Sinks by called name: rule, severity, CWE, the argument that matters (None: any). Names with a dot are whole, others the last part.
SINKS = {
    "execute": ("ast-sql-injection", HIGH, "CWE-89", 0), "executemany": ("ast-sql-injection", HIGH, "CWE-89", 0), "executescript": ("ast-sql-injection", HIGH, "CWE-89", 0), "raw": ("ast-sql-injection", HIGH, "CWE-89", 0),
    "os.system": ("ast-command-injection", HIGH, "CWE-78", 0), "os.popen": ("ast-command-injection", HIGH, "CWE-78", 0),
    "open": ("ast-path-traversal", MEDIUM, "CWE-22", 0), "send_file": ("ast-path-traversal", MEDIUM, "CWE-22", 0), "os.remove": ("ast-path-traversal", MEDIUM, "CWE-22", 0), "os.unlink": ("ast-path-traversal", MEDIUM, "CWE-22", 0), "shutil.rmtree": ("ast-path-traversal", MEDIUM, "CWE-22", 0),
    "eval": ("ast-code-injection", HIGH, "CWE-95", 0), "exec": ("ast-code-injection", HIGH, "CWE-95", 0),
    "pickle.loads": ("ast-unsafe-deserialization", HIGH, "CWE-502", 0), "pickle.load": ("ast-unsafe-deserialization", HIGH, "CWE-502", 0), "marshal.loads": ("ast-unsafe-deserialization", HIGH, "CWE-502", 0), "yaml.load": ("ast-unsafe-deserialization", HIGH, "CWE-502", 0),
    "Markup": ("ast-xss", MEDIUM, "CWE-79", 0), "mark_safe": ("ast-xss", MEDIUM, "CWE-79", 0), "render_template_string": ("ast-xss", MEDIUM, "CWE-79", 0), "make_response": ("ast-xss", MEDIUM, "CWE-79", 0),
    "redirect": ("ast-open-redirect", MEDIUM, "CWE-601", 0), "HttpResponseRedirect": ("ast-open-redirect", MEDIUM, "CWE-601", 0),
    "etree.fromstring": ("ast-xxe", HIGH, "CWE-611", 0), "etree.parse": ("ast-xxe", HIGH, "CWE-611", 0), "minidom.parseString": ("ast-xxe", HIGH, "CWE-611", 0),
    "search_s": ("ast-ldap-injection", HIGH, "CWE-90", None), "search_ext_s": ("ast-ldap-injection", HIGH, "CWE-90", None),
    "xpath": ("ast-xpath-injection", HIGH, "CWE-643", 0),
}
SHELLS = ("subprocess.call", "subprocess.run", "subprocess.Popen", "subprocess.check_output", "subprocess.check_call")
REQUEST = frozenset("args form values json data files cookies headers query_params GET POST get_json body path_params".split())
CLEANERS = {
    "int": ALL, "float": ALL, "bool": ALL, "len": ALL, "uuid.UUID": ALL, "UUID": ALL, "shlex.quote": frozenset(["CWE-78"]), "escape": frozenset(["CWE-79"]), "html.escape": frozenset(["CWE-79"]), "bleach.clean": frozenset(["CWE-79"]),
    "secure_filename": frozenset(["CWE-22", "CWE-78"]), "os.path.basename": frozenset(["CWE-22"]), "safe_join": frozenset(["CWE-22"]), "url_for": frozenset(["CWE-601"]), "escape_filter_chars": frozenset(["CWE-90"]),
}
SECRET_NAME = ("token", "secret", "passw", "nonce", "otp", "salt", "session", "csrf", "api_key", "apikey")
WEAK_RANDOM = frozenset("random randint randrange choice choices getrandbits sample".split())


class Value:
    __slots__ = ("taint", "clean", "literal", "params")

    def __init__(self, taint: bool = False, clean: frozenset = frozenset(), literal: bool = False, params: frozenset = frozenset()):
        self.taint, self.clean, self.literal, self.params = taint, clean, literal, params

    def reaches(self, cwe: str) -> bool:
        return self.taint and "*" not in self.clean and cwe not in self.clean


LITERAL, UNKNOWN = Value(literal=True, clean=ALL), Value()


def _mixed(values: list[Value]) -> Value:
    """A value made of several: tainted if any is, clean for what all tainted ones are clean for."""
    dirty = [v.clean for v in values if v.taint or v.params]
    clean = frozenset.intersection(*dirty) if dirty else frozenset()
    return Value(any(v.taint for v in values), clean, all(v.literal for v in values), frozenset().union(*(v.params for v in values)))


class TooLong(Exception):
    pass


class Analysis:
    """One file. known: functions of the file that return request data."""

    def __init__(self, path: str, tree: ast.Module):
        self.path, self.steps = path, 0
        self.findings: dict[tuple, tuple] = {}
        self.dangerous: set[tuple] = set()
        self.calls: set[tuple] = set()
        self.returns: set[str] = set()
        self.function: str | None = None
        self.names: list[str] = []
        for _ in range(2):  # once more, with the functions that return request data known
            self.findings.clear()
            self.block(tree.body, {})

    # expressions

    def name(self, node: ast.expr) -> str:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if isinstance(node, ast.Name):
            parts.append(node.id)
        return ".".join(reversed(parts))

    def value(self, node: ast.expr | None, env: dict[str, Value]) -> Value:
        self.steps += 1
        if self.steps > STEPS:
            raise TooLong
        if node is None or isinstance(node, ast.Constant):
            return LITERAL
        if isinstance(node, ast.Name):
            return env.get(node.id, UNKNOWN)
        if isinstance(node, ast.Attribute):
            full = self.name(node)
            if self.source(full):
                return Value(True)
            return self.value(node.value, env)
        if isinstance(node, ast.Call):
            return self.call(node, env)
        if isinstance(node, ast.IfExp):
            self.value(node.test, env)
            return _mixed([self.value(node.body, env), self.value(node.orelse, env)])
        if isinstance(node, ast.NamedExpr):
            env[node.target.id] = v = self.value(node.value, env)
            return v
        if isinstance(node, ast.Compare):
            for x in (node.left, *node.comparators):
                self.value(x, env)
            return UNKNOWN
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            inner = dict(env)
            for g in node.generators:
                self.assign(g.target, self.value(g.iter, inner), inner)
                for test in g.ifs:
                    self.value(test, inner)
            return _mixed([self.value(x, inner) for x in ([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])])
        if isinstance(node, ast.Lambda):
            return UNKNOWN
        parts = [self.value(x, env) for x in ast.iter_child_nodes(node) if isinstance(x, ast.expr)]
        return _mixed(parts) if parts else LITERAL

    @staticmethod
    def source(full: str) -> bool:
        head, _, last = full.rpartition(".")
        return head.split(".")[-1] == "request" and last in REQUEST or full in ("sys.argv", "os.environ")

    def call(self, node: ast.Call, env: dict[str, Value]) -> Value:
        full = self.name(node.func)
        last = full.rsplit(".", 1)[-1]
        args = [self.value(a.value if isinstance(a, ast.Starred) else a, env) for a in node.args]
        named = {k.arg: self.value(k.value, env) for k in node.keywords}
        values = [*args, *named.values()]
        self.sink(node, full, last, args, named)
        for i, (a, v) in enumerate([*zip(node.args, args, strict=True), *((k.value, named[k.arg]) for k in node.keywords)]):
            if v.taint and not v.clean and last and isinstance(a, (ast.Call, ast.Attribute, ast.Subscript)):
                keyword = node.keywords[i - len(args)].arg if i >= len(args) else None
                self.calls.add((self.path, node.lineno, last, i if keyword is None else None, keyword))
        if full in CLEANERS or last in CLEANERS and "." not in full:
            m = _mixed(values)
            return Value(m.taint, m.clean | CLEANERS.get(full, CLEANERS.get(last)), False, m.params)
        if full == "input" or full in self.returns:
            return Value(True)
        if full.startswith("request.") and last in REQUEST | {"get", "getlist"}:
            return Value(True)
        owner = self.value(node.func.value, env) if isinstance(node.func, ast.Attribute) else LITERAL
        m = _mixed([owner, *values])
        return Value(m.taint, m.clean, m.literal and last in ("format", "join", "strip", "lower", "upper", "replace"), m.params)

    def report(self, rule: str, severity: int, cwe: str, confidence: int, line: int) -> None:
        self.findings.setdefault((rule, line), (rule, severity, cwe, confidence, line))

    def sink(self, node: ast.Call, full: str, last: str, args: list[Value], named: dict[str | None, Value]) -> None:
        spec = SINKS.get(full) or SINKS.get(".".join(full.split(".")[-2:])) or (SINKS.get(last) if last not in ("open", "eval", "exec", "redirect") or "." not in full else None)
        if full in SHELLS:
            shell = next((k.value for k in node.keywords if k.arg == "shell"), None)
            if isinstance(shell, ast.Constant) and shell.value:
                spec = ("ast-command-injection", HIGH, "CWE-78", 0)
        if not spec:
            return
        if full == "yaml.load" and any("Safe" in ast.dump(x) for x in [*node.args[1:], *(k.value for k in node.keywords)]):
            return
        rule, severity, cwe, at = spec
        looked = [*args, *named.values()] if at is None else args[at : at + 1] or list(named.values())[:1]
        if any(v.reaches(cwe) for v in looked):
            self.report(rule, severity, cwe, 2, node.lineno)
        elif rule == "ast-sql-injection" and node.args and isinstance(node.args[0], (ast.JoinedStr, ast.BinOp)) and not looked[0].literal and "*" not in looked[0].clean:
            self.report("ast-sql-string-building", MEDIUM, cwe, 0, node.lineno)
        for v in looked:
            for p in v.params:
                if self.function and "*" not in v.clean and cwe not in v.clean:
                    self.dangerous.add((self.function, self.names.index(p), p, rule, severity, cwe, node.lineno, self.path))

    # statements

    def assign(self, target: ast.expr, v: Value, env: dict[str, Value]) -> None:
        if isinstance(target, ast.Name):
            env[target.id] = v
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.assign(t, v, env)
        elif isinstance(target, ast.Starred):
            self.assign(target.value, v, env)
        elif isinstance(target, (ast.Subscript, ast.Attribute)):
            base = target.value
            if isinstance(target, ast.Subscript) and self.name(base).split(".")[-1] == "session" and v.reaches("CWE-501"):
                self.report("ast-trust-boundary", LOW, "CWE-501", 1, target.lineno)
            if isinstance(base, ast.Name):
                env[base.id] = _mixed([env.get(base.id, UNKNOWN), v])

    def joined(self, *envs: dict[str, Value]) -> dict[str, Value]:
        return {k: _mixed([e.get(k, UNKNOWN) for e in envs]) if len({id(e.get(k)) for e in envs}) > 1 else envs[0][k] for k in set().union(*envs)}

    def block(self, body: list[ast.stmt], env: dict[str, Value]) -> bool:
        """Runs statements; True if control leaves the block for certain."""
        for s in body:
            if self.statement(s, env):
                return True
        return False

    def branch(self, parts: list[tuple[list[ast.stmt], dict[str, Value]]], env: dict[str, Value]) -> bool:
        left = [(e, self.block(b, e)) for b, e in parts]
        live = [e for e, gone in left if not gone]
        if not live:
            return True
        merged = self.joined(*live)
        env.clear()
        env.update(merged)
        return False

    def guarded(self, test: ast.expr, env: dict[str, Value], holds: bool) -> dict[str, Value]:
        """env where a test holds or not: names found in a literal collection, or numeric or plain by a method, are clean."""
        out = dict(env)
        if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            return self.guarded(test.operand, env, not holds)
        name = None
        if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.left, ast.Name):
            member = isinstance(test.ops[0], ast.In) and holds or isinstance(test.ops[0], ast.NotIn) and not holds
            if member and self.value(test.comparators[0], dict(env)).literal:
                name = test.left.id
        elif holds and isinstance(test, ast.Call) and isinstance(test.func, ast.Attribute) and test.func.attr in ("isdigit", "isnumeric", "isalnum", "isidentifier", "isdecimal") and isinstance(test.func.value, ast.Name):
            name = test.func.value.id
        if name and name in out:
            v = out[name]
            out[name] = Value(v.taint, v.clean | ALL, v.literal, v.params)
        return out

    def statement(self, s: ast.stmt, env: dict[str, Value]) -> bool:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.define(s, env)
        elif isinstance(s, ast.ClassDef):
            self.block(s.body, dict(env))
        elif isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            v = self.value(s.value, env)
            targets = s.targets if isinstance(s, ast.Assign) else [s.target]
            if isinstance(s, ast.AugAssign):
                v = _mixed([self.value(s.target, env), v])
            for t in targets:
                if isinstance(t, ast.Name) and s.value is not None and any(w in t.id.lower() for w in SECRET_NAME) and any(isinstance(x, ast.Call) and self.name(x.func).startswith("random.") and self.name(x.func).split(".")[-1] in WEAK_RANDOM for x in ast.walk(s.value)):
                    self.report("ast-weak-random", MEDIUM, "CWE-330", 1, s.lineno)
                self.assign(t, v, env)
        elif isinstance(s, ast.Return):
            v = self.value(s.value, env)
            if v.taint and not v.clean and self.function:
                self.returns.add(self.function)
            return True
        elif isinstance(s, (ast.Raise, ast.Continue, ast.Break)):
            return True
        elif isinstance(s, ast.If):
            self.value(s.test, env)
            if isinstance(s.test, ast.Constant):  # a dead branch isn't looked at
                return self.block(s.body if s.test.value else s.orelse, env)
            return self.branch([(s.body, self.guarded(s.test, env, True)), (s.orelse, self.guarded(s.test, env, False))], env)
        elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            for _ in range(2):
                inner = dict(env)
                if isinstance(s, ast.While):
                    self.value(s.test, inner)
                else:
                    self.assign(s.target, self.value(s.iter, inner), inner)
                self.block(s.body, inner)
                env.update(self.joined(env, inner))
            self.block(s.orelse, env)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                v = self.value(item.context_expr, env)
                if item.optional_vars:
                    self.assign(item.optional_vars, v, env)
            return self.block(s.body, env)
        elif isinstance(s, ast.Try):
            start = dict(env)
            gone = self.block(s.body, env) or self.block(s.orelse, env)
            parts = [(h.body, self.joined(start, env)) for h in s.handlers]
            if parts:
                self.branch([*parts, ([], env if not gone else self.joined(start, env))], env)
            return self.block(s.finalbody, env)
        elif isinstance(s, ast.Match):
            self.value(s.subject, env)
            return self.branch([*((c.body, dict(env)) for c in s.cases), ([], dict(env))], env)
        else:
            for x in ast.iter_child_nodes(s):
                if isinstance(x, ast.expr):
                    self.value(x, env)
        return False

    def define(self, f: ast.FunctionDef | ast.AsyncFunctionDef, env: dict[str, Value]) -> None:
        outer = (self.function, self.names)
        params = [a.arg for a in (*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs)]
        self.function, self.names = f.name, [p for p in params if p not in ("self", "cls")]
        route = any(isinstance(d, ast.Call) and self.name(d.func).split(".")[-1] in ("route", "get", "post", "put", "delete", "patch") for d in f.decorator_list)
        inner = dict(env) | {p: Value(route, params=frozenset([p])) for p in self.names}
        self.block(f.body, inner)
        self.function, self.names = outer


_SCHEMA = "kind string, project string, path string, line int, rule string, severity int, cwe string, confidence int, func string, arg_index int, arg_name string"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def analysed(files: DataFrame) -> DataFrame:
    """Rows of kind finding, param, call and return of the Python files in files(project, path, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, text in zip(b["project"], b["path"], b["text"], strict=True):
                try:
                    a = Analysis(path, ast.parse(text or ""))
                except (SyntaxError, ValueError, RecursionError, TooLong, MemoryError):
                    rows.append(("finding", project, path, 1, "analysis-skipped", INFO, None, 0, None, None, None))
                    continue
                rows += [("finding", project, path, line, rule, severity, cwe, confidence, None, None, None) for rule, severity, cwe, confidence, line in a.findings.values()]
                rows += [("param", project, where, line, rule, severity, cwe, None, func, index, name) for func, index, name, rule, severity, cwe, line, where in sorted(a.dangerous)]
                rows += [("call", project, where, line, None, None, None, None, func, index, name) for where, line, func, index, name in sorted(a.calls, key=str)]
                rows += [("return", project, path, None, None, None, None, None, f, None, None) for f in sorted(a.returns)]
            frame = pd.DataFrame(rows, columns=_COLUMNS)
            yield frame.astype({c: "Int32" for c in ("line", "severity", "confidence", "arg_index")})

    return files.where("language = 'Python'").select("project", "path", "text").mapInPandas(run, _SCHEMA)


def _findings(rows: DataFrame, scanner: str) -> DataFrame:
    return rows.select("project", "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.concat(F.lit(f"{scanner}."), "rule").alias("rule_id"), F.lit(scanner).alias("scanner"), "severity", "confidence", F.lit(2).alias("likelihood"), F.when(F.col("cwe").isNull(), F.array().cast("array<string>")).otherwise(F.array("cwe")).alias("cwe"), F.lit(None).cast("string").alias("snippet"), F.array().cast("array<string>").alias("tags"))


def python_taint(files: DataFrame) -> DataFrame:
    """Findings inside files."""
    return _findings(analysed(files).where("kind = 'finding'"), "ast-python")


def cross_file(files: DataFrame) -> DataFrame:
    """Findings where a call in one file hands a source to a parameter that reaches a sink in another: a shuffled
    join on (project, function), by position or by name."""
    rows = analysed(files)
    params = rows.where("kind = 'param'").select("project", "func", F.col("arg_index").alias("i"), F.col("arg_name").alias("name"), "rule", "severity", "cwe", F.col("path").alias("defined"))
    calls = rows.where("kind = 'call'").select("project", "func", "path", "line", "arg_index", "arg_name")
    met = calls.join(params, ["project", "func"]).where((F.col("arg_name") == F.col("name")) | F.col("arg_name").isNull() & (F.col("arg_index") == F.col("i")))
    return _findings(met.where("path <> defined").select("project", "path", "line", "rule", "severity", "cwe", F.lit(1).alias("confidence")).distinct(), "ast-python-xfile")
