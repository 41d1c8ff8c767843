"""Trust boundaries of language-model agents: what reaches a model call, and what the model can do from there.

Calls have their whole extent, over as many lines as it takes (sources.code). Names get kinds: external content,
request input, a secret, a model's output, a tool's argument, a tool that acts. Kinds follow assignments of one
function and of its module to a fixed point; a helper decides that for the assignments of one file, all else is joins.

Rules: external content in the prompt of a model that can act; a tool's argument in a sink; roles or whole message
lists from a request; a request that chooses acting tools; a secret in a prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import HIGH, MEDIUM
from ..functions.store import keep
from ..sources.code import LANGUAGES, STRINGS, code_lines, cut_out, extents, literals, tokens
from ..sources.files import MAX_LINE, lines

MODEL = r"(?i)(?:^|\b)(?:client|openai|anthropic|llm|model|chain|agent|completion|chat|messages)[\w.]*\.(?:create|invoke|ainvoke|generate\w*|predict|run|complete|call|stream)$|\.a?invoke$|(?:^|\.)(?:generateText|streamText|generateObject)$"
#: Files that can hold an agent at all.
AGENTS = r"(?i)openai|anthropic|langchain|llm|agent|\bmcp\b|from \"ai\"|generateText"
AGENT = r"(?:^|\.)(?:create_react_agent|create_agent|initialize_agent|AgentExecutor|from_tools)$"
EXTERNAL = r"\b(?:requests|httpx)\.get\(|urlopen\(|\bfetch\(|axios\.get\(|\bopen\([^()]*\)\.read|\.read_text\(|readFile(?:Sync)?\(|\.similarity_search\(|retriever\.\w+\(|loader\.load\(|\.load_data\(|imaplib|\.get_issue\("
REQUEST = r"\breq(?:uest)?\.(?:query|params|body|json|args|form|values|headers|cookies|get_json)\b"
SECRET = r"(?:os\.environ(?:\.get)?\s*[\[(]\s*['\"]|os\.getenv\(\s*['\"]|process\.env\.)(\w*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL)\w*)"
ROUTE = r"^\s*@\w+\.(?:get|post|put|delete|patch|route)\s*\("
TOOL = r"^\s*@(?:\w+\.)?tool\b"
FUNCTION = r"^\s*(?:export\s+)?(?:async\s+)?(?:def\s+(\w+)|function\s+(\w+))\s*\("
ARROW = r"=>\s*\{\s*$"
ASSIGN = r"^\s*(?:export\s+)?(?:const\s+|let\s+|var\s+)?(\{[^}=]*\}|[A-Za-z_$][\w$]*(?:\s*,\s*[A-Za-z_$][\w$]*)*)\s*(?::[^=\n]+)?\+?=(?![=>])\s*(.+)$"
EACH = r"^\s*for\s*\(?\s*(?:const\s+|let\s+|var\s+)?([A-Za-z_$][\w$]*)\s+(?:of|in)\s+(.+)$"
ADDED = r"^\s*([A-Za-z_$][\w$]*)\.(?:append|extend|push|add|update|insert)\((.+)$"
NAME = r"(?<![\w$.])([A-Za-z_$][\w$]*)(?![\w$]*\s*[:=](?!=))"
INSIDE = r"\$?\{\s*([A-Za-z_$][\w$]*)"
#: What a sink does with its first argument, by callee.
SINKS = (
    ("shell", r"^(?:os\.(?:system|popen)|subprocess\.\w+|exec|execSync|execFile|spawn|spawnSync|child_process\.\w+)$"),
    ("code", r"^(?:eval|exec)$"),
    ("file", r"^(?:open|os\.(?:remove|unlink|rename)|shutil\.\w+|writeFile|writeFileSync|unlink|fs\.\w*(?:write|unlink)\w*)$|\.write_(?:text|bytes)$"),
    ("ssrf", r"^(?:requests|httpx|axios)\.(?:get|head)$|^(?:urlopen|urllib\.request\.urlopen|fetch|axios)$"),
    ("api-write", r"^(?:requests|httpx|axios)\.(?:post|put|patch|delete)$"),
    ("sql", r"\.(?:execute|executemany|query|raw)$"),
    ("recipient", r"\.(?:sendMail|send_email)$"),
)
ARGUMENTS = {"file": (MEDIUM, ("CWE-73", "CWE-22")), "ssrf": (MEDIUM, ("CWE-918",)), "sql": (HIGH, ("CWE-89",)), "recipient": (MEDIUM, ("CWE-200",))}
GUARD = r"is_relative_to|\.starts[Ww]ith\(|allow(?:ed|list)|\.has\(|\bbasename\(|secure_filename|not in [A-Z]"
FIXED_HOST = r"^\s*f?['\"`]https?://[^{$/'\"`]+/"
KINDS = ("external", "request", "secret", "model", "argument", "acts", "shell")
_KEY = ("project", "path")


def reached(steps: list) -> list[tuple[int, str, list[str]]]:
    """(scope, name, kinds) of a file's assignments (scope, name, kinds, names, client): a name has the kinds of what it is made from.

    Scope 0 is the module, which all functions see. A client built with a secret doesn't give it away.
    """
    have: dict[tuple[int, str], set[str]] = {}
    takers: dict[tuple[int, str], list] = {}
    for s in steps:
        have.setdefault((s["scope"], s["name"]), set()).update(s["kinds"])
        for n in s["names"] or ():
            for scope in {s["scope"], 0}:
                takers.setdefault((scope, n), []).append(s)
    todo = [k for k, kinds in have.items() if kinds]
    while todo:
        key = todo.pop()
        for s in takers.get(key, ()):
            own = have[(s["scope"], s["name"])]
            new = {k for k in have[key] if not (k == "secret" and s["client"])} - own
            if new:
                own |= new
                todo.append((s["scope"], s["name"]))
    return [(scope, name, sorted(kinds)) for (scope, name), kinds in have.items() if kinds]


def _names(text: Column) -> Column:
    """Identifiers of an expression: outside of its strings, and put into them."""
    bare = F.regexp_replace(text, STRINGS, " ")
    return F.array_distinct(F.concat(F.regexp_extract_all(bare, F.lit(NAME), F.lit(1)), F.regexp_extract_all(text, F.lit(INSIDE), F.lit(1))))


def _is(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _bare(text: Column) -> Column:
    """An expression without the insides of its strings."""
    return F.regexp_replace(text, STRINGS, "''")


def _kinds(**tests: Column) -> Column:
    return F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())


def _scoped(of: DataFrame) -> DataFrame:
    """Lines (text, and over: characters behind it) with their scope (the line of the function they are in, 0 for the module), and of heads: function, params, tool, route."""
    order = Window.partitionBy(*_KEY).orderBy("line")
    text = F.substring("content", 1, MAX_LINE)
    name = F.coalesce(F.nullif(F.regexp_extract(text, FUNCTION, 1), F.lit("")), F.nullif(F.regexp_extract(text, FUNCTION, 2), F.lit("")))
    head = name.isNotNull() | _is(text, ARROW)
    module = (F.trim(text) != "") & _is(text, r"^[^\s})\]@#'\"]") & ~head
    above = F.concat_ws("\n", *(F.lag(text, k).over(order) for k in (3, 2, 1)))
    marks = F.regexp_extract(above, r"((?:^|\n)\s*@[^\n]*(?:\n\s*@[^\n]*)*)$", 1)
    rows = of.select(*_KEY, "line", text.alias("text"), F.greatest(F.length("content") - MAX_LINE, F.lit(0)).alias("over"), name.alias("function"), head.alias("head"), module.alias("module"), marks.alias("marks"))
    scope = F.last(F.when(F.col("head"), F.col("line")).when(F.col("module"), F.lit(0)), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("scope", F.coalesce(scope, F.lit(0)))


def _params(heads: DataFrame) -> DataFrame:
    """A row for each parameter of a function: scope, function, name, kinds."""
    script_tool = _is(F.col("text"), r"\.(?:tool|registerTool)\(|execute\s*:")
    listed = F.when(F.col("function").isNotNull(), F.regexp_extract("text", r"(?:def|function)\s+\w+\s*\((.*)\)", 1)).otherwise(F.regexp_extract("text", r"\(\s*([^()]*)\)\s*=>\s*\{\s*$", 1))
    each = heads.where("head").withColumn("p", F.explode(F.regexp_extract_all(listed, F.lit(r"([A-Za-z_$][\w$]*)\s*(?::\s*([A-Za-z_][\w.]*(?:\[[^\]]*\])?))?(?:\s*=[^,]*)?"), F.lit(0))))
    name, kind = F.regexp_extract("p", r"^([A-Za-z_$][\w$]*)", 1), F.regexp_extract("p", r":\s*([A-Za-z_][\w.]*)", 1)
    tool = _is(F.coalesce("marks", F.lit("")), "(?m)" + TOOL) | script_tool
    route = _is(F.coalesce("marks", F.lit("")), "(?m)" + ROUTE)
    kinds = _kinds(argument=tool & ~kind.isin("Literal", "int", "float", "bool"), request=route)
    return each.select(*_KEY, F.col("line").alias("scope"), "function", name.alias("name"), kinds.alias("kinds"), tool.alias("tool")).where("name <> ''")


def _of_call() -> list[Column]:
    """What the rules ask of a call: columns of callee and cut, its arguments. Null where there is no call, most also where it is of no model, agent or sink."""
    args, callee, none = F.col("cut"), F.col("callee"), F.array().cast("array<string>")
    sink = F.lit(None).cast("string")
    for kind, pattern in reversed(SINKS):
        sink = F.when(_is(callee, pattern), kind).otherwise(sink)
    model, agent = _is(callee, MODEL), _is(callee, AGENT)
    bare, names = _bare(args), F.when(callee.isNotNull(), _names(args))
    first = F.regexp_extract(args, r"(?s)^\s*((?:[fFrRbB]{0,2}(?:" + STRINGS.removeprefix("(?s)") + r")|[^,'\"`])*)", 1)
    free = ~((sink == "ssrf") & _is(first, FIXED_HOST)) & ~((sink == "file") & (callee == "open") & ~_is(args, r"['\"][wax]"))
    chosen = F.regexp_extract(args, r"(?s)\btools\s*[=:]\s*(\[[^\]]*\]|[\w$.]+)", 1)
    prompt = F.regexp_replace(args, r"(?s)\btools\s*[=:]\s*(?:\[[^\]]*\]|[\w$.]+)", " ")
    role = F.regexp_extract(bare, r"(?:\brole|''\s*)\s*:\s*([A-Za-z_$][\w$.]*)", 1)
    execute = _is(args, r"execute\s*:")
    listed = _is(bare, r"(?:messages\s*[=:]|\+|\.\.\.)\s*req(?:uest)?\.(?:\w+\.)?\w*(?:messages|history)\w*") | _is(role, REQUEST) | _is(role, r"^req(?:uest)?\.")
    asked = {
        "first_names": F.when(sink.isNotNull(), _names(first)),
        "free": free,
        "prompt_names": F.when(sink.isNotNull() & ~model, _names(first)).otherwise(_names(prompt)),
        "tool_names": F.when(agent, names).otherwise(_names(chosen)),
        "inner": F.when(model & execute, F.regexp_extract_all(bare, F.lit(r"([A-Za-z_$][\w$]*)\("), F.lit(1))).otherwise(none),
        "roles": F.array(F.regexp_extract(role, r"^(\w+)", 1), F.regexp_extract(bare, r"\{\s*(role)\s*,", 1)),
        "reads": _is(_bare(prompt), EXTERNAL),
        "gives": _is(prompt, SECRET),
        "executes": execute & ~_is(args, r"z\.enum"),
        "runs": _is(bare, r"\b(?:exec|execSync|execFile|spawn|eval|writeFile|unlink)\("),
        "listed": listed,
        "to": F.regexp_extract(args, r"\bto\s*:\s*([A-Za-z_$][\w$]*)", 1),
        "content": F.concat(callee, F.lit("("), F.substring(F.trim(args), 1, 200)),
    }
    every = {"sink": sink, "model": model, "agent": agent, "names": names, "root": F.regexp_extract(callee, r"^([A-Za-z_$][\w$]*)", 1), "requested": F.when(callee.isNotNull(), _is(bare, REQUEST))}
    return [c.alias(k) for k, c in (every | {k: F.when(model | agent | sink.isNotNull(), c) for k, c in asked.items()}).items()]


def _of_assignment() -> list[Column]:
    """What the rules ask of an assignment: columns of left, right, over and cut, what its brackets over more lines hold. Null where there is none."""
    right, cut = F.col("right"), F.col("cut")
    head = F.substring_index(cut, "\n", 1)
    # the line ends with what cut begins with; if that were read twice, a string it opens would end where it begins again, and its words would be code
    n = F.length(right) - F.length(head) + F.col("over")
    meets = (n >= 0) & F.startswith(head, F.substring(right, n + 1, F.length(right)))
    value = F.when(meets, F.concat(F.substring(right, F.lit(1), n), cut)).otherwise(F.concat_ws("\n", right, cut))
    bare = _bare(value)
    client = _is(value, r"^\s*(?:await\s+)?(?:new\s+)?[A-Z]\w*\(|\bfetch\(|\b(?:requests|httpx|axios)\.")
    kinds = _kinds(external=_is(bare, EXTERNAL), request=_is(bare, REQUEST), secret=_is(value, SECRET) & ~client, model=_is(bare, MODEL.replace("$", r"\(")), shell=_is(bare, r"promisify\(\s*(?:exec|execFile)\b"))
    condition = F.coalesce(F.nullif(F.regexp_extract(value, r"\bif\s+(.+?)\s+else\b", 1), F.lit("")), F.nullif(F.regexp_extract(value, r"^\s*([^?\n]+)\?", 1), F.lit("")))
    made = {"left": F.regexp_extract_all("left", F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1)), "kinds": kinds, "client": client, "value_names": _names(value), "condition_names": F.when(condition.isNotNull(), _names(condition))}
    return [F.when(F.col("left").isNotNull(), c).alias(k) for k, c in made.items()]


def agent_calls(files: DataFrame) -> DataFrame:
    """Findings llm.indirect-prompt-injection, tool-argument-to-sink, untrusted-message-role, untrusted-tool-selection and secret-sent-to-model, each on the extent of its call."""
    code = keep(files.select(*_KEY, "language", "text").where(F.col("language").isin(*LANGUAGES) & _is(F.col("text"), AGENTS)), "agent-code")
    if code.isEmpty():
        return _found(lines(code).withColumn("end_line", F.col("line")), "none", HIGH, ())
    # each table is written once, as the rules below read it many times
    pairs, of = keep(extents(tokens(code)), "extents"), keep(_scoped(code_lines(code)), "scopes")
    scopes = of.select(*_KEY, "line", "scope")
    here = [*_KEY, "line"]
    params = keep(_params(of), "parameters")

    # ---- a file's text meets its calls and assignments once; what is asked of them is read there, and no text goes on
    called = _join(pairs.where("bracket = '(' AND callee <> ''").select(*here, "callee", "end_line", "start", "stop"), scopes, here)
    made = of.withColumn("m", F.coalesce(*(F.when(F.rlike("text", F.lit(p)), F.struct(F.regexp_extract("text", p, 1).alias("left"), F.regexp_extract("text", p, 2).alias("right"))) for p in (EACH, ADDED, ASSIGN))))
    made = made.where("m IS NOT NULL").select(*here, "scope", "over", "m.left", "m.right")
    open_ = pairs.where("end_line > line").groupBy(*here).agg(F.max("stop").alias("stop"), F.min("start").alias("start"))
    spans = cut_out(code, called.unionByName(_join(made, open_, here, "left"), allowMissingColumns=True))
    read = keep(spans.withColumn("call", F.monotonically_increasing_id()).select(*here, "call", "scope", "callee", "end_line", *_of_call(), *_of_assignment()), "agent-calls")
    wanted, rows = read.where("callee IS NOT NULL"), read.where("left IS NOT NULL")

    # ---- what names are made from
    steps = rows.select(*_KEY, "scope", F.explode("left").alias("name"), "kinds", F.col("value_names").alias("names"), "client")
    none, no = F.array().cast("array<string>"), F.lit(False)
    given = params.select(*_KEY, "scope", "name", "kinds", none.alias("names"), no.alias("client"))
    # what a file passes to its own functions
    passed = _join(wanted.select(*_KEY, "callee", F.col("scope").alias("from"), "names", "requested"), params.where("function IS NOT NULL AND NOT tool").select(*_KEY, F.col("function").alias("callee"), "scope", "name"), [*_KEY, "callee"])
    passed = passed.select(*_KEY, "scope", "name", _kinds(request=F.col("requested")).alias("kinds"), F.transform("names", lambda n: F.concat(F.col("from").cast("string"), F.lit("/"), n)).alias("names"), no.alias("client"))
    # tools by what their bodies do: a tool with a sink that its argument reaches acts, one that reads the world brings it in
    tools = params.where("tool AND function IS NOT NULL").select(*_KEY, "scope", "function").distinct()
    doing = _join(wanted.where("sink IS NOT NULL").select(*_KEY, "scope", "sink", "free", "names", "first_names"), tools, [*_KEY, "scope"])
    writes = F.col("sink") == "api-write"
    asked = _join(doing.where("free").select(*_KEY, "scope", "function", "sink", F.explode(F.when(writes, F.col("names")).otherwise(F.col("first_names"))).alias("name")), params.where("tool").select(*_KEY, "scope", "name", F.array_contains("kinds", "argument").alias("any")), [*_KEY, "scope", "name"])
    acting = asked.where("any OR sink = 'api-write' AND name <> ''").select(*_KEY, F.col("function").alias("name")).distinct()
    constant = _join(asked.where("sink = 'api-write' AND NOT any"), of.where("head").select(*_KEY, "scope", F.col("text").alias("head_text")).distinct(), [*_KEY, "scope"])
    literal = constant.where(F.expr("head_text rlike concat('\\\\b', name, '\\\\s*:\\\\s*Literal')")).select(*_KEY, F.col("function").alias("name")).distinct()
    acting = _join(acting, literal, [*_KEY, "name"], "left_anti")
    reading = _join(tools, of.where(_is(_bare(F.col("text")), EXTERNAL)).select(*_KEY, "scope").distinct(), [*_KEY, "scope"]).select(*_KEY, F.col("function").alias("name")).distinct()
    of_tools = acting.withColumn("kinds", F.array(F.lit("acts"))).unionByName(reading.withColumn("kinds", F.array(F.lit("external")))).select(*_KEY, F.lit(0).alias("scope"), "name", "kinds", none.alias("names"), no.alias("client"))
    every = steps.unionByName(given).unionByName(of_tools).unionByName(passed)
    found = every.groupBy(*_KEY).agg(F.collect_list(F.struct("scope", "name", "kinds", "names", "client")).alias("steps"))
    closed = F.udf(_closed, "array<struct<scope:int,name:string,kinds:array<string>>>")
    known = keep(found.select(*_KEY, F.explode(closed("steps")).alias("k")).select(*_KEY, "k.*"), "names")

    # ---- rules
    asked = wanted.where("model OR agent OR sink IS NOT NULL")
    keep_ = [*_KEY, "call", "scope"]
    uses = [(u, F.col(c)) for u, c in (("prompt", "prompt_names"), ("tools", "tool_names"), ("inner", "inner"), ("role", "roles"), ("all", "names"))] + [("root", F.array("root"))]
    used = asked.select(*keep_, F.explode(F.array(*(F.struct(F.lit(u).alias("use"), n.alias("n")) for u, n in uses))).alias("u")).select(*keep_, "u.use", F.explode("u.n").alias("name"))
    met = _join(used, known.withColumnRenamed("scope", "of"), [*_KEY, "name"]).where("of = scope OR of = 0").select(*keep_, "use", "name", F.explode("kinds").alias("kind"))
    about = met.groupBy("call").agg(F.collect_set(F.concat_ws(":", "use", "kind")).alias("facts"))
    asked = asked.join(about, "call", "left").withColumn("facts", F.coalesce("facts", none))
    fact = lambda *names: F.arrays_overlap("facts", F.array(*map(F.lit, names)))
    asked = keep(asked, "asked")

    model = asked.where("model OR agent")
    outside = fact("prompt:external", "root:external") | F.col("reads")
    inline = F.col("executes") & (fact("inner:shell") | F.col("runs"))
    acts = fact("tools:acts", "root:acts") | inline
    dangerous = asked.where("sink IS NOT NULL AND NOT model").where(fact("prompt:model")).select(*_KEY, "scope", F.lit(True).alias("obeyed")).distinct()
    injected = _join(model.where("model").where(outside), dangerous, [*_KEY, "scope"], "left").where(acts | F.coalesce("obeyed", F.lit(False)))
    out = _found(injected, "indirect-prompt-injection", HIGH, ("CWE-1427", "CWE-74"))

    guarded = of.where(_is(F.col("text"), GUARD)).select(*_KEY, "scope").distinct()
    mail = of.where(_is(F.col("text"), r"\[['\"](?:To|Cc|Bcc)['\"]\][^=\n]*=")).select(*_KEY, "scope", "line", F.col("line").alias("end_line"), F.lit("recipient").alias("sink"), F.col("text").alias("content"), F.explode(F.regexp_extract_all(F.regexp_replace(F.regexp_extract("text", r"(?<![=!<>])=(?!=)(.*)$", 1), STRINGS, " "), F.lit(NAME), F.lit(1))).alias("name"))
    mail = _join(mail, known.where(F.array_contains("kinds", "argument")).select(*_KEY, "scope", "name"), [*_KEY, "scope", "name"]).drop("name").distinct()
    sent = asked.where("sink = 'recipient'").select(*_KEY, "scope", "line", "end_line", "sink", "content", F.col("to").alias("name"))
    sent = _join(sent, known.where(F.arrays_overlap("kinds", F.array(F.lit("argument"), F.lit("model")))).select(*_KEY, "scope", "name"), [*_KEY, "scope", "name"]).drop("name").distinct()
    taken = asked.where("sink IN ('file', 'ssrf', 'sql')").where(fact("prompt:argument") & F.col("free"))
    taken = taken.select(*_KEY, "scope", "line", "end_line", "sink", "content").unionByName(mail).unionByName(sent)
    taken = _join(taken, guarded, [*_KEY, "scope"], "left_anti")
    for kind, (severity, cwe) in ARGUMENTS.items():
        out = out.unionByName(_found(taken.where(F.col("sink") == kind), "tool-argument-to-sink", severity, cwe, 2))

    whole = F.col("listed") | fact("role:request")
    out = out.unionByName(_found(model.where("model").where(whole), "untrusted-message-role", MEDIUM, ("CWE-1427", "CWE-74")))

    picks = rows.where("condition_names IS NOT NULL")
    both = picks.select(*_KEY, "scope", "call", F.explode(F.array(*(F.struct(F.lit(u).alias("use"), F.col(f"{u}_names").alias("n")) for u in ("condition", "value")))).alias("u")).select(*_KEY, "scope", "call", "u.use", F.explode("u.n").alias("name"))
    both = _join(both, known.withColumnRenamed("scope", "of"), [*_KEY, "name"]).where("of = scope OR of = 0").groupBy("call").agg(F.bool_or((F.col("use") == "condition") & F.array_contains("kinds", "request")).alias("asked"), F.bool_or((F.col("use") == "value") & F.array_contains("kinds", "acts")).alias("acts"))
    selected = picks.join(both.where("asked AND acts"), "call").select(*_KEY, "scope", F.explode("left").alias("name")).distinct()
    granted = _join(model.select("*", F.explode("tool_names").alias("name")), selected, [*_KEY, "scope", "name"]).drop("name").dropDuplicates(["call"])
    out = out.unionByName(_found(granted, "untrusted-tool-selection", MEDIUM, ("CWE-862", "CWE-1427")))

    out = out.unionByName(_found(model.where("model").where(fact("prompt:secret") | F.col("gives")), "secret-sent-to-model", HIGH, ("CWE-200", "CWE-522")))
    return keep(out, "agent-findings")


def _closed(steps: list) -> list[tuple[int, str, list[str]]]:
    """reached() over names that may come from another scope as scope/name."""
    rows = []
    for s in steps:
        names = []
        for n in s["names"] or ():
            scope, slash, name = n.partition("/")
            if slash:
                rows.append({"scope": s["scope"], "name": n, "kinds": [], "names": [], "client": False})
                rows.append({"scope": int(scope), "name": n, "kinds": [], "names": [name], "client": False})
                names.append(n)
            else:
                names.append(n)
        rows.append({"scope": s["scope"], "name": s["name"], "kinds": list(s["kinds"]), "names": names, "client": s["client"]})
    # a value passed on is known in the scope that passes it; the function's own scope takes it from there
    passed = {r["name"]: r["scope"] for r in rows if "/" in r["name"] and r["names"]}
    have = {(scope, name): kinds for scope, name, kinds in reached(rows)}
    for _ in range(len(passed) + 1):
        grown = False
        for name, scope in passed.items():
            for r in rows:
                if r["name"] == name and not r["names"] and set(have.get((scope, name), ())) - set(r["kinds"]):
                    r["kinds"] = sorted(set(r["kinds"]) | set(have[(scope, name)]))
                    grown = True
        if not grown:
            break
        have = {(scope, name): kinds for scope, name, kinds in reached(rows)}
    return [(scope, name, list(kinds)) for (scope, name), kinds in have.items() if "/" not in name]


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi join that takes null projects as equal, with the left side's keys."""
    same = F.lit(True)
    for k in on:
        same = same & (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) if k == "project" else F.col(f"l.{k}") == F.col(f"r.{k}"))
    met = left.alias("l").join(right.alias("r"), same, how)
    return met if how == "left_anti" else met.select("l.*", *(f"r.{c}" for c in right.columns if c not in on))


def _found(rows: DataFrame, rule: str, severity: int, cwe: tuple[str, ...], confidence: int = 1) -> DataFrame:
    """Findings on the extents of calls, each once."""
    return _spanning(rows.dropDuplicates([*_KEY, "line", "end_line", "content"]), f"llm.{rule}", severity, cwe).withColumn("confidence", F.lit(confidence))


#: Internal hosts and addresses in a prompt, and where a literal is a system prompt.
SYSTEM = r"(?i)(?:system(?:_prompt|_message|Prompt|Message)?|instructions?)['\"]?\s*[=:]\s*\(?\s*[fFrR]?$|['\"]?role['\"]?\s*:\s*['\"]system['\"]\s*,\s*['\"]?content['\"]?\s*:\s*[fFrR]?$"
INTERNAL = r"(?i)\b(?:10\.\d{1,3}|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.\d{1,3}\.\d{1,3}\b|\b[\w-]+\.(?:internal|corp|intranet|local)\b"


def prompt_literals(files: DataFrame) -> DataFrame:
    """Findings of secrets and internal addresses in system prompts, whole literals over as many lines as they have."""
    from .rules import PLACEHOLDER, SECRETS

    code = files.where(F.col("language").isin(*LANGUAGES))
    rows = literals(tokens(code)).where(_is(F.col("prefix"), SYSTEM) | _is(F.col("value"), r"(?i)^\s*you are (?:a|an|the)\b")).withColumn("content", F.substring("value", 1, 200))
    secret = F.lit(False)
    for r in SECRETS:
        value = F.regexp_extract("value", r.pattern, 1)
        secret = secret | (value != "") & ~F.rlike(value, F.lit(PLACEHOLDER))
    out = _spanning(rows.where(secret), "llm.secret-in-system-prompt", HIGH, ("CWE-798", "CWE-200"))
    return out.unionByName(_spanning(rows.where(_is(F.col("value"), INTERNAL)), "llm.internal-address-in-prompt", MEDIUM, ("CWE-200",)))


def _spanning(rows: DataFrame, rule: str, severity: int, cwe: tuple[str, ...]) -> DataFrame:
    """Findings on rows that have an end_line."""
    return rows.select(
        *_KEY, F.col("line").alias("start_line"), "end_line", F.lit(rule).alias("rule_id"), F.lit("llm").alias("scanner"), F.lit(severity).alias("severity"), F.lit(1).alias("confidence"), F.lit(2).alias("likelihood"),
        F.array(*map(F.lit, cwe)).alias("cwe"), F.substring(F.trim("content"), 1, 200).alias("snippet"), F.array().cast("array<string>").alias("tags"),
    )
