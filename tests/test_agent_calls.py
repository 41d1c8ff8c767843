"""Code tokens, extents and literals, and the trust-boundary rules of agents: each rule fires, and its look-alike does not."""

import pytest

from spanwarden.operators import agent_calls
from spanwarden.sources import code

PY_TOOLS = """import os
import httpx
from langchain_core.tools import tool
from typing import Literal

@tool
def look_up(place: str) -> str:
    return httpx.get(place).text

@tool
def drop(item: str) -> str:
    os.unlink(item)
    return "dropped"

@tool
def lamp(state: Literal["on", "off"]) -> str:
    return httpx.post("https://home.example.org/lamp", json={"state": state}).text
"""
QUIET = PY_TOOLS.replace("httpx.get(place)", "httpx.get(f'https://maps.example.org/{place}')")
#: A model call of an OpenAI client, with what stands for its messages.
CALL = "client.chat.completions.create(model='m', messages=%s)"
CLIENT = "from openai import OpenAI\nclient = OpenAI()\n"

#: file name, text, and (rule, line, end line) that must be found.
CASES = [
    (
        "shell.py",
        CLIENT + "import requests, subprocess\ndef tidy(address):\n    news = requests.get(address).text\n    turns = [{'role': 'user', 'content': 'Read (this: ' + news}]\n    answer = client.chat.completions.create(\n        model='m',\n        messages=turns,\n    )\n    order = answer.choices[0].message.content\n    subprocess.run(order, shell=True)\n",
        [("indirect-prompt-injection", 7, 10)],
    ),
    ("calm.py", CLIENT + "import requests, subprocess\ndef tidy(address):\n    news = requests.get(address).text\n    answer = " + CALL % "[{'role': 'user', 'content': news}]" + "\n    return answer\ndef apart(order):\n    subprocess.run(order, shell=True)\n", []),
    ("agent.py", PY_TOOLS + "keeper = create_react_agent(ChatOpenAI(), [look_up, drop])\ndef ask(words):\n    return keeper.invoke({'messages': [('user', words)]})\n", [("indirect-prompt-injection", 20, 20), ("tool-argument-to-sink", 8, 8), ("tool-argument-to-sink", 12, 12)]),
    ("lamps.py", QUIET.replace("os.unlink(item)", "print(item)") + "keeper = create_react_agent(ChatOpenAI(), [look_up, lamp])\ndef ask(words):\n    return keeper.invoke({'messages': [('user', words)]})\n", []),
    (
        "build.ts",
        'import { streamText, tool } from "ai";\nimport { execFile } from "node:child_process";\nimport { promisify } from "node:util";\nconst go = promisify(execFile);\nexport async function build(log) {\n  const failed = await fetch(log);\n  const words = await failed.text();\n  return streamText({\n    model,\n    prompt: "Mend " + words,\n    tools: {\n      start: tool({ execute: async ({ line }) => go(line) }),\n    },\n  });\n}\n',
        [("indirect-prompt-injection", 8, 14)],
    ),
    (
        "menu.ts",
        'import { streamText, tool } from "ai";\nimport { spawn } from "node:child_process";\nexport async function build(log) {\n  const words = await (await fetch(log)).text();\n  return streamText({\n    prompt: words,\n    tools: { start: tool({ parameters: z.object({ job: z.enum(["lint", "test"]) }), execute: async ({ job }) => spawn(job) }) },\n  });\n}\n',
        [],
    ),
    ("table.py", "from mcp.server.fastmcp import FastMCP\nserver = FastMCP('t')\n@server.tool()\ndef rows(table: str) -> list:\n    return DB.execute(f'SELECT * FROM {table}').fetchall()\n", [("tool-argument-to-sink", 5, 5)]),
    ("bound.py", "from mcp.server.fastmcp import FastMCP\nserver = FastMCP('t')\n@server.tool()\ndef rows(key: str) -> list:\n    return DB.execute('SELECT * FROM t WHERE k = ?', (key,)).fetchall()\n", []),
    ("inside.py", "from mcp.server.fastmcp import FastMCP\nserver = FastMCP('t')\n@server.tool()\ndef jot(name: str, body: str) -> str:\n    spot = Path(HOME, name).absolute()\n    if spot.is_relative_to(HOME):\n        spot.write_text(body)\n    return 'done'\n", []),
    ("mail.py", "from mcp.server.fastmcp import FastMCP\nserver = FastMCP('t')\n@server.tool()\ndef tell(whom: str) -> str:\n    letter = EmailMessage()\n    letter['Cc'] = whom\n    OUTBOX.send_message(letter)\n", [("tool-argument-to-sink", 6, 6)]),
    ("post.ts", 'import Anthropic from "@anthropic-ai/sdk";\nconst anthropic = new Anthropic();\nasync function deliver(order) {\n  return office.sendMail({ subject: "news", to: order.address });\n}\nexport async function serve(turns) {\n  const reply = await anthropic.messages.create({ model: "m", messages: turns });\n  for (const part of reply.content) {\n    await deliver(part.input);\n  }\n}\n', [("tool-argument-to-sink", 4, 4)]),
    ("roles.py", CLIENT + "api = FastAPI()\n@api.post('/one')\ndef one(req: Turns):\n    return " + CALL % "PREFIX + req.messages" + "\n@api.post('/two')\ndef two(req: Turns):\n    return client.chat.completions.create(\n        model='m', messages=[{'role': req.kind, 'content': 'hi'}])\n", [("untrusted-message-role", 6, 6), ("untrusted-message-role", 9, 10)]),
    ("user.py", CLIENT + "api = FastAPI()\nPAST = []\n@api.post('/one')\ndef one(req: Words):\n    PAST.append({'role': 'user', 'content': req.words})\n    return " + CALL % "PREFIX + PAST" + "\n", []),
    ("role.js", 'import OpenAI from "openai";\nconst openai = new OpenAI();\nrouter.post("/say", async (req, res) => {\n  const { role, words } = req.body;\n  const out = await openai.chat.completions.create({\n    messages: [{ role, content: words }],\n  });\n  res.json(out);\n});\n', [("untrusted-message-role", 5, 7)]),
    ("pick.py", QUIET + "api = FastAPI()\n@api.post('/ask')\ndef ask(words: str, staff: bool = False):\n    kit = [look_up, drop] if staff else [look_up]\n    return create_react_agent(ChatOpenAI(), kit).invoke({'messages': [('user', words)]})\n", [("untrusted-tool-selection", 22, 22), ("tool-argument-to-sink", 12, 12)]),
    ("may.py", QUIET + "api = FastAPI()\n@api.post('/ask')\ndef ask(words: str):\n    kit = [look_up, drop] if on_duty() else [look_up]\n    return create_react_agent(ChatOpenAI(), kit).invoke({'messages': [('user', words)]})\n", [("tool-argument-to-sink", 12, 12)]),
    ("secret.py", "import os\n" + CLIENT + "def bill(words):\n    code = os.getenv('SHOP_SECRET_KEY')\n    return " + CALL % "[{'role': 'user', 'content': f'With {code}: {words}'}]" + "\n", [("secret-sent-to-model", 6, 6)]),
    ("word.py", "import os\n" + CLIENT + "hub = Hub(os.environ['HUB_TOKEN'])\ndef bill(words):\n    code = os.getenv('SHOP_SECRET_KEY')\n    sign(code)\n    ticket = hub.ticket(words)\n    return " + CALL % "[{'role': 'user', 'content': 'a code word ' + words + ticket.body}]" + "\n", []),
]


def files(spark, rows):
    language = {"py": "Python", "js": "JavaScript", "ts": "TypeScript"}
    return spark.createDataFrame([(None if p == "role.js" else "p", p, language[p.rsplit(".", 1)[1]], len(t), t) for p, t in rows], "project string, path string, language string, size long, text string")


@pytest.fixture(scope="module")
def agents(spark):
    got = agent_calls.agent_calls(files(spark, [(p, t) for p, t, _ in CASES])).collect()
    return {p: sorted((r.rule_id.removeprefix("llm."), r.start_line, r.end_line) for r in got if r.path == p) for p, *_ in CASES}


@pytest.mark.parametrize("path,want", [(p, w) for p, _, w in CASES])
def test_agent_rules(agents, path, want):
    assert agents[path] == sorted(want)


def test_tokens_cover_the_text_and_give_lines(spark):
    text = 'a = ("x)" + \'(\',  # ]\n  """two\nlines ("""\n)\nb[1]{\n' * 40
    rows = code.tokens(files(spark, [("a.py", text)])).orderBy("at").collect()
    assert "".join(r.token for r in rows) == text
    assert all(text[: r.offset].count("\n") + 1 == r.line and text[r.offset : r.offset + len(r.token)] == r.token for r in rows)
    pairs = code.extents(code.tokens(files(spark, [("a.py", text)]))).where("bracket = '('").orderBy("line").collect()
    assert [(r.line, r.end_line) for r in pairs] == [(1 + 5 * i, 4 + 5 * i) for i in range(40)]


def test_literals_that_span_lines_are_one(spark):
    text = "x = ('one '\n     'two '\n     f'three')\ny = '''a\nb'''\nz = 'p' + 'q', 'r'\nn = ''\n"
    got = code.literals(code.tokens(files(spark, [("a.py", text)]))).orderBy("line", "value").collect()
    assert [(r.line, r.end_line, r.value) for r in got] == [(1, 3, "one two three"), (4, 5, "a\nb"), (6, 6, "pq"), (6, 6, "r"), (7, 7, "")]


def test_system_prompts(spark):
    rows = [
        ("a.py", "system_prompt = ('You help. '\n  'Use password=\"hunter2hunter2\" at db.corp.internal')\n"),
        ("b.py", "text = 'Use password=hunter2hunter2'\nsystem = 'Be kind.'\n"),
        ("c.js", "m = [{ role: 'system', content: `Ask 10.1.2.3\nfirst` }, { role: 'user', content: 'see 10.1.2.3' }]\n"),
    ]
    got = agent_calls.prompt_literals(files(spark, rows)).collect()
    assert sorted((r.path, r.rule_id, r.start_line) for r in got) == [("a.py", "llm.internal-address-in-prompt", 1), ("a.py", "llm.secret-in-system-prompt", 1), ("c.js", "llm.internal-address-in-prompt", 1)]


def test_words_of_a_string_over_lines_are_no_names(spark):
    """A string that an assignment's line opens and another line closes is one: its words name nothing, also behind a long first line."""
    head = CLIENT + "import requests, subprocess\ndef tidy(address):\n    news = requests.get(address).text\n    turns = [{'role': 'user', 'content': \"\"\"%s the\nnews of today\"\"\" + %s}]\n    answer = " + CALL % "turns" + "\n    subprocess.run(answer, shell=True)\n"
    rows = [(f"{w}{n}.py", head % ("so " * n, w)) for w in ("news", "calm") for n in (1, 1500)]
    got = agent_calls.agent_calls(files(spark, rows)).where("rule_id = 'llm.indirect-prompt-injection'").collect()
    assert sorted((r.path, r.start_line) for r in got) == [("news1.py", 8), ("news1500.py", 8)]


def test_texts_meet_calls_and_assignments_once(spark, monkeypatch):
    """No table but that of the files holds a text: what is asked of calls and assignments is read where a text meets them."""
    kept, keep = {}, agent_calls.keep
    monkeypatch.setattr(agent_calls, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    said = "[{'role': 'user', 'content': '''\n" + "word " * 20_000 + "'''}]"
    agent_calls.agent_calls(files(spark, [("a.py", CLIENT + "def ask(u):\n    turns = " + said + "\n    return " + CALL % said + "\n")]))
    assert [name for name, df in kept.items() if any(len(str(r)) > 10_000 for r in df.collect())] == ["agent-code"]
