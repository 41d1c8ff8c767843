"""Program texts as tables of tokens, bracket extents and string literals, by prefix sums over one regular expression.

A token is a string, a comment, a bracket, a line feed or a run of anything else; together they cover the text, so
running sums over them give each its offset, line and bracket depth. Brackets pair where a level's next bracket
closes it: lead() within (file, level), whatever lies between, over as many lines as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import lines

_QUOTED = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
#: Tokens of Python, and of JavaScript and TypeScript.
PYTHON = rf"(?s)\"\"\".*?\"\"\"|'''.*?'''|{_QUOTED}|#[^\n]*|[()\[\]{{}}]|\n|[^\"'#()\[\]{{}}\n]+|."
SCRIPT = rf"(?s)`[^`\\]*+(?:\\.[^`\\]*+)*+`|{_QUOTED}|//[^\n]*|/\*.*?\*/|[()\[\]{{}}]|\n|[^\"'`/()\[\]{{}}\n]+|."
#: String literals of either.
STRINGS = rf"(?s)\"\"\".*?\"\"\"|'''.*?'''|`[^`\\]*+(?:\\.[^`\\]*+)*+`|{_QUOTED}"
LANGUAGES = ("Python", "JavaScript", "TypeScript")
_KEY = ("project", "path")


def _order() -> Window:
    return Window.partitionBy(*_KEY).orderBy("at")


def _cut(text: Column) -> Column:
    return F.when(F.col("language") == "Python", F.regexp_extract_all(text, F.lit(PYTHON), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(SCRIPT), F.lit(0)))


def code_lines(files: DataFrame) -> DataFrame:
    """project, path, line, content of the lines of code; those that begin inside a string or a comment are empty.

    What is dealt by file are the texts without such lines, so windows over a file's lines shuffle nothing more.
    """
    inner = "\uffff"  # put behind line feeds inside tokens; texts have a blank for it
    marked = F.transform(_cut(F.translate("text", inner, " ")), lambda t: F.when((t != "\n") & F.contains(t, F.lit("\n")), F.replace(t, F.lit("\n"), F.lit("\n" + inner))).otherwise(t))
    bare = F.regexp_replace(F.array_join(marked, ""), inner + r"[^\n\x0B\f\r\x{85}\x{2028}\x{2029}\x1c-\x1e]*", "")
    code = files.where(F.col("language").isin(*LANGUAGES)).select(*_KEY, "language", bare.alias("text")).repartition(*_KEY)
    return lines(code).select(*_KEY, "line", "content")


def tokens(files: DataFrame) -> DataFrame:
    """project, path, at, token, first (its first character), kind (string, comment, open, close, line or code), offset, line, depth (brackets open before it), before (the dotted name that ends the token before it)."""
    found = _cut(F.col("text"))
    # whole texts are dealt, not tokens: every window over a file's tokens finds them in one task, in their order
    texts = files.where(F.col("language").isin(*LANGUAGES)).select(*_KEY, "language", "text").repartition(*_KEY)
    rows = texts.select(*_KEY, F.posexplode(found).alias("at", "token"))
    first = F.substring("token", 1, 1)
    kind = F.when(first.isin("(", "[", "{"), "open").when(first.isin(")", "]", "}"), "close").when(first == "\n", "line").when(F.rlike("token", F.lit(r"(?s)^(?:\"|'|`).*(?:\"|'|`)$")) & (F.length("token") > 1), "string").when(F.rlike("token", F.lit(r"^(?:#|//|/\*)")), "comment").otherwise("code")
    # made before rows are ordered: where the token itself isn't asked for, no text is sorted
    rows = rows.withColumns({"kind": kind, "first": first, "name": F.when(kind != "string", F.regexp_extract("token", r"(?<![\w$.])([\w$.]++)\s*+$", 1))})
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    sums = {"offset": F.length("token"), "line": breaks, "depth": step}
    rows = rows.select("*", *(F.coalesce(F.sum(v).over(before), F.lit(0)).cast("int").alias(c) for c, v in sums.items()), F.coalesce(F.lag("name").over(_order()), F.lit("")).alias("before"))
    return rows.withColumn("line", F.col("line") + 1).drop("name")


def extents(of: DataFrame) -> DataFrame:
    """Brackets of tokens with the close of each: project, path, bracket, callee, start (offset behind the open), stop (offset of the close), line, end_line.

    callee: the dotted name right before a parenthesis, with a dot in front where a call or an index is called on.
    Brackets that nothing closes have no extent.
    """
    level = F.when(F.col("kind") == "open", F.col("depth") + 1).otherwise(F.col("depth"))
    rows = of.where("kind IN ('open', 'close')").withColumn("level", level)
    order = Window.partitionBy(*_KEY, "level").orderBy("at")
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("kind", "offset", "line"))).where("kind = 'open' AND next_kind = 'close'")
    return rows.select(*_KEY, F.col("first").alias("bracket"), F.when(F.col("first") == "(", F.col("before")).otherwise("").alias("callee"), (F.col("offset") + 1).alias("start"), F.col("next_offset").alias("stop"), "line", F.col("next_line").alias("end_line"))


def between(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


def cut_out(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (project, path, start, stop and more) with cut, what a file's text has between start and stop, null where they are. A text meets its spans once, not once a span."""
    own = [c for c in spans.columns if c not in _KEY]
    listed = spans.groupBy(*_KEY).agg(F.collect_list(F.struct(*own)).alias("spans"))
    same = F.col("f.project").eqNullSafe(F.col("c.project")) & (F.col("f.path") == F.col("c.path"))
    cut = F.transform("c.spans", lambda s: F.struct(*(s[c].alias(c) for c in own), between(F.col("f.text"), s["start"], s["stop"]).alias("cut")))
    return files.alias("f").join(listed.alias("c"), same).select("f.project", "f.path", F.explode(cut).alias("s")).select(*_KEY, "s.*")


def calls(files: DataFrame, pairs: DataFrame, callee: Column) -> DataFrame:
    """Calls whose callee is wanted: project, path, callee, line, end_line, args."""
    wanted = pairs.where((F.col("bracket") == "(") & (F.col("callee") != "") & callee).select(*_KEY, "callee", "line", "end_line", "start", "stop")
    return cut_out(files, wanted).select(*_KEY, "callee", "line", "end_line", F.col("cut").alias("args"))


def literals(of: DataFrame) -> DataFrame:
    """String literals: project, path, line, end_line, prefix (the few tokens before it), value. Neighbours that only blanks, line feeds and plus signs part are one value with its first line."""
    rows = of.where("kind <> 'comment'").withColumn("glue", (F.col("kind") == "line") | (F.col("kind") == "code") & F.rlike("token", F.lit(r"^[\s+\\]*[rbfuRBFU]{0,2}$")))
    rows = rows.withColumn("prefix", F.concat_ws("", *(F.lag("token", k).over(_order()) for k in range(7, 0, -1)))).where("NOT glue")
    joins = F.coalesce(F.lag("kind").over(_order()) == "string", F.lit(False)) & (F.col("kind") == "string")
    rows = rows.withColumn("group", F.sum(F.when(joins, 0).otherwise(1)).over(_order().rowsBetween(Window.unboundedPreceding, 0))).where("kind = 'string'")
    quotes = F.when(F.rlike("token", F.lit("^(?:\"\"\"|''')")) & (F.length("token") >= 6), 3).otherwise(1)
    value = F.substring(F.col("token"), quotes + 1, F.greatest(F.length("token") - 2 * quotes, F.lit(0)))
    ends = F.col("line") + F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    parts = rows.groupBy(*_KEY, "group").agg(F.min("line").alias("line"), F.max(ends).alias("end_line"), F.min_by("prefix", "at").alias("prefix"), F.array_sort(F.collect_list(F.struct("at", value.alias("value")))).alias("parts"))
    return parts.select(*_KEY, "line", "end_line", "prefix", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
