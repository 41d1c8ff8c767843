"""Tokens and lines of code: texts are dealt once, not tokens or lines."""

from pyspark.sql import DataFrame

from spanwarden.sources import code

TEXT = 'a = 1\nx = """one\ntwo # three\n""" + b\n# "four\ny = \'\uffff\'\nz(\n  "five",\n)\n'


def files(spark) -> DataFrame:
    return spark.createDataFrame([("p", "a.py", "Python", TEXT), (None, "b.js", "JavaScript", "f(`a\nb`)\n/* c\nd */ g()\nh()"), ("p", "c.txt", "Text", "x")], "project string, path string, language string, text string")


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_that_begin_inside_a_token_are_empty(spark):
    rows = {(r.path, r.line): r.content for r in code.code_lines(files(spark)).collect()}
    python = ["a = 1", 'x = """one', "", "", '# "four', "y = ' '", "z(", '  "five",', ")"]
    script = ["f(`a", "", "/* c", "", "h()"]
    assert rows == {("a.py", i): x for i, x in enumerate(python, 1)} | {("b.js", i): x for i, x in enumerate(script, 1)}


def test_texts_are_dealt_before_they_are_cut(spark):
    for df in (code.extents(code.tokens(files(spark))), code.code_lines(files(spark))):
        said = plan(df)
        assert "Join" not in said and said.count("Exchange hash") == 1
        assert said.index("Generate") < said.index("Exchange hash")  # a parent stands above its child
