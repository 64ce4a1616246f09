import pytest
from pyspark.sql import functions as F

from tessera.functions import filters, rewrite, text


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("troubled", "troubl"), ("happy", "happi"), ("sky", "sky"), ("generalize", "gener"), ("electric", "electr"), ("connection", "connect"), ("running", "run"), ("hopping", "hop"), ("is", "is"), ("été", "été")],
)
def test_stem(word, stem):
    assert text.stem(word) == stem


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_words_and_pairs(spark):
    assert one(spark, text.words(F.lit("The quick2brown_Fox and the fox é"))) == ["quick", "brown", "fox", "fox", "é"]
    assert one(spark, text.query_terms(text.words(F.lit("fox red fox")), pairs=True)) == ["fox", "red", "fox_red", "red_fox"]
    assert one(spark, text.words(F.lit(""))) == []
    assert one(spark, text.bigrams(text.words(F.lit("one")))) == []
    assert one(spark, text.path_words(F.lit("code/run-all/*.go"))) == ["code", "run", "go"]
    assert one(spark, text.camel_words(F.lit("audit.RunAllChecks"))) == ["audit", "run", "checks"]


def test_terms(spark):
    terms = F.array(F.lit("code"), F.lit("index"))
    assert one(spark, text.expand_terms(terms)) == ["index", "codeindex"]
    assert one(spark, text.drop_noise(F.array(F.lit("code")))) == ["code"]


def test_names(spark):
    assert one(spark, text.slugify(F.lit("  Hello, World! "))) == "hello-world"
    assert one(spark, text.title_from_path(F.lit("notes/my-first_note.md"))) == "My First Note"
    assert one(spark, text.token_estimate(F.lit("äbcde"))) == 2
    assert one(spark, text.token_estimate(F.lit(None).cast("string"))) == 0
    assert one(spark, text.is_secret_name(F.lit("MY_API-KEY"))) is True
    assert one(spark, text.cut_to(F.lit("abcdef"), 4)) == "abc…"


@pytest.mark.parametrize(("path", "scope", "inside"), [("code/a/x.go", "code/a/**", True), ("code/b", "code/a/**", False), ("docs/x.md", "docs/*.md", True), ("docs/y/x.md", "docs/*.md", False), ("README.md", "README.md", True), ("x", "", False)])
def test_scope(spark, path, scope, inside):
    assert one(spark, text.in_scope(F.lit(path), F.lit(scope))) is inside


def test_filters():
    name, out, err = filters.compact(["git", "status"], "?? a\nMM b\nUU c\n M d\n", "", 0)
    assert (name, err) == ("git.status", "") and out == "git status summary: staged=2 unstaged=2 untracked=1 conflicts=1\ncontext_lines=1"
    assert filters.compact(["cargo", "build"], "Compiling x\nerror[E1]: no\n --> a.rs\n", "", 1)[1] == "error[E1]: no\n--> a.rs"
    assert filters.compact(["go", "build"], "", "", 0)[1] == "go build summary: ok"
    assert filters.compact(["env"], "A=1\nMY_TOKEN=2\n", "")[1] == "env summary: vars=2 redacted=1\nkeys:\n  A"
    assert filters.compact(["wc"], " 1 2 3 f", "")[1] == "wc L=1 W=2 B=3 f"
    assert filters.compact(["find"], "b.go\na.go\na.go\nx", "")[1] == "find summary: unique_paths=3\nby_ext: (noext)=1, go=2\nsample:\n  a.go\n  b.go\n  x"
    assert filters.compact(["true"], '{"b": 1, "a": [1]}', "") == ("json", "json object: keys=2\n  a: array(len=1)\n  b: number(1)", "")
    assert filters.compact(["x"], "a\na\n\nb", "") == ("generic", "[repeated 2 times] a\nb", "")
    assert filters.filter_of(["top", "-b", "-n1"]) == "top" and filters.filter_of([]) == "generic"
    assert filters.pipe_filter("diff --git a b") == ["git", "diff"] and filters.pipe_filter("a/b\nc/d\ne/f") == ["find"]
    long = "\n".join(str(i) for i in range(300))
    assert len(filters.generic(long, False).split("\n")) == 120 and "...(181 lines omitted)..." in filters.generic(long, False)
    assert filters.compact(["x"], None, None) == ("generic", "", "")


def test_filters_are_stable_and_on_tables(spark):
    rows = spark.createDataFrame([(["ls"], "b\na", "", 0, False), (None, None, None, None, None)], "args array<string>, stdout string, stderr string, exit_code int, ultra boolean")
    got = [r["compact"] for r in filters.with_compact(rows).collect()]
    assert got[0]["out"] == "ls summary: dirs=0 files=0 links=0 entries=2\nnames:\n  a\n  b" and got[1]["filter"] == "generic"
    assert [r.f for r in rows.select(filters.filter_column(F.col("args")).alias("f")).collect()] == ["ls", "generic"]


@pytest.mark.parametrize(
    ("command", "new"),
    [("ls -la", "W run -- ls -la"), ("cat a b", "W read --line-numbers a b"), ("head -n 5 f", "W read --max-lines 5 f"), ("tail f", "W read --tail-lines 10 f"), ("a && b | c && d", "W run -- a && W run -- b | c && d"), ("a > f; b", "a > f; W run -- b"), ("cat -n f", "W run -- cat -n f")],
)
def test_rewrite(command, new):
    assert rewrite.decide(command)[2] == new.replace("W", rewrite.WRAPPER)


def test_rewrite_refuses():
    assert rewrite.decide("") == (False, "empty command", None)
    assert rewrite.decide("ls", enabled=False)[1] == "hooks disabled"
    assert rewrite.decide("Vim x", exclude=("vim",))[1] == "command excluded"
    assert rewrite.decide(f"{rewrite.WRAPPER} run -- ls")[1] == "already wrapped"
    assert rewrite.decide("echo > f")[0] is False


def test_readers(spark):
    from tessera.functions import readers

    go = "// Doc.\npackage p\n\n/* block\n*/\nimport (\n\t\"a\"\n)\n\nfunc F(x int) string { // go\n\ta()\n\tb(\"}\")\n\tc()\n\td()\n\te()\n\tf()\n}\n\nfunc G() { return }\n\ntype T struct {\n\tX int // field\n}\n"
    out = readers.go_outline(go)
    assert out.startswith("package p\n\nimport (\n") and "\t... (2 lines omitted, lines 15-16)\n}" in out and "\td()\n\t..." in out and "field" not in out and "func G() { return }" in out
    assert "\t... (lines 11-16)" in readers.go_outline(go, ultra=True)
    assert readers.go_outline("x // y\n\n\n\nz") == "x\n\nz\n"
    md = "a\n```\n" + "\n".join("x" * 20) + "\n```\nb\n```\nopen"
    assert readers.markdown(md) == "a\n```\n... (20 lines omitted, lines 3-22)\n```\nb\n```\nopen"
    assert readers.json_outline('{"b": "x", "a": [1, 2]}') == 'json object: keys=2\n  a: array(len=2)\n  b: string("x")' and readers.json_outline("no") == "no"
    files = spark.createDataFrame([("a.json", '{"a": 1}'), ("b.txt", "1\n2\n3"), ("c.md", None)], "path string, text string")
    got = {r.path: r for r in readers.read(files, last=2, numbers=True).collect()}
    assert got["b.txt"].content == "1|2\n2|3" and got["a.json"].content == '1|{"a": 1}' and got["b.txt"].language == "generic"


def test_compact_forms_of_more_commands_than_a_slice(spark, monkeypatch):
    n = 2 * filters.SLICE + 3
    rows = spark.range(n).coalesce(1).selectExpr("array('make') args", "concat('error: ', id) stdout", "'' stderr", "0 exit_code", "false ultra")
    got = [r["compact"]["out"] for r in filters.with_compact(rows).collect()]
    assert got == [f"error: {i}" for i in range(n)]
