"""Go declarations told from what only looks like them."""

import re

from pyspark.sql import functions as F

from tessera.sources import workspace

SOURCE = r'''// Package demo is func NotThis() {}
package demo

import "fmt"

/* func Commented() {}
type AlsoCommented struct{} */
const raw = `
func InRaw() {
type InRawToo struct{}
\`

var quoted = "func InString() { \" } {"; var After = 1
const Brace, lower, Other = '{', '\'', "\\"

type (
	// Kept is a type.
	Kept struct {
		Field int
		Nested struct{ Deep int }
	}
	hidden int
	Alias = Kept
)

var (
	Sum = 1 +
		NotAName
	List = []int{
		Also,
	}
	A, B int
)

func (k *Kept) Method() string {
	type Local struct{}
	var Inside = fmt.Sprint("x")
	for i := 0; i < 3; i++ {
	}
	return Inside
}

func Generic[T any](x T) T { return x }

type Set[K comparable] map[K]struct{}

func unexported() {}

func Überall() {}
'''


def found(spark, *texts):
    sources = spark.createDataFrame([(f"f{i}.go", t) for i, t in enumerate(texts)], "path string, text string")
    packages = spark.createDataFrame([("f0.go", "m/demo")], "file string, package string")
    return workspace.symbols(sources, packages)


def line_of(text):
    return SOURCE[: SOURCE.index(text)].count("\n") + 1


def test_symbols_are_declarations(spark):
    got = {(r.name, r.kind, r.line) for r in found(spark, SOURCE).collect()}
    want = {(n, k, line_of(t)) for n, k, t in [("After", "value", "var After"), ("Brace", "value", "const Brace"), ("Other", "value", "const Brace"), ("Kept", "type", "Kept struct"), ("Alias", "type", "Alias ="), ("Sum", "value", "Sum = 1"), ("List", "value", "List ="), ("A", "value", "A, B int"), ("B", "value", "A, B int"), ("Method", "func", "func (k"), ("Generic", "func", "func Generic"), ("Set", "type", "type Set"), ("Überall", "func", "func Über")]}
    assert got == want


def test_unsound_sources_have_no_symbols(spark):
    assert found(spark, "package p\nfunc Open() {\n", "func NoPackage() {}\n", "package p\n}\nfunc A() {\n", "", None).collect() == []
    (one,) = found(spark, "package p; func One() {}").collect()
    assert (one.name, one.package, one.line) == ("One", "m/demo", 1)


def test_code_keeps_lines_and_long_literals(spark):
    long_ = "package p\nvar A = \"" + 'x\\"' * 60_000 + "\"\n/*" + "\n*" * 60_000 + "*/\nvar B = `" + "\n{" * 1000 + "`\nfunc C() {}\n"
    row = spark.createDataFrame([(long_,)], "t string").select(workspace.go_code(F.col("t")).alias("c")).first().c
    assert row.count("\n") == long_.count("\n") and "{" not in row.split("func")[0] and len(row) < 70_000
    assert [(r.name, r.line) for r in found(spark, long_).orderBy("line").collect()] == [("A", 2), ("B", 60_004), ("C", 61_005)]


def test_symbols_stay_in_the_jvm(spark):
    plan = found(spark, SOURCE)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|InArrow|InPandas", plan)
