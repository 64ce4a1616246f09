"""Compact forms of command output as columns: lines are arrays, and what a filter keeps or counts are array functions.

A row is (args, stdout, stderr, exit_code, ultra).  compact() gives struct<filter, out, err> for the commands of NATIVE, for
top and for all that have no filter; functions.filters has the forms of HTTP and JSON, whose texts need a parser of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.filters import _COMMANDS, RULES, STDERR_LINES, filter_column
from tessera.functions.text import SECRET_NAME, let
from tessera.operators import compact as common

# White space, colour codes, what marks a failure.
_WHITE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_COLOUR = "\\x1b\\[[0-9;]*m"
_FAILURE = "(?i)fail|error|fatal|panic"


def _lines(*said: Column) -> Column:
    return F.array(*said) if said else F.array().cast("array<string>")


def tidy(c: Column) -> Column:
    """Lines with white space collapsed, blank ones dropped."""
    each = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(F.regexp_replace(x, f"{_WHITE}+", " ")))
    return F.filter(each, lambda x: x != "")


def raw_lines(c: Column) -> Column:
    """Lines without colours, blank ones dropped."""
    each = F.split(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), _COLOUR, ""), F.lit("\r\n"), F.lit("\n")), "\n")
    return F.filter(each, lambda x: F.regexp_replace(x, f"{_WHITE}+", "") != "")


def bare(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _COLOUR, "")


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_WHITE}+|{_WHITE}+$", "")


def _text(c: Column) -> Column:
    return c.cast("string")


def _more(total: Column, most: Column, what: str = "") -> Column:
    return F.when(total > most, F.concat(F.lit(" ("), _text(total - most), F.lit(f"{what} omitted)"))).otherwise("")


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


class Output:
    """The columns of a captured command."""

    def __init__(self, stdout: str = "stdout", stderr: str = "stderr", exit_code: str = "exit_code", ultra: str = "ultra"):
        self.stdout, self.stderr = F.coalesce(F.col(stdout), F.lit("")), F.coalesce(F.col(stderr), F.lit(""))
        self.failed, self.ultra = F.coalesce(F.col(exit_code), F.lit(0)) != 0, F.coalesce(F.col(ultra), F.lit(False))

    def pick(self, small: int, large: int) -> Column:
        return F.when(self.ultra, small).otherwise(large)

    def both(self) -> Column:
        return F.concat(tidy(self.stderr), tidy(self.stdout))

    def plain(self) -> Column:
        """Lines of the output, or of the error stream where there are none."""
        return let(tidy(bare(self.stdout)), lambda a: F.when(F.size(a) > 0, a).otherwise(tidy(bare(self.stderr))))


def sifted(name: str, o: Output) -> Column:
    """The lines of a rule: noise goes, what is to be kept stays."""
    rule = RULES[name]
    source = tidy(o.stdout) if name == "go.test" else o.both()
    if name == "npm":
        source = F.filter(F.transform(source, lambda x: _strip(F.regexp_replace(x, "[\\u2800-\\u28ff]+", ""))), lambda x: x != "")

    def stays(x: Column) -> Column:
        kept = x.rlike(rule.keep)
        if rule.verbose != "(?!)":
            kept = kept | (~o.ultra & x.rlike(rule.verbose))
        return kept & ~x.rlike(rule.noise) if rule.noise != "(?!)" else kept

    return let(F.filter(source, stays), lambda a: F.when(F.size(a) > 0, a).when(o.failed, _lines()).otherwise(_lines(F.lit(rule.done))))


def git_status(o: Output) -> Column:
    """Counts of short or long status lines; a long line counts for the first heading that it holds."""
    short = "^[ MARCUD?!]{2} "
    prose = ("Changes to be committed", "Changes not staged for commit", "Untracked files", "both modified")

    def counts(a: Column) -> Column:
        new, rest = F.filter(a, lambda x: x.startswith("?? ")), F.filter(a, lambda x: ~x.startswith("?? "))
        marked, told = F.filter(rest, lambda x: x.rlike(short)), F.filter(rest, lambda x: ~x.rlike(short))

        def said(i: int) -> Column:
            return _count(told, lambda x: x.contains(prose[i]) & ~_any(x, prose[:i]))

        staged = _count(marked, lambda x: ~x.substr(1, 1).isin(" ", "?")) + said(0)
        unstaged = _count(marked, lambda x: ~x.substr(2, 1).isin(" ", "?")) + said(1)
        conflicts = _count(marked, lambda x: x.substr(1, 2).contains("U")) + said(3)
        head = F.format_string("git status summary: staged=%d unstaged=%d untracked=%d conflicts=%d", staged, unstaged, F.size(new) + said(2), conflicts)
        return let(_count(told, lambda x: ~_any(x, prose)), lambda n: F.when(n > 0, _lines(head, F.concat(F.lit("context_lines="), _text(n)))).otherwise(_lines(head)))

    return let(tidy(o.stdout), counts)


def _any(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | x.contains(p)
    return out


_STAT = r"(\d+)\s+files?\s+changed(?:,\s+(\d+)\s+insertions?\(\+\))?(?:,\s+(\d+)\s+deletions?\(-\))?"


def diff(o: Output) -> Column:
    """The last totals that are told, and the files of headers, sorted."""

    def summary(a: Column) -> Column:
        stats = F.filter(a, lambda x: x.rlike(_STAT))

        def last(i: int) -> Column:
            told = F.filter(F.transform(stats, lambda x: F.regexp_extract(x, _STAT, i)), lambda x: x != "")
            return F.coalesce(F.try_element_at(told, F.lit(-1)).cast("long"), F.lit(0).cast("long"))

        def named(x: Column) -> Column:
            marked = F.regexp_extract(x, r"^(?:\+\+\+ b/|--- a/)(.+)", 1)
            return F.when(marked != "", marked).otherwise(F.regexp_extract(F.concat(x, F.lit(" ")), r"^diff --git a/(\S+) ", 1))

        files = F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(a, lambda x: ~x.rlike(_STAT)), named), lambda x: ~x.isin("", "/dev/null"))))
        return let(files, lambda f: F.concat(_lines(F.format_string("git diff summary: files=%d insertions=%d deletions=%d", F.greatest(last(1), F.size(f).cast("long")), last(2), last(3))), F.transform(F.slice(f, F.lit(1), o.pick(5, 10)), lambda x: F.concat(F.lit("file: "), x))))

    return let(tidy(o.stdout), summary)


def matches(o: Output) -> Column:
    """Matches (file:line:text) by file: how many, and the first."""

    def summary(a: Column) -> Column:
        found = F.filter(a, lambda x: F.size(F.split(x, ":", 3)) == 3)
        names = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.split_part(x, F.lit(":"), F.lit(1)))))

        def told(f: Column) -> Column:
            own = F.filter(found, lambda x: F.split_part(x, F.lit(":"), F.lit(1)) == f)
            cells = F.split(F.get(own, F.lit(0)), ":", 3)
            return _lines(F.concat(f, F.lit(" ("), _text(F.size(own)), F.lit(" matches)")), F.concat(F.lit("  L"), F.get(cells, F.lit(1)), F.lit(": "), F.get(cells, F.lit(2))))

        out = F.flatten(F.transform(F.slice(names, F.lit(1), o.pick(8, 20)), told))
        return let(out, lambda x: F.when(F.size(x) > 0, x).otherwise(_lines(F.lit("rg summary: no parsed matches"))))

    return let(tidy(o.stdout), summary)


_VET = r"^(.+\.go):(\d+):(?:\d+:)?\s*(.+)$"


def vet(o: Output) -> Column:
    """Findings (file, message), each once, by file."""

    def summary(a: Column) -> Column:
        found = F.transform(F.filter(a, lambda x: x.rlike(_VET)), lambda x: F.struct(F.regexp_extract(x, _VET, 1).alias("file"), F.regexp_extract(x, _VET, 2).alias("line"), _strip(F.regexp_extract(x, _VET, 3)).alias("said")))
        files = F.array_sort(F.array_distinct(F.transform(found, lambda f: f["file"])))

        def own(f: Column) -> Column:
            """The first of each message of a file, in order."""
            rows = F.filter(found, lambda x: x["file"] == f)
            return F.transform(F.array_distinct(F.transform(rows, lambda x: x["said"])), lambda s: F.concat(f, F.lit(":"), F.get(F.filter(rows, lambda x: x["said"] == s), F.lit(0))["line"], F.lit(": "), s))

        total = F.size(F.array_distinct(F.transform(found, lambda x: F.struct(x["file"], x["said"]))))
        head = F.format_string("go vet summary: files=%d findings=%d", F.size(files), total)
        listed = F.flatten(F.transform(F.slice(files, F.lit(1), o.pick(8, 16)), lambda f: F.slice(own(f), F.lit(1), o.pick(4, 8))))
        return F.when(F.size(found) > 0, F.concat(_lines(head), listed)).otherwise(_lines(head, F.lit("go vet summary: (no file:line findings parsed)")))

    return let(o.both(), summary)


def found(o: Output) -> Column:
    """Distinct sorted paths, their numbers by extension, and a sample."""

    def summary(paths: Column) -> Column:
        def extension(p: Column) -> Column:
            name = F.regexp_extract(p, "([^/]*)$", 1)
            return F.when(name.contains("."), F.lower(F.regexp_extract(name, r"([^.]*)$", 1))).otherwise("")

        kinds = F.transform(paths, lambda p: F.coalesce(F.nullif(extension(p), F.lit("")), F.lit("(noext)")))
        parts = let(kinds, lambda k: F.transform(F.slice(F.array_sort(F.array_distinct(k)), F.lit(1), o.pick(8, 16)), lambda x: F.concat(x, F.lit("="), _text(_count(k, lambda y: y == x)))))
        n, most = F.size(paths), o.pick(25, 50)
        head = F.concat(F.lit("find summary: unique_paths="), _text(n))
        by = F.when(n > 0, _lines(F.concat(F.lit("by_ext: "), F.array_join(parts, ", ")))).otherwise(_lines())
        return F.concat(_lines(head), by, _lines(F.concat(F.lit("sample:"), _more(n, most))), F.transform(F.slice(paths, F.lit(1), most), lambda p: F.concat(F.lit("  "), p)))

    return let(F.array_sort(F.array_distinct(tidy(bare(o.stdout)))), summary)


_BRANCH = "^((?:[│|]   )*)((?:    )*)(├──|└──|`--)?"


def tree(o: Output) -> Column:
    """Lines down to a depth; how many lie deeper."""
    most = o.pick(1, 2)

    def depth(x: Column) -> Column:
        bars, spaces = (F.floor(F.length(F.regexp_extract(x, _BRANCH, i)) / 4) for i in (1, 2))
        return bars + spaces + (F.regexp_extract(x, _BRANCH, 3) != "").cast("long")

    def summary(a: Column) -> Column:
        kept = F.filter(a, lambda x: depth(x) <= most)
        deep = F.size(a) - F.size(kept)
        body = F.concat(kept, F.when(deep > 0, _lines(F.concat(F.lit("… collapsed deeper tree lines: "), _text(deep)))).otherwise(_lines()))
        return let(body, lambda b: F.when(F.size(b) > 0, F.concat(_lines(F.concat(F.lit("tree summary: lines="), _text(F.size(b)), F.lit(" max_depth_shown="), _text(most))), b)).otherwise(_lines(F.lit("tree summary: (empty)"))))

    return let(F.transform(raw_lines(o.stdout), lambda x: F.regexp_replace(x, "\r+$", "")), summary)


_MODE = f"^[-dlcbps?][-rwxsStT.+]{{9}}[+@]?{_WHITE}+"


def listing(o: Output) -> Column:
    """Folders, files and links of a long listing, and the names of any."""

    def summary(a: Column) -> Column:
        def cells(x: Column) -> Column:
            return F.split(x, f"{_WHITE}+")

        def is_long(x: Column) -> Column:
            return x.rlike(_MODE) & (F.size(cells(x)) > 1)

        long_ = F.filter(a, is_long)
        names = F.filter(F.transform(a, lambda x: F.when(is_long(x), F.nullif(F.when(~F.element_at(cells(x), -1).isin(".", ".."), F.element_at(cells(x), -1)), F.lit(""))).when(~x.startswith("total "), x)), lambda x: x.isNotNull())
        dirs, links = _count(long_, lambda x: x.startswith("d")), _count(long_, lambda x: x.startswith("l"))
        head = F.format_string("ls summary: dirs=%d files=%d links=%d entries=%d", dirs, F.size(long_) - dirs - links, links, F.size(names))
        most = o.pick(15, 30)
        return F.when(F.size(names) > 0, F.concat(_lines(head, F.concat(F.lit("names:"), _more(F.size(names), most))), F.transform(F.slice(F.array_sort(names), F.lit(1), most), lambda x: F.concat(F.lit("  "), x)))).otherwise(_lines(head))

    return let(F.transform(raw_lines(o.stdout), _strip), summary)


def environment(o: Output) -> Column:
    """How many variables, how many of them secret, and the names of the others."""

    def summary(keys: Column) -> Column:
        shown = F.array_sort(F.filter(keys, lambda k: (k == "") | ~k.rlike(SECRET_NAME)))
        most = o.pick(30, 60)
        return let(shown, lambda s: F.concat(_lines(F.format_string("env summary: vars=%d redacted=%d", F.size(keys), F.size(keys) - F.size(s)), F.concat(F.lit("keys:"), _more(F.size(s), most))), F.transform(F.slice(s, F.lit(1), most), lambda k: F.concat(F.lit("  "), k))))

    return let(F.transform(F.filter(o.plain(), lambda x: x.contains("=")), lambda x: _strip(F.split_part(x, F.lit("="), F.lit(1)))), summary)


def word_count(o: Output) -> Column:
    """One to three numbers with their names, of the first line."""

    def summary(a: Column) -> Column:
        cells = F.split(F.get(a, F.lit(0)), " ")
        numbers = F.coalesce(F.array_min(F.transform(cells, lambda c, i: F.when(~c.rlike(r"^[+-]?\d+$"), i))), F.size(cells))
        whole = F.transform(F.slice(cells, F.lit(1), numbers), lambda c: _text(c.cast("decimal(38,0)")))
        name = F.coalesce(F.nullif(F.array_join(F.slice(cells, numbers + 1, F.size(cells)), " "), F.lit("")), F.lit("total"))

        def labelled(*labels: str) -> Column:
            return F.concat(F.lit("wc "), *[F.concat(F.lit(x), F.get(whole, F.lit(i)), F.lit(" ")) for i, x in enumerate(labels)], name)

        every = F.array_join(a, " ")
        out = F.when(numbers == 1, labelled("")).when(numbers == 2, labelled("L=", "B=")).when(numbers == 3, labelled("L=", "W=", "B=")).otherwise(F.concat(F.lit("wc: "), every))
        return F.when((F.size(a) == 0) | (F.size(cells) < 2), _lines(F.concat(F.lit("wc summary: "), every))).otherwise(_lines(out))

    return let(o.plain(), summary)


def disks(o: Output) -> Column:
    """Mounted file systems but for those in memory."""

    def summary(a: Column) -> Column:
        head = F.try_element_at(F.filter(a, lambda x: F.lower(x).startswith("filesystem")), F.lit(-1))
        kept = F.filter(a, lambda x: ~F.lower(x).startswith("filesystem") & (F.size(F.split(x, " ")) >= 6) & ~F.lower(F.split_part(x, F.lit(" "), F.lit(1))).rlike("tmpfs|overlay|^devfs$|^udev$|^none$"))
        rows = F.transform(kept, lambda x: let(F.split(x, " "), lambda c: F.concat(F.get(c, F.lit(0)), F.lit(" use="), F.get(c, F.lit(4)), F.lit(" mount="), F.array_join(F.slice(c, F.lit(6), F.size(c)), " "))))
        some = F.concat(_lines(F.concat(F.lit("df summary: rows="), _text(F.size(kept)))), F.when(head.isNotNull(), _lines(head)).otherwise(_lines()), rows)
        return F.when((F.size(kept) == 0) & head.isNull(), _lines(F.lit("df summary: (no rows parsed)"))).otherwise(some)

    return let(tidy(bare(o.stdout)), summary)


def batch_top(o: Output) -> Column:
    return let(F.slice(tidy(bare(o.stdout)), F.lit(1), o.pick(15, 30)), lambda a: F.concat(_lines(F.concat(F.lit("top batch summary: lines="), _text(F.size(a)))), a))


def processes(o: Output) -> Column:
    """Processes by their third and fourth figures, the greatest first, below the last header."""

    def summary(a: Column) -> Column:
        def cells(x: Column) -> Column:
            return F.split(x, f"{_WHITE}+")

        def figure(x: Column, i: int) -> Column:
            return F.get(cells(x), F.lit(i)).try_cast("double")

        own = F.filter(a, lambda x: (F.size(cells(x)) >= 4) & ~x.startswith("["))
        is_head = lambda x: (F.upper(F.get(cells(x), F.lit(0))) == "USER") | (F.get(cells(x), F.lit(0)) == "PID")
        head = F.try_element_at(F.filter(own, is_head), F.lit(-1))

        def key(x: Column, i: Column) -> Column:
            both = figure(x, 2).isNotNull() & figure(x, 3).isNotNull()
            return F.struct((-F.when(both, figure(x, 2)).otherwise(0.0)).alias("a"), (-F.when(both, figure(x, 3)).otherwise(0.0)).alias("b"), i.alias("i"), x.alias("x"))

        rows = F.transform(F.array_sort(F.transform(F.filter(own, lambda x: ~is_head(x)), key)), lambda r: r["x"])
        most = o.pick(10, 20)

        def shown(r: Column) -> Column:
            n = F.size(r)
            first = F.when((n > 0) | head.isNotNull(), F.concat(F.lit("ps summary: shown="), _text(F.least(most, n)))).otherwise("ps summary: (no rows parsed)")
            more = F.when(n > most, _lines(F.concat(F.lit("…("), _text(n - most), F.lit(" processes omitted)")))).otherwise(_lines())
            return F.concat(F.when(head.isNotNull(), _lines(head)).otherwise(_lines()), _lines(first), F.slice(r, F.lit(1), most), more)

        return let(rows, shown)

    return let(F.transform(raw_lines(o.stdout), _strip), summary)


def _runs(items: Column, begins) -> Column:
    """Where the runs of an array begin (from 0), and after the last of them its size."""
    return F.concat(F.filter(F.sequence(F.lit(0), F.size(items)), lambda i: (i < F.size(items)) & begins(i)), F.array(F.size(items)))


def blame(o: Output) -> Column:
    """Ranges of neighbouring lines of one commit."""
    mark = r"^([0-9a-f]{7,40})\b"

    def summary(a: Column) -> Column:
        known = F.filter(F.transform(a, lambda x, i: F.struct((i + 1).alias("n"), F.regexp_extract(x, mark, 1).alias("h"), x.alias("x"))), lambda r: r["h"] != "")

        def ranges(k: Column) -> Column:
            starts = _runs(k, lambda i: (i == 0) | (F.get(k, i)["h"] != F.get(k, i - 1)["h"]))

            def told(b: Column) -> Column:
                def of(i: Column, at: Column) -> Column:
                    first, last = F.get(k, i), F.get(k, F.get(b, at + 1) - 1)
                    sample = _strip(F.substring(first["x"], F.length(first["h"]) + 1, F.length(first["x"])))
                    cut = F.when(F.length(sample) > 60, F.concat(F.substring(sample, 1, 59), F.lit("…"))).otherwise(sample)
                    return F.concat(F.lit("L"), _text(first["n"]), F.when(last["n"] > first["n"], F.concat(F.lit("-L"), _text(last["n"]))).otherwise(""), F.lit(" "), F.substring(first["h"], 1, 12), F.lit(" "), cut)

                n, most = F.size(b) - 1, o.pick(20, 40)
                rows = F.transform(F.slice(b, F.lit(1), F.least(n, most)), of)
                more = F.when(n > most, _lines(F.concat(F.lit("…("), _text(n - most), F.lit(" ranges omitted)")))).when(n == 0, _lines(F.lit("git blame summary: (no ranges parsed)"))).otherwise(_lines())
                return F.concat(_lines(F.concat(F.lit("git blame summary: ranges="), _text(n))), rows, more)

            return let(starts, told)

        return let(known, ranges)

    return let(F.transform(raw_lines(o.stdout), _strip), summary)


def log(o: Output) -> Column:
    """Commits with subject, author and date, a line each."""

    def short(x: Column) -> Column:
        """At most 80 bytes, whole characters, and a mark where something is cut."""
        n = F.get(F.filter(F.sequence(F.lit(80), F.lit(20), F.lit(-1)), lambda n: F.octet_length(F.substring(x, F.lit(1), n)) <= 80), F.lit(0))
        return F.when(F.octet_length(x) <= 80, x).otherwise(F.concat(F.substring(x, F.lit(1), n), F.lit("…")))

    def summary(a: Column) -> Column:
        starts = _runs(a, lambda i: F.get(a, i).rlike("^commit [0-9a-f]{7,40}"))

        def told(b: Column) -> Column:
            def of(i: Column, at: Column) -> Column:
                own = F.filter(F.slice(a, i + 2, F.greatest(F.get(b, at + 1) - i - 1, F.lit(0))), lambda x: x != "")
                label = lambda x: F.split_part(x, F.lit(":"), F.lit(1))

                def field(name: str) -> Column:
                    last = F.try_element_at(F.filter(own, lambda x: label(x) == name), F.lit(-1))
                    return F.coalesce(_strip(F.regexp_replace(last, "^[^:]*:?", "")), F.lit(""))

                subject = F.coalesce(F.get(F.filter(own, lambda x: ~label(x).isin("Author", "Date", "Merge")), F.lit(0)), F.lit(""))
                return F.concat_ws(" · ", F.substring(F.regexp_extract(F.get(a, i), "^commit ([0-9a-f]{7,40})", 1), 1, 12), short(subject), field("Author"), field("Date"))

            n, most = F.size(b) - 1, o.pick(10, 20)
            more = F.when(n > most, _lines(F.concat(F.lit("…("), _text(n - most), F.lit(" commits omitted)")))).otherwise(_lines())
            return F.concat(_lines(F.concat(F.lit("git log summary: total="), _text(n), F.lit(" shown="), _text(F.least(most, n)))), F.transform(F.slice(b, F.lit(1), F.least(n, most)), of), more)

        return let(starts, told)

    return let(F.transform(F.split(F.replace(o.stdout, F.lit("\r\n"), F.lit("\n")), "\n"), _strip), summary)


def shown(o: Output) -> Column:
    """What stands before the patch, and the patch's summary."""
    text = F.replace(o.stdout, F.lit("\r\n"), F.lit("\n"))

    def summary(cut: Column) -> Column:
        head, patch = F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, F.length(text))

        class Patch(Output):
            def __init__(self):
                self.stdout, self.stderr, self.failed, self.ultra = patch, o.stderr, o.failed, o.ultra

        own = Patch()
        lines = F.when(o.failed, F.concat(diff(own), F.filter(own.both(), lambda x: x.rlike(_FAILURE)))).otherwise(diff(own))
        errors = F.slice(F.array_distinct(tidy(o.stderr)), 1, STDERR_LINES)
        return F.concat(
            _lines(F.lit("git show metadata:")), F.transform(F.slice(tidy(head), F.lit(1), o.pick(12, 24)), lambda x: F.concat(F.lit("  "), x)), _lines(F.lit("git show diff:")), F.array_distinct(lines),
            F.when(F.size(errors) > 0, F.concat(_lines(F.lit("stderr:")), errors)).otherwise(_lines()),
        )

    begins = F.when(text.startswith("diff --git "), F.lit(0)).when(F.instr(text, "\ndiff --git ") > 0, F.instr(text, "\ndiff --git ")).otherwise(F.length(text))
    return let(begins, summary)


def pytest_run(o: Output) -> Column:
    """Headings and lines of failures, and as much of their traces as the budget allows: a fold over the lines."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"), o.pick(40, 80).alias("budget"))

    def step(acc: Column, x: Column) -> Column:
        low = F.lower(x)
        opens = (x.startswith("===") & low.contains("fail")) | x.rlike("^(FAILED|ERROR)") | (x.contains("E ") & x.contains("Error"))
        traced = ~opens & ((acc["inside"] & x.startswith("_")) | low.contains("traceback"))
        ends = ~opens & ~traced & x.contains("passed") & x.contains("failed")
        kept = opens | (traced & (acc["budget"] > 0)) | ends
        return F.struct(
            F.when(kept, F.array_append(acc["out"], x)).otherwise(acc["out"]).alias("out"),
            ((acc["inside"] & ~ends) | opens | (traced & low.contains("traceback"))).alias("inside"),
            F.when(traced & (acc["budget"] > 0), acc["budget"] - 1).otherwise(acc["budget"]).alias("budget"),
        )

    done = F.aggregate(o.both(), state, step, lambda acc: acc["out"])
    return let(done, lambda a: F.when((F.size(a) > 0) | o.failed, a).otherwise(_lines(F.lit("pytest summary: ok"))))


def is_top(args: Column) -> Column:
    """Whether a command is top in batches of a stated number."""
    words = F.transform(args, lambda w: F.trim(w))
    counted = F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: ((F.get(words, i) == "-n") & (i + 1 < F.size(words))) | (F.get(words, i).startswith("-n") & (F.length(F.get(words, i)) > 2)))
    return F.coalesce((F.get(words, F.lit(0)) == "top") & F.array_contains(words, "-b") & counted, F.lit(False))


#: Filters with their most lines (ultra, else), None for all.
NATIVE = {
    **{name: (lambda o, n=name: sifted(n, o), rule.most) for name, rule in RULES.items()},
    "git.status": (git_status, (8, 16)), "git.diff": (diff, None), "diff": (diff, None), "rg": (matches, None), "go.vet": (vet, None), "find": (found, (40, 80)), "tree": (tree, (30, 60)),
    "ls": (listing, (24, 40)), "env": (environment, None), "wc": (word_count, None), "df": (disks, (15, 30)), "ps": (processes, None), "git.blame": (blame, None), "git.log": (log, None), "git.show": (shown, None), "pytest": (pytest_run, (50, 100)),
}
assert set(NATIVE) <= set(_COMMANDS.values())


def compact(args: Column, o: Output | None = None) -> Column:
    """struct<filter, out, err> of a command with one of these filters: the filter's lines, those of failure where it failed,
    each once, up to the filter's most; of the error stream the first distinct lines.  Commands without a filter get the
    generic form, unless their output opens like JSON; null for what is left."""
    o = o or Output()
    name = filter_column(args)
    out = F.lit(None).cast("string")
    for filter_, (lines, most) in NATIVE.items():
        own = F.array_distinct(F.when(o.failed, F.concat(lines(o), F.filter(o.both(), lambda x: x.rlike(_FAILURE)))).otherwise(lines(o)))
        own = F.slice(own, F.lit(1), o.pick(*most)) if most else own
        out = F.when(name == filter_, F.array_join(own, "\n")).otherwise(out)
    errors = F.array_join(F.slice(F.array_distinct(tidy(o.stderr)), 1, STDERR_LINES), "\n")

    def result(filter_: Column, out: Column, err: Column) -> Column:
        return F.struct(filter_.alias("filter"), out.alias("out"), err.alias("err"))

    def generic(c: Column) -> Column:
        return F.when(o.ultra, common.generic(c, True)).otherwise(common.generic(c))

    made = F.when(is_top(args), result(F.lit("generic"), F.array_join(batch_top(o), "\n"), errors)).when(name.isin(*NATIVE), result(name, out, errors))
    return made.when((name == "generic") & ~o.stdout.rlike(f"^{_WHITE}*[{{\\[]"), result(F.lit("generic"), generic(o.stdout), generic(o.stderr)))
