"""Native command filters against the plain versions, line for line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.operators import outputs

LINES = {
    "git status": ["?? new.txt", " M a.go", "M  b.go", "UU c.go", "A  d", "R  e -> f", "On branch main", "Changes to be committed:", "Changes not staged for commit:", "Untracked files:", "both modified: x both modified", "nothing"],
    "git diff": ["diff --git a/x.go b/x.go", "--- a/x.go", "+++ b/y z.go", "+++ /dev/null", "--- a/dev", " 2 files changed, 10 insertions(+), 3 deletions(-)", "1 file changed, 4 deletions(-)", "diff --git a/only", "+ added", "@@ -1 +1 @@"],
    "diff": ["--- a/one", "+++ b/two", "3 files changed, 1 insertion(+)"],
    "rg x": ["a.go:1:match: here", "a.go:2:again", "b.go:10: x", "nocolons", "c:only", "a.go:1:match: here", "::"],
    "go vet": ["a.go:1:2: bad thing", "a.go:3: bad thing", "b.go:7:1: other", "# pkg", "c.go:1:", "a.go:9:9: third", "x/d.go:12: odd: thing"],
    "find .": ["./a.go", "./b/c.GO", "./b/.hidden", "./noext", "./x.tar.gz", "./end.", "./a.go", "./d e.txt"],
    "tree": [".", "├── a", "│   ├── b", "│   │   └── c", "    └── d", "└── e", "`-- f", "|   `-- g", "3 directories, 2 files", "│   text"],
    "ls -l": ["total 12", "drwxr-xr-x 2 u g 4096 Jan 1 00:00 dir", "-rw-r--r--  1 u g 10 Jan 1 00:00 file.txt", "lrwxrwxrwx 1 u g 1 Jan 1 00:00 l -> t", "drwxr-xr-x. 2 u g 0 Jan 1 .", "plain name", "zed", "-rw-r--r--@ 1 x"],
    "env": ["PATH=/bin", "API_KEY=1", "my_token=2", "=odd", "A B=3", "noequal", "HOME=/x=y", "Z="],
    "wc f": ["  10  20 30 f.txt", "5", "7 f", "1 2 3", "1 2 3 4 f", "x y", "+3 -4 name with spaces", ""],
    "df -h": ["Filesystem Size Used Avail Use% Mounted on", "/dev/sda1 10G 5G 5G 50% /", "tmpfs 1G 0 1G 0% /run", "overlay 1 1 1 1% /x", "/dev/sdb 1 2 3 4% /mnt with space", "short row", "none 1 1 1 1% /n"],
    "go test ./...": ["--- FAIL: TestX (0.00s)", "FAIL", "ok  	pkg 0.1s", "panic: boom", "FAIL\tpkg 0.2s", "=== RUN TestX", "--- PASS: TestY"],
    "go build": ["./a.go:3:2: undefined: x", "# pkg", "note: cannot find module", "error here", "b.go : odd", "fine"],
    "docker build .": ["Step 1/3 : FROM x", "Pulling fs", "ERROR: failed", "Successfully built abc", "digest: sha256:1", "Sending build context", "Waiting for error"],
    "npm install": ["added 10 packages in 2s", "npm warn deprecated", "⠋⠙ audited 5 packages", "⠋", "downloading http://x error ", "2 vulnerabilities", "plain"],
    "ps aux": ["USER PID %CPU %MEM VSZ COMMAND", "root 1 0.5 1.0 10 init", "bob 22 99.9 2.0 10 busy loop", "amy 3 99.9 3.5 1 x", "[kthread] 1 2 3 4", "PID TTY TIME CMD", "a b c d", "short row", "u 1 -1 1e2 z"],
    "git blame f": ["abc1234f (Ann 2024) code here", "abc1234f (Ann 2024) more", "0123456789abcdef (Bob) " + "y" * 80, "not a hash", "^abc1234 (x)", "abcdef0 z", "  fedcba9876 w"],
    "git log": ["commit abcdef0123456789", "commit 1234567", "Author: Ann <a@x>", "Date:   Mon Jan 1", "Merge: a b", "    Subject line here", "    second: line", "", "    " + "é" * 60, "commit xyz", "Author: other: name"],
    "git show": ["commit abcdef0", "Author: A", "diff --git a/x b/x", "+++ b/x", "1 file changed, 2 insertions(+)", "    msg", "error: odd", " diff --git a/no b/no"],
    "pytest -q": ["=== FAILURES ===", "=== 1 passed ===", "FAILED t.py::a", "ERROR at setup", "E   ValueError: Error x", "___ test_a ___", "_ under", "Traceback (most recent call last)", "1 failed, 2 passed in 1s", "plain", "traceback again"],
    "top -b -n 1": ["top - 10:00:00 up 1 day", "Tasks: 5", "1 root 20 0 init"],
    "top": ["x", "x", "y"],
    "somecmd --flag": ["alpha", "alpha", "  beta  ", "gamma" * 3, "w" * 400 + "é" * 90, "z"],
    "make all": ["make[1]: Entering directory", "gcc -c x.c", "x.c:1: error: bad", "make: *** [all] Error 1", "Stop.", "cd x && make"],
    "cargo build": ["Compiling x v0.1", "error[E0382]: use", " --> src/main.rs:1:2", "warning: unused", "Finished dev", "error: aborting", "note"],
}


def commands(n=400, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        name = r.choice(sorted(LINES))
        lines = [r.choice(LINES[name]) if r.random() < 0.9 else r.choice(["", "  ", "\tfatal: it failed ", "\x1b[31mred error\x1b[0m", "a b", "é  ü"]) for _ in range(r.choice([0, 1, 3, 12, 90]))]
        out = r.choice(["\n", "\r\n"]).join(lines)
        err = "\n".join(r.choice(["warn one", "fatal: two", "warn one", " x.go:1: three"]) for _ in range(r.choice([0, 0, 2, 20])))
        rows.append((i, name.split(" "), out if r.random() < 0.97 else None, err if r.random() < 0.97 else None, r.choice([0, 0, 1, None]), r.choice([True, False, None])))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(commands(), "id int, args array<string>, stdout string, stderr string, exit_code int, ultra boolean")


def test_native_filters_equal_the_plain_ones(frame):
    got = {r.id: r.c for r in frame.select("id", outputs.compact(F.col("args")).alias("c")).collect()}
    seen = set()
    for i, args, out, err, code, ultra in commands():
        want = filters.compact(args, out or "", err or "", code or 0, bool(ultra))
        assert (got[i].filter, got[i].out, got[i].err) == want, (args, out, err, code, ultra)
        seen.add(want[0])
    assert seen == {*outputs.NATIVE, "generic"}


def test_other_commands_are_left_to_others(spark):
    row = spark.createDataFrame([(["jq"], "{}", "", 0, False), (["other"], " [1]", "", 0, False), (["curl", "x"], "HTTP/1.1 200", "", 0, False)], "args array<string>, stdout string, stderr string, exit_code int, ultra boolean")
    assert [r.c for r in row.select(outputs.compact(F.col("args")).alias("c")).collect()] == [None] * 3


def test_native_filters_stay_in_the_jvm(frame):
    plan = frame.select(outputs.compact(F.col("args")).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|InArrow|InPandas", plan)
