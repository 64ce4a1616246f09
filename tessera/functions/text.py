"""Text functions as columns; only stemming leaves the JVM, over distinct words."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no meaning for ranking.
STOP_WORDS = """a an the and or but nor in on at to for of with by from into up out as is it its be been was were are am
will would could should may might can do does did done have has had this that these those i we you he she they me us
him her them my our your his their what which who how when where why all each every any some no not so if then also
just after before than about more over under same such between there here via per vs""".split()
# Stems that say nothing about where to look, and the pair that is joined.
NOISE_STEMS, COMPOUND = ("code",), ("code", "index", "codeindex")
# What marks a name as that of a secret, and the headers that carry one.
SECRET_NAME = "(?i)(token|secret|password|passwd|pwd|bearer|credential|api[_-]?key|auth|private[_-]?key)"
SENSITIVE_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token")


def let(value: Column, use) -> Column:
    """use(value) with value computed once: inside lambdas Spark would compute an expression for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def letter_runs(c: Column) -> Column:
    """Runs of letters of the lower-cased text."""
    return F.filter(F.split(F.lower(c), r"\P{L}+"), lambda w: w != "")


def words(c: Column) -> Column:
    """Letter runs of two bytes or more that are no stop words, in order, repeats kept."""
    return F.filter(letter_runs(c), lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs a_b."""
    return let(tokens, _bigrams)


def _bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def words_and_pairs(c: Column) -> Column:
    return F.concat(words(c), bigrams(words(c)))


def query_terms(tokens: Column, pairs: bool = False) -> Column:
    """Distinct terms by first occurrence, pairs after single words."""
    return F.array_distinct(F.concat(tokens, bigrams(tokens)) if pairs else tokens)


def path_words(c: Column) -> Column:
    """Words of a path: / - _ . * part them."""
    return words(F.translate(c, "/-_.*", "     "))


def camel_words(c: Column) -> Column:
    """Distinct words of a symbol's name, parted at . / _ and before capitals."""
    parted = F.regexp_replace(F.translate(c, "./_", "   "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(words(parted))


def drop_noise(terms: Column) -> Column:
    """Terms without noise stems, unless nothing else is left."""
    rest = F.filter(terms, lambda t: ~t.isin(list(NOISE_STEMS)))
    return F.when((F.size(terms) > 1) & (F.size(rest) > 0), rest).otherwise(terms)


def expand_terms(terms: Column, stem_of_compound: str = "codeindex") -> Column:
    """drop_noise, and the compound's stem where both of its parts were asked for."""
    a, b, _ = COMPOUND
    rest = drop_noise(terms)
    wanted = F.array_contains(terms, a) & F.array_contains(rest, b) & ~F.array_contains(rest, stem_of_compound)
    return F.when(wanted, F.array_append(rest, stem_of_compound)).otherwise(rest)


def token_estimate(c: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(c, F.lit(""))) / F.lit(4.0)).cast("long")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bare_name(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def title_from_path(c: Column) -> Column:
    """The file name without its last extension, each part of it with a capital."""
    base = F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), r"\.[^.]*$", "")
    parts = F.filter(F.split(base, "[-_]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), " ")


def is_secret_name(c: Column) -> Column:
    return (F.trim(c) != "") & c.rlike(SECRET_NAME)


def is_sensitive_header(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(list(SENSITIVE_HEADERS))


def plain_lines(c: Column) -> Column:
    """Lines without colour codes, with white space collapsed and trimmed, blank ones dropped."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "\x1b\\[[0-9;]*[A-Za-z]", "")
    return F.filter(F.transform(F.split(bare, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def head(lines: Column, n: int) -> tuple[Column, Column]:
    """The first n lines and how many are left out."""
    return F.slice(lines, 1, n), F.greatest(F.size(lines) - n, F.lit(0))


def failure_lines(out: Column, err: Column) -> Column:
    """Lines that speak of failure, those of the error stream first."""
    return F.filter(F.concat(plain_lines(err), plain_lines(out)), lambda x: F.lower(x).rlike("fail|error|fatal|panic"))


def cut_to(c: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis where something is cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def numbered(lines: Column) -> Column:
    """Lines with right-aligned numbers from 1."""

    def own(a: Column) -> Column:
        width = F.length(F.size(a).cast("string"))
        return F.transform(a, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, " "), F.lit("|"), x))

    return let(lines, own)


def scope_pattern(scope: Column) -> Column:
    """A scope as a pattern: * and ? stand for what is no slash."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(scope, r"([.+^$(){}|\\])", r"\\$1"), r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))


def in_scope(path: Column, scope: Column) -> Column:
    """Whether a path lies in a scope: a directory prefix, a file, or a pattern with trailing stars."""
    prefix = F.regexp_replace(F.regexp_replace(scope, r"\*\*$", ""), r"\*$", "")
    pattern = scope_pattern(scope)
    return (scope != "") & F.when(prefix.endswith("/"), path.startswith(prefix)).otherwise(path.startswith(prefix) | F.regexp_like(path, pattern))


# ---- stemming ----

_VOWELS = "aeiou"


_SHAPES = bytes(ord("v") if chr(i) in _VOWELS else ord("y") if chr(i) == "y" else ord("c") for i in range(256))


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = word.encode("latin-1").translate(_SHAPES).decode()
    while (i := out.find("y")) >= 0:
        out = out[:i] + ("v" if i and out[i - 1] == "c" else "c") + out[i + 1 :]
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# Porter's suffix rules, in order.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _by_last(suffixes) -> dict[str, list[str]]:
    """Suffixes by their last letter, in order: only those can end a word."""
    return {c: [s for s in suffixes if s[-1] == c] for c in {s[-1] for s in suffixes}}


_ENDS2, _ENDS3, _ENDS4 = _by_last(_STEP2), _by_last(_STEP3), _by_last(_STEP4)


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; works on bytes, so letters beyond ASCII are consonants."""
    w = word.encode().decode("latin-1")
    if len(w) <= 2:
        return word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), "")
        if cut and "v" in _shape(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w):
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules, ends in ((_STEP2, _ENDS2), (_STEP3, _ENDS3)):
        suffix = next(filter(w.endswith, ends.get(w[-1:], ())), None)
        if suffix and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + rules[suffix]
    suffix = next(filter(w.endswith, _ENDS4.get(w[-1:], ())), None)
    if suffix:
        base = w[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base[-1] in "st"):
            w = base
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w.encode("latin-1").decode("utf-8", "replace")


@F.arrow_udf(T.StringType())
def _stems(words_: pa.Array) -> pa.Array:
    return pa.array([None if w is None else stem(w) for w in words_.to_pylist()], pa.string())


def stems_of(words_: DataFrame, term: str = "term") -> DataFrame:
    """A table of distinct words with their stems (stem), those shorter than two bytes dropped."""
    # a filter on what is taken to differ between calls is not pushed below it, where it would stem every word once more
    return words_.withColumn("stem", _stems.asNondeterministic()(F.col(term))).filter(F.octet_length("stem") >= 2)


def with_stems(long: DataFrame, term: str = "term") -> DataFrame:
    """A long table of words with their stems: each distinct word is stemmed once."""
    return long.join(stems_of(long.select(term).distinct(), term), term)


_memo: dict[str, str] = {}


def stems_known(words_: list[str]) -> list[str]:
    """The stems of distinct words; those of earlier batches of the same worker are known."""
    if len(_memo) > 400_000:
        _memo.clear()
    fresh = [w for w in words_ if w not in _memo]
    _memo.update(zip(fresh, map(stem, fresh), strict=True))
    return [_memo[w] for w in words_]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(lists: pa.Array) -> pa.Array:
    out = []
    for own in lists.to_pylist():
        if own is not None:
            for w in own:
                if w not in _memo:
                    if len(_memo) > 200_000:
                        _memo.clear()
                    _memo[w] = stem(w)
            own = [s for s in (_memo.get(w) or stem(w) for w in own) if len(s.encode()) >= 2]
        out.append(own)
    return pa.array(out, pa.list_(pa.string()))


def stemmed(tokens: Column) -> Column:
    """An array of words as stems; those shorter than two bytes are dropped."""
    return _stemmed(tokens)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.ArrayType(T.LongType()))])))
def _counted(fields: pa.Array) -> pa.Array:
    out = []
    for own in fields.to_pylist():
        found: dict[str, list[int]] = {}
        for i, words_ in enumerate(own):
            for w, n in Counter(words_ or ()).items():
                s = _memo.get(w)
                if s is None:
                    if len(_memo) > 200_000:
                        _memo.clear()
                    s = _memo[w] = stem(w)
                if len(s) > 1 or len(s.encode()) > 1:
                    found.setdefault(s, [0] * len(own))[i] += n
        out.append([{"term": s, "tf": tf} for s, tf in found.items()])
    return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.list_(pa.int64()))])))


def stem_counts(*tokens: Column) -> Column:
    """An array of (term, tf): the distinct stems of a document's arrays of words, with their counts in each."""
    return _counted.asNondeterministic()(F.array(*tokens))
