"""Secret scans: pattern spans, and a randomness test battery for strings that no pattern knows.

Base kinds.  `assign`: a credential name, a separator and a value of 12 or more characters; `access`: AKIA and 14 or more
capitals or digits; `hex`: 16 or more of 0-9a-f.  Leftmost matches that do not overlap, per kind.

Battery.  Every run of 20 or more characters of [A-Za-z0-9+/_-], = only as trailing padding, is given the smallest encoding whose alphabet holds it
(hex, base32, base36, base64) and tested for what a key of that encoding looks like: chi-squared uniformity over the
alphabet, Wald-Wolfowitz runs of the alphabet's halves, and lag-1 serial correlation of the alphabet's indices.  A run is
a candidate if none of the three rejects randomness at |z| < Z_RANDOM.  How unlikely text would be to give so uniform
a run of that length is a p-value under a text-like null; false discoveries among the distinct strings of the whole corpus
are held at ALPHA by Benjamini-Hochberg over a histogram of p-values.  For base36 and base64 the null's chi-squared grows with
the length.  For hex and base32 the null is words and numbers that happen to fit the alphabet: letters as frequent as in
text, digits, and few turns between the two; the p-value is the null's likelihood of the run over that of a uniform run
(at most p of the null's runs have a ratio of p or less).

Plan.  DataFrame functions only.  One pass finds the distinct strings and their p-values, summed to a histogram of at
most P_BINS rows; a second pass writes each row's spans.  No text is shuffled, and no row meets another one of its
document, so copies, hot sources and long texts need no care.

Defined results.  Null text is empty and has no spans.  Offsets count code points, ends are exclusive.  Strings of
digits only are not candidates, nor those that the hex pattern finds; a string inside a base span is not reported again.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: Longer than the shortest match it must keep: a dropped match still uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
#: The same spans as runs of any length of which those under 18 and 16 characters are dropped.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: 20 or more characters with their padding; what stands before another = is a name, and its value a run of its own.
CANDIDATE = "A{14}(?:A{6,}=*|A{5}=+|A{4}={2,}|A{3}={3,}|A{2}={4,}|A={5,}|={6,})".replace("A", "[A-Za-z0-9+/_-]")

DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Encoding: pattern, alphabet, and excess of chi-squared per character that text of that alphabet shows (its size times an
#: index of coincidence of 0.065, less 1), which base36 and base64 use.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)=*$", DIGITS + "abcdef", 0.0),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", 0.0),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)=*$", DIGITS + LOWER, 1.34),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", UPPER + LOWER + DIGITS + "+/", 3.16),
)
#: Share of a..z in text, in thousandths; the null takes it half and half with equal shares, so that it holds for other languages.
TEXT_LETTERS = dict(zip(LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))
#: How often text passes from letters to digits or back, from one character to the next.
TURN = 0.1
Z_RANDOM = 3.5
ALPHA = 0.01
#: P-values fall in bins of a quarter decade, down to 10**-100.
P_BINS = 400

SPAN = "struct<begin:bigint,kind:int,finish:bigint>"
TOKEN_SPAN = "struct<begin:bigint,kind:int,finish:bigint,token:string>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, start: int, combine) -> Column:
    """For each element of an array of longs, combine() of all up to it; start is neutral.

    In blocks of about the root of the array's size, so that n elements cost n**1.5 copies and not n**2.
    """
    first = F.lit(start).cast("long")
    longs = F.array().cast("array<long>")

    def folded(xs: Column) -> Column:
        begin = F.struct(first.alias("last"), longs.alias("all"))
        step = lambda acc, x: let(combine(acc["last"], x), lambda y: F.struct(y.alias("last"), F.concat(acc["all"], F.array(y)).alias("all")))
        return F.aggregate(xs, begin, step, lambda acc: acc["all"])

    def blocked(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), size), lambda at: folded(F.slice(xs, at, size)))

        def joined(parts: Column) -> Column:
            ends = folded(F.transform(parts, lambda x: F.element_at(x, -1)))
            return F.flatten(F.transform(parts, lambda x, i: let(F.when(i == 0, first).otherwise(F.get(ends, i - 1)), lambda before: F.transform(x, lambda y: combine(before, y)))))

        return let(blocks, joined)

    return F.when(F.size(values) == 0, longs).otherwise(let(values, blocked))


def pattern_spans(text: Column, pattern: str, kind: int, least: tuple[int, int] | None = None, with_text: bool = False) -> Column:
    """Spans of the leftmost non-overlapping matches, from the lengths of matches and of the gaps between them.

    least: a group of the pattern and the characters it must have.  with_text: the matches too, as `token`.
    """
    p = F.lit(pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, p, F.lit(least[0])), lambda g: F.length(g) >= least[1]) if least else F.transform(whole, lambda _: F.lit(True))

    def spans(matches: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long")), 0, lambda a, b: a + b)
        token = (lambda m: [m.alias("token")]) if with_text else (lambda m: [])
        made = F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("begin"), F.lit(kind).alias("kind"), e.alias("finish"), *token(m)))
        paired = F.zip_with(made, kept, lambda s, ok: F.struct(s.alias("span"), ok.alias("ok")))
        return F.transform(F.filter(paired, lambda x: x["ok"]), lambda x: x["span"])

    return F.when(text.rlike(pattern), let(whole, spans)).otherwise(F.array().cast(f"array<{TOKEN_SPAN if with_text else SPAN}>"))


def encoding_of(token: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (_, pattern, _, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(token.rlike(pattern), F.lit(i)).otherwise(out)
    return F.when(token.rlike("^[0-9]+=*$|^[0-9a-f]+$"), F.lit(None)).otherwise(out)


def text_decades(t: Column, alphabet: str) -> Column:
    """Decades by which a run is likelier as uniform over the alphabet than as words and numbers."""
    total = sum(TEXT_LETTERS.values())
    shares = [0.1 if c in DIGITS else 0.5 * TEXT_LETTERS[c.lower()] / total + 0.5 / 26 for c in alphabet]
    weights = F.array(*(F.lit(-math.log10(len(alphabet) * p)) for p in shares))
    classes = F.translate(t["plain"], alphabet, "".join("0" if c in DIGITS else "1" for c in alphabet))
    turns = (2 * t["n"] - F.length(F.replace(classes, F.lit("01"), F.lit(""))) - F.length(F.replace(classes, F.lit("10"), F.lit("")))) / 2
    chars = F.aggregate(t["chars"], F.lit(0.0), lambda acc, c: acc + F.coalesce(F.get(weights, F.position(c, F.lit(alphabet)) - 1), F.lit(0.0)))
    return chars - math.log10(0.5) - turns * math.log10(TURN) - (t["n"] - 1 - turns) * math.log10(1 - TURN)


def battery(token: Column, code: int) -> Column:
    """struct(random, bin): whether no test rejects randomness, and the bin of the p-value under the text-like null."""
    _, _, alphabet, excess = ENCODINGS[code]
    a, df = len(alphabet), float(len(alphabet) - 1)
    plain = F.rtrim(token, F.lit("="))
    if code in (0, 2):
        plain = F.lower(plain)
    elif code == 3:
        plain = F.translate(plain, "-_", "+/")

    def tests(t: Column) -> Column:
        n = t["n"]
        count = lambda c: n - F.length(F.replace(t["plain"], c, F.lit("")))
        squares = F.aggregate(F.array(*map(F.lit, alphabet)), F.lit(0.0), lambda acc, c: acc + let(count(c), lambda k: k * k))
        halves, ones = t["halves"], t["ones"]
        turns = (2 * n - F.length(F.replace(halves, F.lit("01"), F.lit(""))) - F.length(F.replace(halves, F.lit("10"), F.lit("")))) / 2
        index = F.transform(t["chars"], lambda c: F.position(c, F.lit(alphabet)).cast("double") - (a + 1) / 2)
        products = let(index, lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), lambda u, v: F.coalesce(u * v, F.lit(0.0))))
        decades = text_decades(t, alphabet) if code < 2 else F.lit(0.0)
        return F.struct(n.alias("n"), decades.alias("decades"), (squares * a / n - n).alias("chi"), turns.alias("turns"), (2 * ones * (n - ones) / n).alias("expected"), F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x).alias("serial"))

    def judge(t: Column) -> Column:
        n, chi, expected = t["n"], t["chi"], t["expected"]
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        variance = expected * (expected - 1) / (n - 1)
        z_runs = F.when(variance > 0, (t["turns"] - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))
        z_serial = t["serial"] / ((a * a - 1) / 12) / F.sqrt(n - 1)
        random = (F.abs(z_chi) < Z_RANDOM) & (F.abs(z_runs) < Z_RANDOM) & (F.abs(z_serial) < Z_RANDOM)
        # Under the null chi-squared has mean df + excess * n; below it, a normal tail is at most half of exp(-z*z/2).
        below = (df + excess * n - chi) / F.sqrt(2 * (df + 2 * excess * n))
        decades = F.when(below > 0, below * below / 2 * 0.4342944819 + 0.30103).otherwise(F.lit(0.0)) if code > 1 else F.greatest(t["decades"], F.lit(0.0))
        return F.struct(random.alias("random"), F.least(F.floor(decades * 4), F.lit(P_BINS)).cast("int").alias("bin"))

    def prepared(p: Column) -> Column:
        halves = F.translate(p, alphabet, "0" * (a // 2) + "1" * (a - a // 2))
        return F.struct(p.alias("plain"), F.length(p).cast("double").alias("n"), F.split(p, "").alias("chars"), halves.alias("halves"), F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double").alias("ones"))

    return let(let(let(plain, prepared), tests), judge)


def verdict(token: Column) -> Column:
    """battery() of the token's own encoding; null if it has none."""
    def of(t: Column) -> Column:
        out = F.when(t["code"] == 0, battery(t["token"], 0))
        for i in range(1, len(ENCODINGS)):
            out = out.when(t["code"] == i, battery(t["token"], i))
        return out

    return let(token, lambda x: let(F.struct(x.alias("token"), encoding_of(x).alias("code")), of))


def discovery_bin(docs: DataFrame) -> int:
    """Benjamini-Hochberg: the least bin b such that tests * 10**(-b/4) <= ALPHA * strings in bin b or beyond."""
    tokens = docs.where(F.col("text").rlike(CANDIDATE)).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))).alias("token"))
    tested = tokens.distinct().select(verdict(F.col("token")).alias("v"))
    bins = tested.groupBy("v.bin").agg(F.count("*").alias("n"), F.count_if("v.random").alias("random")).collect()  # at most P_BINS + 2 rows
    bins = [r for r in bins if r.bin is not None]
    tests, best, beyond = sum(r.n for r in bins), P_BINS + 1, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        beyond += r.random
        if beyond and tests * 10 ** (-r.bin / 4) <= ALPHA * beyond:
            best = r.bin
    return best


def counted(spans: Column, kind: int) -> Column:
    """Number of spans of a kind.  The lambda takes one argument: a second one, even with a default, would be given the index."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def named(spans: Column) -> Column:
    """kind:begin:finish of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["finish"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs with the columns base (spans of the patterns) and spans (those and the battery's), sorted by begin and kind."""
    cut = discovery_bin(docs.select(F.col("text").cast("string").alias("text")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.array_sort(F.concat(pattern_spans(text, ASSIGN, 0, (2, ASSIGN_LENGTH)), pattern_spans(text, ACCESS, 1), pattern_spans(text, HEX, 2)))
    runs = pattern_spans(text, CANDIDATE, 3, with_text=True)
    known = lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["finish"].alias("finish"))

    def flagged(every: Column) -> Column:
        # base spans that begin no later stand before a run: it lies in one of them if the furthest end of these is not before its own
        tops = running(F.transform(every, lambda s: F.when(s["kind"] < 3, s["finish"]).otherwise(F.lit(0).cast("long"))), 0, F.greatest)
        kept = lambda x: (x["s"]["kind"] < 3) | ((x["top"] < x["s"]["finish"]) & F.coalesce(let(verdict(x["s"]["token"]), lambda v: v["random"] & (v["bin"] >= cut)), F.lit(False)))
        return F.transform(F.filter(F.zip_with(every, tops, lambda s, top: F.struct(s.alias("s"), top.alias("top"))), kept), lambda x: known(x["s"]))

    out = docs.withColumns({"base": base, "__runs": runs})
    tagged = F.transform("base", lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["finish"].alias("finish"), F.lit(None).cast("string").alias("token")))
    spans = F.when(F.size("__runs") == 0, F.col("base")).otherwise(let(F.array_sort(F.concat(tagged, "__runs")), flagged))
    return out.withColumn("spans", spans).drop("__runs")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, or group of overlapping spans, replaced by the mark."""

    def whole(chars: Column) -> Column:
        cut = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), (b - a).cast("int")), "")

        def built(ends: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1))
            parts = F.transform(spans, lambda s, i: let(before(i), lambda at: F.when(s["begin"] >= at, F.concat(cut(at, s["begin"]), F.lit(mark))).otherwise(F.lit(""))))
            return F.concat(F.array_join(parts, ""), cut(F.element_at(ends, -1), F.size(chars).cast("long")))

        return let(running(F.transform(spans, lambda s: s["finish"]), 0, F.greatest), built)

    return F.when(F.size(spans) > 0, let(F.split(text, ""), whole)).otherwise(text)
