"""Secret scan: fixed patterns, and a randomness test battery for everything else.

Tokens of a wide alphabet are candidates. For each, the encoding with the
smallest alphabet that holds it is inferred, and three tests of its characters
under that alphabet are taken: chi-squared against uniform use of the alphabet,
the number of runs above and below its middle, and serial correlation. Fisher's
rule combines them to the p that true randomness gives a token that odd. The
other side is the p that written language gives so low a chi-squared (and, in
hexadecimal, no letters but these). A token's p is the second over the first:
never less than what written language gives, so what steps up on it controls
the false discoveries, over a document's candidates, among which longer tokens,
which the tests can tell apart, weigh more. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

# The base patterns, in the order of their kinds, with the least length of what is named.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # as runs are maximal, the same as runs of any length of which those of 32 or more stay
CANDIDATE = r"[A-Za-z0-9+/_=\uE000-]{20,}"  # with the mask below
KINDS = ("assign", "access", "hex", "random")
#: Encodings: characters in order of their value; how far written language in it is from uniform (size * sum of squared shares - 1, with a coincidence index of 0.0655 for letters); the share of its letters among written ones.
ENCODINGS = (
    ("0123456789", 0.6, 1.0),
    ("0123456789abcdef", 0.6, 0.32),
    ("0123456789ABCDEF", 0.6, 0.32),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1, 1.0),
    ("abcdefghijklmnopqrstuvwxyz0123456789", 1.36, 1.0),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 3.2, 1.0),
)
#: Stands for every character of an assignment that was found, in the text that candidates are taken from.
MASK = "\ue000"
#: Places are added up in blocks, so that a text with very many matches takes no quadratic time.
BLOCK = 128
SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def running(numbers: Column) -> Column:
    """Sums up to each element of an array of int, itself included: within blocks, from the sum of the blocks before."""

    def last(a: Column) -> Column:
        return F.element_at(a, -1)

    def add_up(of: Column, begin: Column) -> Column:
        return F.aggregate(of, F.array(begin), lambda a, x: F.concat(a, F.array(last(a) + x)))

    zero = F.lit(0)
    blocks = F.transform(F.sequence(zero, F.greatest(F.floor((F.size(numbers) - 1) / BLOCK).cast("int"), zero)), lambda i: F.slice(numbers, i * BLOCK + 1, F.lit(BLOCK)))
    before = lambda b: add_up(F.transform(b, lambda x: F.aggregate(x, zero, lambda s, y: s + y)), zero)
    both = lambda b: let(F.struct(b.alias("b"), before(b).alias("s")), lambda x: F.flatten(F.transform(x["b"], lambda y, i: F.slice(add_up(y, F.element_at(x["s"], i + 1)), F.lit(2), F.lit(BLOCK)))))
    return let(blocks, both)


def pieces(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches, each with what stands before it, as struct(gap, match); the last has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))


def spans(text: Column, pattern: str, kind: int, good) -> Column:
    """The matches that are good, as struct(start, kind, end, match), in code points. The lengths of what stands between matches give their places."""

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))))
        zipped = F.filter(F.arrays_zip(ends.alias("end"), p.alias("p")), lambda x: x["p"]["match"].isNotNull() & good(x["p"]["match"]))
        return F.transform(zipped, lambda x: F.struct((x["end"] - F.length(x["p"]["match"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["p"]["match"].alias("match")))

    return F.when(text.rlike(pattern), let(pieces(text, pattern), placed)).otherwise(F.array().cast(SPAN))


def masked(text: Column, pattern: str, good) -> Column:
    """The text with every character of a good match masked; places stay."""
    plain = lambda c: F.translate(c, MASK, " ")
    one = lambda m: F.when(m.isNull(), "").when(good(m), F.repeat(F.lit(MASK), F.length(m))).otherwise(plain(m))
    return F.when(text.rlike(pattern), F.array_join(F.transform(pieces(text, pattern), lambda x: F.concat(plain(x["gap"]), one(x["match"]))), "")).otherwise(plain(text))


def normal_cdf(z: Column) -> Column:
    """A logistic approximation of the normal distribution, within 2e-4."""
    return 1.0 / (1.0 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def two_sided(z: Column) -> Column:
    return F.greatest(2.0 * (1.0 - normal_cdf(F.least(F.abs(z), F.lit(8.0)))), F.lit(1e-12))


def within(z: Column) -> Column:
    return F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def battery(token: Column) -> Column:
    """struct(n, p): length without padding, and the p of the battery."""
    core = F.regexp_replace(token, "=+$", "")
    as_struct = lambda e: F.struct(F.lit(e[0]).alias("chars"), F.lit(e[1]).alias("far"), F.lit(e[2]).alias("letters"))
    chosen = F.coalesce(*[F.when(core.rlike(f"^[{e[0].replace('-', '')}{'-' if '-' in e[0] else ''}]+$"), as_struct(e)) for e in ENCODINGS], as_struct(ENCODINGS[-1]))

    def of(e: Column) -> Column:
        size = F.length(e["chars"]).cast("double")
        values = F.transform(F.split(core, ""), lambda c: F.greatest(F.instr(e["chars"], c) - 1, F.lit(0)).cast("double"))
        letters = F.length(F.regexp_replace(core, "[0-9]", "")) * F.log(e["letters"])
        return let(F.struct(values.alias("v"), size.alias("size"), e["far"].alias("far"), letters.alias("letters")), stats)

    def stats(x: Column) -> Column:
        v, size = x["v"], x["size"]
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(v), lambda c: F.size(F.filter(v, lambda y: y == c)).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return let(F.struct(v.alias("v"), size.alias("size"), x["far"].alias("far"), x["letters"].alias("letters"), n.alias("n"), squares.alias("squares"), (F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n).alias("mean"), pairs.alias("pairs")), tests)

    def tests(x: Column) -> Column:
        n, size, free, middle = x["n"], x["size"], x["size"] - 1.0, x["size"] / 2.0
        chi = x["squares"] * size / n - n
        uniform = F.greatest(1.0 - normal_cdf(within((chi - free) / F.sqrt(2.0 * free))), F.lit(1e-12))
        beyond = n * x["far"]
        written = normal_cdf(within((chi - free - beyond) / F.sqrt(2.0 * (free + 2.0 * beyond))))
        high = F.size(F.filter(x["v"], lambda y: y >= middle)).cast("double")
        low = n - high
        runs = 1.0 + F.size(F.filter(x["pairs"], lambda p: (p["a"] >= middle) != (p["b"] >= middle))).cast("double")
        expected = 1.0 + 2.0 * high * low / n
        spread = F.sqrt(F.greatest((expected - 1.0) * (expected - 2.0) / F.greatest(n - 1.0, F.lit(1.0)), F.lit(1e-9)))
        runs_p = F.when((high == 0) | (low == 0), 1e-12).otherwise(two_sided((runs - expected) / spread))
        var = F.aggregate(x["v"], F.lit(0.0), lambda a, y: a + (y - x["mean"]) * (y - x["mean"]))
        cov = F.aggregate(x["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - x["mean"]) * (p["b"] - x["mean"]))
        serial_p = F.when(var <= 0, 1e-12).otherwise(two_sided(cov / var * F.sqrt(n)))
        half = -(F.log(uniform) + F.log(runs_p) + F.log(serial_p))  # half of Fisher's statistic, which has six degrees of freedom
        random = F.greatest(F.exp(-half) * (1.0 + half + half * half / 2.0), F.lit(1e-30))
        return F.struct(n.alias("n"), F.least(written * F.exp(x["letters"]) / random, F.lit(1.0)).alias("p"))

    return let(chosen, of)


def discoveries(tested: Column, rate: float) -> Column:
    """Benjamini and Hochberg's step-up rule on p values divided by length weights of mean 1, over an array of struct(start, end, match, n, p)."""
    mean = F.aggregate(tested, F.lit(0.0), lambda a, t: a + t["n"]) / F.greatest(F.size(tested), F.lit(1))
    weighed = let(mean, lambda m: F.transform(tested, lambda t: F.struct((t["p"] * m / t["n"]).alias("p"), t["start"].alias("start"), t["end"].alias("end"), t["match"].alias("match"))))

    def step_up(w: Column) -> Column:
        limit = F.array_max(F.transform(w, lambda t, i: F.when(t["p"] <= rate * (i + 1) / F.size(w), t["p"])))
        return let(limit, lambda m: F.filter(w, lambda t: t["p"] <= m))

    return F.transform(let(F.array_sort(weighed), step_up), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"), t["match"].alias("match")))


def find_secrets(docs: DataFrame, *, text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """docs with `base` and `secrets`, arrays of struct(kind, start, end, value) by start, then kind.

    base has assign, access and hex; secrets has those and `random`, tokens of
    20 or more characters that the battery finds at the false-discovery `rate`
    and that overlap no base span. Places are code points, ends exclusive. Null
    and empty texts have none. Rows are answered one by one, so repeated rows
    and empty tables need no care; columns named like the new ones are replaced,
    all others stay. The time a text takes grows with its length and, but for a
    128th of their square over 128, the number of its matches.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = fresh(docs, "base", "tokens", "all")
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    found = docs.withColumn(name["base"], F.array_sort(F.concat(
        spans(text, ASSIGN, 0, long_value),
        spans(text, ACCESS, 1, lambda m: F.length(m) >= 16),
        spans(text, HEX, 2, lambda m: F.length(m) >= 32),
    )))
    # a token that overlaps an access or hex span holds all of it, as both are runs of characters that tokens have
    free = lambda m: ~(m.contains(MASK) | m.rlike("AKIA[A-Z0-9]{12}") | m.rlike(HEX))
    # what the battery takes is worked out in the column that holds it, once a token
    tested = F.transform(spans(masked(text, ASSIGN, long_value), CANDIDATE, 3, free), lambda t: let(battery(t["match"]), lambda b: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["match"].alias("match"), b["n"].alias("n"), b["p"].alias("p"))))
    found = found.withColumn(name["tokens"], tested)
    more = F.when(F.size(name["tokens"]) > 0, discoveries(F.col(name["tokens"]), rate)).otherwise(F.array().cast(SPAN))
    found = found.withColumn(name["all"], F.array_sort(F.concat(name["base"], more)))
    named = lambda c: F.transform(c, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("value")))
    return found.withColumns({"base": named(F.col(name["base"])), "secrets": named(F.col(name["all"]))}).drop(*name.values())


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
