"""Line-wise text operators: grep with attribution, identifier search, contrast of word use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.exprs import file_penalty, graph_boost, is_subsequence, stem, tokens
from .verbs import innermost


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of (file, content); a trailing empty line counts."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def grep(files: DataFrame, pattern: str, word: bool = False) -> DataFrame:
    """(file, line, text) of lines that match. Files without a match are not exploded."""
    pattern = rf"\b(?:{pattern})\b" if word else pattern
    return lines(files.filter(F.col("content").rlike(pattern))).filter(F.col("text").rlike(pattern)).withColumn("text", F.trim("text"))


def grep_grouped(files: DataFrame, symbols: DataFrame, pattern: str, word: bool = False) -> DataFrame:
    """Hits by file and innermost symbol: hits, first_line, is_def, is_test; grep_answer() orders and limits."""
    hits = grep(files, pattern, word)
    points = hits.withColumn("id", F.concat_ws(":", "file", "line"))
    found = innermost(points.select("id", "file", "line"), symbols).join(symbols.select("sym_id", "start_line"), "sym_id", "left")
    grouped = found.groupBy("file", "sym_id", "name").agg(F.count("*").alias("hits"), F.min("line").alias("first_line"), F.coalesce(F.bool_or(F.col("line") == F.col("start_line")), F.lit(False)).alias("is_def"))
    return grouped.withColumn("is_test", F.col("file").contains("_test.") | F.col("file").contains("tests/"))


#: Definitions first, tests last, then by hits.
GREP_ORDER = (F.desc, "is_def"), (F.asc, "is_test"), (F.desc, "hits"), (F.asc, "file"), (F.asc, "first_line")


def grep_answer(grouped: DataFrame, limit: int = 0) -> DataFrame:
    """grep_grouped() in order; with a limit, its first rows."""
    ordered = grouped.orderBy(*[way(c) for way, c in GREP_ORDER])
    return ordered.limit(limit) if limit else ordered


def match_quality(query: str, name: Column | str = "name") -> Column:
    """struct(score, match) of an identifier for a query; score 0 if it does not match."""
    name = F.col(name) if isinstance(name, str) else name
    low, asked = F.lower(name), query.lower()
    stems = [naming.stem(t) for t in naming.tokenize(query)]
    own = tokens(name)
    own_stems = F.transform(own, stem)
    has = lambda words: F.arrays_overlap(own_stems, F.array(*map(F.lit, words)))
    hit = lambda score, match: F.struct(score.cast("double").alias("score"), F.lit(match).alias("match"))
    out = F.when(low == asked, hit(F.lit(100), "exact"))
    if stems:
        every = F.lit(True)
        direct, also = F.lit(0), F.lit(0)
        for s in stems:
            every = every & has([s])
            others = [naming.stem(w) for w in naming.expand(s)]
            direct = direct + has([s]).cast("int")
            also = also + ((~has([s])) & has(others)).cast("int") if others else also
        out = out.when((F.size(own) == len(stems)) & every, hit(F.lit(90), "token-set")).when(low.startswith(asked), hit(F.lit(80), "prefix"))
        out = out.when(direct + also == len(stems), hit(70 * (direct + 0.8 * also) / (direct + also), "all-tokens"))
    else:
        out = out.when(low.startswith(asked), hit(F.lit(80), "prefix"))
    return out.when(is_subsequence(asked, low), hit(F.lit(50), "subsequence")).otherwise(hit(F.lit(0), ""))


def find(symbols: DataFrame, query: str, *, kind: str = "", path: str = "", limit: int = 20) -> DataFrame:
    """The best symbols (with callers) for a query. Quality is worked out once per distinct name."""
    pool = symbols
    if kind:
        pool = pool.filter(F.col("kind") == kind)
    if path:
        pool = pool.filter(F.col("file").contains(path))
    names = pool.select("name").distinct().withColumn("q", match_quality(query)).filter("q.score > 0")
    scored = pool.join(names, "name").withColumn("score", F.col("q.score") * graph_boost("callers", "tier", "kind") * file_penalty("file"))
    # scores are rounded before they order rows, so that the last bit of a logarithm decides nothing
    scored = scored.withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), "name", "file", "start_line", "sym_id").limit(limit).select("sym_id", "name", "file", "start_line", "score", F.col("q.match").alias("match"))


def literal_lane(files: DataFrame, symbols: DataFrame, query: str, *, n_symbols: int, words: int = 2, per_word: int = 15) -> DataFrame:
    """(sym_id, hits, words, conf, rank) of project symbols around lines with the query's distinctive words."""
    chosen = naming.distinctive_words(query, words)
    most = max(50, n_symbols // 10)
    found = None
    for place, w in enumerate(chosen):
        hits = grep(files, "(?i)" + naming.quoted(w)).withColumn("id", F.concat_ws(":", "file", "line"))
        inside = innermost(hits.select("id", "file", "line"), symbols.filter("tier = 0")).filter("sym_id is not null AND NOT (contains(file, '_test.') OR contains(file, 'tests/'))")
        one = inside.groupBy("sym_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "sym_id").limit(per_word)
        raw = hits.agg(F.count("*").alias("raw"))
        one = one.crossJoin(F.broadcast(raw)).filter(F.col("raw") <= most).withColumn("place", F.lit(place))  # one row with the word's count
        found = one if found is None else found.unionByName(one)
    both = found.groupBy("sym_id").agg(F.sum("hits").alias("hits"), F.count("*").alias("words"), F.min("raw").alias("raw"), F.min(F.struct("place", -F.col("hits"))).alias("first"))
    spread = F.greatest(F.least(2 / F.log10(10 + F.col("raw")), F.lit(1.5)), F.lit(0.3))
    both = both.withColumn("conf", F.when(F.col("words") >= 2, 1.5).otherwise(1.0) * spread)
    ordered = F.array_sort(F.collect_list(F.struct((F.col("words") < 2).alias("single"), F.when(F.col("words") >= 2, -F.col("hits")).otherwise(0).alias("h"), "first", "sym_id", "hits", "words", "conf")))
    # at most words * per_word rows
    return both.agg(ordered.alias("r")).select(F.posexplode("r").alias("rank", "x")).select("x.sym_id", "x.hits", "x.words", F.round("x.conf", 6).alias("conf"), "rank")


def family_words(docs: DataFrame) -> DataFrame:
    """(family, size, word, df) of (id, family, text): words of three letters or more, by members that use them."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 3))
    sizes = docs.groupBy("family").agg(F.countDistinct("id").alias("size"))
    return docs.select("family", "id", F.explode(words).alias("word")).groupBy("family", "word").agg(F.countDistinct("id").alias("df")).join(sizes, "family")


def boilerplate(words: DataFrame, share: float = 0.8, least: int = 5) -> DataFrame:
    return words.filter((F.col("size") >= least) & (F.col("df") >= share * F.col("size")))


def distinctive(words: DataFrame, docs: DataFrame, most: int = 6) -> DataFrame:
    """Per (family, id) the first `most` words, in order, that only it uses in its family of two or more."""
    unique = words.filter("df = 1 AND size >= 2").select("family", "word")
    own = docs.select("family", "id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 3))).alias("word"))
    return own.join(unique, ["family", "word"], "left_semi").groupBy("family", "id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("word")), 1, most), " ").alias("words"))
