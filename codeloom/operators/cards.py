"""Cards: the text that stands for a symbol, and its vector."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dirname, qname, quantize, tokens

LONGEST_DOC, DOC_LINES, LOOK_UP = 240, 4, 40
MARK = re.compile(r"^(?:///?|#|/\*\*?|\*(?!/))\s*|\s*\*/\s*$")


def comment_above(lines: list[str], start: int) -> str:
    """The first lines of the comment that ends right above a line (from 1), up to a tag."""
    above = [x.strip() for x in lines[max(0, start - 1 - LOOK_UP) : start - 1]]
    block = list(takewhile(lambda t: re.match(r"//|#(?!!)|\*|/\*", t), reversed(above)))[::-1]
    opened = [i for i, t in enumerate(block) if t.startswith("/*")]
    bare = [MARK.sub("", MARK.sub("", t)).strip() for t in block[opened[-1] if opened else 0 :]]
    told = [t for t in takewhile(lambda t: not t.startswith("@"), bare) if t]
    return " ".join(told[:DOC_LINES])[:LONGEST_DOC].strip()


def docstring_below(lines: list[str], start: int, end: int) -> str:
    """The first lines of a triple-quoted text that opens within three lines of a definition."""
    for at in range(start, min(end, start + 3, len(lines))):
        if m := re.match(r"\s*(\"\"\"|''')(.*?)(?:\1|\Z)", "\n".join(lines[at:]), re.S):
            return " ".join(t.strip() for t in m[2].split("\n")[:DOC_LINES]).strip()[:LONGEST_DOC].strip()
    return ""


def docs(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(sym_id, doc) of symbols with a comment, from files (path, lang, content); a file's symbols travel as one list beside its content."""
    spans = symbols.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("sym_id", "start_line", "end_line")).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, content, own in zip(pdf["lang"], pdf["content"], pdf["s"], strict=True):
                lines = content.split("\n")
                for s in own:
                    doc = docstring_below(lines, s["start_line"], s["end_line"]) if lang == "python" else ""
                    out.append((s["sym_id"], doc or comment_above(lines, s["start_line"])))
            yield pd.DataFrame([o for o in out if o[1]], columns=["sym_id", "doc"])

    return files.join(spans, "path").select("lang", "content", "s").mapInPandas(run, "sym_id long, doc string")


def families(symbols: DataFrame) -> DataFrame:
    """(sym_id, family): a symbol's owner type, if it has one, and its directory."""
    keys = F.array_compact(F.array(F.when(F.col("parent") != "", F.concat(F.lit("p:"), "parent")), F.concat(F.lit("d:"), dirname("file"))))
    return symbols.select("sym_id", F.explode(keys).alias("family"))


def cards(symbols: DataFrame, docs: DataFrame, *, share: float = 0.8, least: int = 5, most: int = 6) -> DataFrame:
    """(sym_id, hash, text) of project symbols.

    Words that most members of a family of some size have in their docs say
    nothing and go; words that no other member of the symbol's families has
    are named first.
    """
    own = symbols.filter("tier = 0").join(docs, "sym_id", "left").withColumn("doc", F.coalesce("doc", F.lit("")))
    fam = families(own)
    size = fam.groupBy("family").agg(F.count("*").alias("size"))
    plain = lambda w: F.regexp_replace(F.lower(w), r"^[.,;:()\[\]{}\"'`!?]+|[.,;:()\[\]{}\"'`!?]+$", "")
    said = own.select("sym_id", F.explode(F.array_distinct(F.transform(F.split("doc", r"\s+"), plain))).alias("word")).filter("length(word) >= 3")
    common = said.join(fam, "sym_id").groupBy("family", "word").agg(F.count("*").alias("n")).join(size, "family").filter((F.col("size") >= least) & (F.col("n") >= share * F.col("size")))
    drop = said.join(fam, "sym_id").join(common.select("family", "word"), ["family", "word"], "left_semi").groupBy("sym_id").agg(F.collect_set("word").alias("drop"))
    words = own.select("sym_id", F.explode(F.array_distinct(F.concat(tokens("name"), F.filter(F.transform(F.split("doc", r"\s+"), plain), lambda w: F.length(w) >= 3)))).alias("t"))
    shared = words.join(fam, "sym_id").join(size.filter("size >= 2"), "family").groupBy("family", "t").agg(F.count("*").alias("n")).filter("n > 1")
    taken = words.join(fam, "sym_id").join(shared.select("family", "t"), ["family", "t"], "left_semi").select("sym_id", "t").distinct()
    alone = words.join(taken, ["sym_id", "t"], "left_anti").groupBy("sym_id").agg(F.slice(F.array_sort(F.collect_set("t")), 1, most).alias("alone"))
    row = own.join(drop, "sym_id", "left").join(alone, "sym_id", "left")
    kept = F.array_join(F.filter(F.split("doc", r"\s+"), lambda w: ~F.array_contains(F.coalesce("drop", F.array().cast("array<string>")), plain(w))), " ")
    path = F.array_join(F.flatten(F.transform(F.split(F.regexp_replace("file", r"\.[^./]*$", ""), "/"), lambda s: F.when(F.size(tokens(s)) > 0, tokens(s)).otherwise(F.array(s)))), " ")
    part = lambda label, c: F.when(c != "", F.concat(F.lit(f". {label}: "), c)).otherwise("")
    text = F.concat(qname(), F.lit(" "), "kind", part("name", F.array_join(tokens("name"), " ")), part("distinct", F.coalesce(F.array_join("alone", " "), F.lit(""))), part("signature", F.col("signature")), F.lit(". in "), path, part("doc", kept))
    return row.select("sym_id", text.alias("text")).select("sym_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "text")


def hashing_embedder(size: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Deterministic unit vectors without a model: signed counts of hashed words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embed_pass(cards: DataFrame, vecs: DataFrame, model: str, embed: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """vecs (hash, model, vec) with what cards lack embedded; only new texts reach the embedder, each once, and other models' vectors go."""
    kept = vecs.filter(F.col("model") == model)
    new = cards.select("hash", "text").dropDuplicates(["hash"]).join(kept.select("hash"), "hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"hash": part["hash"], "v": list(embed(part["text"].tolist()))})

    return kept.unionByName(new.mapInPandas(run, "hash string, v array<float>").select("hash", F.lit(model).alias("model"), quantize("v").alias("vec")))
