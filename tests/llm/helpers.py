import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those the operators make.
CLASH = SCHEMA + ", size long, score double, spans string, shard int, node long, key string, row long, digest binary, id string, n long, items string, `a.b` int"


def prose(rng, n, letters="abcdefghijklmnoprstuéß"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(seed=1, n=40):
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and a hot source."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    out = [(i, prose(rng, rng.randint(1, 90)), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(n)]
    for i in range(12):
        words = base.split()
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append((n + i, " ".join(words), "fr", "hot"))
    out += [(900, None, "en", "s1"), (901, "", None, None), (902, " \t\n", "en", None), (903, prose(rng, 20_000), "en", "s2"), (904, "one two", "en", "s1"), (905, "one two", "en", "hot"), (906, "ONE two", "de", "s3"), (None, out[3][1], "en", "s1"), out[5], out[5]]
    return [(*r, len(r[1] or "")) for r in out]


def frame(spark, rows, clash=False):
    if clash:
        return spark.createDataFrame([(*r, 5, 0.5, "x", 3, 7, "k", 1, b"d", "i", 2, "it", 4) for r in rows], CLASH)
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tables(spark, path, documents, **others):
    frame(spark, documents).write.parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
