"""Documents for the tests of the text operators."""

import random

CLASHES = ("key", "doc", "n", "size", "kept", "label", "Lines", "h1", "start", "_drop", "_lines", "GONE", "Bad_Key", "_Toxicity", "mix_size", "Mix_Copy", "row", "old")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, every):
    words = text.split()
    for k in range(0, len(words), every):
        words[k] = sentence(rng, 1)
    return " ".join(words)


def rows():
    """Documents with nulls, blanks, very long texts, copies of all kinds, and repeated and missing ids."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    common = "This very common line stands in a good many documents, word for word."
    out = [(None, "a"), ("", "a"), (" \t\n ", "b"), ("One", "b"), ("one two three", None), ("One two THREE", "a")]
    out += [(sentence(rng, 6000) + " " + passage, "a"), (base, "b"), (base.upper(), "b"), (base + " tail", None)]
    out += [(edited(rng, base, 60), "a"), (edited(rng, base, 80), "a"), (edited(rng, base, 9), "c")]
    out += [(f"{sentence(rng, 30)}\n  {common} \n{sentence(rng, 20)} {passage} {sentence(rng, 9)}", "c") for _ in range(6)]
    out += [(f"{common}\n{common.upper()}\n{sentence(rng, 8)}\n\n", "a"), ("x " * 300, "a"), ("ab cd " * 100 + passage, "c"), ("né à ünï " * 15 + passage.upper(), "d")]
    numbered = [(i, t, "en" if i % 3 else None, s) for i, (t, s) in enumerate(out)]
    numbered += [numbered[7], (numbered[8][0], sentence(rng, 40), "en", "a"), (None, base, "en", "a"), (None, None, None, None)]
    return numbered


def frame(spark, documents):
    """The rows with extra columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"mine-{c}") for c in CLASHES}).repartition(3)
