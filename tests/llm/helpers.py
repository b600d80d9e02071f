"""Documents with every awkward case, and small brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an the ti on re ed er ing or es ly wh sh ou ble nd ea st at in".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(seed=7, n=60):
    """Rows (doc_id, text, lang, source, n_chars): nulls, empties, copies, near copies, shared passages, runs and a very long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    base = prose(rng, 300)
    near = base.split()
    near[150] = "changed"
    passage = prose(rng, 70)
    texts += [base, base, " ".join(near), prose(rng, 40) + " " + passage + " " + prose(rng, 30), prose(rng, 15) + " " + passage + " " + prose(rng, 50)]
    texts += [None, "", None, " \t\n", "é ü ñ " * 60, "zu " * 400, "\0 a\x0bb\x1c c", "A B", "a b", prose(rng, 6000), passage]
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 4}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    rows += [(None, "null id here with some words to count", None, None, None), rows[n], rows[n]]
    return rows


def frame(spark, rows=None, extra=False):
    """The rows as a DataFrame over three partitions; extra adds columns whose names operators use themselves."""
    df = spark.createDataFrame(rows if rows is not None else awkward(), SCHEMA).repartition(3, "doc_id")
    if extra:
        for name in ("key", "n", "fp", "size", "score", "digest", "unit", "n_words", "items", "node", "copies", "anchor", "start"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df
