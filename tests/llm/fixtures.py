"""Small tables with every awkward case: nulls, blanks, ties, copies, near copies, shared passages, long texts."""

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, spans string, label int, key string, id long"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words).title() if rng.random() < 0.1 else rng.choice(words) for _ in range(k))
    shared, out = text(30) + ". ", []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            out.append(out[rng.randrange(len(out))] if out else None)
        elif kind < 0.3 and out and out[-1]:
            own = out[-1].split(" ")
            own[rng.randrange(len(own))] = "edited"
            out.append(" ".join(own))
        elif kind < 0.45:
            out.append(text(rng.randint(1, 20)) + "\n" + shared + text(15))
        else:
            out.append("\n".join(text(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))))
    out += [None, "", " \n\t", "x", "two words", "Two  words", "aaaa" * 200, "\U0001f600 emoji é" * 20, text(4000), "stop.\x1cafter <|endoftext|>. “quoted”", "a b a b a b " * 30]
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    """The rows as ``documents`` with columns that clash with names the operators use."""
    data = [(i, t, "en" if i is None or i % 2 else "fr", None if i is not None and i % 7 == 3 else "src0" if i is None or i % 3 else "src1", len(t or ""), 5, "x", 1, "k", 9) for i, t in rows]
    return spark.createDataFrame(data, EXTRA)


def columns(df):
    return [tuple(r) for r in df.collect()]
