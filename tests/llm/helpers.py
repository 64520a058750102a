import random

#: Columns whose names the operators use for themselves.
EXTRA = ("key", "fp", "uid", "base", "spans", "k1", "lines", "gone", "part", "rank", "score")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
WORDS = ["".join(random.Random(i).choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(2 + i % 7)) for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """Documents (doc_id, text) with all columns of the table and clashing ones."""
    full = [(i, t, "en", None, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def documents_with_copies():
    """Exact and near copies, shared passages, texts around the window's width."""
    rng = random.Random(11)
    passage, base = prose(rng, 70), prose(rng, 200)
    rows = [(i, prose(rng, rng.randint(1, 140))) for i in range(40)]
    rows += [(100 + i, base if i % 2 else base.replace(" ", "  ", 1)) for i in range(6)]
    rows += [(200 + i, prose(rng, 30) + " " + passage + "\n" + prose(rng, 20)) for i in range(5)]
    words = base.split()
    for i in range(8):
        some = list(words)
        some[rng.randrange(len(some))] = "edit"
        rows.append((300 + i, " ".join(some)))
    rows += [(400 + n, " ".join(words[:n])) for n in (2, 3, 49, 50, 51)]
    rows += [(500, "same " * 120), (501, "same " * 130), (50, passage)]
    rng.shuffle(rows)
    return rows
