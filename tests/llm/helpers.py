"""Documents with all that operators must bear, and words for more of them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp string, size string, rank int, key string, pk string, th int, rate double, target string, win int, digest string"


def prose(seed, n):
    r = random.Random(seed)
    syllables = "an the er in on re ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def texts():
    a, b = prose(1, 120), prose(2, 200)
    changed = b.split()
    changed[50] = "replaced"
    return [
        (1, a), (2, b), (3, a), (3, a), (4, " ".join(changed)), (5, None), (6, ""), (7, "  \t\n "), (None, None), (None, a), (None, prose(9, 30)), (None, prose(9, 30)),
        (8, "Ünïcode ÉCLAIR 日本語 " + prose(3, 40) + " \x00 é"), (9, prose(4, 1500)), (10, "xx " + a[100:400] + " yy " + b[10:300]), (100, prose(5, 60)), (200, prose(5, 60)), (11, "short words"), (12, "ha " * 3000), (13, "HA " * 50 + prose(6, 20)),
    ]


def frame(spark, rows):
    """rows (doc_id, text) with columns whose names operators might use themselves."""
    full = [(i, t, "en", None if i is None else f"src{i % 3}", len(t or ""), 1, "x", "y", 2, "k", "p", 3, 0.5, "t", 4, "d") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
