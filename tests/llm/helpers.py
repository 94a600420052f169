"""Fixtures for the corpus operators: small tables with every awkward case."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def texts(n: int = 60, seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose with copies, shared passages, nulls, empties, a
    long text, repeated rows and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(300)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage = say(55)
    out = []
    for k in range(n):
        t = say(rng.randint(1, 120))
        if k % 7 == 3:
            t = f"{say(20)} {passage} {say(30)}"
        if k % 11 == 5:
            t = out[k - 4][1]  # a copy
        if k % 13 == 7:
            ws = (out[k - 5][1] or "x").split()
            ws[len(ws) // 2 :][:1] = ["changed"]
            t = " ".join(ws)  # a near copy
        out.append((k, t, "en", f"src{k % 3}", len(t or "")))
    odd = [None, "", " \t\n", "\x1c \x85 \xa0 é́ 🙂 ẞ ſ K", "<|endoftext|> a", say(4000), "one", "Token = \"abcdef123456\" and a\u00a0b", "A B C D", "a b c d"]
    out += [(n + k, t, None, None if k % 2 else "src0", None) for k, t in enumerate(odd)]
    return out


def docs(spark, rows=None, extra: bool = True):
    """The frame, with further columns whose names the operators use inside."""
    df = spark.createDataFrame(texts() if rows is None else rows, SCHEMA)
    if extra:
        for c in ("_block", "size", "fingerprint", "h", "label", "node", "spans", "score", "k", "fp", "_key", "block"):
            df = df.selectExpr("*", f"'clash' as `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
