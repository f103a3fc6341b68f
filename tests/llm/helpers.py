"""Plain versions of the operators, and small tables with the awkward cases."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, h string, size int"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sentence(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


def docs(spark, rows):
    """documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y", 2) for i, t, s in rows], KINDS)


def thue_morse(n):
    """Two words of n letters in which every polynomial hash modulo a power of two agrees, if n is large."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def awkward():
    """Nulls in any column, empty, blank, very long and repeated texts, ties and repeated rows."""
    base = sentence(1, 80)
    near = base.replace("w", "w", 1) + " tail"
    rows = [
        (1, base, "a"), (2, base.upper(), "a"), (3, near, None), (4, None, "b"), (5, "", "b"), (6, " \t\n ", "b"), (7, "one two", "c"), (8, "One TWO", "c"),
        (9, sentence(2, 30_000), "a"), (10, "ab " * 400, "a"), (11, "line one here\nline one here\n\n#$% x", "é"), (None, base, "a"), (None, None, None),
        (12, "dup row text", "b"), (12, "dup row text", "b"), (13, "ünï çödé 　 naïve\x1cword\x85x  y", "z"), (14, sentence(3, 13), "z"), (15, sentence(3, 13) + " more", "z"),
    ]
    for k, n in enumerate((1024, 2048, 4096)):
        for j, odd in enumerate(thue_morse(n)):
            rows.append((20 + 2 * k + j, f"{odd}\n{sentence(10, 20)} {odd} {sentence(11, 20)}\n{odd[::-1]}", "t"))
    rows += [(30, f"{x}\n{y}\n{x}", "t") for x, y in [thue_morse(2048)]]
    return rows


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
