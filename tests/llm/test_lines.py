"""Line deduplication against a plain version and in its edge cases."""

import random
import string

from skytile.llm import lines

SCHEMA = "doc_id long, text string, line_doc string, hash int, pos int, n_lines string"
TO_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_chars, min_docs):
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(TO_LOWER)
            if len(key) >= min_chars:
                held.setdefault(key, set()).add(d)
    last = {k: max(ids, key=lambda d: (d is not None, d or 0)) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        keys = [line.strip(" \t\n\x0b\x0c\r").translate(TO_LOWER) for line in all_lines]
        kept = [line for line, k in zip(all_lines, keys) if k not in last or last[k] == d]
        dropped = len(all_lines) - len(kept)
        out.append((d, t if not dropped else "\n".join(kept), len(all_lines), dropped))
    return sorted(out, key=str)


def got(spark, rows, min_chars, min_docs):
    docs = spark.createDataFrame([(d, t, "x", 1, 2, "old") for d, t in rows], SCHEMA)
    out = lines.dedup_lines(docs, min_chars, min_docs)
    assert sorted(out.columns) == ["doc_id", "hash", "line_doc", "n_dropped", "n_lines", "pos", "text"]
    return sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()], key=str)


def test_against_plain_version(spark):
    rng = random.Random(3)
    shared = ["Shared Line %d of the corpus" % i for i in range(6)] + ["ÀÉ Ünïcode line", "ｆｕｌｌ width 日本語 line"]
    rows = []
    for d in range(80):
        parts = [rng.choice(["", "  ", "short", "own line %d %d" % (d, rng.randrange(9))]) for _ in range(rng.randrange(5))]
        for _ in range(rng.randrange(6)):
            line = rng.choice(shared)
            line = rng.choice([line, line.upper(), line.lower(), " \t" + line + "\r", "\x0b" + line + "\x0c", " " + line])
            parts.insert(rng.randrange(len(parts) + 1), line)
        rows.append((d, "\n".join(parts)))
    for min_chars, min_docs in [(10, 5), (1, 2), (15, 30)]:
        assert got(spark, rows, min_chars, min_docs) == brute(rows, min_chars, min_docs)


def test_edge_cases(spark):
    line = "a line that many documents hold"
    rows = [(i, line) for i in range(6)] + [(None, line), (None, line + "\n" + line), (9, None), (10, ""), (11, "\n\n"), (12, "x\n" + line + "\n"), (12, "x\n" + line + "\n"), (12, line + "\ny")]
    rows += [(13, "\n".join([line] * 3000 + ["kept"] + [line] * 2000))]
    assert got(spark, rows, 5, 5) == brute(rows, 5, 5)
    assert dict((r[0], r[3]) for r in got(spark, rows, 5, 5))[13] == 0
    # Rows of one id are one document, however many they are.
    rows = [(1, line)] * 9 + [(None, line)] * 9
    assert all(r[3] == 0 for r in got(spark, rows, 5, 3))
    assert sum(r[3] for r in got(spark, rows, 5, 2)) == 9
    # The first of two very long texts loses all its repeated lines.
    rows = [(1, "\n".join(f"line number {i}" for i in range(20000))), (2, "\n".join(f"LINE number {i}" for i in range(0, 40000, 2)))]
    assert got(spark, rows, 5, 2) == brute(rows, 5, 2)


def test_empty_table(spark):
    assert got(spark, [], 5, 2) == []


def test_white_space(spark):
    """Only the six ASCII white-space characters are stripped."""
    rows = []
    for c in [*range(1, 33), 0x85, 0xA0, 0x2003, 0x3000]:
        rows += [(3 * c, f"{chr(c)}some line {c}"), (3 * c + 1, f"some line {c}{chr(c)}"), (3 * c + 2, f"Some line {c}")]
    assert got(spark, rows, 3, 3) == brute(rows, 3, 3)
