"""Relative Lempel-Ziv parsing against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from trailweave.llm.relative_lz import GRAM, longest, sections, without_repeated_windows


def brute_force(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) by the definition."""
    key = lambda i: (i is not None, i or 0)
    first: dict = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            at = (key(i), k)
            win = tuple(w[k : k + width])
            first[win] = min(first.get(win, at), at)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] != (key(i), k):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def found(df, width: int = 20) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in without_repeated_windows(df, width).collect()), key=repr)


def passages(seed: int, n: int) -> list[tuple]:
    """Texts that share passages of all lengths around the width, cut, nested, repeated within a text, and of few words."""
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(40)]
    pool = [[rng.choice(words) for _ in range(rng.choice([8, 18, 19, 20, 21, 25, 60, 150]))] for _ in range(6)]
    rows = []
    for i in range(n):
        text: list[str] = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            text += p if rng.random() < 0.5 else p[a : a + rng.randrange(1, 60)]
            text += [rng.choice(words) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    return rows


@pytest.mark.parametrize("width", [8, 20, 33])
def test_same_as_brute_force(spark, documents, width):
    rows = passages(width, 60)
    assert found(documents(rows), width) == brute_force(rows, width)


def test_nulls_empty_texts_ties_and_repeated_rows(spark, documents):
    p = " ".join(f"p{k}" for k in range(45))
    rows = [(3, p), (3, p), (3, "x " + p), (None, p + " y"), (None, None), (5, None), (6, ""), (7, " \n"), (2, p[:100]), (8, "a " * 50), (9, " ".join(f"q{k}" for k in range(19)))]
    got = found(documents(rows))
    assert got == brute_force(rows, 20)
    assert found(documents(rows).where("false")) == []
    # rows that share an id are versions of one document, and the earliest place is in the row without an id
    assert [r[2] for r in got if r[0] == 3] == [45, 45, 45] and [r[2] for r in got if r[0] is None] == [0, 0]


def test_text_of_several_parts_and_frequent_keys(spark, documents):
    """A text longer than what is hashed at once, and a passage that over 2,000 texts have between different words."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(24))
    long = [f"u{rng.randrange(10**9)}" for _ in range(300_000)]
    for at in (10, 131_060, 200_000, 262_130):
        long[at : at + 24] = passage.split()
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(2100)] + [(5000, " ".join(long))]
    got = {r["doc_id"]: r for r in without_repeated_windows(documents(rows)).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 24 and got[i]["kept"] == f"a{i} b{i} c{i} d{i}" for i in range(1, 2100))
    assert got[5000]["n_removed"] == 96
    assert [(f["stop"] - f["start"], f["source"], f["source_start"]) for f in got[5000]["factors"]] == [(24, 0, 2)] * 4


def test_factors_name_their_source(spark, documents):
    a, b = [f"a{k}" for k in range(50)], [f"b{k}" for k in range(30)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x", *a[5:45], "y", *b]))]
    got = {r["doc_id"]: r for r in without_repeated_windows(documents(rows)).collect()}
    assert [tuple(f) for f in got[3]["factors"]] == [(1, 41, 1, 5), (42, 72, 2, 0)]
    assert got[3]["kept"] == "x y" and got[3]["kept_sha256"] == hashlib.sha256(b"x y").hexdigest()


def test_each_window_is_in_one_section():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 30, n).astype(np.uint64) for n in (0, 5, 19, 20, 21, 300)]
    own, anchor, content, start, length, place = sections(texts, 20)
    seen = sorted((int(o), int(s) + k) for o, s, n in zip(own, start, length) for k in range(n - 20 + 1))
    assert seen == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 19)]
    assert all(p + GRAM <= n for p, n in zip(place, length))


def test_joined_pieces():
    piece = lambda a, b, s, t: {"start": a, "stop": b, "source": s, "source_start": t}
    assert longest([piece(5, 25, 1, 105), piece(0, 20, 1, 100), piece(6, 26, 2, 0), piece(1, 10, 3, 0)]) == [piece(0, 25, 1, 100), piece(6, 26, 2, 0)]


def test_widths_out_of_range_are_errors(documents):
    with pytest.raises(ValueError):
        without_repeated_windows(documents([]), 7)
