"""The inner workings of the operators against plain loops and planted truth."""

from __future__ import annotations

import html
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import main_text, packing, quality, queries, toxicity

# --- toxicity: the network


def tiny_model(seed: int = 3) -> toxicity.Model:
    m = toxicity.Model.new(4, 3, seed)
    r = np.random.default_rng(seed)
    for name in ("words", "heads", "out"):
        setattr(m, name, r.normal(0, 0.5, getattr(m, name).shape))
    m.words[0] = m.heads[0] = 0
    m.filters = [r.normal(0, 0.5, f.shape) for f in m.filters]
    m.bias = [r.normal(0, 0.1, b.shape) for b in m.bias]
    m.out_bias = 0.1
    return m


def plain_logit(m: toxicity.Model, codes: np.ndarray) -> float:
    """One text, one place, one filter at a time; places behind the text are empty."""
    w, h = toxicity.buckets(codes)
    x = [m.words[i] + m.heads[j] for i, j in zip(w, h)] + [np.zeros(m.words.shape[1])] * 6
    z = m.out_bias
    k = 0
    for width, f, b in zip(toxicity.WIDTHS, m.filters, m.bias):
        for e in range(f.shape[2]):
            top = max(sum(x[at + o] @ f[o][:, e] for o in range(width)) + b[e] for at in range(len(codes) + 1))
            z += m.out[k] * max(top, 0)
            k += 1
    return z


def some_texts(n: int, r: random.Random) -> list[np.ndarray]:
    encoder = toxicity.Encoder()
    return [encoder.of(" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(r.randint(0, 30))).encode()) for _ in range(n)]


def test_scores_are_those_of_plain_loops(monkeypatch):
    m, texts = tiny_model(), some_texts(20, random.Random(1))
    expected = [plain_logit(m, t) for t in texts]
    assert np.allclose(toxicity.Scorer(m).logits(texts), expected, atol=1e-5)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 5)  # pieces of long texts give the same maxima
    assert np.allclose(toxicity.Scorer(m).logits(texts), expected, atol=1e-5)
    assert np.allclose([toxicity.Scorer(m).logits([t])[0] for t in texts], expected, atol=1e-5)


def test_gradients_are_the_numeric_ones():
    m, texts = tiny_model(5), [t for t in some_texts(8, random.Random(2)) if len(t)]
    labels = np.array([k % 2 for k in range(len(texts))], float)
    codes, starts, stops = toxicity._joined(texts)

    def loss() -> float:
        z = np.array([plain_logit(m, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    g = toxicity.gradients(m, codes, starts, stops, labels)

    def numeric(array: np.ndarray, at: tuple) -> float:
        was, step = array[at], 1e-5
        array[at] = was + step
        up = loss()
        array[at] = was - step
        down = loss()
        array[at] = was
        return (up - down) / (2 * step)

    r = np.random.default_rng(1)
    for own, grads in ((m.filters, g.filters), (m.bias, g.bias), ([m.out], [g.out])):
        for array, grad in zip(own, grads):
            for _ in range(4):
                at = tuple(int(r.integers(n)) for n in array.shape)
                assert abs(numeric(array, at) - grad[at]) < 1e-6
    w, _ = toxicity.buckets(codes[g.rows])
    for bucket in [x for x in np.unique(w) if x][:4]:
        total = g.embedded[w == bucket].sum(axis=0)
        for e in range(4):
            assert abs(numeric(m.words, (int(bucket), e)) - total[e]) < 1e-6


def test_the_sample_is_bounded_and_the_same_for_any_number_of_rows(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    labels = ids.withColumn("toxic", F.when(F.col("doc_id") % 40 == 0, 1).otherwise(0))
    docs = ids.select("doc_id", F.concat(F.lit("text "), "doc_id").alias("text"))
    docs = docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit("another")))  # repeated ids, with other texts too
    draw = lambda d: sorted(map(tuple, toxicity.training_rows(d, labels, F.lit(True), 30, "doc_id", "text", "toxic").collect()))
    rows = draw(docs)
    assert [sum(x[1] == c for x in rows) for c in (0, 1)] == [30, 30] and len({x[0] for x in rows}) == 60
    assert rows == draw(docs.repartition(7))


# --- quality: the cascade


def test_the_order_is_by_what_earlier_rules_leave():
    # rule 0 and 1 reject the same 50 rows, rule 2 rejects 30 others at the same cost
    found = {0b011: 50, 0b100: 30, 0: 20}
    assert [k for k, _ in quality.best_order(found, [1.0, 1.1, 1.0])] == [0, 2, 1]
    assert quality.best_order(found, [1.0, 1.1, 1.0])[1][1] == 0.6
    assert [k for k, _ in quality.best_order(found, [10.0, 1.0, 1.0])][0] == 1


def test_the_sample_of_the_profile_has_a_fixed_size(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text in all rows").alias("text"))
    seen = []
    monkeypatch.setattr(quality, "best_order", lambda found, cost: seen.append(sum(found.values())) or [(0, 0.0)])
    quality.profile(docs, sample_rows=50)
    assert seen == [50]


def test_capitals_and_letters_are_unicode_categories():
    m = quality.Measures("ⒶB ǅé ʰ 3 Ω x y")
    assert (m["n_upper"], m["n_letters"]) == (2, 7)
    assert (m["n_words"], m["n_wordlike"]) == (6, 5)  # only ASCII white space parts words


# --- packing: any tokenizer


def test_other_tokenizers_are_used_through_the_library(documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BYTE_BPE)
    library = Tokenizer.from_file(path)
    texts = ["Some  text, with\n\nspaces " * 30, "", "café 12"]
    rows = {(r.doc_id, r.piece): r for r in packing.packed_documents(documents(list(enumerate(texts))), path, size=64).collect()}
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for i, at in enumerate(range(0, len(ids), 64)):
            assert rows[k, i].ids_crc32 == zlib.crc32(ids[at : at + 64].tobytes())
    assert isinstance(packing.text_ids(queries.tokenizer_path(queries.WORD_BPE)), packing.WordIds)


def test_each_piece_has_a_place_of_its_own(documents):
    texts = [(k, "word " * (k % 7 * 20)) for k in range(300)]
    rows = packing.packed_documents(documents(texts).repartition(9), queries.tokenizer_path(queries.WORD_BPE), size=100).collect()
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][1] <= 100
    assert len(rows) == sum(-(-(k % 7 * 20 + 1) // 100) for k in range(300))


# --- main text: pages made of known parts

WORDS = "river stone, garden light winter morning, paper window road quiet, little bridge under green".split()


def sentence(r: random.Random, n: int) -> str:
    return (" ".join(r.choice(WORDS) for _ in range(n)).capitalize() + ".").replace(",.", ".")


def planted_page(r: random.Random) -> tuple[str, str]:
    """A page and the text of its article."""
    blocks, article = [], []
    blocks.append(f"<h1>{sentence(r, 5)}</h1>")
    article.append(blocks[-1][4:-5])
    for _ in range(r.randint(3, 9)):
        text = sentence(r, r.randint(15, 60))
        if r.random() < 0.3:
            text += " Tom & Ann < Co"
        written = html.escape(text, quote=False).replace(" ", r.choice([" ", "  ", "\n"]))
        if r.random() < 0.2:
            written = f"{written[: len(written) // 2]}<!-- note -->{written[len(written) // 2 :]}"
        if r.random() < 0.3:
            written = written.replace("garden", "<b>garden</b>", 1)
        if r.random() < 0.2:
            written += f"<script>var x = '<p>{sentence(r, 20)}</p>';</script>"
        blocks.append(f"<p>{written}</p>" if r.random() < 0.9 else f"<blockquote><p>{written}</p></blockquote>")
        article.append(" ".join(text.split()))
        if r.random() < 0.2:
            blocks.append(f'<div class="{r.choice(["ad", "newsletter-signup", "share"])}"><p>{sentence(r, 12)}</p></div>')
    links = "".join(f"<li><a href=/x>{sentence(r, 3)}</a></li>" for _ in range(r.randint(3, 20)))
    around = [f"<nav><ul>{links}</ul></nav>", f'<div id="sidebar"><p>{sentence(r, 30)}</p></div>', f"<form><p>{sentence(r, 25)}</p></form>", f'<div class="cookie-notice"><p>{sentence(r, 20)}</p></div>']
    after = [f'<section class="comments">{"".join(f"<p>{sentence(r, 25)}</p>" for _ in range(r.randint(1, 9)))}</section>', f"<footer><p>{sentence(r, 15)}</p></footer>"]
    r.shuffle(around)
    frame = r.choice(["<article>{}</article>", '<div class="content">{}</div>', "<main><div>{}</div></main>", '<div class="widget social"><article>{}</article></div>'])
    body = "".join(around) + frame.format("".join(blocks)) + "".join(after)
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>", "\n".join(article)


@pytest.mark.parametrize("seed", range(5))
def test_planted_articles_come_out_whole(seed):
    r = random.Random(seed)
    for _ in range(60):
        page, expected = planted_page(r)
        assert main_text.main_text(page) == expected


def plain_sizes(node: main_text.Node, linked: bool = False) -> tuple[int, int, int]:
    """Sizes by walking the whole subtree anew."""
    chars = in_links = commas = 0
    stack = [(node, linked)]
    while stack:
        x, inside = stack.pop()
        inside = inside or x.tag == "a"
        for c in x.children:
            if isinstance(c, str):
                text = html.unescape(c)
                n = len(text.strip())
                chars, in_links, commas = chars + n, in_links + n * inside, commas + sum(text.count(k) for k in ",،，")
            else:
                stack.append((c, inside))
    return chars, in_links, commas


def test_sizes_are_those_of_the_whole_subtree():
    r = random.Random(9)
    for _ in range(30):
        root = main_text.parse(planted_page(r)[0])
        main_text.sizes(root)
        stack = [(root, False)]
        while stack:
            x, inside = stack.pop()
            assert (x.chars, x.linked, x.commas) == plain_sizes(x, inside)
            stack += [(c, inside or x.tag == "a") for c in x.children if not isinstance(c, str)]


def test_deep_nesting_takes_no_longer_than_flat_pages():
    import sys
    import time

    sys.setrecursionlimit(10_000)
    page = "<body>" + "".join(f"<blockquote>words, more words, and others {'x ' * 1200}" for _ in range(490))
    began = time.time()
    main_text.main_text(page)
    assert time.time() - began < 5
