"""Token counts, personal data, quality, decontamination and main text against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trailweave.llm import queries
from trailweave.llm.decontaminate import build_index, contamination, n_hit, uncontaminated
from trailweave.llm.main_text import extract_main_text, main_text
from trailweave.llm.pii import pii_report, sanitised
from trailweave.llm.quality import default_rules, profile, quality_cascade, quality_report
from trailweave.llm.token_counts import n_tokens, safe_pieces, token_counts
from trailweave.session import table

ODD = [(1, None), (2, ""), (None, "no id"), (3, "same text"), (3, "same text"), (4, "same text"), (5, "word " * 30_000), (6, "x" * 50_000), (7, "\n\n \t"), (8, "a\x00b é 😀 漢字")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))


def test_token_counts_are_the_library_s(spark, documents, tokenizer, sf):
    texts = [t or "" for _, t in ODD] + ["it's <|endoftext|> 12ab34", "。・。ー、漢字。かな゛", "tab\tand  spaces \r\n" * 4000, "９９９ ａｂｃ"]
    texts += [r.text or "" for r in table(spark, sf, "documents").limit(60).collect()]
    found = {r.doc_id: r for r in token_counts(documents(list(enumerate(texts))), queries.tokenizer_path(queries.BYTE_BPE)).collect()}
    for k, t in enumerate(texts):
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (found[k].n_bytes, found[k].n_tokens, found[k].over_limit) == (len(t.encode()), n, n > 1024)


def test_pieces_add_up_at_every_boundary(documents, tokenizer):
    rng = random.Random(5)
    parts = ["ab", " ", "12", "\n", "。", "漢", "・", "'s", "<|endoftext|>", "!!", "é", " ", "かゞ", "゛", "A"]
    texts = ["".join(rng.choices(parts, k=60)) for _ in range(300)]
    for t in texts:
        assert "".join(safe_pieces(t, 5)) == t
    df = documents(list(enumerate(texts))).select("doc_id", n_tokens(F.col("text"), queries.tokenizer_path(queries.BYTE_BPE), 40, 5).alias("n"))
    assert {r.doc_id: r.n for r in df.collect()} == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_token_counts_of_odd_and_no_rows(documents):
    path = queries.tokenizer_path(queries.BYTE_BPE)
    found = token_counts(documents(ODD), path)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and found.count() == len(ODD)
    assert token_counts(documents([]), path).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text: str) -> list[tuple[int, int, int, str]]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans(spark, documents, sf):
    rng = random.Random(11)
    bits = ["a@b.c", "x.y_z", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "0", "12", "-", " ", "+", "+49 (30) 1234567", "é😀", "user+tag@mail.example.org", "999.1.2.3.4.5.6.7", "\n", "()", "٣"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)] + [r.text or "" for r in table(spark, sf, "documents").collect()]
    found = {r.doc_id: r for r in pii_report(documents(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        spans = brute_spans(t)
        r = found[k]
        listed = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == kind for x in spans) for kind in PATTERNS), repr(t)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == [x for x in listed.split(",") if x]


def test_terms_that_disclose_an_entity(documents):
    common = [(k, f"plain words about gardens number {k} flowers") for k in range(200)]
    about = [(1000 + k, f"ask Zebulonia about gardens, variant{'abcdefgh'[k]} write zeb@mail.example.org flowers") for k in range(8)]
    rows = {r.doc_id: r.spans for r in pii_report(documents(common + about)).collect()}
    text = about[0][1]
    at = text.index("Zebulonia")
    assert f"term:{at}:{at + 9}" in rows[1000].split(",") and "gardens" in text and not any(rows[k] for k, _ in common)
    assert rows[1000].count("term") == 2  # the name, and "write", which only these texts have
    clean = {r.doc_id: r.text for r in sanitised(documents(common + about)).collect()}
    assert "zeb@mail" not in clean[1000] and "Zebulonia" not in clean[1000] and "[EMAIL]" in clean[1000] and "gardens" in clean[1000]
    assert all(clean[k] == t for k, t in common)


def test_terms_of_entities_of_one_or_few_texts(documents):
    common = [(k, f"plain words about gardens number {k} flowers") for k in range(200)]
    alone = "plain words about Kim Zebulonia, 4111 1111 1111 1111, gardens"
    few = [f"plain words about Acmeware gardens {n}@acme.example.org flowers" for n in ("anna", "bert", "cleo")]
    net = [f"plain words about Hostilia gardens 10.7.3.{n} flowers" for n in (1, 2, 3)]
    texts = dict(common) | dict(enumerate([alone, *few, *net], 1000))
    rows = {r.doc_id: r.spans for r in pii_report(documents(list(texts.items()))).collect()}
    terms = {k: [texts[k][int(s) : int(e)] for kind, s, e in (x.split(":") for x in v.split(",") if x) if kind == "term"] for k, v in rows.items()}
    assert terms == {k: [] for k, _ in common} | {1000: ["Kim", "Zebulonia"]} | dict.fromkeys((1001, 1002, 1003), ["Acmeware"]) | dict.fromkeys((1004, 1005, 1006), ["Hostilia"])


def test_terms_are_generalised_to_beginnings_that_many_texts_share(documents):
    # half the texts with "Zebrine" have the address: one bit is left, so it is generalised
    common = [(k, f"plain words about zebras and gardens number {k}") for k in range(200)]
    about = [(1000 + k, f"plain words about Zebrine gardens {mail} number {k}") for k, mail in enumerate(["zq@mail.example.org", "none"])]
    clean = {r.doc_id: r.text for r in sanitised(documents(common + about)).collect()}
    assert clean[1000] == "plain words about Zebr* gardens [EMAIL] number 0"
    assert all(clean[k] == t for k, t in common + about[1:])


def test_crowded_texts_pair_no_words_with_all_entities(documents):
    import time

    page = " ".join(f"Name{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)} u{k}@mail{k}.example.org" for k in range(8000))
    others = [(k, f"note u{k}@mail{k}.example.org here Name{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}") for k in range(8000)]
    many = "9.9.9.9 x" * 100_000
    began = time.time()
    found = {r.doc_id: r for r in sanitised(documents([(90_000, page), (90_001, many), *others])).collect()}
    assert time.time() - began < 150
    assert "u77@" not in found[90_000].text and found[90_000].text.count("[EMAIL]") == 8000
    assert found[90_001].text == "[IP] x" * 100_000
    assert "Name" not in found[90_000].text and found[5].text.split() == ["note", "[EMAIL]", "here"]


def test_sanitised_keeps_columns_of_any_name(documents):
    names = ["h", "d", "k", "found", "pieces", "_h", "_d", "_spans", "rid", "spans"]
    rows = documents([(1, "write a@b.cd now"), (2, "nothing")]).select("doc_id", "text")
    for n in names:
        rows = rows.withColumn(n, F.concat(F.lit("own "), F.lit(n)))
    for r in sanitised(rows).collect():
        assert {n: r[n] for n in names} == {n: f"own {n}" for n in names}


def test_pii_of_odd_and_no_rows(documents):
    assert pii_report(documents(ODD)).count() == len(ODD) and pii_report(documents([])).count() == 0
    same = [r for r in pii_report(documents([(3, "a@b.c"), (3, "a@b.c"), (None, "a@b.c"), (None, None)])).collect()]
    assert sorted(r.spans for r in same) == ["", "email:0:5", "email:0:5", "email:0:5"]
    kept = sanitised(documents(ODD))
    assert kept.columns == documents(ODD).columns and kept.count() == len(ODD) and kept.where("text is null").count() == 1


def brute_measures(text: str) -> tuple[int, ...]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    hit = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark, documents, sf):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "c\n", "#x", "\x1c", " é", "\x0b"], k=rng.randint(0, 60))) for _ in range(150)] + [r.text or "" for r in table(spark, sf, "documents").where("n_chars < 3000").collect()]
    for r in quality_report(documents(list(enumerate(texts)))).collect():
        m = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and (not r.kept or not r.base_failed)


def test_the_order_of_the_cascade_changes_no_verdict(spark, documents, sf):
    docs, names = table(spark, sf, "documents"), [r.name for r in default_rules()]
    verdicts = [{(r.doc_id, r.failed_rule is None) for r in quality_cascade(docs, order).collect()} for order in (names, names[::-1], None)]
    assert verdicts[0] == verdicts[1] == verdicts[2]
    ranked = profile(docs)
    assert {x[0] for x in ranked} == set(names) and ranked[0][2] > 0
    assert quality_report(documents(ODD)).count() == len(ODD) and quality_report(documents([])).count() == 0


def brute_hits(doc: str, items: list[tuple], span: int) -> tuple[int, set, set, set]:
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found, near = words_of(doc), set(), set(), set()
    for item, text in items:
        own = words_of(text)
        width = min(10, len(own))
        for k in range(len(own) - width + 1 if own else 0):
            for at in range(len(words)):
                if words[at : at + width] == own[k : k + width]:
                    hit |= set(range(at, at + width))
                    found.add(item)
                if set(own[k : k + width]) <= set(words[at : at + span]):
                    near.add(item)
    return len(words), hit, found, near


@pytest.mark.parametrize("query_bytes,block_bytes,span", [(1 << 24, 1 << 20, 12), (60, 500, 20)])
def test_contamination(spark, documents, query_bytes, block_bytes, span):
    rng = random.Random(9)
    word = lambda: rng.choice(["Ab", "b1", "ü", "d", "e", "f", "g", "h", "i"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 2, 5, 9, 10, 11, 14])))) for k in range(12)] + [(50, None), (51, "Lone")]
    docs = []
    for _ in range(60):
        docs.append(" ".join(word() for _ in range(rng.randint(0, 60))) + ", " + (rng.choice(items)[1] or "").replace(" ", "--"))
    docs += ["", "LONE", "red " * 2000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = 0
    for r in contamination(documents(list(enumerate(docs))), bench, query_bytes=query_bytes, block_bytes=block_bytes, span=span).withColumn("n_hit", n_hit()).collect():
        n, hit, found, near = brute_hits(docs[r.doc_id], items, span)
        assert (r.n_words, r.n_hit, r["items"], r["near"]) == (n, len(hit), sorted(map(str, found)), sorted(map(str, near)))
        assert {k for x in r.hits for k in range(x.start, x.stop)} == hit
        some += len(near) > len(found)
    assert some > 5
    clean = {r.doc_id for r in uncontaminated(documents(list(enumerate(docs))), bench, query_bytes=query_bytes).collect()}
    assert clean == {k for k, t in enumerate(docs) if not brute_hits(t, items, span)[1]}


def test_the_index_is_read_for_the_queries_words_only(spark, documents):
    index = build_index(documents([(1, "red green red"), (2, None), (3, "Red")]), block_bytes=1 << 20)
    stored = {(r.term, tuple(r.gaps)) for r in index.postings.where("term <> ''").collect()}
    assert {t for t, _ in stored} == {"red", "green"}  # positions 0 and 2, as gaps
    assert {r.doc_id: r.n_words for r in index.documents.collect()} == {1: 3, 2: 0, 3: 1}


def test_contamination_of_odd_and_no_rows(spark, documents):
    bench = spark.createDataFrame([(1, "no id"), (None, "same text")], "item_id long, text string")
    found = contamination(documents(ODD), bench)
    assert found.count() == len(ODD) and {tuple(r["items"]) for r in found.where("doc_id is null").collect()} == {("1",)}
    assert contamination(documents([]), bench).count() == 0
    assert contamination(documents(ODD), bench.where("false")).where("size(hits) > 0").count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><p>Site, name, and, more, words here</p></header>
<nav><ul><li><a href=/a>Alpha, beta</a></li></ul></nav><div class="sidebar"><p>Aside, with, many, commas, in, it, that, go, on.</p></div>
<article><h1>Head &amp; line</h1><p>First   para,
graph with text, and commas, to score &lt;high&gt;.<br>After break<p>Second paragraph is <b>bold</b> and <a href=x>linked</a>, long enough, to be kept.</p>
<form><p>Name, please, do, write</p></form><div class="comments"><p>Nice post, I, think, so, too, and, more.</p></div></article><footer><p>Footer, words, here, too</p></footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line\nFirst para, graph with text, and commas, to score <high>. After break\nSecond paragraph is bold and linked, long enough, to be kept."
    assert main_text("") == "" and main_text("<div><p>") == "" and main_text("plain &amp; text only, no tags at all") == "plain & text only, no tags at all"
    assert main_text("<div>" * 30_000 + "<p>Deep, but a paragraph that counts, still</p>") == "Deep, but a paragraph that counts, still"
    assert main_text("<a" * 100_000 + '"') == ""


def test_siblings_of_the_best_container():
    part = "<div class=part><p>{} sentence, with commas, and enough length to score well in any tree.</p></div>"
    page = "<body><div id=wrap>" + part.format("One") + part.format("Two") + "<div class=links>" + "<a href=x>link text here</a> " * 20 + "</div></div></body>"
    assert [x.split()[0] for x in main_text(page).split("\n")] == ["One", "Two"]


def test_pages_of_odd_and_no_rows(spark):
    rows = [(1, None, None, "t"), (None, "u", "", "t"), (2, "v", PAGE, "t"), (2, "v", PAGE, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_main_text(pages)
    assert sorted(r.n_chars for r in found.collect())[:2] == [0, 0] and found.count() == 4 and found.columns == ["page_id", "url", "text", "n_chars"]
    assert extract_main_text(pages.where("false")).count() == 0
