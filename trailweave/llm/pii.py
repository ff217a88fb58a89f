"""Personal data: patterns, and terms of the corpus that disclose what the patterns found.

Only DataFrame functions run here.  The patterns find the protected entities: e-mail addresses,
IP addresses, card numbers and phone numbers.  Then information theory: an entity's information
content is -log2 p(entity), and a term tells of it the pointwise mutual information that their
co-occurrence in the corpus has.  What remains unknown, the difference of the two, is
-log2 p(entity | term).  In texts that have the entity, terms that leave under ``remove_bits``
unknown are removed and those that leave under ``generalise_bits`` are generalised: to the longest
beginning that so many texts of the corpus share that it no longer discloses the entity.
Protected too is what an entity is part of: the domain and the local part of an address, and the
network of an IP address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.llm.blocks import free_name
from trailweave.session import checkpoint, join_checked

#: Kinds in the order in which spans at one place are listed; "term" is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns as Java matches them without backtracking.  A match can begin only where a run of the
#: first class begins or where the last match ended (\\G), so long runs aren't tried from each place.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words of four letters and more, and shorter ones if they begin with a capital or have no case, as names do.
_WORD = r"(?<!\p{L})(?:\p{L}{4,}+|[\p{Lu}\p{Lt}\p{Lo}]\p{L}*+)"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
MOST_BROADCAST = 200_000
#: Code points in which a text is cut where spans are replaced; longer than a generalised term can begin.
_PIECE, _HEAD = 4096, 32


def _matches(text: Column, kind: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(F.array().cast("array<string>")) if kind in _NEEDS else found


def _measured(found: Column, text: Column, pattern: str, order: int) -> Column:
    """Structs of each match: its kind, number, text, and the code points before it since the last match."""
    between = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(found.alias("v"), F.slice(between, 1, F.size(found)).alias("g")),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), x["v"].alias("value"), F.length(x["g"]).cast("long").alias("gap"), F.length(x["v"]).cast("long").alias("len")),
    )
    return F.when(F.size(found) > 0, rows).otherwise(F.slice(rows, 1, 0))


def _placed(rows: DataFrame) -> DataFrame:
    """start and end of each match, as running sums over the matches of its text and kind."""
    so_far = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).select(
        "doc_id", "h", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value"
    )


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 1, value.rlike(f"^({_OCTET}\\.){{3}}{_OCTET}$"))
        .when(kind == 2, n.between(12, 19) & F.call_function("luhn_check", digits))
        .when(kind == 3, n.between(9, 15))
        .otherwise(True)
    )


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, h): null texts as empty, and a hash of the text, which with the id is a row's key."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def base_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, value) of what the patterns find; repeated rows give theirs once."""
    text = F.col("text")
    found = texts.select("doc_id", "h", "text", *(_matches(text, k, p).alias(k) for k, p in PATTERNS.items()))
    some = found.where(F.size(F.concat(*PATTERNS)) > 0)
    arrays = [_measured(F.col(k), text, p, i) for i, (k, p) in enumerate(PATTERNS.items())]
    rows = some.select("doc_id", "h", F.explode(F.concat(*arrays)).alias("m")).select("doc_id", "h", "m.*").distinct()
    return _placed(rows).where(_valid(F.col("kind"), F.col("value")))


def _words(text: Column) -> Column:
    """Distinct lower-case words, without those of e-mail addresses."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(_WORD), F.lit(0)), F.lower))


def _entities(base: DataFrame) -> DataFrame:
    """(h, entity) of what is protected: each entity itself, and the coarser ones that it belongs to."""
    value, kind = F.lower("value"), F.col("kind")
    norm = F.when(kind <= 1, value).otherwise(F.regexp_replace("value", "[^0-9]", ""))
    coarser = (
        F.when(kind == 0, F.array(F.concat(F.lit("@"), F.substring_index(value, "@", -1)), F.concat(F.substring_index(value, "@", 1), F.lit("@"))))
        .when(kind == 1, F.array(F.concat(F.substring_index(value, ".", 3), F.lit("."))))
        .otherwise(F.array().cast("array<string>"))
    )
    return base.select("h", "kind", F.explode(F.concat(F.array(norm), coarser)).alias("v")).select("h", F.xxhash64("kind", "v").alias("entity")).distinct()


def _classes(base: DataFrame, copies: DataFrame, support: int) -> DataFrame:
    """(h, class, needed, size): the classes of entities that each text has.

    Entities that occur in exactly the same texts are one class, as every term tells the same of
    them.  ``needed``: in how many different texts of the class a term must be; ``size``: rows that have it.
    """
    entities = checkpoint(_entities(base))
    sets = entities.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y"))
    sets = sets.select("entity", F.xxhash64("n", "x", "y").alias("class"), F.least(F.lit(support), F.ceil(F.col("n") / 2)).alias("needed"))
    classes = checkpoint(join_checked(entities, sets, "entity", "inner", MOST_BROADCAST).select("h", "class", "needed").distinct())
    sizes = join_checked(classes, copies, "h", "inner", MOST_BROADCAST).groupBy("class").agg(F.sum("copies").alias("size"))
    return checkpoint(join_checked(classes, sizes, "class", "inner", MOST_BROADCAST).select("h", "class", "needed", "size"))


def _joint(words: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, term, joint) of terms that two or more texts of a class have, as many as it needs.

    Of a class's texts that with the most classes is looked at last, and only for terms that
    another text of the class has.  So a text with very many entities and very many words doesn't
    pair all of these.
    """
    crowds = classes.groupBy("h").agg(F.count("*").alias("crowd"))
    sized = join_checked(classes, crowds, "h", "inner", MOST_BROADCAST)
    last = sized.groupBy("class").agg(F.max(F.struct("crowd", "h"))["h"].alias("last"), F.first("needed").alias("needed"), F.count("*").alias("texts_of"))
    last = checkpoint(last.where("texts_of > 1"))
    others = join_checked(classes.select("h", "class"), last.select("class", "last"), "class", "inner", MOST_BROADCAST).where("h <> last").select("h", "class")
    part = words.join(others, "h").groupBy("class", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("joint"))
    at_last = words.select(F.col("h").alias("last"), "term", F.col("copies").alias("more"))
    both = join_checked(part, last, "class", "inner", MOST_BROADCAST).join(at_last, ["last", "term"], "left")
    texts = F.col("texts") + F.col("more").isNotNull().cast("int")
    return both.where((texts >= F.col("needed")) & (texts > 1)).select("class", "term", (F.col("joint") + F.coalesce("more", F.lit(0))).alias("joint"))


def _heads(terms: DataFrame, counts: DataFrame, bits: float) -> DataFrame:
    """(term, size, head): the longest beginning of a term that no longer discloses a class of ``size`` rows.

    A beginning is in no fewer texts than the most frequent term that has it, so p(class | head) is
    at most ``size`` over that count.
    """
    begun = lambda rows: rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.length("term") - 1, F.lit(_HEAD))))).withColumn("head", F.left("term", F.col("k")))
    wanted = checkpoint(begun(terms.where(F.length("term") > 1)))
    known = join_checked(begun(counts.where(F.length("term") > 1)).select("head", "count"), wanted.select("head").distinct(), "head", "left_semi", MOST_BROADCAST)
    most = known.groupBy("head").agg(F.max("count").alias("most"))
    able = wanted.join(most, "head").where(F.col("most") > F.col("size") * 2.0**bits)
    return able.groupBy("term", "size").agg(F.max_by("head", "k").alias("head"))


def disclosing_terms(texts: DataFrame, base: DataFrame, support: int, remove_bits: float, generalise_bits: float) -> DataFrame | None:
    """(h, term, bits, head): what the terms of a text leave unknown of its entities; None if there is no such term.

    A term counts for a class if half of the class's different texts have it, one at least, or if
    ``support`` of them have it.  Counts are over all documents; copies of a text count as often as
    they occur.  ``head``: what the term is generalised to, null where nothing general enough is.
    """
    # rows, as in the counts of terms: repeated rows and copies with ids of their own are alike
    copies = join_checked(texts.select("h"), base.select("h").distinct(), "h", "left_semi", MOST_BROADCAST).groupBy("h").agg(F.count("*").alias("copies"))
    classes = _classes(base, copies, support)
    # words of the texts that have a class, once for each different text
    own = join_checked(texts.select("h", "text"), copies, "h", "inner", MOST_BROADCAST)
    words = checkpoint(own.select("h", "copies", F.explode(_words(F.col("text"))).alias("term")).distinct())
    if words.isEmpty():
        return None
    # the texts at hand bound a term's count from below: most terms, common words first, leave too much unknown in these
    near = words.groupBy("term").agg(F.sum("copies").alias("near"))
    most = 2.0**generalise_bits
    joint = checkpoint(_joint(words, classes).join(near, "term").where(F.col("near") <= F.col("joint") * most).drop("near"))
    # a term of one text tells of each class that needs no more than one of its texts
    single = join_checked(words, classes.where("needed <= 1").groupBy("h").agg(F.max("size").alias("size")), "h", "inner", MOST_BROADCAST)
    single = checkpoint(single.join(near, "term").where(F.col("near") <= F.col("copies") * most).select("h", "term", F.col("copies").alias("joint"), "size"))
    # counted where the words are, so what is shuffled grows with the vocabulary and not with the words
    counts = checkpoint(texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").count())
    many = words.select("h", "term").join(joint, "term").join(classes.select("h", "class", "size"), ["h", "class"]).select("h", "term", "joint", "size")
    rows = single.unionByName(many).groupBy("h", "term").agg(F.max("joint").alias("joint"), F.max("size").alias("size"))
    # IC(class) - PMI(class; term) = -log2 p(class | term)
    rows = rows.join(counts, "term").withColumn("bits", F.greatest(F.lit(0.0), F.log2(F.col("count") / F.col("joint")))).where(F.col("bits") <= generalise_bits)
    rows = checkpoint(rows)
    general = rows.where(F.col("bits") > remove_bits).select("term", "size").distinct()
    return rows.join(_heads(general, counts, generalise_bits), ["term", "size"], "left").select("h", "term", "bits", "head")


def term_spans(texts: DataFrame, base: DataFrame, support: int, remove_bits: float, generalise_bits: float) -> DataFrame | None:
    """(doc_id, h, kind, start, end, value, bits, head) of disclosing terms outside the base spans."""
    per_text = disclosing_terms(texts, base, support, remove_bits, generalise_bits)
    if per_text is None:
        return None
    per_text = checkpoint(per_text)
    listed = join_checked(texts, per_text.select("h").distinct(), "h", "left_semi", MOST_BROADCAST)
    text = F.col("text")
    with_words = listed.select("doc_id", "h", "text", F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("w"))
    rows = with_words.select("doc_id", "h", F.explode(_measured(F.col("w"), text, _WORD, 4)).alias("m")).select("doc_id", "h", "m.*").distinct()
    words = _placed(rows).withColumn("term", F.lower("value"))
    hits = words.join(per_text, ["h", "term"]).drop("term")
    # drop what overlaps a base span: one that began before and goes on, or one that begins within
    both = hits.unionByName(base.withColumn("bits", F.lit(None).cast("double")).withColumn("head", F.lit(None).cast("string")))
    is_base = F.col("kind") < 4
    so_far = lambda *by: Window.partitionBy("doc_id", "h").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    checked = both.withColumn("before", F.max(F.when(is_base, F.col("end"))).over(so_far("start", "kind")))
    checked = checked.withColumn("after", F.min(F.when(is_base, F.col("start"))).over(so_far(F.desc("start"), F.desc("kind"))))
    clear = ~is_base & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return checked.where(clear).drop("before", "after")


def found_spans(texts: DataFrame, support: int = 5, remove_bits: float = 0.25, generalise_bits: float = 1.0) -> DataFrame:
    """(doc_id, h, spans) of the texts that have any; spans: [{start, kind, end, label, last}] in order.

    ``label`` is what the sanitiser writes there: the kind in brackets, nothing for a term to
    remove, the beginning and a star for one that is generalised.  ``last``: where the spans before it end.
    """
    base = checkpoint(base_spans(texts))
    terms = term_spans(texts, base, support, remove_bits, generalise_bits)
    spans = base.withColumn("bits", F.lit(None).cast("double")).withColumn("head", F.lit(None).cast("string"))
    spans = spans.unionByName(terms) if terms is not None else spans
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    # as written: the term's own letters, as many as the head has
    general = F.concat(F.left("value", F.length("head")), F.lit("*"))
    label = F.when(F.col("bits") <= remove_bits, "").otherwise(F.coalesce(general, F.concat(F.lit("["), F.upper(names), F.lit("]"))))
    before = Window.partitionBy("doc_id", "h").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.select("doc_id", "h", "start", "kind", "end", label.alias("label"), F.coalesce(F.max("end").over(before), F.lit(0)).alias("last"))
    return rows.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "label", "last"))).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (doc_id, h, ...) each with its spans, empty if it has none."""
    s = spans.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "spans")
    joined = rows.join(s, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["h"] == F.col("_h")), "left").drop("_d", "_h")
    return joined.withColumn("spans", F.coalesce("spans", F.expr("array()").cast(s.schema["spans"].dataType)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def pii_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each document.

    Positions are code points, ends exclusive.  A null text has no spans.  Rows are told apart by
    id and text, null ids included, so that each repeated row has the same result.  Other columns
    are ignored; an empty table gives an empty report.
    """
    texts = keyed(documents, id_col, text_col)
    found = with_spans(texts.drop("text"), found_spans(texts, **options))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k) for k in range(4)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _between(pieces: Column, low: Column, high: Column) -> Column:
    """Code points [low, high) of a text that is cut in ``pieces``; only the pieces they lie in are read."""
    first = F.floor(low / _PIECE).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, F.floor(high / _PIECE).cast("int") - first + 1), "")
    return F.substring(joined, (low % _PIECE).cast("int") + 1, (high - low).cast("int"))


def sanitised(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` with each text's spans replaced by their labels; overlapping spans become the first one's.

    All columns are kept, whatever their names, and rows without spans, null texts among them, are
    unchanged.  Repeated rows are cleaned alike; an empty table stays empty.  The work grows with
    the text and with its spans, not with their product.
    """
    texts = keyed(documents, id_col, text_col)
    names = {x: free_name(documents, x) for x in ("h", "d", "k", "found", "pieces")}
    h, d, k, found, pieces = names.values()
    s = found_spans(texts, **options).select(F.col("doc_id").alias(d), F.col("h").alias(k), F.col("spans").alias(found))
    rows = documents.withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = rows.join(s, rows[id_col].eqNullSafe(F.col(d)) & (F.col(h) == F.col(k)), "left")
    cut = F.when(F.col(found).isNotNull(), F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    # where a span begins after all before it have ended, the text goes on from there to it
    written = F.transform(
        F.col(found), lambda x: F.when(x["start"] >= x["last"], F.concat(_between(F.col(pieces), x["last"], x["start"]), x["label"])).otherwise("")
    )
    end = F.array_max(F.transform(F.col(found), lambda x: x["end"]))
    rest = _between(F.col(pieces), end, F.length(text_col).cast("long"))
    cleaned = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(written, ""), rest))
    return joined.withColumn(pieces, cut).withColumn(text_col, cleaned).select(*documents.columns)
