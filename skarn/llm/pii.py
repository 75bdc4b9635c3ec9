"""Personal data: patterns, and terms that give protected entities away.

DataFrame functions only.  Patterns find the protected entities (mail and network
addresses, card and phone numbers).  Then the corpus itself says which ordinary terms
disclose them: a term that stands in several texts with an entity, and hardly anywhere
else, tells nearly as much as the entity.  With N rows of documents,

    information of an entity  IC(e) = log2(N / df(e))
    information a term gives  PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e)))

a term is *removed* if PMI >= ``remove`` * IC and *generalised* to its shape if
PMI >= ``generalise`` * IC, in both cases only with ``min_support`` different texts that
hold both, wherever in them.  All occurrences in the texts that hold the entity are
treated; in other texts those of terms that point to the entity more often than not, that
is df(t, e) >= ``elsewhere`` * df(t).

All four counts are of rows, so repeating every row changes nothing; only the support
counts different texts.  A row counts once however often it has the term, and df(t) also
counts rows that have the term inside a pattern's match.  Pairs are counted over whole
texts of those that hold an entity of enough support, one task's pairs together before
they move; entities and terms are 64-bit hashes there.

Offsets are code points.  They are prefix sums over the pieces that a pattern's matches
cut a text into, built by chunks so that long lists stay nearly linear; nothing leaves the
row.  The patterns are possessive and start only where a run starts, which finds the same
matches in time linear in the text.

Defined results: null and empty texts have no spans; rows that repeat an id are treated
one by one; equal texts have equal spans; spans of terms that overlap a pattern's span are
not added; an empty table gives no rows; other columns are ignored (``detect``) or passed
on unchanged whatever their names (``sanitise``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._jobs import free_names, text_of, written

#: Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold the kind at all.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}

MIN_SUPPORT = 3
REMOVE = 0.9
GENERALISE = 0.7
ELSEWHERE = 0.5
CHUNK = 256
#: Bits of the table that sorts out words before they move, at least and at most: 16 for each term, as
#: powers of two.  64 of them are a row of what is broadcast, so that has at most 2**20 rows.
FILTER_BITS = (16, 26)
#: Rows of one text are dealt to so many places when they join their terms.
SALTS = 16
#: The same where spans of all texts with personal data are joined, which are more.
FEW_SALTS = 4
#: Stands for the code points of a found span; a private one, no letter of any script.
MASK = "\ue000"


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits is a multiple of ten."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: (lambda d: F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # parts of at most 255; leading zeros do not count
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "phone"):
        digits = F.regexp_replace(match, "[^0-9]", "")
        n = F.length(digits)
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(F.lit(False)) if kind == "card" else n.between(9, 15)
    return F.lit(True)


def _running(values: Column, op=lambda a, b: a + b) -> Column:
    """Running sums (or maxima) of an array of numbers from 0, each including its own.

    In chunks of some square root of the length: an array grows by one only within a
    chunk, and by whole chunks outside.
    """
    n = F.size(values)
    width = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(n)).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda k: F.slice(values, k * width + 1, width))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("done"))
    step = lambda a, x: _once(op(a["at"], x), lambda y: F.struct(y.alias("at"), F.concat(a["done"], F.array(y)).alias("done")))
    outer = lambda a, xs: _once(F.aggregate(xs, F.struct(a["at"].alias("at"), F.array().cast("array<bigint>").alias("done")), step), lambda inner: F.struct(inner["at"].alias("at"), F.concat(a["done"], inner["done"]).alias("done")))
    return F.aggregate(chunks, start, outer, lambda a: a["done"])


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, also where ``use`` has lambdas."""
    return F.transform(F.array(value), use)[0]


def _found(text: Column, kind: str) -> Column:
    """array<struct<start, end, kind, match>> of the kind's valid matches."""
    pattern = PATTERNS[kind]
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,match:string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    # lengths of gap, match, gap, match ...: ends of matches are running sums
    steps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda g, m: g + F.length(m))
    ends = _running(steps)
    spans = F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), m.alias("match")))
    spans = F.filter(spans, lambda s: _valid(kind, s["match"]))
    return F.when(NEEDS[kind](text) & (F.size(matches) > 0), spans.cast("array<struct<start:bigint,end:bigint,kind:int,match:string>>")).otherwise(empty)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): all pattern spans by start, then kind."""
    rows = text_of(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*[_found(F.col("text"), k) for k in KINDS])).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _entity(match: Column, kind: Column) -> Column:
    """One entity however it is written: digits of numbers, lower-cased addresses; hashed."""
    return F.xxhash64(kind, F.when(kind < 2, F.lower(match)).otherwise(F.regexp_replace(match, "[^0-9]", "")))


_TERM = r"[\p{L}\p{N}_]+"
_MASKED = r"[\p{L}\p{N}_\x{E000}]+"


def _terms(text: Column) -> Column:
    """The hashes of the different lower-cased words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))


def _replaced(text: Column, edits: Column, fill=None) -> Column:
    """The text with spans replaced by their marks; of spans that overlap, what follows the first is cut.

    ``edits`` (start, end, mark) are in order of start.  ``fill`` makes the mark from the
    length of what is cut instead.  The text is cut to the pieces of a chunk of edits
    first, and within those to the gaps, so a long list of edits costs the length of the
    text once per chunk and not once per edit.
    """

    def cut(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["upto"], i - 1)).otherwise(F.lit(0).cast("bigint"))
        kept = F.filter(F.transform(x["edits"], lambda e, i: F.struct(before(i).alias("b"), e["start"].alias("s"), e["mark"].alias("m"))), lambda y: y["s"] >= y["b"])
        return _once(F.struct(x["text"].alias("text"), kept.alias("kept"), F.get(x["upto"], F.size(x["upto"]) - 1).alias("end")), joined)

    def joined(x: Column) -> Column:
        end = lambda i: F.when(i + 1 < F.size(x["kept"]), F.get(x["kept"], i + 1)["b"]).otherwise(x["end"])
        kept = x["kept"] if fill is None else F.transform(x["kept"], lambda y, i: F.struct(y["b"].alias("b"), y["s"].alias("s"), fill((end(i) - y["s"]).cast("int")).alias("m")))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["kept"]) - 1) / CHUNK).cast("int")), lambda k: F.slice(kept, k * CHUNK + 1, CHUNK))
        parts = F.transform(chunks, lambda c: _once(F.struct(c.alias("c"), F.substring(x["text"], (F.get(c, F.lit(0))["b"] + 1).cast("int"), (F.get(c, F.size(c) - 1)["s"] - F.get(c, F.lit(0))["b"]).cast("int")).alias("text")), one))
        return F.concat(F.array_join(parts, ""), F.substring(x["text"], (x["end"] + 1).cast("int"), F.length(x["text"])))

    def one(x: Column) -> Column:
        first = F.get(x["c"], F.lit(0))["b"]
        return F.array_join(F.transform(x["c"], lambda y: F.concat(F.substring(x["text"], (y["b"] - first + 1).cast("int"), (y["s"] - y["b"]).cast("int")), y["m"])), "")

    def given(x: Column) -> Column:
        upto = _running(F.transform(x["edits"], lambda e: e["end"]), F.greatest)
        return F.when(F.size(x["edits"]) > 0, _once(F.struct(x["text"].alias("text"), x["edits"].alias("edits"), upto.alias("upto")), cut)).otherwise(x["text"])

    return _once(F.struct(text.alias("text"), edits.alias("edits")), given)


def _masked(text: Column, spans: Column) -> Column:
    """The text with each code point of a span masked."""
    edits = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("mark")))
    return _replaced(F.translate(text, MASK, " "), edits, lambda n: F.repeat(F.lit(MASK), n))


def _free(masked: Column) -> Column:
    """The hashes of the different words that overlap no span, from a masked text."""
    words = F.filter(F.regexp_extract_all(masked, F.lit(_MASKED), F.lit(0)), lambda w: ~F.contains(w, F.lit(MASK)))
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.lower(w))))


def _may_be(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose term may be one of the known ones, as its bit is set; the exact join comes after.

    The words of all texts are many times the text, so they are sorted out before they move,
    whatever form Spark gives the join.  The table of bits follows the number of terms up to its
    bound: one in 16 words that are no terms passes at four million terms, one in two at 46 million.
    """
    bits = min(max((16 * known.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    at = F.col("term").bitwiseAND(F.lit((1 << bits) - 1))
    place, bit = F.shiftright(at, 6), F.expr("shiftleft(1L, cast(_at & 63 AS int))")
    words = known.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_place"), bit.alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_at", at).withColumn("_place", place).join(F.broadcast(words), "_place")  # 2**20 rows at most
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_at", "_place", "_bits")


_ADDED = "array<struct<start:bigint,end:bigint,kind:int,term:string,share:double>>"


def _placed(masked: Column, hits: Column) -> Column:
    """Where the words of ``hits`` (term, share) stand in a masked text, as ``_ADDED``.

    The hits are dealt to lists by their hash, so a word is compared with few of them.
    """
    def cut(x: Column) -> Column:
        return F.struct(F.regexp_extract_all(x["masked"], F.lit(_MASKED), F.lit(0)).alias("words"), F.split(x["masked"], _MASKED, -1).alias("gaps"), _once(x["hits"], _dealt).alias("dealt"))

    def listed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["words"])), x["words"], lambda g, w: (F.length(g) + F.length(w)).cast("bigint"))
        return _once(F.struct(x["words"].alias("words"), x["dealt"].alias("dealt"), _running(steps).alias("ends")), found)

    def found(x: Column) -> Column:
        lists = F.size(x["dealt"])
        share = lambda w: _once(F.xxhash64(F.lower(w)), lambda h: F.get(F.filter(F.get(x["dealt"], F.pmod(h, lists).cast("int")), lambda y: y["term"] == h), F.lit(0))["share"])
        each = F.zip_with(x["ends"], x["words"], lambda e, w: F.struct((e - F.length(w)).alias("start"), e.alias("end"), F.lit(len(KINDS)).alias("kind"), w.alias("term"), share(w).alias("share")))
        return F.filter(each, lambda t: t["share"].isNotNull() & ~F.contains(t["term"], F.lit(MASK)))

    return _once(F.struct(masked.alias("masked"), hits.alias("hits")), lambda x: _once(cut(x), listed)).cast(_ADDED)


def _dealt(hits: Column) -> Column:
    """The hits in lists of a handful."""
    n = F.ceil(F.size(hits) / 8).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(hits, lambda y: F.pmod(y["term"], n) == k))


def _copy(text: Column) -> Column:
    """What tells texts apart, whoever wrote them: 16 bytes of their SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _salted(found: DataFrame, name: str = "_salt", salts: int = SALTS) -> DataFrame:
    """What is known of texts, once for each salt."""
    return found.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))


def _all_spans(docs: DataFrame, id_col: str, text_col: str, min_support: int, remove: float, generalise: float, elsewhere: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy, spans) of every row, and (copy, added) of texts with disclosing terms.

    ``added`` has the terms' spans with their share.  ``copy`` is half of the text's SHA-256, so
    equal texts have equal spans whatever their ids, and other texts have their own.
    """
    rows = text_of(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("copy", _copy(F.col("text")))
    spans = written(find(rows).select("doc_id", _copy(F.col("text")).alias("copy"), "spans"), "spans")
    n = F.lit(float(max(spans.count(), 1)))
    per_text = written(spans.where(F.size("spans") > 0).groupBy("copy").agg(F.first("spans").alias("spans"), F.count("*").alias("k")), "spans-by-text")

    # entities of enough support, and the texts that hold them with their free words
    mentions = per_text.select("copy", "k", F.explode(F.array_distinct(F.transform("spans", lambda s: _entity(s["match"], s["kind"])))).alias("entity"))
    entities = written(mentions.groupBy("entity").agg(F.sum("k").alias("df_e"), F.count("*").alias("copies")).where(F.col("copies") >= min_support), "entities")
    held = mentions.join(entities, "entity").groupBy("copy").agg(F.collect_list("entity").alias("entities"))
    held = written(per_text.join(held, "copy"), "held")
    free = rows.select("copy", "text").join(held, "copy").dropDuplicates(["copy"])
    free = written(free.select("copy", "k", "entities", _free(_masked(F.col("text"), F.col("spans"))).alias("terms")), "free")

    # what each pair tells
    paired = free.select("copy", "k", F.explode("entities").alias("entity"), "terms").select("copy", "k", "entity", F.explode("terms").alias("term"))
    pairs = paired.groupBy("entity", "term").agg(F.count("*").alias("support"), F.sum("k").alias("both")).where(F.col("support") >= min_support)
    pairs = written(pairs, "pairs")
    each = rows.select(F.explode(_terms(F.col("text"))).alias("term"))
    counts = _may_be(each, pairs).groupBy("term").agg(F.count("*").alias("df_t"))
    ic = F.log2(n / F.col("df_e"))
    pmi = F.log2(n * F.col("both") / (F.col("df_t") * F.col("df_e")))
    told = pairs.join(counts, "term").join(entities, "entity").where(ic > 0)
    told = told.select("entity", "term", (pmi / ic).alias("share"), (F.col("both") >= elsewhere * F.col("df_t")).alias("everywhere"))
    told = written(told.where(F.col("share") >= generalise), "disclosing")

    # the terms of each text: those of its own entities, and those that point to one anyway
    own = _may_be(paired, told).join(told, ["entity", "term"]).select("copy", "term", "share")
    points = told.where("everywhere").groupBy("term").agg(F.max("share").alias("share"))
    other = _may_be(rows.select("copy", F.explode(_terms(F.col("text"))).alias("term")), points).join(points, "term").select("copy", "term", "share")
    hits = own.unionByName(other).groupBy("copy", "term").agg(F.max("share").alias("share"))
    hits = written(hits.groupBy("copy").agg(F.collect_list(F.struct("term", "share")).alias("hits")), "hits")
    texts = rows.select("copy", "text").join(hits, "copy").dropDuplicates(["copy"]).join(per_text.select("copy", "spans"), "copy", "left")
    # few bytes and much work: dealt to all tasks, and computed before any filter that would repeat it
    texts = texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "copy")
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,match:string>>")
    added = texts.select("copy", _placed(_masked(F.col("text"), F.coalesce("spans", none)), F.col("hits")).alias("added"))
    return spans, written(added, "added").where(F.size("added") > 0)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE, elsewhere: float = ELSEWHERE) -> DataFrame:
    """Per row: doc_id, counts per kind, base_sha256, spans (pattern and term spans), n_term, n_spans (all)."""
    spans, added = _all_spans(docs, id_col, text_col, min_support, remove, generalise, elsewhere)
    salted = spans.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    every = salted.join(_salted(added), ["copy", "_salt"], "left").drop("_salt").withColumn("added", F.coalesce("added", F.array().cast(_ADDED)))
    order = lambda xs: F.array_sort(F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    bare = lambda xs: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", of(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = _listed(order(F.col("spans")))
    merged = _listed(order(F.concat(bare(F.col("spans")), bare(F.col("added")))))
    total = (F.size("spans") + F.size("added")).cast("bigint").alias("n_spans")
    return every.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), merged.alias("spans"), F.size("added").cast("bigint").alias("n_term"), total)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE, elsewhere: float = ELSEWHERE) -> DataFrame:
    """The documents with all their columns, personal data in the text replaced.

    Entities become ``<EMAIL>`` and so on; of the terms that give them away the strongest
    become ``<TERM>`` and the others their shape (``<NUMBER>``, ``<NAME>``, ``<WORD>``).
    Texts without spans and such terms pass untouched.
    """
    spans, added = _all_spans(docs, id_col, text_col, min_support, remove, generalise, elsewhere)
    kind = "array<struct<start:bigint,kind:int,end:bigint,mark:string>>"
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    shape = lambda w: F.when(w.rlike(r"^\p{N}+$"), "<NUMBER>").when(w.rlike(r"\p{N}"), "<NAME>").otherwise("<WORD>")
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.element_at(marks, s["kind"] + 1).alias("mark")))
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.when(s["share"] >= remove, F.lit("<TERM>")).otherwise(shape(s["term"])).alias("mark")))
    copy, edits, salt = free_names(docs, "_copy", "_edits", "_salt")
    marked = spans.where(F.size("spans") > 0).groupBy("copy").agg(F.first(base).alias("base"))
    found = marked.join(added.select("copy", more.alias("more")), "copy", "full")
    found = found.select(F.col("copy").alias(copy), F.array_sort(F.concat(*[F.coalesce(c, F.array()).cast(kind) for c in ("base", "more")])).alias(edits))
    text = F.col(f"`{text_col}`")
    hit = docs.withColumn(copy, _copy(text)).withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(FEW_SALTS)))
    hit = hit.join(_salted(found, salt, FEW_SALTS), [copy, salt], "left")
    hit = hit.withColumn(text_col, F.when(F.col(edits).isNull(), text).otherwise(_replaced(text, F.col(edits))))
    return hit.select(*[F.col(f"`{c}`") for c in docs.columns])
