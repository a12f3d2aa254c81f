"""Personal data in texts, and the terms that give it away; in built-in Spark functions only.

Patterns find the base spans. What they find are the protected entities. The corpus tells how strongly a term reveals an
entity: with p over distinct texts, their pointwise mutual information log(p(entity, term) / (p(entity) p(term))) as a
share of the entity's information -log(p(entity)). The share is 1 for a term that stands near the entity wherever it
occurs. Terms above a threshold are generalised to their class, above a higher one removed.

Only words within a window around an entity are held together with it, so the pairs grow with the text and never with
its square, and a pair has to stand in several different contexts: a passage that is copied whole is one context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, documents, small, written

KINDS = ("email", "ip", "card", "phone")
#: Words of a local part or a number are taken from their first character on, or from the end of the match before, so that
#: a long run is looked through once. Possessive groups keep a long match from filling the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: What may be an entity, for contexts: the patterns side by side, cards with enough digits.
ENTITY = rf"{EMAIL}|{IP}|{PHONE}|[0-9](?:[\x20-]?[0-9]){{12,}}+"
TERM = r"[\p{L}\p{N}_]+"

#: Words on either side of an entity that are held together with it, and the characters that they are looked for in.
WINDOW = 8
REACH = 160
#: Different contexts that a term must share with an entity.
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.98
BLOCK = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern is one of that kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(IP_VALID)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((F.length(value) >= 13) & n.between(13, 19), F.call_function("luhn_check", _digits(value))).otherwise(False)
    return n.between(9, 15)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that each text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){12}")


def with_places(df: DataFrame, text: str, patterns: dict[str, str], wanted: dict[str, Column]) -> DataFrame:
    """df with, for each name of patterns, the array of (start, end, v) of all matches in the text.

    wanted says which rows are looked through. A match starts after all gaps and matches before it; their lengths are
    added up in blocks, so that a text with many matches takes no time with the square of their number. Each step is a
    projection, and what a lambda reads besides its element is used twice there, so Spark does not move it into the lambda.
    """
    names = df.columns
    none = F.array().cast("array<string>")
    df = df.select(*names, *(F.when(wanted[k], F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none).alias(f"_m_{k}") for k, p in patterns.items()))

    def parts(k, p):
        m = F.col(f"_m_{k}")
        gaps = F.slice(F.split(F.col(text), p, -1), F.lit(1), F.size(m))
        each = F.zip_with(gaps, m, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("v")))
        return F.when(F.size(m) > 0, each).otherwise(F.array().cast("array<struct<gap:int,size:int,v:string>>"))

    long = lambda a, first, n: F.aggregate(F.slice(a, first, n), F.lit(0), lambda s, x: s + x["gap"] + x["size"])
    df = df.select(*names, *(parts(k, p).alias(f"_a_{k}") for k, p in patterns.items()))

    def blocks(k):
        a = F.col(f"_a_{k}")
        at = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
        return F.when(F.size(a) > 0, F.transform(at, lambda b: long(a, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<int>"))

    df = df.select(*names, *(f"_a_{k}" for k in patterns), *(blocks(k).alias(f"_b_{k}") for k in patterns))
    before = lambda k: F.transform(F.col(f"_b_{k}"), lambda _, b: F.aggregate(F.slice(F.col(f"_b_{k}"), F.lit(1), b), F.lit(0), lambda s, x: s + x))
    df = df.select(*names, *(f"_a_{k}" for k in patterns), *(before(k).alias(f"_p_{k}") for k in patterns))

    def places(k):
        a, p = F.col(f"_a_{k}"), F.col(f"_p_{k}")

        def place(x, i):
            b = F.floor(i / BLOCK).cast("int")
            start = F.when(F.size(p) > b, F.get(p, b)) + long(a, b * BLOCK + 1, i % BLOCK) + x["gap"]
            return F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["v"].alias("v"))

        return F.transform(a, place)

    return df.select(*names, *(places(k).alias(f"_{k}") for k in patterns))


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with the columns _email, _ip, _card and _phone: arrays of (start, end, v), in code points, end exclusive."""
    names = df.columns
    df = with_places(df, text, PATTERNS, {k: _may_hold(k, F.col(text)) for k in KINDS})
    kept = lambda k: F.filter(F.col(f"_{k}"), lambda x: _holds(k, x["v"])).alias(f"_{k}")
    return df.select(*names, *map(kept, KINDS))


def _entity(value: Column) -> Column:
    """A name for the entity that a match of ENTITY stands for; null if it is none."""
    of = lambda kind, x: F.when(_holds(kind, value), F.concat(F.lit(f"{kind}:"), x))
    return (
        F.when(value.contains("@"), F.concat(F.lit("email:"), F.lower(value)))
        .when(value.startswith("+"), of("phone", _digits(value)))
        .when(value.contains("."), of("ip", value))
        .otherwise(of("card", _digits(value)))
    )


def with_contexts(df: DataFrame, text: str, wanted: Column) -> DataFrame:
    """df with _contexts: an array of (entity, words around it) of the rows that are wanted."""
    names = df.columns
    none = F.array().cast("array<string>")
    look = lambda f: F.when(wanted, f).otherwise(none)
    df = df.select(*names, look(F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0))).alias("_m"), look(F.split(F.col(text), ENTITY, -1)).alias("_g"))
    words = lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"({TERM})"), F.lit(1)), lambda w: F.lower(w))
    # a word that the reach cuts is left out
    before = lambda g: words(F.when(F.length(g) > REACH, F.regexp_replace(F.right(g, F.lit(REACH)), rf"^{TERM}", "")).otherwise(g))
    after = lambda g: words(F.when(F.length(g) > REACH, F.regexp_replace(F.left(g, F.lit(REACH)), rf"{TERM}$", "")).otherwise(g))
    last = lambda a: F.reverse(F.slice(F.reverse(a), F.lit(1), F.lit(WINDOW)))
    found = F.transform(F.col("_m"), lambda v, i: F.struct(_entity(v).alias("entity"), F.concat(last(before(F.get(F.col("_g"), i))), F.slice(after(F.get(F.col("_g"), i + 1)), F.lit(1), F.lit(WINDOW))).alias("words")))
    return df.select(*names, F.filter(F.when(F.size("_m") > 0, found).otherwise(F.array().cast("array<struct<entity:string,words:array<string>>>")), lambda x: x["entity"].isNotNull()).alias("_contexts"))


def _key(text: Column) -> Column:
    """What names a text: 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _span_list(arrays: dict[str, Column]) -> Column:
    of = lambda k, a: F.transform(a, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.concat(*(of(k, a) for k, a in arrays.items()))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def disclosing_terms(rows: DataFrame, texts: DataFrame, *, support: int = SUPPORT, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """((term, disclosure), (key, term)): terms that reveal an entity, and the texts that each of them stands in.

    rows has key and contexts (entity, words) of each row, texts (key, text) all of them. Counts are of distinct texts.
    """
    spark = rows.sparkSession
    n = rows.select("key").distinct().count()
    near = rows.select("key", F.explode("contexts").alias("c")).select("key", "c.entity", "c.words")
    near = written(near.withColumn("context", F.xxhash64("words")), "pii_contexts")
    entities = near.select("entity", "key").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    entities = written(entities, "pii_entities")
    empty = spark.createDataFrame([], "term string, disclosure double"), spark.createDataFrame([], "key binary, term string")
    if entities.isEmpty():
        return empty
    word = near.select("entity", "key", "context", F.explode(F.array_distinct("words")).alias("term"))
    # a term stands in at least as many texts as it does near entities
    around = word.select("term", "key").distinct().groupBy("term").agg(F.count("*").alias("n_around"))
    held = word.join(small(entities), "entity").groupBy("entity", "n_entity", "term").agg(F.count_distinct("key").alias("n_both"), F.count_distinct("context").alias("contexts"))
    held = held.where(F.col("contexts") >= support)
    # share of the entity's information: 1 - log(p(entity | term)) / log(p(entity))
    share = lambda texts_of_term: F.when(F.col("n_entity") < n, 1 - F.log(F.least(F.lit(1.0), F.col("n_both") / texts_of_term)) / F.log(F.col("n_entity") / F.lit(n)))
    likely = written(held.join(around, "term").where(share(F.col("n_around")) >= generalise).drop("n_around"), "pii_candidates")
    if likely.isEmpty():
        return empty
    terms = likely.select("term").distinct()
    own = texts.select("key", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1)), lambda w: F.lower(w)))).alias("term"))
    places = written(own.join(small(terms), "term").select("key", "term").distinct(), "pii_term_texts")
    df = places.groupBy("term").agg(F.count("*").alias("n_term"))
    found = likely.join(df, "term").withColumn("disclosure", share(F.col("n_term"))).where(F.col("disclosure") >= generalise)
    found = written(found.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii_terms")
    return found, places.join(small(found.select("term")), "term").select("key", "term")


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, key, base, terms), a row for each row of docs.

    base and terms are arrays of (kind, start, end); places count code points of the whole text, end exclusive. Base spans
    stand by kind, then start. Terms are of kind `general` or `removed`, by start, and none overlaps a base span. A null
    text is empty; empty texts have no spans; equal texts have equal ones, and copies of a text count once. A null or
    repeated id is a value like others. Empty tables give no rows; other columns of docs play no role.
    """
    source = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("_text"))
    rows = with_base_spans(source, "_text")
    rows = rows.select("doc_id", "_text", _span_list({k: F.col(f"_{k}") for k in KINDS}).alias("base"))
    rows = with_contexts(rows, "_text", F.size("base") > 0)
    rows = written(rows.select("doc_id", _key(F.col("_text")).alias("key"), "base", F.col("_contexts").alias("contexts")), "pii_rows")
    texts = docs.select(F.coalesce(column(text_col), F.lit("")).alias("text")).withColumn("key", _key(F.col("text")))
    terms, places = disclosing_terms(rows, texts, support=support, generalise=generalise)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if terms.isEmpty():
        return rows.select("doc_id", "key", "base", none.alias("terms"))
    action = F.when(F.col("disclosure") >= remove, F.lit("removed")).otherwise(F.lit("general"))
    known = places.join(small(terms), "term").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", action.alias("kind")))).alias("_known"))
    known = written(known, "pii_known")
    hit = texts.join(small(known), "key")
    hit = with_places(hit, "text", {"word": TERM}, {"word": F.lit(True)})
    hit = hit.select("key", F.transform("_word", lambda x: F.struct(F.try_element_at("_known", F.lower(x["v"])).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("_w"))
    hit = hit.select("key", F.filter("_w", lambda x: x["kind"].isNotNull()).alias("_w")).groupBy("key").agg(F.first("_w").alias("_w"))
    hit = written(hit, "pii_hits")
    free = F.filter("_w", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.join(small(hit), "key", "left").select("doc_id", "key", "base", F.coalesce(free, none).alias("terms"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with personal data out of the texts, in the same columns: `[kind]` for base spans, the class of a term that
    is generalised ([name], [number] or [word]), and nothing for one that is removed.

    Overlapping spans become one, with the mark of the first. A null text stays null; all other columns, of any name, stay
    as they are (a count of characters too). Texts are joined with what was found in them by their hash.
    """
    spans = personal_spans(docs, id_col=id_col, text_col=text_col, **options)
    spans = spans.where("size(base) > 0 or size(terms) > 0").groupBy("key").agg(F.first(F.concat("base", "terms")).alias("spans"))
    spans = written(spans, "pii_spans")
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(text_col).alias("text")).withColumn("key", _key(F.coalesce("text", F.lit(""))))
    rows = rows.join(small(spans), "key", "left")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    rows = rows.select("row", "text", ordered.alias("spans"))
    open_ = F.struct(F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("done"), F.lit(None).cast("struct<start:int,end:int,kind:string>").alias("last"))

    def merge(acc, x):
        last = acc["last"]
        joins = last.isNotNull() & (x["start"] < last["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(joins, F.struct(acc["done"].alias("done"), grown.alias("last"))).otherwise(
            F.struct(F.when(last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"), x.alias("last"))
        )

    merged = F.aggregate("spans", open_, merge, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    rows = rows.select("row", "text", F.when(F.size("spans") > 0, merged).alias("spans"))
    cut = lambda a, b: F.substring(F.col("text"), a + 1, b - a)

    def mark(x):
        own = cut(x["start"], x["end"])
        name = F.when(own.rlike(r"[0-9]"), F.lit("[number]")).when(own.rlike(r"^\p{Lu}"), F.lit("[name]")).otherwise(F.lit("[word]"))
        return F.when(x["kind"] == "removed", F.lit("")).when(x["kind"] == "general", name).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))

    pieces = F.transform("spans", lambda x, i: F.concat(cut(F.when(i == 0, 0).otherwise(F.get(F.col("spans"), i - 1)["end"]), x["start"]), mark(x)))
    rest = F.substring(F.col("text"), F.try_element_at("spans", F.lit(-1))["end"] + 1, F.length("text"))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    field = lambda c: F.col("row").getField(c)
    return rows.select(*((clean if c == text_col else field(c)).alias(c) for c in docs.columns))


def op12_personal_data(spark, sf_dir):
    found = personal_spans(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    terms = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", terms)).alias("spans"), F.size("terms").cast("long").alias("n_terms")
    )
