"""Personal data: pattern spans, and terms whose co-occurrence in the corpus discloses a protected value.

DataFrame functions only. The disclosure measure is pointwise mutual information over information content, both
estimated from document frequencies of the whole corpus (Sanchez and Batet, "C-sanitized", 2016)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import durable, lower_az, numbered

#: Kinds in the order of results, as patterns. Possessive repeats match what greedy ones do here, without
#: recursion; the assertions keep long runs from being rescanned from each of their places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

#: What a text must hold for a kind to be searched for.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}

TERM = "term"
KINDS = [*PATTERNS, TERM]

#: What stands between words, as a class for patterns.
_GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def _pieces(text: Column, pattern: Column) -> Column:
    """Of each leftmost match the value, and the length of the text before it; after the last one a null value."""
    return F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))


def _spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, start, end from rows (keys, pieces): offsets are sums over the pieces before."""
    at = rows.select(*keys, F.posexplode("pieces").alias("at", "z"))
    length = F.coalesce(F.length("z.value"), F.lit(0))
    start = F.sum(F.col("z.gap") + length).over(Window.partitionBy(*keys).orderBy("at")) - length
    return at.withColumn("start", start.cast("long")).filter("z.value is not null").select(
        *keys, F.col("z.value").alias("value"), "start", (F.col("start") + F.length("z.value")).alias("end")
    )


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip_ok = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    doubled = F.transform(
        F.split(F.reverse(F.substring(digits, 1, 19)), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int")),
    )
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0
    return (
        F.when(kind == "ip", ip_ok).when(kind == "card", F.when(n.between(16, 19), luhn).otherwise(False))
        .when(kind == "phone", n.between(8, 15)).otherwise(True)
    )


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, f"[{_GAP}]+", " ")), " ")


def _read(rows: DataFrame) -> DataFrame:
    """row_id, doc_id and the pieces of each kind that a row of (row_id, doc_id, text) may hold."""
    text = F.col("text")
    kinds = [F.when(gate(text), F.struct(F.lit(k).alias("kind"), _pieces(text, F.lit(PATTERNS[k])).alias("pieces"))) for k, gate in GATES.items()]
    return rows.select("row_id", "doc_id", F.array_compact(F.array(*kinds)).alias("kinds"))


def _terms(rows: DataFrame) -> DataFrame:
    """(row_id, t): hashes of a text's distinct words with a letter outside e-mail addresses, the only values with
    letters. They are read from the texts each time: written down they would take more room than the texts."""
    text = F.col("text")
    lower = lower_az(text)
    outside = F.when(F.contains(text, F.lit("@")), F.regexp_replace(lower, PATTERNS["email"], " ")).otherwise(lower)
    words = F.filter(F.array_distinct(_words(outside)), lambda w: w.rlike(r"[a-z\x{80}-\x{10FFFF}]"))
    # an outer explode, as Spark would read the words twice to leave rows without any out before a plain one
    return rows.select("row_id", F.explode_outer(F.transform(words, lambda w: F.xxhash64(w))).alias("t")).filter("t is not null")


def pattern_spans(seen: DataFrame) -> DataFrame:
    """row_id, kind, value, start, end (code points, end exclusive) of valid matches."""
    held = seen.select("row_id", F.explode("kinds").alias("k")).select("row_id", "k.kind", "k.pieces").filter("size(pieces) > 1")
    return _spans(held, ["row_id", "kind"]).filter(_valid(F.col("kind"), F.col("value")))


def disclosing_terms(rows: DataFrame, found: DataFrame, *, min_documents: int = 2, threshold: float = 0.8) -> DataFrame:
    """Hashes t of the terms that disclose a protected value.

    A term is a word with a letter. With n documents in all, n_t with the term, n_e with the value and n_te with both
    anywhere in them, its disclosure is log(n_te n / (n_t n_e)) / log(n / n_e): 1 if the term never stands without the
    value. A term counts from threshold and min_documents documents with both on; in one document alone every word of
    its own would score 1, so nothing can be estimated. Frequencies are over all documents and whole texts. A term
    reaches the threshold only if n_t <= n (n_e / n) ^ threshold, so rarer values meet only rare terms: that keeps what
    a document sends small, and drops nothing."""
    n = float(max(2, rows.count()))
    values = durable(found.select(F.xxhash64("kind", "value").alias("entity"), "row_id").distinct())
    n_e = values.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= min_documents)
    most = F.lit(n) * F.pow(F.col("n_e") / n, F.lit(threshold)) * (1 + 1e-9)
    n_e = durable(n_e.select("entity", "n_e", most.alias("most"), F.monotonically_increasing_id().alias("e")))  # e: short in a shuffle
    shared = durable(values.join(n_e, "entity").select("row_id", "e", "most"))
    n_t = _terms(rows).groupBy("t").agg(F.count("*").alias("n_t")).filter(F.col("n_t") >= min_documents)
    reach = n_e.agg(F.max("most")).first()[0] or 0.0
    on = durable(shared.select("row_id").distinct())  # by number, so that the texts stay where they are
    held = _terms(rows.join(F.broadcast(on) if on.count() <= 2_000_000 else on, "row_id", "left_semi"))
    one, two = held.join(n_t.filter(F.col("n_t") <= reach), "t").alias("one"), shared.alias("two")
    both = one.join(two, (F.col("one.row_id") == F.col("two.row_id")) & (F.col("n_t") <= F.col("most")))
    n_te = both.groupBy("t", "n_t", "e").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= min_documents)
    value = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.greatest(F.log(n / F.col("n_e")), F.lit(1e-9))
    few = F.broadcast(n_e) if n_e.count() <= 1_000_000 else n_e
    return n_te.join(few, "e").filter(value >= threshold).select("t").distinct()


def _beside(rows: DataFrame, held: DataFrame, weight: Column, how: str, limit: int = 2_000_000) -> DataFrame:
    """rows (row_id, texts) joined with held, which is broadcast while the sum of its weight, numbers that it holds, is
    under limit, some 64 MB; beyond, Spark shuffles both."""
    small = (held.agg(F.sum(weight)).first()[0] or 0) <= limit
    return rows.join(F.broadcast(held) if small else held, "row_id", how)


def term_spans(rows: DataFrame, strong: DataFrame) -> DataFrame:
    """row_id, kind, value, start, end of every place of the strong terms (t) in all rows, outside e-mail addresses."""
    strong = durable(strong)
    few = F.broadcast(strong) if strong.count() <= 2_000_000 else strong
    held = _terms(rows).join(few, "t")
    held = durable(held.groupBy("row_id").agg(F.collect_set("t").alias("ts")))
    texts = _beside(rows.select("row_id", lower_az(F.col("text")).alias("text")), held, F.size("ts") + 4, "inner")
    # an address is one match, so that the words in it are none; offsets run along, places gather where a term stands
    pieces = _pieces(F.col("text"), F.lit(PATTERNS["email"] + f"|[^{_GAP}]++"))
    places = F.expr(
        "aggregate(pieces, named_struct('at', 0L, 'out', cast(array() as array<struct<value: string, start: bigint, end: bigint>>)), (a, z) -> named_struct("
        "'at', a.at + z.gap + coalesce(length(z.value), 0), 'out', if(z.value is not null and array_contains(ts, xxhash64(z.value)), "
        "concat(a.out, array(named_struct('value', z.value, 'start', a.at + z.gap, 'end', a.at + z.gap + length(z.value)))), a.out)), a -> a.out)"
    )
    found = texts.select("row_id", "ts", pieces.alias("pieces")).select("row_id", F.explode(places).alias("p"))
    return found.select("row_id", F.lit(TERM).alias("kind"), "p.value", "p.start", "p.end")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **disclosure) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): (row_id, doc_id, text) per row of docs, and (row_id, kind, value, start, end) of every span.

    Null counts as the empty text. Base kinds are matched leftmost and without overlap within a kind; matches that
    fail their test are dropped. Terms that disclose a value are reported wherever they stand, in documents without the
    value too. Repeated rows count as documents of their own; an empty table gives empty results; texts of any length
    are read whole; other columns are not read."""
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).select("row_id", "doc_id", "text")
    found = durable(pattern_spans(durable(_read(rows))))
    terms = durable(term_spans(rows, disclosing_terms(rows, found, **disclosure)))
    return rows, found.unionByName(terms)


def span_summary(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Per row: row_id, doc_id, a count for each base kind, base_sha256, spans."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    per = spans.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("all"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in PATTERNS],
    )
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("all", lambda s: s["kind"] != TERM)
    per = per.select("row_id", *[f"n_{k}" for k in PATTERNS], text(base).alias("base"), text(F.col("all")).alias("spans"))
    return rows.select("row_id", "doc_id").join(per, "row_id", "left").select(
        "row_id", "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def sanitise(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(row_id, doc_id, text) with each span of a base kind generalised to its kind in brackets and terms removed.

    Of overlapping spans the earlier, then the longer one counts; the rest of an overlapping one goes with it."""
    before = Window.partitionBy("row_id").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    cuts = spans.select("row_id", "start", "end", "kind").withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    per = durable(cuts.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "at", "kind", "end"))).alias("cuts"), F.max("end").alias("last")))
    piece = (
        "concat(substring(text, cast(c.at + 1 as int), cast(greatest(c.start - c.at, 0) as int)), "
        f"if(c.start < c.at or c.kind = '{TERM}', '', concat('[', upper(c.kind), ']')))"
    )
    clean = F.expr(f"concat(array_join(transform(cuts, c -> {piece}), ''), substring(text, cast(last + 1 as int)))")
    return _beside(rows, per, 4 * F.size("cuts") + 4, "left").select("row_id", "doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(clean).alias("text"))
