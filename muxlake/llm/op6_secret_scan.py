"""Operator 6, secret scan: a trigram index finds the texts that a rule can match, and only those are read by it.

Each rule's expression gives a Boolean query over trigrams. The index has a posting (trigram, document) for every trigram of
the queries; postings are intersected for each rule, and its expression verifies the candidates. A rule
without mandatory trigrams reads every text. DataFrame functions only.

Defined cases: a null text is the empty one (no spans); null and repeated doc_ids keep one result a row; texts are read whole,
in time that grows with their length and matches; an empty table gives an empty result; other columns are ignored, or carried along by
scan and redact whatever their names are. Offsets count code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm.common import cols, documents, fresh
from muxlake.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has min_chars characters or more."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0


# Fixed values of the base contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED
#: States that a running fold appends to one array.
BLOCK = 256
_SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def _plain(pattern: str) -> str:
    return pattern.replace("(?i:", "(?:")


def _scan_pattern(rule: Rule) -> str:
    """Where the matches are whole runs of one class, short ones can be left out by the expression itself."""
    if rule.kind == "hex":
        return r"[0-9a-f]{16,}"
    return rule.pattern


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, hash, kinds) of the texts whose postings satisfy the queries of rules that have one."""
    spark = docs.sparkSession
    wanted = [
        (rule.kind, c, a, gram, len(alternative), len(clauses))
        for rule in rules
        for clauses in [trigram_query(_plain(rule.pattern))]
        for c, clause in enumerate(clauses)
        for a, alternative in enumerate(clause)
        for gram in sorted(alternative)
    ]
    terms = spark.createDataFrame(wanted, "kind string, clause int, alternative int, gram string, n_grams int, n_clauses int")
    grams = F.array(*map(F.lit, sorted({w[3] for w in wanted})))
    present = F.flatten(F.transform(F.array(F.lower("text")), lambda t: F.filter(grams, lambda g: F.contains(t, g))))
    postings = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.explode(present).alias("gram"))
    postings = postings.distinct()
    return (
        postings.join(F.broadcast(terms), "gram")
        .groupBy("id", "hash", "kind", "clause", "alternative", "n_grams", "n_clauses").agg(F.count("*").alias("n"))
        .where(F.col("n") == F.col("n_grams"))
        .groupBy("id", "hash", "kind", "n_clauses").agg(F.countDistinct("clause").alias("n"))
        .where(F.col("n") == F.col("n_clauses"))
        .groupBy("id", "hash").agg(F.collect_set("kind").alias("kinds"))
    )


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for all its uses, those inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, step) -> Column:
    """The states (int) of a fold over an array, one after each item, in blocks: appending to one long array would copy it each time."""
    empty = F.array().cast("array<int>")
    last = lambda states: F.element_at(states, -1)

    def block(out: Column, at: Column) -> Column:
        states = F.aggregate(F.slice(items, at, F.lit(BLOCK)), F.array(last(last(out))), lambda s, x: F.array_append(s, step(last(s), x).cast("int")))
        return F.array_append(out, states)

    blocks = F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), F.array(F.array(zero.cast("int"))), block)
    own = F.flatten(F.transform(blocks, lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))))
    return F.when(F.size(items) > 0, own).otherwise(empty)


def _spans(text: Column, place: int, rule: Rule) -> Column:
    """The spans of one rule: the running sum of the lengths of matches and of what lies between them gives their places."""
    pattern = F.lit(_scan_pattern(rule))
    none = F.array().cast(_SPANS)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, _scan_pattern(rule), -1)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(m).alias("n"), (F.length(g) + F.length(m)).alias("all")))

    def located(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: p["all"]), F.lit(0), lambda at, n: at + n)
        secret = lambda m: F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        span = lambda p, end: F.struct((end - p["n"]).alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        each = F.zip_with(pairs, ends, lambda p, end: F.when(F.length(secret(p["m"])) >= rule.min_chars, span(p, end)))
        return F.filter(each, lambda x: x.isNotNull())

    # The last gap has no match behind it.
    whole = F.filter(pairs, lambda p: p["m"].isNotNull())
    return F.when(F.rlike(text, pattern), _let(whole, located)).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, found: str = "found") -> DataFrame:
    """Every column of docs, text never null, and found: the spans (start, place, end, kind) by start, then rule.

    A column of docs that is called as found is replaced.
    """
    docs = docs.drop(found)
    names = docs.columns
    own, text_hash, kinds = fresh(docs, "id", "hash", "kinds")
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    hits = candidates(rows, rules).select(F.col("id").alias(own), F.col("hash").alias(text_hash), F.col("kinds").alias(kinds))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    each = []
    for place, rule in enumerate(rules):
        spans = _spans(F.col("text"), place, rule)
        if trigram_query(_plain(rule.pattern)):
            hit = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))
            spans = F.when(hit, spans).otherwise(F.array().cast(_SPANS))
        each.append(spans)
    return joined.select(*cols(*names), F.array_sort(F.concat(*each)).alias(found))


def _listed(spans: Column) -> Column:
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span's characters replaced by the mark, and n_chars counted anew; overlapping spans become one.

    The text is cut in four-byte characters, where a cut takes no walk through what stands before it.
    """
    names = docs.columns
    (found,) = fresh(docs, "found")
    wide = F.encode("text", "UTF-32")
    # The mark of the byte order is dropped by decode, so each part gets one.
    cut = lambda data, a, b: F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(data, a * 4 + 1, (b - a) * 4)), "UTF-32")

    def replaced(s: Column) -> Column:
        data, spans, reach = s["data"], s["spans"], s["reach"]
        before = lambda k: F.when(k > 0, F.get(reach, k - 1)).otherwise(0)
        parts = F.transform(spans, lambda x, k: F.when(x["start"] >= before(k), cut(data, before(k), x["start"])))
        rest = cut(data, F.element_at(reach, -1), F.length(data) / 4)
        return F.array_join(F.concat(F.filter(parts, lambda x: x.isNotNull()), F.array(rest)), mark)

    reach = running(F.transform(F.col(found), lambda x: x["end"]), F.lit(0), lambda at, end: F.greatest(at, end))
    state = F.struct(wide.alias("data"), F.col(found).alias("spans"), reach.alias("reach"))
    new = F.when(F.size(found) == 0, F.col("text")).otherwise(_let(state, replaced))
    out = scan(docs, rules, found).withColumn("text", new)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*cols(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents."""
    base = F.filter("found", lambda s: s["place"] < len(BASE))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scan(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", *(n(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
    )
