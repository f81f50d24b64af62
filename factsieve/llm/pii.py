r"""Personal data: fixed patterns and bootstrapped contextual extraction (operator 3); DataFrame functions only.

Four fixed patterns give the base spans.  They are the seeds: the two words before a seed are a lexical pattern of its kind.
Patterns and the identifier-like words (with a digit or an at sign) that follow them form a graph, whose two sides score each
other: a pattern by the share of its instances that are believed to be of the kind, an instance by the patterns that it follows.  Instances
that trusted patterns believe in are added as spans of the pattern's kind.

Positions come from marking all matches with a noncharacter and adding up the lengths of the pieces.  The fixed patterns are
written without backtracking over long runs (possessive, and anchored where a run of the same characters begins), so their time is
linear and they need no deep stack.  The graph holds a row for each distinct pair of pattern and word; hot patterns and words
collapse before the shuffle.

Defined results: a null text counts as empty and has no spans.  Rows equal in id and text get equal results, null ids too.
Other columns are never read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.bitmap import flagged
from factsieve.plans.store import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern is trusted with this many believed instances and this share of them; an instance is added from this score on.
MIN_SUPPORT, MIN_TRUST, MIN_BELIEF = 3.0, 0.6, 0.7
CONTEXT_CHARS = 80

_MARK, _OTHER = "﷐", "﷑"
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*?[0-9@])[^\x20\x09-\x0D]++"
_STEP = 128


def _running(lengths: Column) -> Column:
    """Sum of the lengths before each entry; runs of 128 entries, so that long arrays are not copied for every entry."""
    def growing(values: Column, begin: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), begin.cast("long").alias("sum"))
        return F.aggregate(values, start, lambda s, x: F.struct(
            F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + x).alias("sum")))["out"]

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")),
                       lambda g: F.slice(lengths, g * _STEP + 1, F.lit(_STEP)))
    sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.flatten(F.zip_with(runs, growing(sums, F.lit(0)), growing))


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    def spans(pieces: Column) -> Column:
        starts = _running(F.transform(pieces, lambda p: F.length(p).cast("long")))
        rows = F.zip_with(pieces, starts, lambda p, at: F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.alias("value")))
        return F.filter(rows, lambda r, i: i % 2 == 1)

    # one evaluation of the pieces, and none of the rest where nothing matched
    return F.element_at(F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))), 1)


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        def luhn(d: Column) -> Column:
            weighed = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 1, F.when(
                x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int")))
            return F.aggregate(weighed, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0

        return F.length(digits).between(16, 19) & luhn(digits)
    return F.lit(True)


def _plain(text: Column) -> Column:
    """Text of the same length in which the mark is free."""
    return F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind as listed, then start."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def of(kind: str) -> Column:
        could = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        found = F.when(could, F.filter(_located(text, _PATTERNS[kind]), lambda s: _passes(kind, s["value"]))).otherwise(empty)
        return F.transform(found, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*[of(kind) for kind in KINDS])


def _words_before(text: Column, start: Column) -> Column:
    """The last two words before a position, in lower case."""
    begin = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    left = F.substr(text, (begin + 1).cast("int"), (start - begin).cast("int"))
    return F.lower(F.regexp_replace(F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1),
                                    r"[\x20\x09-\x0D]+", " "))


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, a hash of the text, base spans, and other identifier-like words, all with the words before them."""
    text = docs.select(F.col(id_col).alias("id"), _plain(F.col(text_col)).alias("text"))
    based = text.select("id", F.xxhash64("text").alias("h"), "text", base_spans(F.col("text")).alias("base"))
    words = F.when(F.col("text").rlike("[0-9@]"), _located(F.col("text"), _TOKEN)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))
    # the word without the marks around it; both ends are anchored, so long runs of marks cost no more than their length
    lead = lambda w: F.length(F.regexp_extract(w["value"], r"^[^\p{L}\p{N}+@]*", 0))
    tail = lambda w: F.length(F.regexp_extract(F.reverse(w["value"]), r"^[^\p{L}\p{N}]*", 0))
    cut = F.transform(words, lambda w: F.struct(w["start"], w["value"], lead(w).alias("lead"), tail(w).alias("tail")))
    trimmed = F.transform(cut, lambda w: F.struct(
        (w["start"] + w["lead"]).alias("start"), (w["start"] + F.length(w["value"]) - w["tail"]).alias("end"),
        F.substr(w["value"], w["lead"] + 1, F.greatest(F.length(w["value"]) - w["lead"] - w["tail"], F.lit(0))).alias("value")))
    free = F.filter(trimmed, lambda w: (w["end"] > w["start"]) & ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    with_words = based.select("id", "h", "text", "base", free.alias("others"))
    placed = lambda c, kind: F.transform(c, lambda s: F.struct(
        (s["kind"] if kind else F.lit(None).cast("string")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.lower(s["value"]).alias("value"), _words_before(F.col("text"), s["start"]).alias("words")))
    return with_words.select("id", "h", placed("base", True).alias("base"), placed("others", False).alias("others"))


def believed(found: DataFrame, rounds: int = ROUNDS, min_support: float = MIN_SUPPORT, min_trust: float = MIN_TRUST,
             min_belief: float = MIN_BELIEF) -> DataFrame:
    """Rows (words, value, kind) of instances that trusted patterns believe in and that are no seeds."""
    rows = found.select(F.explode(F.concat("base", "others")).alias("m")).select("m.*").where("words <> '' and value <> ''")
    seeds = rows.where("kind is not null").select("value", "kind").distinct()
    pairs = rows.groupBy("words", "value").agg(F.max("kind").alias("seed"))
    hopeful = rows.where("kind is not null").select("words").distinct()  # a pattern without a seed can never be trusted
    graph = materialize(pairs.join(hopeful, "words", "left_semi").select("words", "value"), "graph")
    total = graph.groupBy("words").agg(F.count(F.lit(1)).alias("instances"))
    belief = seeds.select("value", "kind", F.lit(1.0).alias("belief"))
    trust = None
    for _ in range(rounds):
        trust = materialize(
            graph.join(belief, "value").groupBy("words", "kind").agg(F.sum("belief").alias("support")).join(total, "words")
            .select("words", "kind", (F.col("support") / (F.col("instances") + 1)).alias("trust"), "support")
            .where((F.col("support") >= min_support) & (F.col("trust") >= min_trust)), "trust")
        # noisy or over the trusted patterns of an instance; a seed stays certain
        told = graph.join(trust, "words").groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("belief"))
        belief = materialize(seeds.select("value", "kind", F.lit(1.0).alias("belief")).unionAll(told).groupBy("value", "kind").agg(
            F.max("belief").alias("belief")), "belief")
    new = belief.where(F.col("belief") >= min_belief).join(seeds, ["value", "kind"], "left_anti")
    return materialize(graph.join(trust, "words").join(new, ["value", "kind"]).groupBy("words", "value").agg(
        F.max_by("kind", F.struct("trust", "kind")).alias("kind")), "learned")


def learned_spans(found: DataFrame, **settings) -> DataFrame:
    """Rows (id, h, learned) for texts with added spans."""
    new = believed(found, **settings)
    open_rows = found.select("id", "h", F.explode("others").alias("m")).select("id", "h", "m.start", "m.end", "m.value", "m.words")
    return (open_rows.join(new, ["words", "value"]).groupBy("id", "h").agg(F.collect_set(F.struct("kind", "start", "end")).alias("learned")))


def _matched(left: DataFrame, learned: DataFrame) -> DataFrame:
    known = learned.select(F.col("id").alias("of"), F.col("h").alias("of_h"), "learned")
    return left.join(known, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left").drop("of", "of_h")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per row of ``docs``: id, base and spans, arrays of (kind, start, end); spans holds base and learned ones."""
    found = materialize(mentions(docs, id_col, text_col), "mentions")
    learned = materialize(learned_spans(found, **settings), "spans")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    joined = _matched(found.select("id", "h", base.alias("base")), learned)
    return joined.select(F.col("id").alias(id_col), "base", in_order(F.concat("base", F.coalesce("learned", none))).alias("spans"))


def in_order(spans: Column) -> Column:
    """By kind as listed, then start."""
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        place(s).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """Text with each span replaced by its kind in brackets; of overlapping spans the earlier, then the longer one stands for both."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(s: Column, x: Column) -> Column:
        end = -x["end"]
        fresh = x["start"] >= s["at"]
        return F.struct(
            F.when(fresh, F.concat(s["out"], F.array(cut(s["at"], x["start"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))).otherwise(
                s["out"]).alias("out"), F.greatest(s["at"], end).alias("at"))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, begin, step, lambda s: F.concat(
        F.array_join(s["out"], ""), cut(s["at"], F.length(text).cast("long"))))).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with the spans of its texts replaced; all columns stay, a null text stays null."""
    found = materialize(mentions(docs, id_col, text_col), "mentions")
    learned = learned_spans(found, **settings)
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # only texts that hold something are on the join's other side, a row for each distinct id and text
    known = found.where("size(base) > 0").select("id", "h", base.alias("spans")).distinct()
    hit = materialize(known.unionAll(learned.select("id", "h", "learned")).groupBy("id", "h").agg(
        F.flatten(F.collect_list("spans")).alias("spans")).toDF("_pii_id", "_pii_h", "_pii_spans"), "hits")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    h = F.xxhash64(_plain(F.col(text_col)))
    marked = flagged(docs, h, hit.select("_pii_h"), "_pii_maybe")  # texts without spans stay where they are
    joined = marked.where("_pii_maybe").join(hit, F.col(id_col).eqNullSafe(F.col("_pii_id")) & (h == F.col("_pii_h")), "left")
    new_text = F.when(F.col(text_col).isNotNull(), redacted(F.col(text_col), F.coalesce("_pii_spans", none)))
    return marked.where("not _pii_maybe").select(*columns).unionAll(joined.withColumn(text_col, new_text).select(*columns))
