"""Personal data by fixed patterns, and by bootstrapped contexts that lead to identifiers no pattern knows.

The base patterns find e-mail and IP addresses, payment cards and telephone numbers: leftmost, non-overlapping by
kind, failing matches dropped. Their spans are the seeds. Each seed and each other identifier-like token (a run of six
or more ASCII letters, digits and @._%+- with three digits, of any length) is an instance; the words around it are its
lexical patterns: the two words before it, and the words on both sides. A word counts by its part within LEFT
characters before the instance or RIGHT behind it, so that a longer one stands by its nearest part.
Instances and patterns form a bipartite graph that is scored in ROUNDS rounds for each kind:
    confidence(pattern) = mean score of its distinct instances, 0 with a support under LEAST_SUPPORT
    score(instance) = 1 for seeds, else 1 - product over its confident patterns of (1 - confidence).
The support sums the scores of all instances, so a pattern may become confident by discovered ones alone.
Tokens in a pattern of confidence ACCEPT or more, and tokens whose score reaches it, become spans of that kind.

DataFrame functions only. Splitting by a pattern gives the gaps between its matches; offsets are running sums of their
lengths in a window over the document's matches, and surroundings come from the neighbouring gaps, so no step goes
through a text once a match. The patterns are written with possessive and lazy classes, so that no run of characters
takes quadratic time or deep recursion. Tokens are held against base spans in the same window. The graph holds distinct
(pattern, instance) pairs; its sums are aggregated map-side. Documents without any match are never shuffled; others meet
their spans in a join, with their text only where it is rewritten.

Defined results: null text is empty; overlapping spans of different kinds all count (redaction merges them); null
ids and repeated rows pass through; an empty table gives no rows; clashing columns are
replaced by detect and kept by redact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import set_aside, without
from millrace.session import written

#: Fixed order of the kinds.
KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, each in a form of the same matches without backtracking into a run. In EMAIL a match starts
#: where a run of local characters starts or where the last match ended; CARD names the 13 to 19 digits of a whole chain.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))

TOKEN = r"(?<![A-Za-z0-9@._%+-])(?=(?:[A-Za-z@._%+-]*+[0-9]){3})[A-Za-z0-9@._%+-]{6,}+"
LEFT, RIGHT = 256, 128
ROUNDS = 3
LEAST_SUPPORT = 3.0
CONFIDENT, ACCEPT = 0.5, 0.9


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.try_to_number(bare, F.lit("999")), F.lit(0)) <= 255)


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _octet)
    if kind == "card":
        return F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


#: A character without which a text cannot match, to leave most texts alone.
_NEEDS = {"email": "@", "phone": "+"}


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def hits(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with hits__: each pattern's matches (kind, or -1 for tokens; number, text) with the lengths and ends of the gaps around."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    found, gaps = {}, {}
    for kind, pattern in (PATTERNS | {"token": TOKEN}).items():
        needs = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
        found[f"m_{kind}__"] = F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        gaps[f"g_{kind}__"] = F.when(F.size(f"m_{kind}__") > 0, F.split(text, pattern, -1)).otherwise(none)
    docs = docs.withColumns(found).withColumns(gaps)
    each = []
    for i, kind in enumerate([*KINDS, "token"]):
        each.append(F.zip_with(f"m_{kind}__", f"g_{kind}__", _hit(F.lit(i if kind in KINDS else -1))))
    # one more gap than matches: the last one has none
    return docs.withColumn("hits__", F.concat(*each)).drop(*found, *gaps)


def _hit(kind: Column):
    return lambda m, g: F.struct(
        kind.alias("kind"), m.alias("m"), F.length(g).alias("gap"), F.octet_length(g).alias("gap_bytes"),
        F.right(g, F.lit(LEFT)).alias("before"), F.left(g, F.lit(RIGHT)).alias("after"),
    )


def _rows(marked: DataFrame) -> DataFrame:
    """row__, kind, start, end, first, last, m and contexts of each match that holds; of tokens, those that no base span touches."""
    rows = marked.where(F.size("hits__") > 0).select("row__", F.posexplode("hits__").alias("i", "h")).select("row__", "i", "h.*").repartition("row__")
    own = Window.partitionBy("row__", "kind").orderBy("i")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    m, nothing = F.coalesce("m", F.lit("")), F.lit("")

    def offset(gap: str, size: Column) -> Column:
        return F.col(gap) + F.coalesce(F.sum(F.col(gap) + size).over(past), F.lit(0))

    def near(column: str, k: int) -> Column:
        return F.coalesce(F.lag(column, k).over(own) if k > 0 else F.lead(column, -k).over(own), nothing)

    # two tokens before a match may be the words before it, one behind it the word behind it
    left = F.concat(near("before", 2), near("m", 2), near("before", 1), near("m", 1), F.col("before"))
    right = F.concat(near("after", -1), near("m", -1), near("after", -2))
    rows = rows.select(
        "row__", "kind", "m", offset("gap", F.length(m)).cast("int").alias("start"), offset("gap_bytes", F.octet_length(m)).cast("int").alias("first"),
        F.right(left, F.lit(LEFT)).alias("left"), F.left(right, F.lit(RIGHT)).alias("right"),
    ).where("m is not null")
    holds = F.lit(True)
    for i, kind in enumerate(KINDS):
        holds = F.when(F.col("kind") == i, _holds(kind, F.col("m"))).otherwise(holds)
    rows = rows.where(holds).withColumn("end", F.col("start") + F.length("m")).withColumn("last", F.col("first") + F.octet_length("m"))
    by_start = Window.partitionBy("row__").orderBy("start", "end", "kind")
    seed = F.col("kind") >= 0
    reach = F.max(F.when(seed, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("row__").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.min(F.when(seed, F.col("start"))).over(back)
    rows = rows.withColumn("reach__", reach).withColumn("ahead__", ahead)
    touched = (F.coalesce("reach__", F.lit(0)) > F.col("start")) | (F.coalesce("ahead__", "end") < F.col("end"))
    return rows.where(seed | ~touched).select("row__", *SPAN, "m", _contexts(F.col("left"), F.col("right")).alias("contexts"))


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: the two words before it, and the words on both sides."""
    clean = F.regexp_replace(F.lower(left), "[0-9]", "0")
    two = F.regexp_extract(clean, r"(?:^|\s)(\S+\s+\S+)\s*$", 1)
    one = F.regexp_extract(clean, r"(\S+)\s*$", 1)
    after = F.regexp_extract(F.regexp_replace(F.lower(right), "[0-9]", "0"), r"^\s*(\S+)\s", 1)
    both = F.when((one != "") & (after != ""), F.concat(F.lit("1:"), one, F.lit(" _ "), after))
    return F.array_compact(F.array(F.when(two != "", F.concat(F.lit("2:"), F.regexp_replace(two, r"\s+", " "))), both))


def _graph(places: DataFrame) -> DataFrame:
    """Distinct (pattern, instance) pairs; kind is the seed's, or -1."""
    rows = places.select(F.explode("contexts").alias("pattern"), F.col("m").alias("instance"), "kind")
    return rows.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def bootstrap(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (pattern, kind) and instances (instance, kind)."""
    graph = written(_graph(places))
    # scores are at most 1, so a pattern of fewer distinct instances never has the support
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_SUPPORT)
    edges = written(graph.join(sizes, "pattern"))
    seeds = written(graph.where("kind >= 0").select("instance", F.col("kind").alias("as_kind"), F.lit(1.0).alias("score")).distinct())
    scores, confident = seeds, None
    for _ in range(ROUNDS):
        # instances without a score count in the size as 0
        held = edges.join(scores, "instance").groupBy("pattern", "as_kind").agg((F.sum("score") / F.max("size")).alias("confidence"), F.sum("score").alias("support"))
        confident = written(held.where((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= CONFIDENT)).select("pattern", "as_kind", "confidence"))
        # a product of factors as a sum of logarithms; a seed stays at 1 for its kind and at 0 for others
        reached = edges.where("kind < 0").join(confident, "pattern").groupBy("instance", "as_kind")
        found = reached.agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        scores = written(seeds.unionByName(found.join(seeds, "instance", "left_anti")))
    patterns = confident.where(F.col("confidence") >= ACCEPT).groupBy("pattern").agg(F.min_by("as_kind", -F.col("confidence") * 10 + F.col("as_kind") / 100).alias("kind"))
    tokens = scores.join(graph.where("kind = -1").select("instance").distinct(), "instance", "left_semi")
    instances = tokens.where(F.col("score") >= ACCEPT).groupBy("instance").agg(F.min_by("as_kind", -F.col("score") * 10 + F.col("as_kind") / 100).alias("kind"))
    return written(patterns), written(instances)


#: The fields of a span: offsets in code points, then in bytes.
SPAN = ("kind", "start", "end", "first", "last")
_SPANS = "array<struct<kind:int,start:int,end:int,first:int,last:int>>"


def _with_spans(docs: DataFrame, text_col: str, keep_text: bool) -> DataFrame:
    """docs with base__ and all__, the base spans and all spans of each row, sorted."""
    marked = hits(docs, text_col)
    marked = written((marked if keep_text else marked.drop(text_col)).withColumn("row__", F.monotonically_increasing_id()))
    places = written(_rows(marked.select("row__", "hits__")))
    patterns, instances = bootstrap(places)
    spans = places.where("kind >= 0").select("row__", *SPAN, F.lit(True).alias("seed"))
    if not (patterns.isEmpty() and instances.isEmpty()):
        fields = [c for c in SPAN if c != "kind"]
        tokens = places.where("kind < 0")
        by_pattern = tokens.select("row__", *fields, F.explode("contexts").alias("pattern")).join(patterns, "pattern").select("row__", "kind", *fields)
        by_instance = tokens.drop("kind").join(instances, F.col("m") == F.col("instance")).select("row__", "kind", *fields)
        added = by_pattern.unionByName(by_instance).groupBy("row__", *fields).agg(F.min("kind").alias("kind"))
        spans = spans.unionByName(added.select("row__", *SPAN, F.lit(False).alias("seed")))
    one = F.struct(*SPAN)
    # the spans of one row, which its own text bounds
    per = spans.groupBy("row__").agg(F.array_sort(F.collect_list(F.when(F.col("seed"), one))).alias("base__"), F.array_sort(F.collect_list(one)).alias("all__"))
    none = F.array().cast(_SPANS)
    marked = marked.withColumn("hits__", F.size("hits__"))
    met = marked.where("hits__ > 0").join(per, "row__", "left").withColumns({c: F.coalesce(c, none) for c in ("base__", "all__")})
    return marked.where("hits__ = 0").withColumns({"base__": none, "all__": none}).drop("row__", "hits__").unionByName(met.drop("row__", "hits__"))


def detect(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with base_spans and spans: arrays of (kind, start, end), kinds numbered as in KINDS, sorted."""
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    found = _with_spans(without(docs, "base_spans", "spans"), text_col, keep_text)
    return found.withColumns({"base_spans": F.transform("base__", bare), "spans": F.transform("all__", bare)}).drop("base__", "all__")


def digest(spans: Column) -> Column:
    """kind:start:end, by kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = detect(docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")), keep_text=False)
    counts = [F.size(_of_kind("base_spans", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind's name in brackets; overlapping spans become the first one's."""
    docs, back = set_aside(docs, "base__", "all__", "row__", "hits__")
    found = _with_spans(docs, text_col, True)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    kind = "array<struct<first:int,last:int,kind:int>>"
    by_place = F.array_sort(F.transform("all__", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))

    def merge(acc: Column, s: Column) -> Column:
        """Spans that overlap the one before them widen it; a fold over blocks would copy less, but spans are few beside the text."""
        top = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"), top["kind"].alias("kind"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["first"] < top["last"], wider).otherwise(F.concat(acc, F.array(s))).cast(kind)

    # nearly all rows have no overlaps, and need no fold
    apart = lambda a: F.forall(F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: x["last"] <= y["first"]), lambda ok: ok)
    found = found.withColumn("all__", by_place)
    found = found.withColumn("all__", F.when(F.size("all__") < 2, F.col("all__")).when(apart(F.col("all__")), F.col("all__")).otherwise(F.aggregate("all__", F.array().cast(kind), merge)))

    def rewritten(x: Column) -> Column:
        data, spans = x["data"], x["spans"]
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["last"]))
        piece = lambda s, end: F.when(s.isNotNull(), F.concat(F.substring(data, end + 1, s["first"] - end).cast("string"), F.element_at(names, s["kind"] + 1))).otherwise(F.substring(data, end + 1, F.octet_length(data) - end).cast("string"))
        return F.array_join(F.zip_with(spans, ends, piece), "")

    # inside a lambda the text's bytes are made once
    masked = F.transform(F.array(F.struct(F.col(text_col).cast("binary").alias("data"), F.col("all__").alias("spans"))), rewritten)[0]
    new = F.when(F.size("all__") > 0, masked).otherwise(F.col(text_col))
    return found.select(*(back | {text_col: new.alias(text_col)}).values())
