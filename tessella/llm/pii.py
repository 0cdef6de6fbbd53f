"""Personal data by bootstrapped contextual extraction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.carried import carry
from tessella.session import BROADCAST_ROWS, compact, materialise, small

# The contract's patterns, written so that no match backtracks (possessive; a match begins where a run of its
# first characters begins or where the match before it ended). Matches are the same.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Characters without which a pattern need not be tried.
NEEDS = {"email": "@", "phone": "+"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = tuple(PATTERNS)
#: A kind of the method's own, which no expression finds: what stands behind a name like these and = or : is taken for one by its context.
SECRET = "secret"
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "private-key", "credential")
SEED_PATTERN = rf"^[012]:(?:.* )?[\w-]*(?:{'|'.join(SECRET_NAMES)})s?(?:=|:| =| :)(?: _ .*)?$"
#: Confidence of such seed patterns; others earn theirs.
SEED_CONFIDENCE = 0.9
#: Characters without which no match of the other kinds exists.
DIGIT = "[0-9]"
#: Runs of identifier characters with a digit or an at sign (four digits or an at sign in all) that may be identifiers.
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"

#: Characters before and after a span that its lexical patterns are taken from.
CONTEXT = 64
#: Distinct seeds that a lexical pattern needs, the confidence of patterns that score, and that of instances that count.
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.5
ACCEPT = 0.8


def luhn(digits: str) -> Column:
    """Whether the string of digits has a correct check digit."""
    return F.expr(
        f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + case when i % 2 = 1 then cast(substring(reverse({digits}), i, 1) as int)"
        f" else cast(substring(reverse({digits}), i, 1) as int) * 2 - if(substring(reverse({digits}), i, 1) > '4', 9, 0) end) % 10 = 0"
    )


def raw_spans(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A row for each match of a pattern, and one of kind '' for each row of docs: _row, keep, kind, start, end, token, left, right.

    A text is cut by each pattern into matches and the gaps between them; the running sum of their lengths gives the places.
    left and right are up to CONTEXT characters around a match, over the two matches before it and the one behind.
    """
    text = F.col("_text")
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    searched = PATTERNS | {"candidate": CANDIDATE}
    none = F.array().cast("array<string>")
    maybe = lambda kind: F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(DIGIT) | F.contains(text, F.lit("@"))
    matched = rows.select("*", *[F.when(maybe(kind), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_m_{kind}") for kind, p in searched.items()])

    def pieces(kind: str, pattern: str) -> Column:
        gap = lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -CONTEXT, CONTEXT).alias("tail"), F.substring(g, 1, CONTEXT).alias("head"))
        gaps = F.when(F.size(f"_m_{kind}") > 0, F.transform(F.split(text, pattern, -1), gap))
        return F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), F.col(f"_m_{kind}").alias("tokens"))

    own = F.from_json(F.lit('{"kind": ""}'), "kind string, gaps array<struct<n:int,tail:string,head:string>>, tokens array<string>")
    found = F.filter(F.array(*[pieces(kind, p) for kind, p in searched.items()]), lambda x: F.size(x["tokens"]) > 0)
    by_kind = matched.select(*keep, "_row", F.explode(F.concat(F.array(own), found)).alias("_k"))
    zipped = F.arrays_zip(F.col("_k.tokens").alias("token"), F.col("_k.gaps").alias("before"), F.expr("slice(_k.gaps, 2, greatest(size(_k.tokens), 1))").alias("after"))
    each = by_kind.select(*keep, "_row", F.col("_k.kind").alias("kind"), F.posexplode_outer(zipped).alias("_i", "_p")).where("_i is null or _p.token is not null")
    order = Window.partitionBy("_row", "kind").orderBy("_i")
    place = F.sum(F.col("_p.before.n") + F.length("_p.token")).over(order)
    earlier = [part for k in (2, 1) for part in (F.lag("_p.before.tail", k).over(order), F.lag("_p.token", k).over(order))]
    left = F.substring(F.concat_ws("", *earlier, "_p.before.tail"), -CONTEXT, CONTEXT)
    right = F.substring(F.concat_ws("", "_p.after.head", F.when(F.col("_p.after.n") < CONTEXT, F.lead("_p.token").over(order))), 1, CONTEXT)
    spans = each.withColumns({"end": place.cast("long"), "left": left, "right": right}).withColumn("start", F.col("end") - F.length("_p.token"))
    return spans.select("_row", *keep, "kind", "start", "end", F.col("_p.token").alias("token"), "left", "right")


def valid() -> Column:
    """Whether a match passes its kind's test; candidates and the rows' own entries pass theirs."""
    digits = F.regexp_replace("token", "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(F.col("kind") == "ip", F.col("token").rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
        .when(F.col("kind") == "card", F.when(n.between(13, 19), luhn("regexp_replace(token, '[^0-9]', '')")).otherwise(F.lit(False)))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .when(F.col("kind") == "candidate", (n >= 4) | F.contains(F.col("token"), F.lit("@")))
        .otherwise(F.lit(True))
    )


def lexical_patterns() -> Column:
    """The two words before a span; the word before with the one behind; the word that the span is attached to.

    Digits count as one, case, quotes and brackets do not.
    """
    side = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"[\"'`()\[\]{}<>]", " "), "[0-9]", "0"))
    word = lambda c: F.filter(F.split(side(c), r"\s+"), lambda w: w != "")
    before, after = word("left"), word("right")
    one, two = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2))
    attached = F.when(side("left").rlike(r"\S$"), F.concat(F.lit("0:"), one))
    return F.filter(
        F.array(attached, F.concat(F.lit("2:"), two, F.lit(" "), one), F.concat(F.lit("1:"), one, F.lit(" _ "), F.try_element_at(after, F.lit(1)))),
        lambda p: p.isNotNull(),
    )


def free_candidates(spans: DataFrame) -> DataFrame:
    """Candidates that no seed's span overlaps."""
    w = Window.partitionBy("_row").orderBy("start", "end")
    base = F.col("kind").isin(*KINDS)
    before = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    return spans.where("kind <> ''").withColumns({"_before": before, "_after": after}).where("kind = 'candidate' and coalesce(_before, 0) <= start and coalesce(_after, end) >= end").drop("_before", "_after")


def score_graph(edges: DataFrame) -> DataFrame:
    """(instance, kind) of the discovered instances, from edges (pattern, instance, seed kind or null).

    A pattern's confidence for a kind is the mean score of its distinct instances, where enough of them are seeds or
    accepted; that of a seed pattern is given. An instance's score is the noisy-or of its confident patterns. Seeds keep
    score 1. Scores only rise with what is accepted, and rounds end when none of them adds an instance. Both sums are
    pre-aggregated, and a pattern that many instances share joins as a key that adaptive execution splits.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("seed is not null").select("pattern", "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    open_edges = edges.where("seed is null").select("pattern", "instance")
    given = open_edges.select("pattern").distinct().where(F.col("pattern").rlike(SEED_PATTERN)).select("pattern", F.lit(SECRET).alias("kind"), F.lit(SEED_CONFIDENCE).alias("c"))
    known, before = seeds, 0
    while True:
        confident = known.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("m")).where(F.col("m") >= MIN_SEEDS)
        confident = confident.join(sizes, "pattern").withColumn("c", F.col("s") / (F.col("n") + 1)).where(F.col("c") >= MIN_CONFIDENCE).select("pattern", "kind", "c")
        confident = confident.unionByName(given).groupBy("pattern", "kind").agg(F.max("c").alias("c"))
        scores = open_edges.join(confident, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("score"))
        scores = materialise(compact(scores.where(F.col("score") >= ACCEPT)))
        if (accepted := scores.count()) == before:
            return scores.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        before = accepted
        known = seeds.unionByName(open_edges.join(scores, "instance").select("pattern", "instance", "kind", "score"))


def find_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each span, and one of kind '' for each row of docs: _row, keep, kind, start, end, base (from the patterns or discovered)."""
    spans = materialise(raw_spans(docs, keep).where(valid()))
    instance = F.lower(F.regexp_replace("token", r"^[^\w@+]+|[^\w]+$", ""))
    occurrences = free_candidates(spans).withColumn("seed", F.lit(None).cast("string")).unionByName(spans.where(F.col("kind").isin(*KINDS)).withColumn("seed", F.col("kind")))
    edges = materialise(compact(occurrences.select(instance.alias("instance"), "seed", F.explode(lexical_patterns()).alias("pattern")).distinct()))
    base = spans.where("kind <> 'candidate'").select("_row", *keep, "kind", "start", "end", F.col("kind").isin(*KINDS).alias("base"))
    if edges.where("seed is null").isEmpty():
        return base
    found = small(score_graph(edges))
    discovered = free_candidates(spans).drop("kind").withColumn("instance", instance).join(found, "instance")
    return base.unionByName(discovered.select("_row", *keep, "kind", "start", "end", F.lit(False).alias("base")))


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null or empty text has no spans (the digest is that of the empty string). Kinds may overlap each other. Repeated rows
    give a row each; other columns are not read. A discovered span takes the kind of its best patterns; the kinds are those of
    the base, and secrets, which stand last. All spans beyond the base come from the graph.
    """
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind"))
    span = F.when(F.col("kind") != "", F.struct(rank.alias("r"), "start", F.col("end"), F.col("kind"), F.col("base")))
    written = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.count(F.when((F.col("kind") == kind) & F.col("base"), 1)).alias(f"n_{kind}")
    rows = find_spans(docs).groupBy("_row", "doc_id").agg(*map(count, KINDS), F.collect_list(span).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    return rows.select("doc_id", *[f"n_{kind}" for kind in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("s")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars (if there is one) counted anew.

    Of spans that overlap, the first stays whole and the others are cut off with it. Rows are met by doc_id and a digest of
    their text, so repeated rows are redacted alike; a null text stays null.
    """
    return carry(docs, ("doc_id", "text", "n_chars"), _redact)


def _redact(docs: DataFrame) -> DataFrame:
    keyed = docs.withColumns({"_pii_id": F.col("doc_id").cast("string"), "_pii_digest": F.xxhash64("doc_id", "text")})
    key = ("_pii_id", "_pii_digest")
    w = Window.partitionBy(*key).orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = find_spans(keyed.select(*key, "text"), key).where("kind <> ''").select(*key, "kind", "start", "end").distinct()
    spans = materialise(compact(spans.withColumn("reached", F.coalesce(F.max("end").over(w), F.lit(0))).where("end > reached")))
    cut = F.struct(F.greatest("start", "reached").alias("start"), "end", "reached", "kind")
    cuts = spans.groupBy(F.col("_pii_id").alias("_cut_id"), F.col("_pii_digest").alias("_cut_digest")).agg(F.array_sort(F.collect_list(cut)).alias("_cuts"))
    cuts = F.broadcast(cuts) if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else cuts  # their spans are counted, not their rows
    joined = keyed.join(cuts, (F.col("_pii_digest") == F.col("_cut_digest")) & F.col("_pii_id").eqNullSafe(F.col("_cut_id")), "left")
    pieces = F.expr("transform(_cuts, c -> concat(substring(text, cast(c.reached + 1 as int), cast(c.start - c.reached as int)), '[', upper(c.kind), ']'))")
    rest = F.expr("substring(text, cast(element_at(_cuts, -1).end + 1 as int))")
    changed = {"text": F.concat(F.array_join(pieces, ""), rest)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns({c: F.when(F.col("_cuts").isNull(), F.col(c)).otherwise(x) for c, x in changed.items()}).select(*docs.columns)
