"""Personal data by candidate generation and gradient-boosted trees, in DataFrame functions alone.

Rules find base spans (kinds email, ip, card, phone), which always stay. Wider generators propose more spans, which may
overlap each other and the base ones: names around an @, a bracketed (at) or a spelled-out "at ... dot", addresses with
bracketed dots, and any run of seven digits or more with separators, which may stand for a card and a phone number at
once. A candidate that fails its kind's validity (Luhn, parts up to 255, a domain with a dot, a number that stands
free) is a look-alike. Boosted trees are fitted on all of them, base spans against look-alikes, by format and
context. Features are taken from a form in which base and other spans are written alike (no leading plus, @ and dots
for their spellings) and hold none of the rules' own tests, so the trees can take a span that the rules miss. For
each kind a threshold is calibrated on candidates left out of the fit: precision PRECISION against look-alikes, and no
lower than all but TAIL of the base spans. A valid candidate at or above it is added unless it overlaps a base span or
an added one that starts before it.

Every text is scanned whole by regular expressions without nested backtracking: quantifiers are possessive, and
a match may begin inside a run only where the match before it ended, so time is in proportion to length.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.shared import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base rules. Possessive forms of the plain patterns, with the same leftmost non-overlapping matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTES = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"
#: The wide generators.
AT = r"(?: ?[\[({] ?(?:(?i:at)|@) ?[\])}] ?| ?@ ?)"
DOT = r"(?:\.| ?[\[({] ?(?:(?i:dot)|\.) ?[\])}] ?| (?i:dot) )"
AROUND_AT = rf"(?:\G|(?<![\p{{L}}0-9._%+-]))[\p{{L}}0-9._%+-]++(?:{AT}[\p{{L}}0-9-]++(?:{DOT}[\p{{L}}0-9-]++)*+| (?i:at) [\p{{L}}0-9-]++(?: (?i:dot) [\p{{L}}0-9-]++)++)"
DOTTED = r"(?<![0-9])[0-9]++(?:(?: ?[\[({] ?(?:(?i:dot)|\.) ?[\])}] ?| \. |\.)[0-9]++){3}+"
DIGITS = r"[+(]{0,2}+[0-9](?:[ ./()-]{0,2}+[0-9]){6,}+"
#: Steps of a score between 0 and 1 at which a threshold may lie.
STEPS = 10_000
#: Of either label, needed to fit at all; with fewer, only base spans are returned.
FIT_LEAST = 20
#: Precision on left-out candidates that a threshold has to reach, and the share of base spans that may lie below it.
PRECISION, TAIL = 0.98, 0.05
CONTEXT = 24


def _found(text: Column, guard: Column, pattern: str, name: str) -> Column:
    """Array of (generator, text before, match) of all matches, and a last one with the rest of the text and a null match."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    rows = F.transform(pairs, lambda x: F.struct(F.lit(name).alias("gen"), x["piece"].alias("piece"), x["match"].alias("match")))
    return F.when(guard, rows).otherwise(F.array().cast("array<struct<gen:string,piece:string,match:string>>"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((n - i) % 2 == 1, F.pmod(F.substring(digits, i, F.lit(1)).cast("int") * 2 - 1, F.lit(9)) + F.when(F.substring(digits, i, F.lit(1)) == "0", -8).otherwise(1)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return (n > 0) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, key, kind, start, stop, base, valid, match, digits, before, after) of all candidates; one with a null kind for each document.

    start and stop are in code points. base: a span of the rules. Other candidates come from the wide generators, and
    those that are not valid are look-alikes.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    digit = t.rlike("[0-9]")
    at = t.contains("@")
    spelled = t.rlike(r"(?i)[\[({] ?(?:at|dot|\.) ?[\])}]|\bdot\b")
    found = F.concat(
        F.array(F.struct(F.lit("").alias("gen"), F.lit("").alias("piece"), F.lit("").alias("match"))),
        _found(t, at, EMAIL, "email"),
        _found(t, digit, IP, "ip"),
        _found(t, digit, CARD, "card"),
        _found(t, digit & t.contains("+"), PHONE, "phone"),
        _found(t, at | spelled, AROUND_AT, "wide_at"),
        _found(t, digit & (spelled | t.contains(" . ")), DOTTED, "wide_dots"),
        _found(t, digit, DIGITS, "wide_digits"),
    )
    # The row number is given before the explosion, which copies it.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = numbered.select("row", "key", F.posexplode(found).alias("i", "x"))
    rows = rows.select("row", "key", "i", F.col("x.gen").alias("gen"), F.col("x.match").alias("match"), F.length("x.piece").alias("skip"), F.right(F.col("x.piece"), F.lit(CONTEXT)).alias("before"), F.left(F.col("x.piece"), F.lit(CONTEXT)).alias("head"))
    order = Window.partitionBy("row", "gen").orderBy("i")
    placed = rows.withColumn("stop", F.sum(F.col("skip") + F.coalesce(F.length("match"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("after", F.coalesce(F.lead("head").over(order), F.lit(""))).where("match is not null")
    placed = placed.withColumn("start", F.col("stop") - F.length("match")).withColumn("digits", F.regexp_replace("match", "[^0-9]", ""))
    n = F.length("digits")
    luhn = _luhn(F.when(n <= 19, F.col("digits")).otherwise(""))
    # A number that is a piece of a longer run of letters, digits or signs is none of its own.
    free = ~F.col("before").rlike(r"[\p{L}\p{N}_=+.:/-]$") & ~F.col("after").rlike(r"^[\p{L}\p{N}_=:/-]")
    one = lambda kind, valid, base=False: F.struct(F.lit(kind).alias("kind"), F.lit(valid).alias("valid") if isinstance(valid, bool) else valid.alias("valid"), F.lit(base).alias("base"))
    kinds = (
        F.when(F.col("gen") == "", F.array(one(None, True)))
        .when(F.col("gen") == "email", F.array(one("email", True, True)))
        .when(F.col("gen") == "ip", F.array(F.when(F.col("match").rlike(BYTES), one("ip", True, True)).otherwise(one("ip", False))))
        .when(F.col("gen") == "card", F.when(n.between(16, 19), F.array(F.when(luhn, one("card", True, True)).otherwise(one("card", False)))))
        .when(F.col("gen") == "phone", F.when(n.between(8, 15), F.array(one("phone", True, True))))
        .when(F.col("gen") == "wide_at", F.array(one("email", _plain(F.col("match")).rlike(r"@[^@]*\.\p{L}{2,}$"))))
        .when(F.col("gen") == "wide_dots", F.array(one("ip", _plain(F.col("match")).rlike(BYTES))))
        .otherwise(F.array_compact(F.array(F.when(n.between(13, 19), one("card", luhn)), F.when(n.between(7, 15), one("phone", free)))))
    )
    named = placed.select("row", "key", "start", "stop", "match", "digits", "before", "after", F.explode(kinds).alias("x"))
    return named.select("row", "key", F.col("x.kind").cast("string").alias("kind"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("x.base").alias("base"), F.col("x.valid").alias("valid"), "match", "digits", "before", "after")


def _plain(match: Column) -> Column:
    """A span with @ and dots for their spellings and without a plus or zeros before a number, so that base and other spans are written alike."""
    at = F.regexp_replace(match, r" ?[\[({] ?(?:(?i:at)|@) ?[\])}] ?| ?@ ?|(?<=[\p{L}0-9]) (?i:at) (?=[\p{L}0-9])", "@")
    dots = F.regexp_replace(at, r" ?[\[({] ?(?:(?i:dot)|\.) ?[\])}] ?|(?<=[\p{L}0-9]) (?i:dot) (?=[\p{L}0-9])| \. ", ".")
    return F.regexp_replace(dots, r"^(?:\+|00(?=[1-9]))", "")


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context features of candidates, of their plain form; none is a test of the rules."""
    before, after = F.lower("before"), F.lower("after")
    m = F.col("plain")
    d = F.regexp_replace(m, "[^0-9]", "")
    flag = lambda c: c.cast("double")
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    columns = {
        **{f"is_{k}": flag(F.col("kind") == k) for k in KINDS},
        "length": F.length(m).cast("double"),
        "digit_count": F.length(d).cast("double"),
        "digit_share": F.length(d) / F.length(m),
        "groups": count(m, "[0-9]+"),
        "longest_group": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "separators": count(m, "[ ()/.-]"),
        "dots": count(m, r"\."),
        "letters": count(m, r"\p{L}"),
        "lead": F.coalesce(F.substring(d, 1, 1).try_cast("double"), F.lit(-1.0)),
        "glued_before": flag(before.rlike(r"[\p{L}\p{N}_=+.:/-]$")),
        "glued_after": flag(after.rlike(r"^[\p{L}\p{N}_=:/-]")),
        "quoted": flag(before.rlike("[\"'`]$")),
        "mail_word": flag(before.rlike("mail|contact|write")),
        "call_word": flag(before.rlike("phone|tel|call|fax|mobile")),
        "card_word": flag(before.rlike("card|visa|credit|pay")),
        "net_word": flag(before.rlike(r"\bip\b|host|server|addr")),
        "secret_word": flag(before.rlike("pass|token|key|secret|sha|hash|id *[=:#]?$")),
        "digits_near": count(F.concat(before, F.lit(" "), after), "[0-9]"),
    }
    return found.withColumn("plain", _plain(F.col("match"))).select("*", *(c.alias(f"f_{k}") for k, c in columns.items())).drop("plain"), [f"f_{k}" for k in columns]


def _overlaps(found: DataFrame, by: str, follow: bool) -> Column:
    """Whether a span meets one with the flag by that starts before it (or, with follow, after it)."""
    order = Window.partitionBy("row").orderBy("start", F.desc("stop"), "kind")
    met = F.coalesce(F.max(F.when(F.col(by), F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False))
    if follow:
        back = Window.partitionBy("row").orderBy(F.desc("start"), "stop", F.desc("kind"))
        met = met | F.coalesce(F.min(F.when(F.col(by), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)) < F.col("stop"), F.lit(False))
    return met


def added(found: DataFrame) -> DataFrame | None:
    """Candidates beyond the base spans that the trees select; None where there are too few of either label to fit them."""
    named = found.where("kind is not null")
    # A wide candidate that lies on a base span is that span once more: it is not an example of the rest.
    fresh = named.withColumn("met", _overlaps(named, "base", follow=True)).where("base or not met")
    # Copies of a candidate count once, so that a group of copies do not outweigh the rest.
    known = fresh.where("base or not valid").select("kind", "match", "before", "after", F.col("base").cast("double").alias("label")).withColumn("turn", F.xxhash64("kind", "match", "before", "after"))
    known = materialize(known.dropDuplicates(["turn", "label"]), "pii-known")
    # All of them are used: a hash's first fold calibrates, the others fit.
    told, names = features(known)
    sample = materialize(told.select("kind", F.pmod(F.xxhash64("turn"), F.lit(4)).alias("fold"), "label", *names), "pii-labelled")
    sizes = {r["label"]: r["count"] for r in sample.where("fold != 0").groupBy("label").count().collect()}
    if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < FIT_LEAST:
        return None
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=7).fit(assembler.transform(sample.where("fold != 0")))
    scored = lambda df: model.transform(assembler.transform(df)).withColumn("score", vector_to_array("probability")[1])
    # Counts by step of the score: a row for each, however many candidates there are.
    steps = scored(sample.where("fold = 0")).groupBy("kind", F.floor(F.col("score") * STEPS).alias("step")).agg(F.sum("label").cast("long").alias("right"), F.count("*").alias("all"))
    down = Window.partitionBy("kind").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    judged = steps.withColumn("precision", F.sum("right").over(down) / F.sum("all").over(down))
    limits = judged.groupBy("kind").agg(F.min(F.when(F.col("precision") >= PRECISION, F.col("step"))).alias("t"), F.percentile("step", F.lit(TAIL), F.col("right")).alias("tail"))
    threshold = {r["kind"]: max(r["t"], r["tail"]) / STEPS for r in limits.where("t is not null and tail is not null").collect()}
    if not threshold:
        return None
    rest, _ = features(fresh.where("not base and valid"))
    limit = F.create_map(*[F.lit(x) for pair in threshold.items() for x in pair])
    chosen = scored(rest).where(F.col("score") >= limit[F.col("kind")]).select(*found.columns).withColumn("any", F.lit(True))
    return chosen.withColumn("met", _overlaps(chosen, "any", follow=False)).where("not met").select(*found.columns)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, kind, start, stop, base, match, ...) of all spans found, and one row with a null kind for each document.

    Null texts count as empty. Repeated rows have their spans each. Other columns are not read. With fewer than
    FIT_LEAST distinct base spans or look-alikes to fit on, the base spans are all.
    """
    found = materialize(spans(docs, key, text), "pii-candidates")
    more = added(found)
    kept = found.where("base or kind is null")
    return kept if more is None else kept.unionByName(more)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document: counts of base spans by kind, the digest of their list, the list of all spans."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    item = F.struct(place[F.col("kind")].alias("place"), "start", "stop", "kind", "base")
    listed = found.groupBy("row", "key").agg(*(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS), F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("all"))
    joined = lambda rows: F.concat_ws(",", F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))
    return listed.select(F.col("key").alias(key), *(f"n_{k}" for k in KINDS), F.sha2(joined(F.filter("all", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every span found replaced by its kind in angle brackets; keys have to be unique.

    Spans that overlap are replaced from the first start on, by the kind of the earliest.
    """
    found = find_pii(docs.select(key, text), key, text).where("kind is not null")
    order = Window.partitionBy("row").orderBy("start", F.desc("stop"))
    free = found.withColumn("over", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("from", F.greatest("start", F.coalesce("over", "start"))).where("stop > from")
    cuts = free.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("from", "stop", "kind"))).alias("cuts")).withColumnRenamed("key", "__key")
    joined = docs.select(key, text).join(cuts, F.col(key) == F.col("__key"), "left")
    pieces = F.transform(F.col("cuts"), lambda x, i: F.concat(F.substring(F.col(text), F.when(i == 0, F.lit(0)).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["stop"].cast("int")) + 1, (x["from"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["stop"])).cast("int")), F.lit("<"), x["kind"], F.lit(">")))
    tail = F.substring(F.col(text), F.element_at("cuts", -1)["stop"].cast("int") + 1, F.length(text))
    return joined.select(key, F.when(F.col("cuts").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), tail)).alias(text))
