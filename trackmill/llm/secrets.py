"""Secret scanning with a random forest that removes false positives.

Candidates are runs of 12 key-like characters or more with a digit in them, runs of 16 letters or more whose case
changes often, and values assigned to a name that sounds secret. A forest sees a candidate's length, its mix of
characters and their transitions, how much of it words of a dictionary cover, the path (source) it stands in and the
words beside it. It is trained on labelled findings: given ones, or those that labelling rules are sure of in this
table (known key formats and values assigned to secret names against plain numbers, addresses and wordy runs); the
rest are left unlabelled and the forest decides. Whether a format is known or a name sounds secret is evidence for
labels alone: the forest does not see it, and so cannot repeat the rules but has to find what their findings have in
common. held_out tells how well it does on labelled findings that it was not fitted on. The dictionary and the letter
transitions come from all documents: words and pairs of letters are counted by Spark, and the words that a finding may
hold are joined to it, so the dictionary has no limit. Only the forest is fitted on a bounded sample, of labelled
findings; candidates come from every text, whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.sampling import smallest
from trackmill.llm.tokens import slices, small_batches
from trackmill.shared import materialize

#: Findings that the forest is fitted on, at most.
FIT_FINDINGS = 20_000
#: Words that stand this often in all documents are of the dictionary.
WORD_LEAST = 2
#: A word stands by itself: letters beside digits, underscores, plus or equals signs are pieces of key-like runs.
STANDING = r"(?<![\p{L}\p{N}_+=])\p{L}{3,}+(?![\p{N}_+=])"
#: Log probability of a transition that was not seen, and the least of any.
RARE = -8.0
FIT_LEAST = 10
CONTEXT = 32
LETTERS = re.compile(r"[^\W\d_]{3,}")
#: Pieces of findings handed on at once.
PIECES = 1 << 17
NAME = re.compile(r"[\w-]")
RUN = re.compile(r"[A-Za-z0-9_\-+/=.~]{12,}")
ASSIGNED = re.compile(r"""[:=]\s{0,3}["']?([^\s"'<>]{6,})""")
SECRET_NAME = re.compile(r"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)[\w-]*[\"'\]]?\s{0,3}(?:is\s{0,2})?[:=]?\s{0,3}[\"']?$", re.IGNORECASE)
KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})$")
FINDING = "key long, start long, stop long, match string, before string, after string, path string"
FEATURES = ["length", "digits", "uppers", "lowers", "others", "distinct", "entropy", "class_changes", "transition", "covered", "longest_letters", "hex", "assigned", "quoted", "glued", "path_config", "path_test", "words_near", "numbers_near", "all_digits", "dotted"]
#: What labels rest on, and the forest does not see.
EVIDENCE = ["known_format", "secret_name"]


def mixed(run: str) -> bool:
    """Whether a run has 16 letters or more and changes from lower to upper case four times or more."""
    return sum(map(str.isalpha, run)) >= 16 and sum(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False)) >= 4


def named_before(text: str, at: int) -> str:
    """The 40 characters before a place, or as many more as the name that they begin in is long."""
    begin = max(0, at - 40)
    while begin and NAME.fullmatch(text[begin - 1]):
        begin -= 1
    return text[begin:at]


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of candidates in a text, in code points, in order; one that lies in another is left out."""
    found = [m.span() for m in RUN.finditer(text) if any(c.isdigit() for c in m[0]) or KNOWN.match(m[0]) or mixed(m[0])]
    if "=" in text or ":" in text:
        found += [m.span(1) for m in ASSIGNED.finditer(text) if SECRET_NAME.search(named_before(text, m.start(1)))]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        # NAME=value is one run: the value alone is the finding.
        if out and b <= out[-1][1] and a > out[-1][0] and SECRET_NAME.search(text[max(0, out[-1][0] - 8) : a]):
            out[-1] = (a, b)
        elif not out or b > out[-1][1]:
            out.append((a, b))
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Rows (key, start, stop, match, before, after, path) of all candidates of all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for k, t, p in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("path").to_pylist(), strict=True):
                rows += [(k, a, b, t[a:b], t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT], p) for a, b in candidates(t or "")]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "start", "stop", "match", "before", "after", "path"])

    small_batches(docs.sparkSession)
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), where.alias("path")).mapInArrow(scan, FINDING)


def pieces(match: str, before: str, after: str) -> Iterator[str]:
    """All that may be a word of the dictionary in a match or beside it: runs of 3 to 16 letters in it, whole longer runs, whole words beside it."""
    for run in LETTERS.findall(match.lower()):
        if len(run) > 16:
            yield run
        for i in range(len(run) - 2):
            for j in range(i + 3, min(i + 16, len(run)) + 1):
                yield run[i:j]
    yield from LETTERS.findall(f"{before} {after}".lower())


class Language:
    """The letter transitions of ordinary text: log probability of the second of two letters; what is left out is RARE."""

    def __init__(self, pairs: dict[str, float]):
        self.pairs = pairs

    def transition(self, s: str) -> float:
        """Mean log probability of the transitions between characters."""
        s = s.lower()
        return sum(self.pairs.get(s[i : i + 2], RARE) for i in range(len(s) - 1)) / max(len(s) - 1, 1)

    def covered(self, s: str, words: set[str]) -> float:
        """Share of characters in words, longest first from the left."""
        s, at, n = s.lower(), 0, 0
        sizes = sorted({len(w) for w in words if len(w) > 2}, reverse=True)
        while at < len(s):
            for size in sizes:
                if s[at : at + size] in words:
                    at, n = at + size, n + size
                    break
            else:
                at += 1
        return n / max(len(s), 1)

    def features(self, match: str, before: str, after: str, path: str | None, words: list[str] | None) -> list[float]:
        """The values of FEATURES, then of EVIDENCE."""
        known = set(words or ())
        n = len(match)
        counts = Counter(match)
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in match]
        share = Counter(kinds)
        path = (path or "").lower()
        near = f"{before} {after}"
        return [
            float(n), share["d"] / n, share["u"] / n, share["l"] / n, share["o"] / n, len(counts) / n,
            -sum(c / n * math.log2(c / n) for c in counts.values()),
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
            self.transition(match), self.covered(match, known),
            float(max((len(x) for x in re.findall(r"[^\W\d_]+", match)), default=0)),
            float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", match))), float(bool(re.search(r"[:=]\s{0,3}[\"']?$", before))),
            float(before[-1:] in ("'", '"', "`")), float(before[-1:].isalnum() or after[:1].isalnum() or after[:1] == "@" or before[-1:] == "@"),
            float(bool(re.search(r"conf|\.env|secret|deploy|\.ya?ml|\.ini", path))), float(bool(re.search(r"test|example|sample|doc", path))),
            float(sum(w in known for w in LETTERS.findall(near.lower()))), float(sum(c.isdigit() for c in near)),
            float(match.isdigit()), float(match.count(".")),
            float(bool(KNOWN.match(match))), float(bool(SECRET_NAME.search(before))),
        ]


def rule_label(f: dict[str, float]) -> float | None:
    """Label of a finding that rules are sure of, else None."""
    if f["known_format"] or (f["secret_name"] and f["digits"] > 0.05 and f["length"] >= 8 and f["entropy"] >= 2.5 and f["covered"] < 0.5):
        return 1.0
    if not f["secret_name"] and (f["all_digits"] or f["covered"] >= 0.5 or (f["dotted"] >= 2 and f["length"] < 40) or f["digits"] + f["others"] > 0.99):
        return 0.0
    return None


def with_words(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Findings with those words of the dictionary that stand in or beside each (words, null without any), by joins."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for k, *what in zip(*(batch.column(c).to_pylist() for c in ("content", "match", "before", "after")), strict=True):
                for piece in pieces(*what):
                    rows.append((k, piece))
                    if len(rows) == PIECES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["content", "word"])
                        rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[], []], kinds, strict=True)], ["content", "word"])

    named = found.withColumn("content", F.xxhash64("match", "before", "after"))
    parts = named.select("content", "match", "before", "after").dropDuplicates(["content"]).mapInArrow(cut, "content long, word string").distinct()
    words = counts.where(F.col("count") >= WORD_LEAST).select("word")
    return named.join(parts.join(words, "word").groupBy("content").agg(F.collect_list("word").alias("words")), "content", "left").drop("content")


def described(found: DataFrame, language: Language, counts: DataFrame) -> DataFrame:
    """Findings with features and evidence (f_) and the label of the rules."""
    names = [*FEATURES, *EVIDENCE]
    shared = found.sparkSession.sparkContext.broadcast(language)  # under e^8 pairs for each letter of the alphabets

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.features(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("match", "before", "after", "path", "words")), strict=True)]
            labels = [rule_label(dict(zip(names, r, strict=True))) for r in rows]
            batch = batch.drop_columns(["words"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.float64()), *(pa.array(np.array(rows).reshape(-1, len(names))[:, i]) for i in range(len(names)))], [*batch.schema.names, "rule", *(f"f_{c}" for c in names)])

    return with_words(found, counts).mapInArrow(describe, ", ".join([FINDING, "rule double", *(f"f_{c} double" for c in names)]))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, count) of all standing words of all documents, in lower case."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(STANDING), F.lit(0))).alias("word"))
    return materialize(words.groupBy("word").count(), "secret-words")


def learn_language(counts: DataFrame) -> Language:
    """The transitions of all pairs of letters in all words.

    Pairs that are RARE or below are not collected, as they count as RARE: each letter has fewer than e^8 others.
    """
    two = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    pairs = counts.select(F.explode(two).alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("n")).withColumn("first", F.substring("pair", 1, 1))
    firsts = pairs.groupBy("first").agg(F.sum("n").alias("of"))
    shares = pairs.join(firsts, "first").select("pair", F.log((F.col("n") + 0.1) / (F.col("of") + 3)).alias("share"))
    return Language({r["pair"]: r["share"] for r in shares.where(F.col("share") > RARE).collect()})


def _labelled(docs: DataFrame, key: str, text: str, path: str | None, labelled: DataFrame | None) -> tuple[DataFrame, DataFrame, VectorAssembler]:
    """All candidates described, the bounded sample of labelled ones (label, turn, features), and the assembler of features."""
    found = materialize(find(docs, key, text, path), "secret-candidates")
    counts = count_words(docs, text)
    language = learn_language(counts)
    rows = materialize(described(found, language, counts), "secret-features")
    columns = [f"f_{c}" for c in FEATURES]
    known = rows.where("rule is not null").select(F.col("rule").alias("label"), F.xxhash64("match", "before", "after").alias("turn"), *columns)
    if labelled is not None:
        given = labelled.select(F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), "match", "before", "after", "path", F.col("label").cast("double").alias("given"))
        named = described(given.drop("given"), language, counts).join(given.select("match", "before", "after", "given").distinct(), ["match", "before", "after"])
        known = known.unionByName(named.select(F.col("given").alias("label"), F.xxhash64("match", "before", "after").alias("turn"), *columns))
    # The same number of either label at most, those with the smallest hashes; copies count once.
    known = materialize(known.dropDuplicates(["label", "turn"]), "secret-known")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    few = [smallest(known.where(F.col("label") == x), F.pmod("turn", F.lit(2**32)), FIT_FINDINGS // 2, totals.get(x, 0), "turn") for x in (0.0, 1.0)]
    return rows, materialize(few[0].unionByName(few[1]), "secret-sample"), VectorAssembler(inputCols=columns, outputCol="features")


def _forest(sample: DataFrame, assembler: VectorAssembler) -> Callable[[DataFrame], DataFrame] | None:
    """What adds a score to described findings; None with fewer than FIT_LEAST of either label."""
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < FIT_LEAST:
        return None
    forest = RandomForestClassifier(labelCol="label", numTrees=40, maxDepth=7, featureSubsetStrategy="sqrt", seed=11).fit(assembler.transform(sample))
    return lambda rows: forest.transform(assembler.transform(rows)).withColumn("score", vector_to_array("probability")[1])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows (key, start, stop, match, score) of the candidates that the forest takes for secrets (places in code points).

    labelled: findings with columns match, before, after, path and label (1: secret), beside those of the rules. With
    fewer than FIT_LEAST distinct findings of either label nothing can be fitted, and the rules' own secrets are
    returned (score 1). A score equal to threshold is a secret's. Null and empty texts have none; repeated rows have
    theirs each; null keys are kept as null. Other columns are not read.
    """
    rows, sample, assembler = _labelled(docs, key, text, path, labelled)
    score = _forest(sample, assembler)
    if score is None:
        return rows.where("rule = 1").select(F.col("key").alias(key), "start", "stop", "match", F.lit(1.0).alias("score"))
    return score(rows).where(F.col("score") >= threshold).select(F.col("key").alias(key), "start", "stop", "match", "score")


def held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows (label, found, n): of a quarter of the labelled findings (by hash), how many a forest fitted on the others finds. No rows where nothing can be fitted."""
    _, sample, assembler = _labelled(docs, key, text, path, labelled)
    quarter = F.pmod(F.xxhash64("turn"), F.lit(4)) == 0
    score = _forest(sample.where(~quarter), assembler)
    asked = sample.where(quarter) if score else sample.limit(0).withColumn("score", F.lit(0.0))
    return (score(asked) if score else asked).groupBy("label", (F.col("score") >= threshold).alias("found")).agg(F.count("*").alias("n"))


def redact_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", mark: str = "<secret>", **how) -> DataFrame:
    """docs with each secret's characters replaced by mark; every row stays.

    A finding belongs to the rows with its key in whose text it stands where it was found; rows with a null key are
    left as they are.
    """
    found = scan_secrets(docs, key, text, path, **how)
    cuts = found.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("start", "stop", "match"))).alias("__cuts"))
    joined = docs.join(cuts.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left")
    here = F.filter("__cuts", lambda x: F.substring(F.col(text), (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int")) == x["match"])
    joined = joined.withColumn("__cuts", here)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("__cuts", F.greatest(i, F.lit(1)))["stop"])
    pieces = F.transform("__cuts", lambda x, i: F.concat(F.substring(F.col(text), (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), F.lit(mark)))
    tail = F.substring(F.col(text), (F.element_at("__cuts", -1)["stop"] + 1).cast("int"), F.length(text))
    cut = F.when(F.coalesce(F.size("__cuts"), F.lit(0)) <= 0, F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(*(cut.alias(c) if c == text else docs[c] for c in docs.columns))
