"""Secret scan: pattern candidates, and a random forest that removes false positives.

Everything is DataFrame functions and the JVM's own forest.  A candidate is a
run of at least LEAST key characters in a word, or the value, of any length and
characters, that a credential's name is assigned.  Its features are its length,
the share of neighbouring characters of different kinds, the share of digits,
capitals and different characters, how much of it the corpus' own frequent words
cover, the document's path, and the words around it.  The forest is trained
from labelled findings; where none are given, documented formats label what they
decide, and candidates that they leave open are not learned from.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored

LEAST = 16
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: The bound of the dictionary, and of the training sample for each label.
DICTIONARY, SAMPLE = 2000, 5000
TREES, DEPTH, HASHED = 20, 6, 256
MEASURES = ["length", "transitions", "digits", "capitals", "different", "coverage", "assigned"]
#: The end of a credential's name, what may close it, and the sign that assigns to it.
KEY = "(?i)(?:pass(?:word|wd|phrase|code)|pwd|(?<![a-z])pass|secret|token|credentials?|(?:api|access|account|auth|private|secret|shared|signing|encryption|master|license)[_.-]?key)[0-9]*"
CLOSE, ASSIGN = "[\"'`\\\\\\])]*", "(?::=|=>|={1,3}|(?<!:):(?!:))"
#: A value: quoted, or all up to a closing sign at the end of the word or the next name that is assigned to.
VALUE = "(\\\\*\"[^\"]+\"|\\\\*'[^']+'|[^\\s]+?(?=[\"'`,;)\\]}>]*$|[&;,][\"']?[A-Za-z_][\\w.-]*[\"']?[=:]))"
NAMED, INSIDE = f"{KEY}{CLOSE}", f"{KEY}{CLOSE}{ASSIGN}"
#: Published forms of keys: whole candidates, and parts of dotted tokens by what stands before them.
PUBLISHED = "^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|pypi-AgE[A-Za-z0-9_-]{50,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{64}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|eyJ[A-Za-z0-9_-]{13,})$"
DOTTED = "(?:\\beyJ[A-Za-z0-9_-]+\\.(?:eyJ[A-Za-z0-9_-]+\\.)?|\\bSG\\.(?:[A-Za-z0-9_-]{22}\\.)?)$"
#: What is assigned in place of a secret, and what only refers to one.
STAND_IN = "(?i)^(?:none|null|nil|true|false|undefined|empty|string|str|text|bool|int|number|bytes|any|required|optional|changeme|example|placeholder|redacted|x{3,}|\\*+|\\.{3}|your[_-].*|<.*|\\$.*|\\{\\{.*|%\\(.*|%[a-z_]+%|(?:process\\.env|os\\.environ|os\\.getenv|getenv|env|config|self|this|settings|request|args|options|params)[.(\\[].*)$"
REFERS = "[(\\[{]|->|::|^[A-Za-z][A-Za-z0-9+.-]*://|^(?:~|\\.{0,2})/"


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that labels are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("candidate", pattern, "")) / F.length("candidate")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Candidates of all documents: doc_id, word, place in the word, candidate, the context before it, around, path."""

    def takes_value(own: Column, before: Column, earlier: Column) -> Column:
        ahead = F.concat_ws(" ", earlier, before)
        return own.rlike(f"{INSIDE}.") | ahead.rlike(f"{NAMED} ?{ASSIGN}$") | (own.rlike(f"^{ASSIGN}.") & ahead.rlike(f"{NAMED}$"))

    # Most texts assign to no credential; only in the others every word is looked at.
    named = F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(f"{NAMED}[ \\t\\n\\x0B\\f\\r]*{ASSIGN}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")).alias("path"), named.alias("named"), F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+").alias("words"))
    long_words = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: (F.length(F.get("words", k)) >= LEAST) | (F.col("named") & F.coalesce(takes_value(F.get("words", k), F.get("words", k - 1), F.get("words", k - 2)), F.lit(False))))
    around = F.transform(long_words, lambda k: F.struct(k.alias("word"), F.get("words", k).alias("own"), F.get("words", k - 1).alias("before"), F.get("words", k - 2).alias("earlier"), F.get("words", k + 1).alias("after")))
    words = rows.select("doc_id", "path", F.explode(around).alias("w")).select("doc_id", "path", "w.*")
    runs = F.regexp_extract_all("own", F.lit(f"({CANDIDATE})"), F.lit(1))
    names = F.concat_ws(" ", "earlier", "before")
    outside = F.when(names.rlike(f"{NAMED} ?{ASSIGN}$"), F.regexp_extract("own", f"^{VALUE}", 1)).when(names.rlike(f"{NAMED}$"), F.regexp_extract("own", f"^{ASSIGN}{VALUE}", 1)).otherwise("")
    values = F.transform(F.concat(F.regexp_extract_all("own", F.lit(f"{INSIDE}{VALUE}"), F.lit(1)), F.array(outside)), lambda v: F.regexp_replace(v, "^\\\\*[\"'`]+|\\\\*[\"'`]+$", ""))
    # Runs keep their places; a value that is a run is one candidate.
    extra = F.array_except(F.filter(values, lambda v: v != ""), runs)
    every = words.withColumn("all", F.concat(runs, extra))
    found = every.select("*", F.posexplode("all").alias("place", "candidate"))
    found = found.withColumn("same", F.size(F.filter(F.slice("all", 1, F.col("place")), lambda c: c == F.col("candidate"))) + 1)
    # What stands in the same word before the candidate belongs to its context.
    ahead = F.expr("substring_index(own, candidate, same)")
    context = F.concat(F.array(*(F.concat(F.lit(f"{name}:"), F.lower(F.coalesce(part, F.lit("")))) for name, part in (("own", ahead), ("before", F.col("before")), ("earlier", F.col("earlier")), ("after", F.col("after"))))), F.array(F.concat(F.lit("path:"), F.coalesce("path", F.lit("")))))
    # The value starts in this word: after the sign, or after a name or sign at the end of the words before.
    assigned = F.concat_ws(" ", F.coalesce("earlier", F.lit("")), F.coalesce("before", F.lit("")), ahead).rlike(f"{KEY}{CLOSE} ?{ASSIGN} ?[^ &;,]*$")
    return found.select("doc_id", "word", "place", "candidate", ahead.alias("ahead"), "before", "earlier", context.alias("context"), assigned.cast("double").alias("assigned"))


def frequent_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """Letter trigrams of the corpus' DICTIONARY most frequent words of three letters or more that occur twice at least, counted over all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text).cast("string")), "[^\\p{L}]+")).alias("entry")).where("length(entry) >= 3")
    counts = stored(words.groupBy("entry").count().where("count > 1"), "word-counts")
    # Only words of the highest powers of two that hold enough are ranked: one row for each power reaches the driver.
    powers = {r["power"]: r["n"] for r in counts.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.count("*").alias("n")).collect()}
    least, held = 0, 0
    for power in sorted(powers, reverse=True):
        least, held = power, held + powers[power]
        if held >= DICTIONARY:
            break
    top = counts.where(F.floor(F.log2("count")) >= least).orderBy(F.desc("count"), "entry").limit(DICTIONARY)
    return top.select(F.explode(_grams("entry")).alias("gram")).distinct()


def _grams(column: str) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - 2, F.lit(1))), lambda k: F.substring(F.col(column), k, F.lit(3)))
    return F.filter(grams, lambda gram: F.length(gram) == 3)


def features(found: DataFrame, grams: DataFrame) -> DataFrame:
    """The measures of every candidate; `grams` has at most DICTIONARY words' trigrams."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), "[^0aA]+", "-")
    measured = found.select(
        "*",
        F.length("candidate").cast("double").alias("length"),
        (F.length(kinds) / F.length("candidate")).alias("transitions"),
        _share("[^0-9]").alias("digits"),
        _share("[^A-Z]").alias("capitals"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate")).alias("different"),
    )
    exploded = found.select("candidate").distinct().withColumn("lower", F.lower("candidate")).select("candidate", F.explode(_grams("lower")).alias("gram"))
    known = exploded.join(F.broadcast(grams.withColumn("known", F.lit(1.0))), "gram", "left")
    # Written first, so that the join of a candidate that very many documents hold can be split.
    coverage = stored(known.groupBy("candidate").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage")), "coverage")
    # A candidate shorter than a trigram has none.
    return measured.join(coverage, "candidate", "left").fillna(0.0, ["coverage"])


def known_formats() -> Column:
    """Label by documented formats: 1 or 0, or null where they don't decide.

    1 has a published form of key or is assigned, in any case, spacing and
    quotes, to the name of a credential and has letters and digits.  0 stands in
    for a secret, is a number or words of the corpus that nothing names a
    credential, or is announced as a checksum.
    """
    candidate, assigned = F.col("candidate"), F.col("assigned") == 1
    published = candidate.rlike(PUBLISHED) | F.col("ahead").rlike(DOTTED)
    mixed = (F.length(candidate) >= 6) & candidate.rlike("[A-Za-z]") & candidate.rlike("[0-9]") & ~candidate.rlike(REFERS)
    bearer = F.coalesce(F.col("before"), F.lit("")).rlike("(?i)^[\"'`]?bearer$") & (F.col("ahead") == "")
    words = ~candidate.rlike("[0-9]|[a-z][A-Z]") & (F.col("coverage") >= 0.5)
    checksum = F.concat_ws(" ", "before", "ahead").rlike("(?i)\\b(?:sha-?(?:1|256|384|512)|md5|checksum|digest|commit)[\"']?[ :=-]*[\"']?$")
    return F.when(published, 1).when(assigned & candidate.rlike(STAND_IN), 0).when((assigned | bearer) & mixed, 1).when(~assigned & ~bearer & (candidate.rlike("^[0-9]+$") | words | checksum), 0)


def fit(measured: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> PipelineModel | None:
    """The forest, from at most `sample` labelled findings of each label; None without both.

    `findings` has doc_id, word, place and label (0 or 1); without it, formats label.
    """
    usable = measured.where(F.coalesce(~held_out(), F.lit(False)))
    labelled = usable.withColumn("label", known_formats().cast("double")) if findings is None else usable.join(findings.select("doc_id", "word", "place", F.col("label").cast("double")), ["doc_id", "word", "place"])
    parts = [labelled.where(F.col("label") == k).orderBy(F.xxhash64("candidate", "doc_id", "word"), "candidate", "doc_id", "word", "place").limit(sample) for k in (0, 1)]
    train = stored(parts[0].unionByName(parts[1]).select("label", "context", *MEASURES), "labelled-findings")
    if train.select("label").distinct().count() < 2:
        return None
    hashed = HashingTF(inputCol="context", outputCol="words", numFeatures=HASHED, binary=True)
    vector = VectorAssembler(inputCols=[*MEASURES, "words"], outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=32, featureSubsetStrategy="onethird", seed=11)
    return Pipeline(stages=[hashed, vector, forest]).fit(train)


def scan(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source", sample: int = SAMPLE) -> DataFrame:
    """One row per candidate of `docs`: doc_id, word, place, candidate, score, is_secret, held_out.

    `word` counts the white-space separated words before it, `place` the
    candidates before it in its word, assigned values after its runs.  Null and empty texts have none; a missing
    or null path counts as an empty one; rows that repeat an id have their
    candidates each.  Without labels of both kinds every score is 1, so that no
    candidate is lost.
    """
    found = stored(candidates(docs, doc_id, text, path), "candidates")
    measured = stored(features(found, stored(frequent_grams(docs, text), "grams")), "measured")
    model = fit(measured, findings, sample)
    if model is None:
        scored = measured.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(measured).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word", "place", "candidate", "score", (F.col("score") >= 0.5).alias("is_secret"), F.coalesce(held_out(), F.lit(False)).alias("held_out"))
