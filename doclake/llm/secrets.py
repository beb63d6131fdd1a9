"""Secrets in texts: candidates by shape, false positives removed by a random forest.

Features are the length of a candidate, the transitions between its character classes, how far dictionary words
cover it, the path of its document and its neighbouring words. The forest is trained on labelled findings. All
steps are DataFrame functions and Spark's own forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.arrays import let
from doclake.llm.texts import SPACES, packed, words
from doclake.sources.scratch import freeze

MIN_LENGTH = 8
DICTIONARY_DOCS = 5         # a dictionary word stands in at least so many documents
FIT_ROWS = 200_000          # bound of the labelled findings that the forest is fitted on
TREES, DEPTH, SEED = 30, 8, 11
MASK = "[SECRET]"

_KEY = "(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)"
_OWN_KEY = _KEY + "[A-Za-z_]*[\"']?[:=]+"
# a word that ends in a key and its own sign, as in `password: hunter2`; `author:` and `secretary:` are no keys
_KEY_SIGN = _KEY + "(?:s|_[A-Za-z_]*)?[\"']?[:=]+>?"
_KEY_END = _KEY_SIGN + "$"
_LOCATION = "://[^/\\s:@]*:([^/\\s@]+)@"        # a location with user:password@
_WRAP = "^[\"'(\\[{<=:]+|[\"')\\]}>,.;:!?#*$%&|]+$"

# Public formats of findings that need no forest to be labelled.
SECRET_FORMATS = [
    "^AKIA[0-9A-Z]{16}$", "^gh[pousr]_[A-Za-z0-9]{36}$", "^xox[abp]-[0-9A-Za-z-]{10,}$",
    "^AIza[0-9A-Za-z_-]{35}$", "^sk_(?:live|test)_[0-9A-Za-z]{16,}$",
]
OTHER_FORMATS = [
    "^[^@\\s]+@[^@\\s]+$",                       # mail address
    "^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?::[0-9]+)?$",  # network address
    "^[+(]?[0-9][0-9()+./:,-]*$",                # number, date, time, telephone, card
    "://",                                       # location
    "^\\p{L}+[0-9]{1,4}$",                       # word with a number
]

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "distinct", "hex", "longest_letters",
    "lower_digit", "digit_lower", "upper_digit", "digit_upper", "lower_upper", "upper_lower", "to_other",
    "coverage", "key_before", "assigned", "quoted", "before_common", "after_common",
    "path_test", "path_config", "path_depth",
]


def _may_hold(text: Column) -> Column:
    return text.rlike("[0-9]") | text.rlike(_KEY) | text.rlike(_LOCATION)


def _assigned(word: Column, before: Column, before2: Column) -> Column:
    """Whether a key has the word as its value: in the same word, with its own sign before, or with a sign as a word."""
    return F.coalesce(word.rlike(_KEY_SIGN + "."), F.lit(False)) | F.coalesce(before.rlike(_KEY_END), F.lit(False)) | F.coalesce(
        before.isin("=", ":", "=>", ":=") & before2.rlike(_KEY), F.lit(False))


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per candidate: ``doc_id``, ``text_hash``, ``path``, ``word_no``, ``word``, ``value``, neighbours.

    A candidate is a word of at least ``MIN_LENGTH`` characters with a digit, or one that a key word is
    assigned to, in the word itself, as the next word (``password: hunter2``) or behind a sign, or a location with
    user:password@, of which the password is the value.
    """
    place = F.col(f"`{path}`").cast("string") if path else F.lit("")
    texts = (docs.select("doc_id", "text", F.coalesce(place, F.lit("")).alias("path"))
             .filter(_may_hold(F.col("text")))
             .select("doc_id", "path", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("_w")))

    def found(w):
        def holds(i):
            x = F.get(w, i)
            after_key = (i >= 2) & F.get(w, i - 1).isin("=", ":", "=>", ":=") & F.get(w, i - 2).rlike(_KEY)
            return (((F.length(x) >= MIN_LENGTH) & x.rlike("[0-9]")) | x.rlike(_OWN_KEY + ".")
                    | F.coalesce(after_key, F.lit(False)) | x.rlike(_LOCATION)
                    | F.coalesce((i >= 1) & F.get(w, i - 1).rlike(_KEY_END), F.lit(False)))
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), holds)
        return F.transform(at, lambda i: F.struct(
            i.cast("long").alias("word_no"), F.get(w, i).alias("word"),
            F.when(i >= 2, F.get(w, i - 2)).alias("before2"), F.when(i >= 1, F.get(w, i - 1)).alias("before"),
            F.get(w, i + 1).alias("after")))
    # bound to a variable, as an optimizer may put the expression of the words where their column stands
    rows = (texts.filter(F.size("_w") > 0).select("doc_id", "path", "text_hash", F.explode(let(F.col("_w"), found)).alias("f"))
            .select("doc_id", "path", "text_hash", "f.*"))
    value = F.when(F.col("word").rlike(_LOCATION), F.regexp_extract("word", _LOCATION, 1)).otherwise(
        F.regexp_replace(F.regexp_replace("word", "^.*?" + _OWN_KEY, ""), _WRAP, ""))
    return rows.withColumn("value", value).filter("length(value) > 0")


def dictionary(docs: DataFrame) -> DataFrame:
    """``run, docs``: lower-case runs of letters that stand in at least ``DICTIONARY_DOCS`` documents."""
    runs = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    return (docs.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("docs"))
            .filter((F.col("docs") >= DICTIONARY_DOCS) & (F.length("run") > 0)))


def featured(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` with an ``id`` and the columns ``FEATURES``."""
    found = freeze(found.withColumn("id", F.monotonically_increasing_id()), "candidates")
    letters = lambda c: F.split(F.lower(c), "[^\\p{L}]+")
    parts = (found.select("id", F.explode(F.array(
        F.struct(F.lit("value").alias("part"), letters("value").alias("runs")),
        F.struct(F.lit("before").alias("part"), letters("before").alias("runs")),
        F.struct(F.lit("after").alias("part"), letters("after").alias("runs")))).alias("p"))
        .select("id", "p.part", F.explode("p.runs").alias("run")).filter("length(run) >= 2"))
    known = dictionary(docs)
    covered = (parts.join(known, "run").groupBy("id").agg(
        F.sum(F.when((F.col("part") == "value") & (F.length("run") >= 3), F.length("run"))).alias("_covered"),
        F.max(F.when(F.col("part") == "before", F.log1p("docs"))).alias("_before"),
        F.max(F.when(F.col("part") == "after", F.log1p("docs"))).alias("_after")))

    n = F.length("value")
    count = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    column = {
        "length": F.log1p(n), "digits": count("[0-9]"), "uppers": count("[A-Z]"), "lowers": count("[a-z]"),
        "others": count("[^0-9A-Za-z]"), "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "hex": flag(F.col("value").rlike("^[0-9a-fA-F]+$")),
        "longest_letters": F.array_max(F.transform(letters("value"), F.length)) / n,
        "lower_digit": count("[a-z](?=[0-9])"), "digit_lower": count("[0-9](?=[a-z])"),
        "upper_digit": count("[A-Z](?=[0-9])"), "digit_upper": count("[0-9](?=[A-Z])"),
        "lower_upper": count("[a-z](?=[A-Z])"), "upper_lower": count("[A-Z](?=[a-z])"),
        "to_other": count("[0-9A-Za-z](?=[^0-9A-Za-z])"),
        "coverage": F.coalesce("_covered", F.lit(0)) / n,
        "key_before": flag(F.col("word").rlike(_OWN_KEY)) + flag(F.col("before").rlike(_KEY)) + flag(F.col("before2").rlike(_KEY))
        + flag(F.col("word").rlike(_LOCATION)),
        "assigned": flag(F.col("word").rlike("[:=]")) + flag(F.col("before").isin("=", ":", "=>", ":=") | F.col("before").rlike(_KEY_END)),
        "quoted": flag(F.col("word").rlike("[\"']")),
        "before_common": F.coalesce("_before", F.lit(0.0)), "after_common": F.coalesce("_after", F.lit(0.0)),
        "path_test": flag(F.col("path").rlike("(?i)test|example|sample|fixture|doc")),
        "path_config": flag(F.col("path").rlike("(?i)config|\\.env|\\.ya?ml|\\.ini|secret|credential")),
        "path_depth": F.regexp_count("path", F.lit("/")),
    }
    return found.join(covered, "id", "left").select(*found.columns, *[c.cast("double").alias(k) for k, c in column.items()])


def format_labels(rows: DataFrame) -> DataFrame:
    """Labels findings by public formats: ``label`` 1 for secrets, 0 for what is known to be another thing, else null."""
    any_of = lambda patterns: F.greatest(*[F.col("value").rlike(p) for p in patterns])
    near = (F.col("key_before") > 0) & (F.col("assigned") > 0)
    own = _assigned(F.col("word"), F.col("before"), F.col("before2")) | F.col("word").rlike(_LOCATION)
    fit_value = (F.length("value") >= MIN_LENGTH) & (F.col("digits") > 0)
    # what a key has as its value is never known to be another thing; what merely stands near a key may be
    label = (F.when(any_of(SECRET_FORMATS) | (own & fit_value), 1.0).when(~own & any_of(OTHER_FORMATS), 0.0)
             .when(near & fit_value, 1.0))
    return rows.withColumn("label", label)


def fit(labelled: DataFrame):
    """A forest on rows with ``doc_id``, ``word_no``, ``FEATURES`` and ``label`` 0 or 1; None if a class is missing.

    About ``FIT_ROWS`` / 2 rows of each class at most, chosen by document and place, so that a value in many
    documents is thinned like any other. A class within its bound is taken whole.
    Each row stands for those that its class left out, so that shares of the classes stay as they are.
    """
    labelled = labelled.filter("label is not null")
    n, positive = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, n):
        return None
    one_in = [max(1, -(-int(k) // (FIT_ROWS // 2))) for k in (n - positive, positive)]
    own = F.when(F.col("label") == 1, F.lit(one_in[1])).otherwise(F.lit(one_in[0]))
    labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", "word_no"), own) == 0).withColumn("_weight", own.cast("double"))
    if labelled.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(labelled).select("_features", "label", "_weight")
    return RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", numTrees=TREES, maxDepth=DEPTH,
                                  seed=SEED).fit(rows)


def scanned(docs: DataFrame, path: str | None = None, findings: DataFrame | None = None) -> DataFrame:
    """Every candidate with ``score`` (share of the forest for a secret) and ``secret``.

    ``findings`` holds labelled findings: rows of ``featured`` with a ``label``. Without it the candidates of
    documents outside the held-out fold (crc32 of the id mod 5 is 0) that have a public format are the labelled
    findings. Without both classes nothing is removed: every candidate scores 1.
    Null and empty texts have no candidates, texts of any length are read whole, a null path is an empty one, repeated
    rows give repeated candidates.
    """
    rows = freeze(featured(candidates(docs, path), docs), "features")
    if findings is None:
        held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
        findings = format_labels(rows).filter(~held_out)
    model = fit(findings)
    if model is None:
        return rows.withColumns({"score": F.lit(1.0), "secret": F.lit(True)})
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
    scores = model.transform(vectors).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scores.withColumn("secret", F.col("score") >= 0.5).select(*rows.columns, "score", "secret")


def _masked_words(text: Column, found: Column) -> Column:
    """``text`` with each value of ``found`` (``word_no, value``) replaced in its own word, where it stands last."""
    def in_word(word: Column, value: Column) -> Column:
        start = F.length(word) - F.instr(F.reverse(word), F.reverse(value)) - F.length(value) + 2
        own = F.concat(F.substring(word, F.lit(1), start - 1), F.lit(MASK), F.substring(word, start + F.length(value), F.length(word)))
        return F.when(word.rlike(_LOCATION), F.replace(word, F.concat(F.lit(":"), value, F.lit("@")), F.lit(f":{MASK}@"))).otherwise(own)

    def rebuilt(at: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(f"[^ {SPACES}]+"), F.lit(0))
        new = F.transform(parts, lambda w, i: F.coalesce(in_word(w, F.get(at, F.array_position(
            F.transform(at, lambda x: x["word_no"]), i.cast("long")).cast("int") - 1)["value"]), w))
        gaps = F.split(text, f"[^ {SPACES}]+", -1)
        return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), new), gaps, lambda w, gap: F.concat(w, gap)), "")
    return F.when(F.size(found) > 0, let(found, rebuilt)).otherwise(text)


def masked(docs: DataFrame, path: str | None = None, findings: DataFrame | None = None) -> DataFrame:
    """``docs`` with the confirmed secrets in ``text`` replaced by ``MASK``; all rows and columns stay.

    A value of ``MIN_LENGTH`` characters or more is replaced wherever it stands in its text, a shorter one, which may
    be part of other words, in the word that it was found in only.

    Where ``docs`` has ``n_chars``, it follows the text. Only texts that may hold a candidate are joined.
    """
    secret = (scanned(docs, path, findings).filter("secret").groupBy("doc_id", "text_hash")
              .agg(F.collect_set(F.struct("word_no", "value")).alias("_found"))
              .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_found"))
    rows = packed(docs, ["doc_id", "text"])
    may = F.coalesce(_may_hold(F.col("text")), F.lit(False))
    hit = (rows.filter(may).withColumn("_own", F.xxhash64("text"))
           .join(secret, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_hash")), "left"))
    # longer values first, so that a value inside another one does not cut it
    long_ = F.filter("_found", lambda x: F.length(x["value"]) >= MIN_LENGTH)
    longest = F.reverse(F.array_sort(F.array_distinct(F.transform(
        long_, lambda x: F.struct(F.length(x["value"]).alias("n"), x["value"].alias("v"))))))
    text = F.aggregate(longest, _masked_words(F.col("text"), F.filter("_found", lambda x: F.length(x["value"]) < MIN_LENGTH)),
                       lambda t, x: F.replace(t, x["v"], F.lit(MASK)))
    hit = hit.withColumn("_row", F.col("_row").withField("text", F.coalesce(text, F.col("text"))))
    if "n_chars" in docs.columns:
        length = F.length("_row.text").cast(docs.schema["n_chars"].dataType)
        hit = hit.withColumn("_row", F.col("_row").withField(
            "n_chars", F.when(F.col("_found").isNotNull(), length).otherwise(F.col("_row.n_chars"))))
    return hit.select("_row.*").unionByName(rows.filter(~may).select("_row.*"))
