"""Secret scans: candidates by pattern, a random forest to tell secrets from the rest.

Everything is SQL functions and Spark's own forest; no row passes through Python.

A candidate is a run of letters, digits and + / _ = - of MIN_LENGTH or more that holds a
digit, or any value without blanks of MIN_VALUE or more that is assigned to a name that
means a secret. A run NAME=value is cut after its '=': the name stands beside the value. What is known of it: its length, the changes between its kinds of characters,
the share of it that dictionary words cover, the words beside it, and the path its
document came from. The forest learns from labelled findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm.parted import parted
from parchmill.session import scratch_path

MIN_LENGTH = 16
MIN_VALUE = 6  # characters of a value assigned to a name
BESIDE = 48  # characters before and after a candidate that count as beside it
MAX_TRAINING = 20_000  # labelled findings that the forest learns from, at most
_MARK = "\u0001"

# Words that often stand beside secrets, and beside things that are none.
SECRET_WORDS = (
    "access", "api", "apikey", "auth", "authorization", "bearer", "client", "credential",
    "credentials", "key", "passphrase", "passwd", "password", "private", "pwd", "secret",
    "token",
)
HARMLESS_WORDS = (
    "checksum", "commit", "digest", "dummy", "example", "fake", "hash", "id", "isbn", "md5",
    "number", "order", "phone", "placeholder", "revision", "sample", "sha1", "sha256", "test",
    "uuid", "version",
)
# Common words and parts of words of prose and of identifiers.
DICTIONARY = (
    "about", "after", "all", "and", "auf", "avec", "base", "but", "class", "code", "con",
    "config", "dans", "data", "das", "date", "default", "dem", "den", "der", "des", "die",
    "document", "ein", "eine", "elle", "for", "from", "get", "have", "http", "https", "image",
    "ing", "ist", "les", "lich", "line", "list", "los", "ment", "mit", "name", "new", "nicht",
    "not", "number", "page", "para", "pas", "por", "pour", "que", "qui", "set", "sich", "sur",
    "test", "that", "the", "this", "time", "tion", "type", "und", "une", "ung", "user",
    "value", "version", "von", "was", "with", "you", "zu",
)

FEATURES = (
    "f_length", "f_changes", "f_digits", "f_upper", "f_symbols", "f_kinds_of_character",
    "f_hex", "f_dictionary", "f_assigned", "f_quoted", "f_secret_word", "f_harmless_word",
    "f_words_beside", "f_path_depth", "f_path_config", "f_path_test",
)


_SECRET_NAME = rf"(?<![a-z0-9])(?:{'|'.join(SECRET_WORDS)})[a-z0-9_\-]*"
# Blanks are all signs up to the space, _MARK among them.
_ASSIGNED = (
    rf"{_SECRET_NAME}+[\"'`]?[\x00-\x20]*+(?::=|=>|[=:])[\x00-\x20]*+[\"'`]?(?:(?:bearer|basic)[\x00-\x20]++)?"
)
# A quote ends a quoted value; another one ends before the next NAME= of a list and
# before closing punctuation. No part of it is tried twice.
_SOLID = r"[^\x00-\x20\"'`&;,.)\]}>]"
_VALUE = (
    rf"(?=[^\x00-\x20\"'`]{{{MIN_VALUE}}})(?:(?<=[\"'`])[^\x00-\x20\"'`]++"
    rf"|(?:(?![=:]){_SOLID}|[.)\]}}>]++(?={_SOLID}))"
    rf"(?:{_SOLID}|(?:[.)\]}}>]|[&;,](?![A-Za-z0-9_.\-]++[=:]))++(?={_SOLID}))*+)"
)
_SENT = r"(?<![a-z0-9])(?:bearer|authorization)\s+[\"'`]?"
# A value follows, whatever it holds. Of several names one that means a secret counts,
# the first of them, as its value may hold '='; otherwise the last.
_VALUE_AHEAD = rf"(?=[^=].{{{MIN_VALUE - 1}}})"
_SECRET_HEAD = rf"(?i)^(.*?{_SECRET_NAME}=){_VALUE_AHEAD}"
_LAST_HEAD = rf"^((?:.*[^A-Za-z0-9_\-])?[A-Za-z_][A-Za-z0-9_\-]*=){_VALUE_AHEAD}"


def _head(run: Column) -> Column:
    """What of a run stands before its value, up to the '='; empty if it has no name."""
    secret, last = (F.regexp_extract(run, pattern, 1) for pattern in (_SECRET_HEAD, _LAST_HEAD))
    return F.when(~run.contains("="), "").when(secret != "", secret).otherwise(last)


def _is_run(part: Column) -> Column:
    return (F.length(part) >= MIN_LENGTH) & part.rlike("[0-9]")


def _marked(text: Column) -> Column:
    """The text, which holds no _MARK, with one on both sides of each assigned value
    and of each other run."""
    run = rf"[A-Za-z0-9+/_=\-]{{{MIN_LENGTH},}}"
    return F.regexp_replace(text, f"((?i:{_ASSIGNED}))({_VALUE})|({run})", f"$1{_MARK}$2$3{_MARK}")


def _assigned(before: Column) -> Column:
    return before.rlike(f"(?i){_ASSIGNED}$")


def _is_candidate(run: Column, head: Column, before: Column) -> Column:
    """Whether what follows `head` in the run counts: a run with a digit, its name
    included, or a value assigned to a name that means a secret."""
    value = F.length(run) - F.length(head) >= MIN_VALUE
    return _is_run(run) | (value & _assigned(F.concat(before, head)))


def _value_head(run: Column, before: Column) -> Column:
    """_head, but a value that is already parted from its name is whole."""
    return F.when(_assigned(before), "").otherwise(_head(run))


def _without_last(run: Column, first: Column) -> Column:
    return F.transform(F.slice(run, F.lit(1), F.size(run) - 1), lambda x: first + x)


def candidates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source"
) -> DataFrame:
    """Every candidate of every whole text, one row each: id, nth (from 0), slot (where
    redact() finds it), start (in code points), candidate, before, after, path. Of a run NAME=value the value is a
    candidate, and what is before the '=' another if it would be one alone.

    A text without candidates gives no row, and so do null and empty ones. A text is
    cut at its candidates once, so its length and their number cost in proportion.
    Repeated rows give repeated rows. Columns other than those named are not read.
    """
    # A sign that no text holds after this stands on both sides of each run.
    marked = _marked(F.translate(F.col(f"`{text_col}`"), _MARK, " "))
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    parts = docs.select(F.col(f"`{id_col}`").alias("id"), path.alias("path"), marked.alias("marked"))
    parts = parts.where(F.instr("marked", _MARK) > 0)
    parts = parts.select("id", "path", F.split("marked", _MARK).alias("p"))
    parts = parts.withColumn("runs", _running_lengths("p"))
    totals = F.transform("runs", lambda r: F.element_at(r, -1))
    firsts = F.slice(_running_sums(totals), F.lit(1), F.size("runs"))
    starts = F.zip_with("runs", firsts, _without_last)
    # An array looked up in a lambda may be made anew for each element; one zipped is not.
    zipped = F.arrays_zip(F.col("p").alias("run"), F.flatten(starts).alias("start"))

    def cut(part: Column, k: Column) -> Column:
        return F.struct(
            (k * 2).alias("slot"),
            part["start"].alias("start"),
            part["run"].alias("run"),
            # Every second part is a run.
            F.when(k % 2 == 1, _value_head(part["run"], F.get(F.col("p"), k - 1))).alias("head"),
            F.get(F.col("p"), k - 1).alias("before"),
            F.get(F.col("p"), k + 1).alias("after"),
        )

    def found_in(c: Column) -> Column:
        size = F.length(c["head"])
        name, value = F.left(c["head"], size - 1), F.right(c["run"], F.length(c["run"]) - size)

        def one(slot: Column, start: Column, candidate: Column, before: Column, after: Column) -> Column:
            return F.struct(
                slot.alias("slot"),
                start.alias("start"),
                candidate.alias("candidate"),
                F.right(before, F.lit(BESIDE)).alias("before"),
                F.left(after, F.lit(BESIDE)).alias("after"),
            )

        as_name = one(c["slot"], c["start"], name, c["before"], F.concat(F.lit("="), value, c["after"]))
        as_value = one(c["slot"] + 1, c["start"] + size, value, F.concat(c["before"], c["head"]), c["after"])
        values = F.when(_is_candidate(c["run"], c["head"], c["before"]), F.array(as_value))
        values = F.coalesce(values, F.filter(F.array(as_value), lambda c: F.lit(False)))
        return F.when(_is_run(name), F.concat(F.array(as_name), values)).otherwise(values)

    cuts = F.filter(F.transform(zipped, cut), lambda c: c["head"].isNotNull())
    found = F.flatten(F.transform(cuts, found_in))
    found = parts.select("id", "path", F.posexplode(found).alias("nth", "c"))
    return found.select("id", "nth", "c.slot", "c.start", "c.candidate", "c.before", "c.after", "path")


_BLOCK = 512


def _running_sums(numbers: Column) -> Column:
    """The sum of the numbers before each, and of all of them at the end."""
    return F.aggregate(
        numbers,
        F.array(F.lit(0)),
        lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)),
    )


def _running_lengths(parts: str) -> Column:
    """Sums of the lengths of the parts before each, in blocks of _BLOCK, which keeps the
    work in proportion to their number; the last one of all is the sum of all."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int"))
    return F.transform(
        blocks,
        lambda b: _running_sums(
            F.transform(F.slice(F.col(parts), b * _BLOCK + 1, F.lit(_BLOCK)), lambda x: F.length(x))
        ),
    )


def _has_word(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(rf"(?i)(?<![a-z0-9])({'|'.join(words)})(?![a-z0-9])")


def with_features(found: DataFrame, dictionary: Sequence[str] = DICTIONARY) -> DataFrame:
    """Candidates with the forest's features, all doubles."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c).cast("double")
    path = F.lower(F.coalesce("path", F.lit("")))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / n

    kinds = F.translate(c, "", "")
    for pattern, sign in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[^aA0]", "-")):
        kinds = F.regexp_replace(kinds, pattern, sign)
    uncovered = F.regexp_replace(F.lower(c), "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), "")
    beside = F.concat(before, F.lit(" "), after)
    values = {
        "f_length": n,
        "f_changes": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "f_digits": share("0-9"),
        "f_upper": share("A-Z"),
        "f_symbols": F.length(F.regexp_replace(c, "[A-Za-z0-9]", "")) / n,
        "f_kinds_of_character": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "f_dictionary": 1 - F.length(uncovered) / n,
        "f_assigned": before.rlike(r"([=:]|=>)\s*[\"'`]?$").cast("double"),
        "f_quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "f_secret_word": _has_word(before, SECRET_WORDS).cast("double"),
        "f_harmless_word": _has_word(beside, HARMLESS_WORDS).cast("double"),
        "f_words_beside": F.regexp_count(beside, F.lit(r"[A-Za-z]{3,}")),
        "f_path_depth": F.regexp_count(path, F.lit("/")),
        "f_path_config": path.rlike(r"(\.env|\.ini|\.ya?ml|\.conf|\.properties|config)").cast("double"),
        "f_path_test": path.rlike("(test|example|sample|doc|fixture)").cast("double"),
    }
    return found.select("*", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()])


# The shapes of well-known keys and tokens.
KEY_SHAPES = (
    "AKIA[0-9A-Z]{16}", "AIza[0-9A-Za-z_-]{35}", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+",
    "gh[opsu]_[0-9A-Za-z]{36}", "glpat-[0-9A-Za-z_-]{20}", "[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "xox[abps]-[0-9A-Za-z-]{10,}",
)
# Parts of values that stand where a secret would.
PLACEHOLDERS = (
    "[<{$%]", "change.?me", "dummy", "example", "fake", "insert", "placeholder", "redacted", "replace", "sample",
    "test", "todo", "your.?", "xxx", "[*][*]",
)


def label_by_rule(found: DataFrame) -> DataFrame:
    """Findings labelled by their name alone: a value assigned to a name that means a
    secret, or sent as one (Bearer ...), is one (label 1.0), anything else is not (0.0)."""
    return found.withColumn("label", F.col("before").rlike(rf"(?i)(?:{_ASSIGNED}|{_SENT})$").cast("double"))


def label_by_evidence(found: DataFrame) -> DataFrame:
    """Findings labelled without a person, where there is evidence beyond the name.

    A secret (1.0) has the shape of a known key, or a secret's name and a value of many
    different characters of several kinds. None (0.0) is a placeholder, a UUID, a value
    that hardly changes, a number, or a digest that its name or prefix calls one. What
    there is no evidence on has no label: the forest is to judge it, not to learn that it
    is harmless.
    """
    c, before = F.col("candidate"), F.col("before")
    named = before.rlike(rf"(?i)(?:{_ASSIGNED}|{_SENT})$")
    known = c.rlike(f"^(?:{'|'.join(KEY_SHAPES)})$")
    different = F.size(F.array_distinct(F.split(c, "")))
    kinds = sum(c.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    strong = (different >= 8) & (kinds >= 2)
    placeholder = c.rlike(f"(?i){'|'.join(PLACEHOLDERS)}")
    uuid = c.rlike("(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    digest = c.rlike("^[0-9a-f]{16,128}$") & before.rlike(
        r"(?i)(?<![a-z0-9])(?:checksum|commit|digest|etag|integrity|md5|revision|sha-?\d+)[\"'`]?[\s:=]+[\"'`]?$"
    )
    harmless = placeholder | uuid | digest | c.rlike("^[0-9.,:+/ -]+$") | (different <= 4)
    label = F.when(known & ~placeholder, 1.0).when(harmless, 0.0).when(named & strong, 1.0)
    return found.withColumn("label", label)


def train(
    labelled: DataFrame,
    trees: int = 20,
    depth: int = 6,
    max_training: int = MAX_TRAINING,
    seed: int = 11,
) -> PipelineModel | None:
    """A forest fitted to candidates with a column `label` of 0 or 1.

    At most half of `max_training` findings of either label are used, those of the
    smallest hashes of candidate and surroundings; equal ones count once. Findings
    with another label or none are left out. None is returned where one label is
    missing, as there is nothing to tell apart.
    """
    half = max_training // 2
    asked = with_features(labelled.where(F.col("label").isin(0.0, 1.0))).select("candidate", "label", *FEATURES)
    distinct = asked.dropDuplicates(["candidate", "label"])
    order = F.xxhash64(F.lit(seed), "candidate")
    parts = [distinct.where(F.col("label") == v).orderBy(order).limit(half) for v in (0.0, 1.0)]
    rows = parts[0].unionByName(parts[1]).cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(
            labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt"
        )
        return PipelineModel([assemble, forest.fit(assemble.transform(rows))])
    finally:
        rows.unpersist()


def classify(found: DataFrame, model: PipelineModel | None, threshold: float = 0.5) -> DataFrame:
    """Candidates with probability and is_secret; none give none. Without a model (nothing
    to learn from) no candidate can be ruled out: all are secrets with probability 1."""
    if model is None:
        made = found.withColumn("probability", F.lit(1.0))
    else:
        made = model.transform(with_features(found))
        made = made.withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    made = made.select(*found.columns, "probability")
    return made.withColumn("is_secret", F.col("probability") >= threshold)


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
) -> DataFrame:
    """All findings of all texts, with the forest's probability and verdict.

    `labelled` are candidates with a label; by default those of `docs` themselves,
    labelled by evidence. Columns: the id, nth, start, candidate, before, after, path,
    probability, is_secret. See candidates() for nulls, empty and repeated rows.
    """
    path = scratch_path(docs.sparkSession, "candidates")
    candidates(docs, id_col, text_col, path_col).write.parquet(path)  # texts are read once
    found = docs.sparkSession.read.parquet(path)
    model = train(labelled if labelled is not None else label_by_evidence(found))
    return classify(found, model).withColumnRenamed("id", id_col)


def redact(
    docs: DataFrame,
    findings: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stand_in: str = "[SECRET]",
) -> DataFrame:
    """The rows with each secret of their text replaced; all other text stays.

    `findings` are scan()'s of these rows, and `id_col` tells rows apart: number them
    (rows.numbered) where ids are missing or repeated. A secret is replaced wherever the
    row's text has the same value as a candidate, whatever the verdict there. Rows
    without an id, text or secret stay as they are, and so do all columns' names, order
    and types. The work grows with the text and its candidates, not their product. An
    empty table, or no findings, changes nothing.
    """
    same = findings.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"), "candidate")
    same = same.agg(F.max("is_secret").alias("secret"), F.collect_list("slot").alias("slots"))
    # One byte a slot, 1 for those to replace: a place among bytes is read at once.
    slots = F.array_sort(F.flatten(F.collect_list("slots")))
    secrets = same.where("secret").groupBy("__id").agg(slots.alias("slots"))
    after = F.concat(F.array(F.lit(-1)), F.col("slots"))
    gaps = F.zip_with("slots", F.slice(after, F.lit(1), F.size("slots")), lambda here, last: here - last - 1)
    marks = F.array_join(F.transform(gaps, lambda g: F.concat(F.repeat(F.lit("0"), g), F.lit("1"))), "")
    secrets = secrets.select("__id", F.encode(marks, "UTF-8").alias("__marks"))
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "secrets")
    secrets.write.parquet(path)
    secrets = spark.read.schema(secrets.schema).parquet(path)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    # Only texts that may have a secret are shuffled.
    some, others = parted(rows, F.col("__row")[id_col], secrets.select("__id"))
    both = some.join(secrets, F.col("__row")[id_col] == F.col("__id"), "left")
    text = F.col("__row")[text_col]
    # The text is cut as for candidates(), with signs like _MARK spelled in others.
    spelled = F.replace(F.replace(text, F.lit("\u0002"), F.lit("\u0002\u0004")), F.lit(_MARK), F.lit("\u0002\u0003"))
    both = both.withColumn("__parts", F.when(F.col("__marks").isNotNull(), F.split(_marked(spelled), _MARK)))
    parts = F.col("__parts")

    def cleaned(part: Column, k: Column) -> Column:
        def stood_in(c: Column, slot: Column) -> Column:
            hidden = F.substring(F.col("__marks"), slot + 1, F.lit(1)) == F.lit(b"1")
            return F.when(hidden, F.lit(stand_in)).otherwise(c)

        before = F.get(parts, k - 1)
        head = _value_head(part, before)
        name, value = F.left(head, F.length(head) - 1), F.right(part, F.length(part) - F.length(head))
        value = F.when(_is_candidate(part, head, before), stood_in(value, k * 2 + 1)).otherwise(value)
        head = F.when(_is_run(name), F.concat(stood_in(name, k * 2), F.lit("="))).otherwise(head)
        return F.when(k % 2 == 0, part).otherwise(F.concat(head, value))

    clean = F.array_join(F.transform(parts, cleaned), "")
    clean = F.replace(F.replace(clean, F.lit("\u0002\u0003"), F.lit(_MARK)), F.lit("\u0002\u0004"), F.lit("\u0002"))
    clean = F.when(F.col("__marks").isNull(), text).otherwise(clean)
    made = both.select(
        *[clean.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns]
    )
    return made.unionAll(others.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
