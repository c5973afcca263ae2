"""Secret scan: candidate strings, judged by a random forest.

Candidates are values assigned to a credential word, bare runs of key-like
characters with a digit, and runs of a known key format without one.  A random forest over their length, character
transitions, dictionary coverage, path and neighbouring words, trained from
labelled findings, removes the false positives.

Labelled findings are a parameter.  By default they are candidates of the
documents themselves whose kind is beyond doubt (``certain_findings``: a known
key format, a value assigned to a credential word; against card-like digit
runs, identifiers of words, placeholders), plus ``example_findings``, made by
rule, so that both classes are always there.

Only DataFrame functions are used, the forest included.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, let, text_key

# Credential words, words that speak for something harmless,
# words of identifiers and placeholders, known key formats.
CREDENTIAL = r"passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth"
HARMLESS = r"sha\d*|md5|commit|checksum|digest|hash|uuid|guid|isbn|order|invoice|card|phone|tel|version|build|file|image|img|href|src|http|www|url|path|example|sample|test|dummy"
DICTIONARY = (r"password|passwd|secret|token|example|sample|test|dummy|changeme|change|placeholder|your|insert|here|redacted|"
              r"admin|user|name|default|value|string|null|none|key|path|file|image|index|page|home|site|version|build|release|"
              r"report|draft|final|title|section|chapter|figure|table|the|and|for|with|from|this|that|xxxx+|abcd|qwerty|lorem|ipsum")
_FORMATS = (r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36,}", r"xox[abprs]-[0-9A-Za-z-]{10,}", r"AIza[0-9A-Za-z_-]{35}",
            r"sk-[0-9A-Za-z_-]{20,}")
KNOWN_FORMAT = "|".join(f"^{f}$" for f in _FORMATS)

_RUN = r"[A-Za-z0-9_+/\-]"
_ASSIGNED = rf"(?i:(?:{CREDENTIAL})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)"
CANDIDATE = rf"{_ASSIGNED}[^\s\"']{{6,}}|(?<!{_RUN})(?=[A-Za-z_+/\-]*[0-9]){_RUN}{{12,}}={{0,2}}"
CANDIDATE += rf"|(?<!{_RUN})(?:{'|'.join(_FORMATS)})(?!{_RUN})"

FEATURES = ("length", "digits", "uppers", "lowers", "marks", "turns", "vowel_turns", "repeats", "hex", "dictionary",
            "slashes", "in_path", "assigned", "quoted", "known_format", "credential_left", "harmless_left", "credential_near")
SAMPLE_ROWS = 4_000
THRESHOLD = 0.5
MASK = "[SECRET]"


def _cut(text: Column):
    """The text between candidates (one more than these) and the candidates."""
    return F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, text_key, nr, start, end, value, left, right): every candidate.

    ``start`` and ``end`` are code point offsets of the value; ``left`` and
    ``right`` the text around it, up to 80 and 40 characters; ``nr`` its place
    among the document's candidates.
    """
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
            # Every candidate holds a digit, an assignment mark or the head of a known format: a cheap test first.
            .where(F.col("text").rlike("[0-9:=]|AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk-")).where(F.col("text").rlike(CANDIDATE))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key(F.col("text")).alias("text_key"), "text"))
    pieces, found = _cut(F.col("text"))
    parts = let(pieces, lambda ps: F.transform(found, lambda m, i: F.struct(
        i.alias("nr"), m.alias("m"), F.char_length(F.get(ps, i)).alias("gap"),
        F.right(F.get(ps, i), F.lit(80)).alias("left"), F.left(F.get(ps, i + 1), F.lit(40)).alias("right"))))
    rows = rows.select("row", "doc_id", "text_key", F.inline(parts))
    prefix = F.regexp_extract("m", f"^({_ASSIGNED})", 1)
    # Where a candidate starts: all gaps and candidates of its document before it.
    upto = Window.partitionBy("row").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("m")).over(upto)
    rows = rows.select("row", "doc_id", "text_key", "nr", end.alias("end"), "m", prefix.alias("prefix"), "left", "right")
    value = F.expr("substring(m, char_length(prefix) + 1)")
    return rows.select("row", "doc_id", "text_key", "nr", (F.col("end") - F.char_length(value)).alias("start"), "end",
                       value.alias("value"), F.concat("left", "prefix").alias("left"), "right")


def with_features(found: DataFrame) -> DataFrame:
    """Candidates with the columns of FEATURES (value, left and right given)."""
    v, n = F.col("value"), F.greatest(F.char_length("value"), F.lit(1)).cast("double")
    near = F.regexp_extract("left", r"(\S+\s+)?(\S+\s+)?(\S*\s*)$", 0)      # up to three words before
    glued = F.regexp_extract("left", r"(\S*)$", 1)                           # what the value hangs on

    def count(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)).cast("double")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    f = {
        "length": n,
        "digits": count("[0-9]") / n, "uppers": count("[A-Z]") / n, "lowers": count("[a-z]") / n,
        "marks": count("[^A-Za-z0-9]") / n,
        # character transitions: between digits and letters, between cases, between vowels and consonants
        "turns": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / n,
        "vowel_turns": count("(?i)(?<=[aeiou])(?=[bcdfghj-np-tv-z])|(?<=[bcdfghj-np-tv-z])(?=[aeiou])") / n,
        "repeats": count(r"(.)(?=\1)") / n,
        "hex": flag(v.rlike("^[0-9a-f]+$")),
        "dictionary": F.char_length(F.concat_ws("", F.regexp_extract_all(F.lower(v), F.lit(f"({DICTIONARY})"), F.lit(1)))) / n,
        "slashes": count("/"),
        "in_path": flag(glued.rlike(r"(?i)https?:|www\.|[/\\]$") | F.col("right").rlike(r"^[/\\]|^\.[A-Za-z]{2,4}\b")),
        "assigned": flag(F.col("left").rlike(r"[:=]\s{0,3}[\"']?$")),
        "quoted": flag(F.col("left").rlike("[\"']$")),
        "known_format": flag(v.rlike(KNOWN_FORMAT)),
        "credential_left": flag(near.rlike(f"(?i){CREDENTIAL}")),
        "harmless_left": flag(near.rlike(rf"(?i)(?<![a-z])(?:{HARMLESS})(?![a-z])")),
        "credential_near": flag(F.concat_ws(" ", "left", "right").rlike(f"(?i){CREDENTIAL}")),
    }
    return found.withColumns(f)


def certain_findings(found: DataFrame) -> DataFrame:
    """Distinct (value, left, right, label) of candidates whose kind is beyond
    doubt; the label follows from the other three."""
    v = F.col("value")
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    words = v.rlike(f"(?i)^(?:(?:{DICTIONARY})[_/+-]?)+[0-9]*$")
    secret = (v.rlike(KNOWN_FORMAT) | (F.col("left").rlike(f"{_ASSIGNED}$") & mixed & (F.char_length(v) >= 16))) & ~words
    # Digits alone are harmless unless they are assigned: they may be a password then.
    harmless = (v.rlike("^[0-9+/_-]+=*$") & ~F.col("left").rlike(f"{_ASSIGNED}$")) | words
    return (found.where(secret | harmless)
            .select("value", "left", "right", F.when(harmless, 0).otherwise(1).alias("label"))
            .dropDuplicates(["value", "left", "right"]))


def bounded(findings: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` of distinct findings: those with the smallest hash, half
    from each label if there are enough, filled up from the other if not."""
    order = (F.xxhash64("value", "left", "right"), "value", "left", "right")
    first = checkpointed(findings.where("label = 0").orderBy(*order).limit(rows)
                         .unionByName(findings.where("label = 1").orderBy(*order).limit(rows)))
    n = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    take0 = min(n0, max(rows // 2, rows - n1))
    return (first.where("label = 0").orderBy(*order).limit(take0)
            .unionByName(first.where("label = 1").orderBy(*order).limit(min(n1, rows - take0))))


def example_findings(spark: SparkSession, rows: int = 400) -> DataFrame:
    """(value, left, right, label): labelled findings made by rule from row numbers."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[+/=]", "x")
    word = F.element_at(F.split(F.lit("the report final user table section image release"), " "), (F.col("id") % 8 + 1).cast("int"))
    cases = [  # value, left, right, label
        (F.substring(h, 1, 32), F.lit("set password="), F.lit(" and"), 1),
        (F.substring(h, 1, 40), F.lit('the token = "'), F.lit('" in'), 1),
        (F.concat(F.lit("AKIA"), F.substring(F.upper(b64), 1, 16)), F.lit("used with "), F.lit(" then"), 1),
        (b64, F.lit("api_key: "), F.lit("\n"), 1),
        (F.substring(b64, 1, 20), F.lit("client secret = '"), F.lit("'"), 1),
        (F.substring(h, 1, 18), F.lit("pwd="), F.lit(" or"), 1),
        (F.lpad(F.conv(F.substring(h, 1, 10), 16, 10), 12, "7"), F.lit("password="), F.lit(" and"), 1),
        (F.lpad(F.conv(F.substring(h, 1, 13), 16, 10), 16, "4"), F.lit("is with "), F.lit(" of"), 0),
        (F.substring(h, 1, 40), F.lit("fixed in commit "), F.lit(" last"), 0),
        (F.substring(h, 1, 32), F.lit("file md5 checksum "), F.lit("."), 0),
        (F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 12)),
         F.lit("see https://site.example/img/"), F.lit(".png"), 0),
        (F.concat(word, F.lit("-"), F.reverse(word), F.lit("-"), F.col("id").cast("string"), F.lit("-release")), F.lit("in the "), F.lit(" we"), 0),
        (F.concat(F.lit("your-"), word, F.lit("-here-"), F.col("id").cast("string")), F.lit("password="), F.lit(" "), 0),
        (F.concat(F.lit("2024-0"), (F.col("id") % 9 + 1).cast("string"), F.lit("-1"), (F.col("id") % 9).cast("string"), F.lit("-draft")), F.lit("dated "), F.lit(" and"), 0),
    ]
    picked = F.element_at(F.array(*[F.struct(v.alias("value"), a.alias("left"), b.alias("right"), F.lit(y).alias("label"))
                                    for v, a, b, y in cases]), (F.col("id") % len(cases) + 1).cast("int"))
    return spark.range(rows).select(picked.alias("x")).select("x.*")


def train(findings: DataFrame, rows: int = SAMPLE_ROWS, trees: int = 30, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """Forest from labelled findings (value, left, right, label 0/1).

    At most ``rows`` distinct findings are used (``bounded``); they are sorted
    into one small partition, so reruns agree.
    """
    picked = bounded(findings.where(F.col("value").isNotNull() & F.col("label").isin(0, 1)).dropDuplicates(["value", "left", "right"]), rows)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        with_features(picked).withColumn("label", F.col("label").cast("double")))
    data = data.select("features", "label", "value").repartition(1).sortWithinPartitions("value", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def secrets(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
            rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, nr, start, end, value, score, is_secret) per candidate.

    Whole texts are scanned.  Null, empty and candidate-free texts give no
    rows; repeated rows give repeated findings; null ids are kept; an empty
    table gives no rows; other columns are ignored.
    """
    found = checkpointed(candidates(docs, doc_id, text))      # texts are scanned once
    if findings is None:
        findings = bounded(certain_findings(found), rows).unionByName(example_findings(docs.sparkSession))
    model = train(findings, 2 * rows)
    judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(found)))
    return (judged.withColumn("score", F.element_at(vector_to_array("probability"), 2))
            .select("doc_id", "text_key", "nr", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
                    "value", "score", (F.col("score") >= threshold).alias("is_secret")))


def redact(docs: DataFrame, judged: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every value judged a secret replaced by ``mask``; all columns
    and rows stay, rows without secrets are unchanged."""
    marks = (judged.where("is_secret").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
             .agg(F.collect_set("nr").alias("__nrs")))
    joined = (docs.withColumn("__text_key", text_key(F.col(text)))
              .join(marks, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left"))
    pieces, found = _cut(F.col(text))
    masked = let(pieces, lambda ps: F.concat(
        F.array_join(F.transform(found, lambda m, i: F.concat(
            F.get(ps, i), F.when(F.array_contains("__nrs", i), F.concat(F.regexp_extract(m, f"^({_ASSIGNED})", 1), F.lit(mask)))
            .otherwise(m))), ""), F.element_at(ps, -1)))
    clean = F.when(F.col("__nrs").isNull(), F.col(text)).otherwise(masked)
    return joined.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])
