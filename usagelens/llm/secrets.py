"""Secret scan: patterns propose candidates, a random forest on their shape and surroundings removes false ones.

Column expressions, joins and the DataFrame-based forest of Spark ML only.
"""

from string import ascii_lowercase

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.llm.common import drop_stage, stage, stage_sealed
from usagelens.llm.matches import collect_matches

FOUND = "struct<start:int,end:int,value:string,before:string>"
# Formats that providers give their keys. Fixed values.
PROVIDER = (r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|"
            r"AIza[A-Za-z0-9_-]{35})$")
# Words of a name end at underscores, hyphens and capitals too, as in db_password, client-secret, accessToken, AWSSecret.
_CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
_WORD = rf"(?:(?<![\p{{L}}\p{{N}}])|{_CAMEL})(?i:%s)(?:(?![\p{{L}}\p{{N}}])|{_CAMEL})"
# Words in front of a candidate that speak for or against a secret. Fixed values.
SECRET_WORDS = _WORD % "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer"
PLAIN_WORDS = _WORD % "sha1|sha256|md5|checksum|digest|hash|commit|revision|uuid|guid|etag|version|example|sample|license"
ASSIGNED = r"[=:]\s*[\"']?$"
# The same with a secret's word in what is assigned to, not in an assignment before it.
SECRET_ASSIGNED = rf"{SECRET_WORDS}[^=:,;\n]*[=:]+\s*[\"']?$"
# A run of at least 16 characters that keys are made of; a shorter one straight after the name of a secret.
_KEY = "A-Za-z0-9+/_-"
_NAMED = rf"(?<=[=:][\x20\t]{{0,2}}[\"']?)(?<={SECRET_WORDS}[A-Za-z0-9_-]{{0,20}}[\"']?[\x20\t]{{0,2}}[=:]{{1,2}}[\x20\t]{{0,2}}[\"']?)"
CANDIDATE = rf"(?<![{_KEY}])(?:[{_KEY}]{{16,}}+|{_NAMED}[{_KEY}]{{2,15}}+(?![{_KEY}]))"
MIN_WORD_ROWS = 3  # a letter run counts as a word of the dictionary if it occurs this often
MIN_LABELLED = 8  # characters from which an assigned value with digits is labelled a secret; shorter ones are only scored
TRAIN_ROWS = 20_000  # labelled findings that a forest is fitted on
UNSEEN = -9.0  # log chance of a pair of characters that the corpus lacks
FEATURES = ("length", "transitions", "pair_chance", "coverage", "digits", "capitals", "variety", "hex", "slashes",
            "path_before", "assigned", "secret_word", "plain_word")
EVIDENCE = ("assigned", "secret_word")  # features that secrets are labelled by


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, value, before) of every candidate in every text; places are code points."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = collect_matches(text, CANDIDATE, text.rlike(CANDIDATE), FOUND,
                            lambda value, before, start, end: (F.lit(True), [value.alias("value"), before.alias("before")]))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.explode(found).alias("found")).select(
        "doc_id", "found.*")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): letter runs of all texts in small letters; partial counts go before the shuffle."""
    words = F.split(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), r"[^\p{L}]+")
    return docs.select(F.explode(words).alias("word")).filter("length(word) >= 2").groupBy("word").agg(
        F.count("*").alias("n"))


def pair_chances(words: DataFrame) -> dict[str, float]:
    """Log chance of each letter after each other one, for the letters a to z: at most 676 numbers."""
    pairs = words.filter(r"word rlike '^[a-z]+$'").select("n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", k, F.lit(2)))).alias("pair"))
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    share = F.log(F.col("n") / F.sum("n").over(_first_letter()))
    return {row.pair: float(row.chance) for row in rows.select("pair", share.alias("chance")).collect()}


def _first_letter():
    from pyspark.sql import Window

    return Window.partitionBy(F.substring("pair", 1, 1))


def _pair_chance(value: Column, chances: dict[str, float]) -> Column:
    """Mean log chance of the candidate's neighbouring characters, looked up by the places of both in the alphabet."""
    small = F.lower(value)
    table = F.lit([chances.get(one + two, UNSEEN) for one in ascii_lowercase for two in ascii_lowercase])

    def letter(k):
        place = F.ascii(F.substring(small, k, F.lit(1))) - ord("a")
        return F.when(place.between(0, len(ascii_lowercase) - 1), place)

    def step(total, k):
        return total + F.coalesce(F.get(table, letter(k) * len(ascii_lowercase) + letter(k + 1)), F.lit(UNSEEN))

    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), step) / (F.length(value) - 1)


def features(found: DataFrame, words: DataFrame, chances: dict[str, float]) -> DataFrame:
    """Candidates with the columns of FEATURES; equal candidates in equal surroundings are measured once by the caller.

    Coverage is the share of characters in letter runs of at least three that the dictionary holds. The runs meet the
    dictionary in a join, as neither has a bound.
    """
    value, before = F.col("value"), F.col("before")
    length = F.length(value)
    runs = found.select("value").distinct().select(
        "value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}+"), F.lit(0))).alias("word"))
    known = words.filter(F.col("n") >= MIN_WORD_ROWS).select("word")
    covered = runs.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    number = {
        "length": length,
        "transitions": F.regexp_count(value, F.lit(change)) / length,
        "pair_chance": _pair_chance(value, chances),
        "coverage": F.coalesce("covered", F.lit(0)) / length,
        "digits": F.regexp_count(value, F.lit("[0-9]")) / length,
        "capitals": F.regexp_count(value, F.lit("[A-Z]")) / length,
        "variety": F.size(F.array_distinct(F.split(value, ""))) / length,
        "hex": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "slashes": F.regexp_count(value, F.lit("/")),
        "path_before": before.rlike(r"(?:[A-Za-z]+://\S*|[/\\.])$").cast("double"),
        "assigned": before.rlike(ASSIGNED).cast("double"),
        "secret_word": before.rlike(SECRET_WORDS).cast("double"),
        "plain_word": before.rlike(PLAIN_WORDS).cast("double"),
    }
    return found.join(covered, "value", "left").select(
        *found.columns, *[column.cast("double").alias(name) for name, column in number.items()])


def labelled_findings(measured: DataFrame) -> DataFrame:
    """Findings that evidence outside their score settles: a provider's format or an assignment to a secret's name is
    one; words of letters only, parts of paths and hashes named as such are none. All others stay unlabelled."""
    label = (F.when(F.col("value").rlike(PROVIDER), 1)
             .when(F.col("before").rlike(SECRET_ASSIGNED) & (F.col("digits") > 0) & (F.col("length") >= MIN_LABELLED), 1)
             .when(F.col("value").rlike("^[A-Za-z][a-z]+$|^[A-Z]+$") | (F.col("path_before") == 1)
                   | (F.col("plain_word") == 1), 0))
    return measured.withColumn("label", label.cast("double")).filter("label is not null")


def train(findings: DataFrame, rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 6, seed: int = 3):
    """Forest on at most ``rows`` distinct labelled findings of each class, the first by a hash; None without both.

    Secrets are mostly labelled by the name that they are assigned to, which is a feature too. So that the forest does
    not learn that rule alone, each secret is learned a second time without those features (EVIDENCE).
    """
    distinct = findings.dropDuplicates(["value", "before"]).withColumn("place", F.xxhash64("value", "before"))
    sample = None
    for label in (0, 1):
        part = distinct.filter(F.col("label") == label).orderBy("place").limit(rows)
        sample = part if sample is None else sample.union(part)
    sample = sample.select(*FEATURES, "label")
    bare = sample.filter("label = 1").withColumns({name: F.lit(0.0) for name in EVIDENCE}).select(*sample.columns)
    sample, path = stage(sample.unionByName(bare), "findings")
    forest = None
    if sample.select("label").distinct().count() == 2:
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label").fit(assembled)
    drop_stage(findings.sparkSession, path)
    return forest


def score(measured: DataFrame, forest) -> DataFrame:
    """Findings with score, the forest's chance that they are secrets; without a forest, that of a provider's format."""
    if forest is None:
        return measured.withColumn("score", F.col("value").rlike(PROVIDER).cast("double"))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(measured)
    return forest.transform(assembled).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings=None,
         threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, value, score, secret) of every candidate in every text.

    ``findings`` is a function from measured candidates to labelled ones, those of ``labelled_findings`` by default.
    Word and pair counts cover all texts. Null and empty texts have no candidate; repeated rows and null ids give
    findings like any others; an empty table gives none; further columns are not read. Runs jobs before it returns.
    Values and what stands around them are staged encrypted; the result reads two of the staged tables.
    """
    found, _ = stage_sealed(candidates(docs, id_col, text_col), "candidates")
    words, dictionary = stage_sealed(word_counts(docs, text_col), "words")
    shapes, _ = stage_sealed(features(found.select("value", "before").distinct(), words, pair_chances(words)), "shapes")
    drop_stage(docs.sparkSession, dictionary)
    forest = train((findings or labelled_findings)(shapes))
    scored = score(shapes, forest).select(
        F.col("value").alias("v"), F.col("before").alias("b"), F.round("score", 6).alias("score"))
    return found.join(scored, (found.value == scored.v) & (found.before == scored.b)).select(
        "doc_id", "start", "end", "value", "score", (F.col("score") >= threshold).alias("secret"))
