"""Secret scan: candidate strings, and a random forest that tells secrets from look-alikes. All of it DataFrame functions and Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import let
from matchloom.llm.tables import stored

#: A candidate is a run of so many of these characters with a digit in it, or a value of VALUES.
LEAST = 12
CORE = rf"([A-Za-z0-9+/_.@-]{{{LEAST},}}={{0,2}})"
#: Words that announce a secret, and such a word with a sign of assignment at the end.
KEYWORD = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)"
ASSIGNED = KEYWORD + r"[^A-Za-z0-9]{0,12}$"
#: A value assigned to a keyword, of any length and any characters: in quotes up to the closing one, else up to white space, a quote or closing punctuation.
VALUES = (
    "(?i)(" + KEYWORD.removeprefix("(?i)").replace("(", "(?:") + r"(?:[0-9_-][A-Za-z0-9_-]{0,30})?[\"'`\])]{0,2}[ \t]{0,8}(?:=>|:=|={1,3}|:(?!:))[ \t]{0,8})"
    + r"""(?:(")([^"\r\n]+)(?=")|(')([^'\r\n]+)(?=')|(`)([^`\r\n]+)(?=`)|(["'`]?)([^\s"'`]*[^\s"'`,;.)\]}]))""")
#: Marks around a value in a text.
OPEN, CLOSE = "\u0001", "\u0002"
#: Forms of keys that need no keyword near them.
KEY_SHAPE = r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|sk[-_][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{10,}[.]eyJ"
#: Mean transition cost from which on a string of so many characters is like no words.
OPAQUE, OPAQUE_LENGTH = 9.0, 20
#: What stands in examples instead of a secret.
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000000|12345678)"
#: Characters before a candidate that are looked at.
BEFORE = 60
#: Words of the dictionary: those that make up this share of all words, and occur twice. The dictionary is a table and never collected.
DICTIONARY_SHARE = 1e-6
#: Labelled findings that the forest learns from, at most: the fit's bounded sample, chosen by hash.
FIT_ROWS = 50_000

CORE_FEATURES = [
    "length", "digit_share", "upper_share", "vowel_share", "class_changes", "distinct_share", "transition", "coverage", "slashes", "dots", "at_sign", "dashes", "is_hex", "placeholder"]
#: What labels are made from where reviewed ones are missing is no feature: the forest learns from the string, its neighbouring words and its path.
FEATURES = [*CORE_FEATURES, "neighbour_mean", "neighbour_most", "neighbours", "quoted", "path_before", "path_depth"]
#: A neighbouring word counts from so many labelled findings on; its odds are those of a secret beside it against those without.
NEIGHBOUR_FINDINGS = 5
NEIGHBOUR = r"([a-z_]{2,24})"


def _last(chars: Column, n: int) -> Column:
    return F.substring(chars, -n, n)


def _one_line(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, CLOSE, ""), r"\s+", " ")


def _found(kind: int, at: Column, s: Column, near: Column, after: Column, spaces: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), at.alias("at"), s.alias("s"), near.alias("near"), after.alias("after"), spaces.alias("spaces"))


def _likely_words(text: Column) -> Column:
    """Words that may hold a run, each with what stands before it. The words are bound once, so a word costs its own length."""
    def pick(words: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
        likely = F.filter(numbered, lambda x: (F.length(x["w"]) >= LEAST) & x["w"].rlike("[0-9]") & x["w"].rlike(CORE))
        near = lambda x: F.concat_ws(" ", *[F.when(x["i"] >= k, _last(F.get(words, x["i"] - k), BEFORE)) for k in (3, 2, 1)])
        return F.transform(likely, lambda x: _found(0, x["i"], x["w"], near(x), F.lit(""), F.lit(0)))

    return let(F.split(text, r"\s+"), pick)


def _value_pieces(text: Column) -> Column:
    """The text cut before each value that is assigned to a keyword: the value, what follows it, the piece's end and its white spaces."""
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, "\u0003\u0003"), F.lit(VALUES), F.lit(f"$1$2$4$6$8{OPEN}$3$5$7$9{CLOSE}"))

    def piece(x: Column, k: Column) -> Column:
        return _found(1, k, F.substring_index(x, CLOSE, 1), _last(_one_line(x), BEFORE), F.substring(_one_line(F.substring_index(x, CLOSE, -1)), 1, 8), F.regexp_count(x, F.lit(r"\s+")))

    pieces = let(F.split(marked, OPEN), lambda ps: F.when(F.size(ps) > 1, F.transform(ps, piece)))
    return F.when(text.rlike(VALUES), pieces)


def candidates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, word, part, core, before, after), one row for each candidate: word is the number of its (first) word, part its number in it, from 0.

    Runs of LEAST characters with a digit come first in a word, then the values assigned to keywords that are none of
    them. The work on a text grows with its length and the number of its candidates, not with their product.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9]") | F.col("text").rlike(VALUES))
    none = F.array().cast("array<struct<kind:int,at:int,s:string,near:string,after:string,spaces:int>>")
    both = F.concat(_likely_words(F.col("text")), F.coalesce(_value_pieces(F.col("text")), none))
    found = stored(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), both.alias("x")).select("doc_id", "row", F.inline("x")), "candidates")

    runs = found.where("kind = 0").select("doc_id", "row", F.col("at").alias("word"), "s", "near", F.posexplode(F.regexp_extract_all("s", F.lit(CORE), F.lit(1))).alias("part", "core"))
    runs = runs.where(F.col("core").rlike("[0-9]")).select(
        "doc_id", "row", "word", "part", "core", _last(F.concat_ws(" ", "near", F.expr("left(s, locate(core, s) - 1)")), BEFORE).alias("before"),
        F.expr("substring(s, locate(core, s) + length(core), 8)").alias("after"))
    # A value stands at the start of each piece but the first; the white space before a piece is the number of its word.
    upto = Window.partitionBy("row").orderBy("at")
    values = found.where("kind = 1").select(
        "doc_id", "row", "at", F.coalesce(F.sum("spaces").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("word"),
        F.col("s").alias("core"), F.lag("near").over(upto).alias("before"), "after").where("at > 0")
    values = values.join(runs.select("row", "word", "core").distinct(), ["row", "word", "core"], "left_anti")
    taken = runs.groupBy("row", "word").agg((F.max("part") + 1).alias("taken"))
    place = F.row_number().over(Window.partitionBy("row", "word").orderBy("at")) - 1
    values = values.join(taken, ["row", "word"], "left").withColumn("part", F.coalesce("taken", F.lit(0)) + place)
    columns = ["doc_id", "word", "part", "core", "before", "after"]
    return runs.select(columns).unionByName(values.select(columns))


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs(text) -> stored (word, n): how often each lower-case word of 4 to 12 letters a-z occurs in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word"))
    return stored(words.where(F.length("word").between(4, 12)).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "vocabulary")


def _classes(chars: Column) -> Column:
    return F.translate(chars, "0123456789", "0000000000")


def _pairs(chars: Column) -> Column:
    """Neighbouring characters of an array, digits as 0; linear in its length."""
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(_classes(a), _classes(b)))


def transitions(words: DataFrame) -> DataFrame:
    """vocabulary() -> (pair, cost): minus the log of the share that a letter pair has among all pairs, weighted by occurrence; 676 rows at most."""
    pairs = words.select(F.explode(_pairs(F.split("word", ""))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select("pair", (-F.log(F.col("n") / F.sum("n").over(Window.partitionBy()))).alias("cost"))


def _core_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Features of each different candidate string."""
    cores = found.select("core").distinct().withColumn("chars", F.filter(F.split(F.lower("core"), ""), lambda c: c != ""))
    n = F.length("core").cast("double")
    share = lambda pattern: F.regexp_count("core", F.lit(pattern)) / n
    changes = F.regexp_count("core", F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])")) / n
    plain = cores.select(
        "core", n.alias("length"), share("[0-9]").alias("digit_share"), share("[A-Z]").alias("upper_share"), share("(?i)[aeiou]").alias("vowel_share"),
        changes.alias("class_changes"), (F.size(F.array_distinct("chars")) / n).alias("distinct_share"), (share("/") * n).alias("slashes"), (share("[.]") * n).alias("dots"),
        (share("@") * n).alias("at_sign"), (share("[-_]") * n).alias("dashes"), F.col("core").rlike("^[0-9a-fA-F]+$").cast("double").alias("is_hex"),
        F.col("core").rlike(PLACEHOLDER).cast("double").alias("placeholder"))
    unseen = 14.0
    pairs = cores.select("core", F.explode(_pairs(F.col("chars"))).alias("pair")).join(F.broadcast(transitions(words)), "pair", "left")
    moved = pairs.groupBy("core").agg(F.avg(F.coalesce("cost", F.lit(unseen))).alias("transition"))
    known = words.where(F.col("n") >= F.greatest(F.lit(2.0), DICTIONARY_SHARE * words.agg(F.sum("n")).scalar())).select("word")
    sizes = [F.transform(F.sequence(F.lit(1), F.greatest(F.size("chars") - k + 1, F.lit(1))), lambda i, k=k: F.array_join(F.slice("chars", i, k), "")) for k in range(4, 13)]
    parts = cores.select("core", F.explode(F.array_distinct(F.concat(*sizes))).alias("word")).where(F.length("word") >= 4)
    covered = parts.join(known, "word", "left_semi").groupBy("core").agg(F.sum(F.length("word")).alias("letters"))
    out = plain.join(moved, "core", "left").join(covered, "core", "left")
    return out.withColumn("transition", F.coalesce("transition", F.lit(unseen))).withColumn(
        "coverage", F.least(F.lit(1.0), F.coalesce("letters", F.lit(0)) / F.col("length"))).select("core", *CORE_FEATURES)


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """candidates() and vocabulary() -> candidates with CORE_FEATURES and what stands around them; strings that occur often are described once."""
    path = F.regexp_extract("before", r"(\S*)$", 1)
    around = found.select(
        "doc_id", "word", "part", "core", F.array_distinct(F.regexp_extract_all(F.lower("before"), F.lit(NEIGHBOUR), F.lit(1))).alias("near"),
        F.col("before").rlike(KEYWORD).cast("double").alias("keyword_near"), F.col("before").rlike(ASSIGNED).cast("double").alias("assigned"),
        (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double").alias("quoted"), F.col("before").rlike(r"[\w.]*[/\\@:.]$").cast("double").alias("path_before"),
        F.regexp_count(F.concat(path, "core"), F.lit(r"[/\\]")).cast("double").alias("path_depth"))
    return stored(around.join(_core_features(found, words), "core"), "findings")


def neighbour_odds(labelled: DataFrame) -> DataFrame:
    """described() with label -> (near_word, odds): log odds of a secret beside the word, against the share of secrets in all."""
    total = labelled.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).first()
    bad, good = float(total["bad"] or 0), float(total["good"] or 0)
    counts = labelled.select(F.explode("near").alias("near_word"), "label").groupBy("near_word").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5)) - F.log(F.lit((bad + 0.5) / (good + 0.5)))
    return counts.where(F.col("n") >= NEIGHBOUR_FINDINGS).select("near_word", odds.alias("odds"))


def with_neighbours(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """Adds how many neighbouring words have odds, and their mean and their greatest; 0 without any."""
    sets = rows.select("near").distinct()
    told = sets.select("near", F.explode("near").alias("near_word")).join(odds, "near_word").groupBy("near").agg(
        F.count(F.lit(1)).cast("double").alias("neighbours"), F.avg("odds").alias("neighbour_mean"), F.max("odds").alias("neighbour_most"))
    # A table, so that the join can be split where most findings stand beside the same words.
    out = rows.join(stored(told, "neighbours"), "near", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("neighbours", "neighbour_mean", "neighbour_most")})


def distant_labels(rows: DataFrame) -> DataFrame:
    """Labels where reviewed ones are missing: 1 for what is assigned to a keyword and no placeholder, address or path; 0 for what has no keyword near.

    Left out are others, and what has no keyword near but the form of a key, or is long and like no words: it may be a secret.
    """
    secret = (F.col("assigned") > 0) & (F.col("placeholder") == 0) & (F.col("at_sign") == 0) & (F.col("dots") < 2) & (F.col("slashes") < 3) & (F.col("digit_share") > 0.05)
    opaque = (F.col("transition") >= OPAQUE) & (F.col("length") >= OPAQUE_LENGTH) & (F.col("slashes") == 0) & (F.col("dots") == 0)
    harmless = ((F.col("keyword_near") == 0) & ~F.col("core").rlike(KEY_SHAPE) & ~opaque) | (F.col("at_sign") > 0) | (F.col("placeholder") > 0)
    return rows.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0)).where("label is not null")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, word, part, n_chars, finding_sha256, held_out, score, is_secret), one row for each candidate.

    labelled(doc_id, word, part, label): reviewed findings; without any, distant_labels() of the documents that are not held
    out (crc32 of the id as text, mod 5 = 0). The forest learns from at most FIT_ROWS of them, the odds of neighbouring words from all. score: the forest's
    probability of a secret; is_secret: 0.5 or more. The string itself is not given out, its digest is.

    Null and empty texts, and digitless ones that assign nothing to a keyword, have no candidates. Without labels of both classes the score is 1 for what is
    assigned to a keyword, else 0. A null doc_id is scanned and held out. Repeated rows give repeated findings. Other columns are not read.
    """
    found = stored(candidates(docs), "findings")
    rows = described(found, vocabulary(docs))
    if labelled is None:
        known = distant_labels(rows.where(~held_out(F.col("doc_id"))))
    else:
        own = labelled.select("doc_id", "word", "part", F.col("label").cast("double").alias("label"))
        known = rows.join(own, ["doc_id", "word", "part"])
    known = stored(known, "labelled")
    odds = stored(neighbour_odds(known), "odds")
    rows, known = with_neighbours(rows, odds), with_neighbours(known, odds)
    n = known.count()
    known = known if n <= FIT_ROWS else known.where(F.pmod(F.xxhash64("doc_id", "word", "part"), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / n))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    sample = stored(vectors.transform(known).select("features", "label"), "secret_fit")
    if sample.select("label").distinct().count() < 2:
        scored = rows.withColumn("score", F.col("assigned"))
    else:
        forest = RandomForestClassifier(numTrees=20, maxDepth=6, seed=3).fit(sample)
        scored = forest.transform(vectors.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "word", "part", F.length("core").cast("bigint").alias("n_chars"), F.sha2(F.col("core").cast("binary"), 256).alias("finding_sha256"),
        held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).alias("is_secret"))
