"""Secret scan with a random forest against false positives, in DataFrame functions and Spark ML only.

Candidates are long tokens with a digit or an inner capital, and values that are assigned to a secret's
name. A forest judges each by its length, its character transitions (changes of kind, and pairs of letters
that are common in words), how much of it dictionary words cover, its path and its neighbouring words; it
is trained on labelled findings.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import free_name, quoted, stash

#: A long token inside a word: at least 16 token characters with a digit, or a capital after the first, with base64's padding, without a full stop at its end.
#: '=' and ':' are no token characters, so that an assigned value stands alone and its name before it.
TOKEN = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*[0-9]|[A-Za-z+/_.-]+[A-Z])[A-Za-z0-9+/_.-]{16,}(?<!\.)={0,2}"
#: Names whose assigned value is a candidate of its own, and signs that assign.
SECRET_NAME = r"(?i:secret|token|passw|passphrase|pwd|api_?key|access_?key|private|credential|bearer|auth(?!or))"
_SIGN = r"(?::=|=>|==?|:)"
#: Stands before a word that the words before it make an assigned value.
_MARK = "\x01"
#: The assignment of a word by the words before it, or by its own first sign.
_ASSIGNED = rf"{SECRET_NAME}[^\s=:,;]{{0,40}}(?:\s[^\s=:,;{_MARK}]{{1,40}})?\s?(?:{_SIGN}\s?{_MARK}|{_MARK}{_SIGN})"
#: An assigned value: 8 characters or more up to a quote, the next assignment or closing punctuation.
VALUE = rf"(?<=[=:>\"'`({_MARK}])(?<=(?:{SECRET_NAME}[^\s=:,;]{{0,40}}{_SIGN}|{_MARK}{_SIGN}?)[\"'`(]{{0,2}})(?![=>:(]|//)(?:(?![,;&|][A-Za-z_\"'][A-Za-z0-9_.\-\"']{{0,40}}[=:])[^\s\"'`{_MARK}]){{8,}}(?:(?=[\"'`])|(?<![,;.)\]}}>]))"
CANDIDATE = f"{VALUE}|{TOKEN}"
_WHITE = r"[\x20\x09-\x0D]+"
#: Dictionary: words whose presence speaks for a name rather than a random token.
WORDS = (
    "the and for with that this from not are was have you all can but one out use new other "
    "test example sample user name file data value version build release image model page index config local server client "
    "http www com org html json item list order number date time line block part section chapter figure table "
    "account action address admin agent answer array author backup base batch binary board body book branch bucket cache "
    "call case change channel character check child class code color column command comment common content context control "
    "copy count country create current custom customer database default delete demo design detail device display document "
    "domain element email empty error event field filter first folder form format frame function global group handler head "
    "header height hello home host input install int internal job key label language last layer layout length letter level "
    "library link log login main manager map mark master max menu message method min mode module month music network news "
    "node note object offset open option output package parent password path photo place player point port post price "
    "print process product profile program project property public query random range record report request response "
    "result return right root route rule save schema scope screen script search select service session set shop simple "
    "size source space start state status step store story stream string style subject system tag target task team "
    "template text thread title token tool total trace track tree type under unit update upload url valid video view "
    "water web week width window word work world write year zone"
).split()
#: Pairs of letters that are common in words, most common first.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
#: Words before a candidate that name a secret, and words that name something else.
SECRET_NEAR = r"(secret|token|passw|pwd|api_?key|apikey|access_?key|private|credential|bearer|auth)"
OTHER_NEAR = r"(commit|sha1|sha256|md5|hash|digest|checksum|uuid|guid|etag|revision|isbn|order|phone|card|example|sample|dummy|placeholder|version)"
PATH_NOISE = r"(test|example|sample|doc|vendor|lock|fixture|mock|readme)"
FEATURES = ["length", "transitions", "pairs", "distinct", "digits", "upper", "hex", "dictionary", "path_noise", "secret_near", "other_near", "assigned", "repeats", "symbols", "vowels"]
#: The forest is fitted on at most so many labelled findings, chosen by hash.
MAX_TRAINING = 50_000


def _candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """candidates() and, to put words together again: row, marked, gap before the candidate, rest after the last."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    path = F.coalesce(quoted(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    words = F.split(text, _WHITE)
    # Most texts assign nothing to a secret's name; only the others' words are read with those before them.
    named = F.rlike(text, F.lit(rf"{SECRET_NAME}[^\s=:,;]{{0,40}}(?:\s+[^\s=:,;]{{1,40}})?\s*[=:]"))
    whole = F.struct(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("row"), path.alias("path"), words.alias("w"), named.alias("named"))
    rows = docs.select(F.explode(F.array(whole)).alias("s")).select("s.*")  # through a generator, else a text is split again for each of its words
    found = F.expr("filter(transform(w, (x, i) -> struct(i as at, x as word)), x -> length(x.word) >= if(named, 8, 16))")

    def marked(x: Column) -> Column:
        lead = F.array_join(F.slice("w", F.greatest(x["at"] - 2, F.lit(1)), F.least(x["at"], F.lit(3))), " ")
        assigned = F.col("named") & F.rlike(F.concat(lead, F.lit(" " + _MARK), x["word"]), F.lit(_ASSIGNED))
        return F.struct(x["at"].alias("at"), F.when(assigned, F.concat(F.lit(_MARK), x["word"])).otherwise(x["word"]).alias("word"))

    rows = rows.withColumn("hits", F.filter(F.transform(found, marked), lambda x: F.rlike(x["word"], F.lit(CANDIDATE))))
    each = rows.where("size(hits) > 0").select("doc_id", "row", "path", F.explode_outer(F.expr("transform(hits, x -> struct(x.at as at, x.word as word, array_join(slice(w, greatest(x.at - 2, 1), least(x.at, 3)), ' ') as lead, coalesce(get(w, x.at + 1), '') as next))")).alias("h"))
    tokens = F.regexp_extract_all("h.word", F.lit(CANDIDATE), F.lit(0))
    each = each.select("doc_id", "row", "path", "h", F.split("h.word", CANDIDATE).alias("between"), F.posexplode(tokens).alias("part", "candidate"))
    gap, rest = F.get("between", F.col("part")), F.get("between", F.col("part") + 1)
    before = F.concat_ws(" ", "h.lead", F.translate(gap, _MARK, ""))
    last = F.when(F.col("part") + 2 >= F.size("between"), rest)
    return each.select("doc_id", F.col("h.at").alias("at"), "part", "candidate", before.alias("before"), F.concat_ws(" ", rest, "h.next").alias("after"), "path", "row", F.startswith("h.word", F.lit(_MARK)).alias("marked"), gap.alias("gap"), last.alias("rest"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, at, part, candidate, before, after, path), one row per candidate.

    `at` is the word's place in the text, words being runs without white space, and `part` counts the
    candidates of one word; before holds the three words before it, with what stands between the
    candidate and the start of its own word or the candidate before it, and after what follows it in its
    word and the next word.
    """
    return _candidates(docs, id_col, text_col, path_col).select("doc_id", "at", "part", "candidate", "before", "after", "path")


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, the longest first, told apart by their first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words), key=len, reverse=True):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{x}(?:{'|'.join(rest)})" for x, rest in sorted(by.items())) + ")"


def features(found: DataFrame) -> DataFrame:
    """Adds FEATURES as doubles to rows with candidate, before, after and path."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    kinds = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(kinds, "A+", "A"), "a+", "a"), "0+", "0")
    bare = F.regexp_replace(F.lower(c), _any_of(WORDS), "")

    def share(pattern: str) -> Column:
        return 1 - F.length(F.regexp_replace(c, pattern, "")) / n

    cols = {
        "length": F.length(c),
        "transitions": (F.length(runs) - 1) / n,
        "pairs": 1 - F.length(F.regexp_replace(F.lower(c), _any_of(PAIRS), "")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hex": F.rlike(c, F.lit("^([0-9a-f]+|[0-9A-F]+)$")).cast("int"),
        "dictionary": 1 - F.length(bare) / n,
        "path_noise": F.rlike(F.lower(F.col("path")), F.lit(PATH_NOISE)).cast("int"),
        "secret_near": F.rlike(F.lower(F.col("before")), F.lit(SECRET_NEAR)).cast("int"),
        "other_near": F.rlike(F.lower(F.concat_ws(" ", "before", "after")), F.lit(OTHER_NEAR)).cast("int"),
        "assigned": F.rlike(F.col("before"), F.lit(r"[=:]\s*[\"'`]?$")).cast("int"),
        "repeats": 1 - F.length(F.regexp_replace(c, r"(.)\1+", "$1")) / n,
        "symbols": share("[^A-Za-z0-9+/_.-]"),
        "vowels": share("[AEIOUaeiou]"),
    }
    return found.withColumns({k: v.cast("double") for k, v in cols.items()})


def synthetic_findings(spark: SparkSession, n: int = 6000, seed: int = 5) -> DataFrame:
    """Labelled findings made by rule: (candidate, before, after, path, label), half of them secrets.

    Secrets are random tokens of 16 to 48 characters in hex, base64, capitals with digits (a key id with
    its prefix) or mixed letters, assigned to a secret's name or following one; two in five of those that
    are not hex stand alone. The others are digests, ids, numbers, host names, names with digits in small
    or capital letters, and placeholders, some of them next to a secret's name or assigned. Half as many
    more are without digits or short: secrets are random letters and assigned passwords of 8 to 15
    characters with signs; the others are compound names and words, and words, calls and placeholders
    assigned to a secret's name.
    """

    def draw(salt: object, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(str(salt))), F.lit(n)).cast("int")

    def pick(options: list[str], salt: object) -> Column:
        return F.element_at(F.array(*(F.lit(x) for x in options)), draw(f"pick{salt}", len(options)) + 1)

    h = F.sha2(F.concat_ws("-", F.lit(seed), F.col("id")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[^A-Za-z0-9+/]", "")
    words = [pick(WORDS, f"word{i}") for i in range(4)]
    number = F.concat((draw("n", 9 * 10**7) + 10**7).cast("string"), (draw("m", 9 * 10**7) + 10**7).cast("string"))
    kind = draw("kind", 4)
    size = F.lit(16) + draw("size", 33)
    capitals = F.translate(F.substring(h, 1, 16), "0123456789abcdef", "QW2RT5YUIPAS3DF7")
    prefix = F.substring(F.translate(F.substring(h, 100, 4), "0123456789abcdef", "GHJKAZXCVBNMLOSI"), 1, 4)
    secret = F.when(kind == 0, F.substring(h, F.lit(1), size)).when(kind == 1, F.substring(b64, F.lit(1), size)).when(kind == 2, F.concat(prefix, capitals)).otherwise(F.substring(F.translate(b64, "+/", "xk"), F.lit(20), size))
    alone = (kind > 0) & (draw("alone", 5) < 2)
    key = pick(["token", "secret", "password", "api_key", "access_key", "private_key", "auth_token", "credential"], 1)
    assign = pick([' = "', "=", ": ", ' : "', " = '", " "], 2)
    noise = pick(["sha256", "commit", "checksum", "uuid", "order", "card", "version", "digest"], 3)
    uuid = F.regexp_replace(F.substring(h, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    named = F.concat_ws("_", words[0], words[1], words[2], F.substring(number, 1, 3))
    host = F.concat_ws(".", F.concat(words[0], F.substring(number, 1, 1)), words[1], pick(["com", "org", "net", "example.com"], 9))
    named = F.when(draw("of4", 4) == 0, F.upper(named)).when(draw("of4", 4) == 1, F.rpad(host, 16, "s")).otherwise(named)
    filler = F.concat(F.repeat(pick(["x", "0", "ab", "*"], 4), F.lit(16)), F.lit("1234"))
    other = F.when(kind == 0, F.substring(h, 1, 40)).when(kind == 1, F.when(draw("of3", 3) == 0, uuid).otherwise(number)).when(kind == 2, named).otherwise(F.when(draw("of2", 2) == 0, filler).otherwise(F.concat(words[3], F.lit("-"), named)))
    other_before = F.when(kind == 0, F.concat(noise, assign)).when((kind == 2) | (kind == 3), F.concat(F.when(draw("of5", 5) < 2, key).otherwise(words[0]), assign)).otherwise(F.concat(noise, F.lit(" ")))
    label = draw("label", 2)
    lead = F.concat_ws(" ", words[1], words[2])
    syllables = ["er", "ung", "ti", "on", "schlich", "ment", "keit", "la", "st", "con", "ber", "den", "tz", "tra", "ing", "sch"]
    spoken = F.concat(*(pick(syllables, 20 + i) for i in range(7)))
    signs = F.translate(F.substring(b64, F.lit(5), F.lit(8) + draw("more8", 8)), "AEIMaeim048+/", "!@#$%&*?!@#$^")
    letters = F.translate(F.substring(b64, F.lit(3), F.lit(16) + draw("more20", 20)), "0123456789+/", "qWzRtYxIoPaS")
    letters = F.when(draw("of3", 3) == 0, F.concat(prefix, F.translate(F.substring(h, 1, 16), "0123456789abcdef", "QWZRTYUIPASDFGHK"))).otherwise(letters)
    camel = F.concat(*(F.initcap(pick(WORDS, 40 + i)) for i in range(4)), F.initcap(spoken))
    plain = F.when(draw("of3", 3) == 0, camel).when(draw("of3", 3) == 1, F.upper(spoken)).otherwise(F.concat_ws("-", F.initcap(words[0]), F.initcap(spoken), F.initcap(words[2])))
    stub = pick(["required", "undefined", "********", "xxxxxxxx", "<your-value>", "${SECRET_VALUE}", "{{password}}", "getpass()", "os.environ[KEY]", "changeme", "example1"], 60)
    stub = F.when(draw("of3", 3) == 0, stub).when(draw("of3", 3) == 1, F.substring(spoken, 1, 14)).otherwise(F.concat(words[0], pick(["_", "-", "", "."], 61), words[1], words[2]))
    odd, named_before = draw("of2", 2) == 1, F.concat(key, assign)
    short = F.when(label == 1, F.when(odd, signs).otherwise(letters)).otherwise(F.when(odd, stub).otherwise(plain))
    short_before = F.when(odd, F.concat(key, pick([' = "', "=", ": ", "='"], 62))).when(label == 1, F.when(alone, words[3]).otherwise(named_before)).otherwise(F.when(draw("of5", 5) == 0, F.concat(words[0], assign)).otherwise(words[3]))
    more = spark.range(10**9, 10**9 + n // 2).select(
        short.alias("candidate"),
        F.concat_ws(" ", lead, short_before).alias("before"),
        F.concat_ws(" ", pick(['"', "", "'", ","], 6), words[3]).alias("after"),
        pick(["", "src/app.py", "deploy/env", "web"], 8).alias("path"),
        label.cast("double").alias("label"),
    )
    first = spark.range(n).select(
        F.when(label == 1, secret).otherwise(other).alias("candidate"),
        F.concat_ws(" ", lead, F.when((label == 1) & alone, words[3]).when(label == 1, F.concat(key, assign)).otherwise(other_before)).alias("before"),
        F.concat_ws(" ", pick(['"', "", "'", ","], 6), words[3]).alias("after"),
        F.when(draw("path", 10) < F.when(label == 1, 1).otherwise(4), pick(["tests/data.py", "docs/example.md", "vendor/x.lock"], 7)).otherwise(pick(["", "src/app.py", "deploy/env", "web"], 8)).alias("path"),
        label.cast("double").alias("label"),
    )
    return stash(first.unionByName(more), "findings")  # features would repeat the long expressions


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11, max_rows: int = MAX_TRAINING) -> RandomForestClassificationModel:
    """Fits the forest on labelled findings (candidate, before, after, path, label in {0.0, 1.0}).

    At most `max_rows` findings are used, those of the smallest hashes. Null fields count as empty and
    rows without a label are left out; both labels must occur.
    """
    rows = findings.where("label is not null").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("candidate", "before", "after", "path")), F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "label").limit(max_rows)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(ready.select("features", "label"))


def _scored(found: DataFrame, model: RandomForestClassificationModel, threshold: float) -> DataFrame:
    scored = PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), model]).transform(features(found))
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.withColumns({"score": score, "is_secret": score >= threshold})


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, at, part, candidate, before, after, path, score, is_secret), one row per candidate.

    score is the forest's probability of a secret, is_secret score >= threshold. Null, empty and blank
    texts have no candidates; repeated rows give their findings each, and so does each candidate of one
    word. Extra columns are ignored, a missing path is empty.
    """
    return _scored(candidates(docs, id_col, text_col, path_col), model, threshold).select("doc_id", "at", "part", "candidate", "before", "after", "path", "score", "is_secret")


def redact(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """The input rows, with all their columns, every found secret replaced by `mask` where it stands.

    The same string elsewhere stays unless it is found there too; white space and all else stay as they
    are. Rows are told apart by id and text.
    """
    scored = _scored(_candidates(docs, id_col, text_col, path_col), model, threshold)
    piece = F.concat("gap", F.when(F.col("is_secret"), F.lit(mask)).otherwise(F.col("candidate")), F.coalesce("rest", F.lit("")))
    # Repeated rows find the same: a set of parts puts the word together.
    word = F.array_join(F.array_sort(F.collect_set(F.struct("part", piece.alias("piece"))))["piece"], "")
    words = scored.groupBy("doc_id", "row", "at", "marked").agg(word.alias("word"), F.max("is_secret").alias("any")).where("any")
    words = words.withColumn("word", F.when(F.col("marked"), F.expr("substring(word, 2)")).otherwise(F.col("word")))
    d, r, m = (free_name(docs, x) for x in ("found_doc", "found_row", "found_words"))
    found = words.groupBy(F.col("doc_id").alias(d), F.col("row").alias(r)).agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias(m))
    joined = docs.join(found, quoted(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(quoted(text_col)) == F.col(r)), "left")
    text = quoted(text_col).cast("string")
    both = F.arrays_zip(F.split(text, _WHITE).alias("word"), F.regexp_extract_all(text, F.lit(_WHITE), F.lit(0)).alias("white"))
    clean = F.array_join(F.transform(both, lambda x, i: F.concat(F.coalesce(F.element_at(F.col(m), i), x["word"]), F.coalesce(x["white"], F.lit("")))), "")
    return joined.withColumn(text_col, F.when(F.col(m).isNull(), text).otherwise(clean)).select(*map(quoted, docs.columns))
