"""Secret scans with a random forest against false positives, in DataFrame operations only.

Candidates are runs of key-like characters of at least LEAST_CHARS that hold a
digit and a letter, and whatever value of at least LEAST_VALUE stands after a key
word and a colon, equals sign or "is", found in whole texts. An equals sign is
part of a candidate only as padding at its end. Each is described by its length,
classes and transitions of its characters, how much of it a dictionary covers,
whether it lies in a path or URL, and the words beside it.
A random forest, trained on labelled findings, gives each candidate a
probability; findings from THRESHOLD on are secrets.

The labelled findings that come with the operator are made by `findings`: texts
with keys, tokens and passwords in the forms that services give them, and texts
with what scanners take for them: digests, identifiers, placeholders, file paths,
long words. A table of one's own findings (text, start, secret) can be given
instead. The dictionary is built from the scanned corpus: its frequent words and
letter pairs; the share of a candidate's characters in such words, and the share
of its letter pairs that are frequent, are features.

Null and empty texts have no candidates, nor has an empty table. Offsets are code
points from 0; of candidates that could overlap the first and longest stands.
Texts are cut whole, whatever their length. Repeated rows are scanned each.
Columns of other names are not read and do not come out. Frequent words and pairs
that tie at the limit go by name.
"""

from __future__ import annotations

import warnings

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash

#: Shortest candidate, in code points.
LEAST_CHARS = 16
#: Shortest value after a key word.
LEAST_VALUE = 8
#: Stands around a candidate while a text is cut; noncharacters do not occur in text, and are taken out first.
MARK = "\ufdd0"
THRESHOLD = 0.5
#: Code points before and after a candidate that its neighbours are read from.
AROUND = 48
#: Fixed lists: words that come before a secret, and words that say a value is none.
KEY_WORDS = "token|secret|password|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|auth|authorization|bearer|credential|private[_ -]?key|client[_ -]?secret|signature"
OTHER_WORDS = "sha1|sha256|sha512|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|integrity|example|sample|placeholder|dummy|test|changeme|redacted|request[_ -]?id|trace[_ -]?id|version|build"
RUN = "[A-Za-z0-9+/_.~-]"
VALUE = "[A-Za-z0-9+/_.~!#$%*?@^-]"
#: What stands before a value; the cheap look at one or two characters comes first, as this is tried at every place.
AFTER_KEY = rf"(?<=[:=>\"'`]|[:=>s] )(?<=(?i:{KEY_WORDS})[A-Za-z0-9_-]{{0,16}}[\"'`]? {{0,2}}(?:=>|:=|[:=]|\bis ) {{0,2}}[\"'`]?)"
CANDIDATE = (
    rf"(?:{AFTER_KEY}{VALUE}{{{LEAST_VALUE - 1},}}[A-Za-z0-9+/_!#$%*@^-]={{0,2}}(?![A-Za-z0-9+/=_!#$%*@^-])"
    rf"|(?<!{RUN})(?={RUN}*[0-9])(?={RUN}*[A-Za-z])[A-Za-z0-9+/_~-]{RUN}{{{LEAST_CHARS - 2},}}[A-Za-z0-9+/_-]={{0,2}}(?![A-Za-z0-9+/=_~-]))"
)
#: Fixed: how known services begin their keys.
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk_live_|rk_live_|sk-|AIza|ya29\\.|eyJ|SG\\.|npm_|hf_|pypi-"

FEATURES = (
    "length",
    "upper",
    "lower",
    "digit",
    "mark",
    "hex",
    "uuid",
    "changes",
    "repeat",
    "distinct",
    "known_pairs",
    "known_words",
    "word_run",
    "path",
    "url",
    "email",
    "assigned",
    "quoted",
    "key_word",
    "other_word",
    "prefix",
    "dots",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, value, before, after) of each candidate in whole texts."""
    text = F.replace(F.col(text_col), F.lit(MARK), F.lit(" "))
    # Texts without a run of the least length or a key word before a value are not cut at all.
    some = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.col("text").rlike(rf"{RUN}{{{LEAST_CHARS}}}|{AFTER_KEY}{VALUE}{{{LEAST_VALUE}}}"))
    parts = some.select("id", F.split(F.regexp_replace("text", CANDIDATE, f"{MARK}$0{MARK}"), MARK).alias("p")).where(F.size("p") > 1)
    ends = F.expr("aggregate(transform(p, x -> char_length(x)), array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))")
    parts = parts.withColumn("at", ends)
    one = F.explode(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)))
    each = parts.select("id", "p", "at", one.alias("i"))
    return each.select(
        "id",
        F.expr("at[i]").alias("start"),
        F.expr("at[i + 1]").alias("end"),
        F.expr("p[i]").alias("value"),
        F.expr(f"right(p[i - 1], {AROUND})").alias("before"),
        F.expr(f"left(p[i + 1], {AROUND})").alias("after"),
    )


def share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def dictionary(docs: DataFrame, text_col: str = "text", most_pairs: int = 300, most_words: int = 5000) -> DataFrame:
    """One row: the frequent letter pairs (pairs) and words of three letters or more (words) of a corpus.

    All words of all texts count, after runs as long as candidates are taken out.
    They are counted first, so that pairs are read once a different word.
    """
    low = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), rf"{RUN}{{{LEAST_CHARS},}}", " "))
    words = docs.select(F.explode(F.split(low, "[^a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = Stash(docs.sparkSession, "dictionary").keep(words.where("length(word) between 2 and 40"))
    twos = words.select("n", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i")).select("n", F.expr("substring(word, i, 2)").alias("two"))
    top = lambda df, by, most, name: df.groupBy(by).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), by).limit(most).agg(F.sort_array(F.collect_list(by)).alias(name))
    # Two rows of bounded arrays side by side.
    return top(twos, "two", most_pairs, "pairs").withColumn("_k", F.lit(1)).join(top(words.where("length(word) > 2"), "word", most_words, "words").withColumn("_k", F.lit(1)), "_k").drop("_k")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with FEATURES. known: the one row of dictionary."""
    v, before, after = F.col("value"), F.lower("before"), F.lower("after")
    has = lambda c, p: c.rlike(p).cast("double")
    low = F.lower(v)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]", "A"), "[a-z]", "b"), "[0-9]", "0"), "[^Ab0]", "-")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    pairs = F.expr("size(filter(transform(sequence(1, greatest(char_length(value) - 1, 1)), i -> substring(lower(value), i, 2)), x -> array_contains(pairs, x)))")
    parts = "split(lower(regexp_replace(value, '([a-z])([A-Z])', '$1 $2')), '[^a-z]+')"
    covered = F.expr(f"aggregate(filter({parts}, x -> array_contains(words, x)), 0, (n, x) -> n + char_length(x))")
    # A corpus has one row of bounded size, broadcast with each candidate row kept once.
    joined = found.withColumn("_one", F.lit(1)).join(F.broadcast(known.withColumn("_one", F.lit(1))), "_one").drop("_one")
    cols = {
        "length": F.length(v).cast("double"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "digit": share("[0-9]"),
        "mark": share("[^A-Za-z0-9]"),
        "hex": has(v, "^[0-9a-fA-F]+$"),
        "uuid": has(v, "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
        "changes": F.length(runs) / F.length(v),
        "repeat": F.regexp_count(v, F.lit(r"(.)\1")) / F.length(v),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "known_pairs": pairs / F.length(v),
        "known_words": covered / F.length(v),
        "word_run": F.array_max(F.transform(F.split(low, "[^a-z]+"), F.length)) / F.length(v),
        "path": has(F.concat(F.right(before, F.lit(8)), v), r"/[^/ ]*/|^\.?/|\\\\"),
        "url": has(F.concat(before, v), r"(https?|ftp)://[^ ]*$|www\.[^ ]*$"),
        "email": has(F.concat(v, F.left(after, F.lit(2))), r"@[a-z0-9]|@$"),
        "assigned": has(F.right(before, F.lit(4)), r"[:=] ?[\"'`]?$"),
        "quoted": has(F.right(before, F.lit(1)), "[\"'`]$"),
        "key_word": has(before, rf"(^|[^a-z])[a-z_-]*({KEY_WORDS})[a-z_-]*[\"']? ?(is|[:=]|=>)? ?[\"'`]?$"),
        "other_word": has(F.concat(before, F.lit(" "), low), rf"({OTHER_WORDS})"),
        "prefix": has(v, f"^({PREFIXES})"),
        "dots": F.regexp_count(v, F.lit(r"\.")).cast("double"),
    }
    return joined.select("*", *[cols[f].cast("double").alias(f"f_{f}") for f in FEATURES]).drop("pairs", "words")


def findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(id, text, start, secret): labelled findings, one in a text, made from row numbers alone."""
    r = lambda n: f"substring(sha2(concat('{n}:', id), 512), 1, 128)"
    b64 = lambda n: f"translate(base64(unhex({r(n)})), '+/=', 'xYz')"
    pick = lambda n, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), 1 + cast(pmod(xxhash64('{n}', id), {len(xs)}) as int))"
    word = pick("w1", "river", "table", "house", "window", "garden", "station", "morning", "system", "market", "number")
    word2 = pick("w2", "report", "index", "module", "handler", "config", "session", "archive", "document", "service", "image")
    key = pick("k", "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret")
    sep = pick("s", ' = "', "=", ": ", ' => "', " ")
    firm = pick("f", ' = "', "=", ": ", ' => "', " is ")
    other = pick("o", "commit ", "sha256: ", "md5 ", "checksum = ", "request_id=", "etag: ", "revision ", "uuid ")
    num = "cast(pmod(xxhash64('n', id), 100000) as string)"
    length = "cast(20 + pmod(xxhash64('l', id), 30) as int)"
    forms = [  # (what comes before, value, whether it is a secret)
        (f"concat({key}, {sep})", f"substring({r('a')}, 1, 40)", 1),
        (f"concat({key}, {sep})", f"substring({b64('b')}, 1, {length})", 1),
        (f"concat({word}, ' ')", f"concat('AKIA', upper(substring({r('c')}, 1, 16)))", 1),
        (f"concat({pick('p', '', 'use ', 'export ')}, ' ')", f"concat({pick('g', 'ghp_', 'glpat-', 'sk_live_', 'npm_', 'hf_')}, substring({b64('d')}, 1, 36))", 1),
        ("'Authorization: Bearer '", f"concat('eyJ', substring({b64('e')}, 1, 30), '.', substring({b64('f')}, 1, 40))", 1),
        (f"concat({key}, {sep})", f"substring({r('h')}, 1, 32)", 1),
        (f"{other}", f"substring({r('i')}, 1, 40)", 0),
        (f"{other}", f"substring({r('j')}, 1, 64)", 0),
        (f"concat({word}, ' ')", f"concat(substring({r('u')}, 1, 8), '-', substring({r('u')}, 9, 4), '-4', substring({r('u')}, 13, 3), '-a', substring({r('u')}, 16, 3), '-', substring({r('u')}, 20, 12))", 0),
        ("'see https://www.example.com/'", f"concat({word}, '/', {word2}, '-', {num}, '/page')", 0),
        ("' '", f"concat('/usr/lib/', {word}, '/', {word2}, '_', {num}, '.py')", 0),
        (f"concat({word}, ' ')", f"concat({word2}, '_', {word}, '_', {word2}, {num})", 0),
        (f"concat({key}, {sep})", f"concat('your-', {word}, '-', {word2}, '-here-', {num})", 0),
        (f"concat({word}, ' ')", f"concat({word}, '.', {word2}, '-', {num}, '.example.com')", 0),
        (f"concat({word}, ' ')", "concat('2024', lpad(cast(pmod(id, 12) + 1 as string), 2, '0'), '01T', lpad(cast(pmod(id, 24) as string), 2, '0'), '0000Z-run', cast(id as string))", 0),
        (f"concat({key}, {firm})", f"concat(substring({b64('m')}, 1, 4 + cast(pmod(id, 5) as int)), {pick('x', '!', '#', '@', '$', '%')}, substring({b64('n')}, 1, 4), cast(pmod(id, 7) as string))", 1),
        (f"concat({key}, {firm})", f"substring({b64('v')}, 1, cast(10 + pmod(id, 6) as int))", 1),
        (f"concat({key}, {firm})", f"substring(translate({b64('y')}, '0123456789', 'aBcDeFgHiJ'), 1, cast(14 + pmod(id, 12) as int))", 1),
        (f"concat({key}, {firm})", f"concat({word}, {pick('z', '', '-', '_')}, {word2})", 0),
        (f"concat({key}, {firm})", f"concat({pick('t', 'os.environ.', 'settings.', 'self.', 'config.')}, {word2}_)".replace("_)", ")"), 0),
    ]
    choose = lambda i: f"case pmod(id, {len(forms)}) " + " ".join(f"when {k} then {form[i]}" for k, form in enumerate(forms)) + " end"
    out = spark.range(rows).selectExpr("id", f"{choose(0)} as lead", f"{choose(1)} as value", f"{choose(2)} as secret")
    around = F.expr("concat(element_at(array('', 'the value of ', 'It was here that the ', 'set '), 1 + cast(pmod(xxhash64('q', id), 4) as int)), lead)")
    close = F.when(F.col("lead").endswith('"'), '" and more.').otherwise(" and more.")
    out = out.withColumn("around", around)
    return out.select("id", F.concat("around", "value", close).alias("text"), F.length("around").alias("start"), F.col("secret").cast("double").alias("label"))


def missed(labelled: DataFrame) -> DataFrame:
    """Labelled secrets (id, text, start, label) at whose start no candidate begins: what no forest can find."""
    found = candidates(labelled, "id", "text").select("id", "start").distinct()
    return labelled.where("label = 1").join(found, ["id", "start"], "left_anti")


def train(labelled: DataFrame, known: DataFrame, trees: int = 40, depth: int = 8, seed: int = 7) -> PipelineModel:
    """Forest of labelled findings (id, text, start, label); a text's candidate at start carries the label, others are left out.

    Labelled secrets without a candidate cannot be learned; they are counted in a warning.
    """
    lost = missed(labelled).count()
    if lost:
        warnings.warn(f"{lost} labelled secrets have no candidate at their start", stacklevel=2)
    found = candidates(labelled, "id", "text")
    rows = described(found, known).join(labelled.select("id", F.col("start").alias("_start"), "label"), "id").where("start = _start")
    # Written once: fitting reads them in several jobs.
    rows = Stash(labelled.sparkSession, "findings").keep(rows.select("label", *[f"f_{f}" for f in FEATURES]))
    stages = [VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)]
    return Pipeline(stages=stages).fit(rows)


def scan(docs: DataFrame, model: PipelineModel, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, start, end, value, probability, secret) of every candidate."""
    out = model.transform(described(candidates(docs, id_col, text_col), known))
    p = vector_to_array("probability")[1]
    return out.select(F.col("id").alias(id_col), "start", "end", "value", p.alias("probability")).withColumn("secret", F.col("probability") >= threshold)
