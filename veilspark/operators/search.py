"""Search and summaries: chunks, TF-IDF, latent semantic analysis, extractive summaries.

A corpus is (id, name, text). Terms of texts are rows; weights are joined and
added up by term and chunk, so nothing but a query and, for latent analysis, the
term matrix of at most MAX_TERMS x DIMENSIONS is on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import MAX_TEXT, InputError
from ..functions.text import SPACE, WORD_CHARS, stripped, without_accents

CHUNK, STEP = 1800, 1620
#: Windows of a block.
BLOCK = 64
MAX_TERMS = 20_000
MAX_QUERY = 4000
DIMENSIONS = 96
#: Chunks or terms up to which the matrix of their inner products is made and solved whole.
WHOLE = 2048
#: Further vectors beside those asked for, blocks of vectors kept at once, and the residual, as a share of the largest value.
BESIDE, BLOCKS, TOLERANCE = 32, 4, 1e-9
SNIPPET = 320


def chunks(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep..., offset, part): windows of CHUNK code points every STEP over the whole text, blank ones left out."""
    each = df.select(*keep, text.alias("_t")).where("_t <> ''")
    # Long texts are cut into blocks of windows first: a window is looked for from its block's start, not the text's.
    each = each.select(*keep, "_t", F.explode(F.sequence(F.lit(0), F.length("_t") - 1, F.lit(STEP * BLOCK))).alias("_at"))
    each = each.select(*keep, "_at", F.substr("_t", F.col("_at") + 1, F.lit(STEP * (BLOCK - 1) + CHUNK)).alias("_b"), F.least(F.length("_t") - F.col("_at"), F.lit(STEP * BLOCK)).alias("_n"))
    each = each.select(*keep, "_at", "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(STEP))).alias("_i"))
    each = each.select(*keep, (F.col("_at") + F.col("_i")).alias("offset"), F.substr("_b", F.col("_i") + 1, F.lit(CHUNK)).alias("part"))
    return each.where(stripped(F.col("part")) != "")


def tokens(text: Column) -> Column:
    """Words of two characters or more, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD_CHARS}]{{2,}})"), 1)


def terms(text: Column, pairs: bool = True) -> Column:
    """Words without accents and, with pairs, neighbouring words."""
    one = tokens(without_accents(F.lower(text)))
    if not pairs:
        return one
    return F.transform(F.array(one), lambda t: F.concat(t, F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))))[0]


def term_counts(df: DataFrame, key: str, text: Column, pairs: bool = True) -> DataFrame:
    """(key, term, tf)"""
    each = df.select(key, terms(text, pairs).alias("t"))
    return each.select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_texts: int, most: int | None = MAX_TERMS) -> DataFrame:
    """(term, idf) of the most frequent terms: idf = ln((1 + n) / (1 + df)) + 1. Ties go to the lesser term."""
    sums = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if most is not None:
        sums = sums.orderBy(F.desc("total"), "term").limit(most)
    return sums.select("term", (F.log((1.0 + n_texts) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weighted(counts: DataFrame, vocab: DataFrame, key: str, sublinear: bool = True) -> DataFrame:
    """(key, term, w): TF-IDF weights of unit length for each key."""
    tf = (1.0 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    raw = counts.join(vocab, "term").select(key, "term", (tf * F.col("idf")).alias("x"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("w"))


def query_of(spark, query: str) -> DataFrame:
    if not isinstance(query, str) or not query.strip() or len(query) > MAX_QUERY:
        raise InputError(f"a query has 1 to {MAX_QUERY} characters")
    return spark.createDataFrame([(0, query)], "q long, text string")


def score(value: Column) -> Column:
    return F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)), 6)


def corpus_chunks(records: DataFrame) -> DataFrame:
    """(chunk, id, offset, part) of records (id, name, text); name and text are searched together."""
    whole = F.concat(F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    each = chunks(records, whole, "id")
    return each.select(F.concat_ws(":", F.col("id").cast("string"), "offset").alias("chunk"), "id", "offset", "part")


def best_hits(parts: DataFrame, scores: DataFrame, records: DataFrame, limit: int, minimum: float) -> DataFrame:
    """(rank, id, semantic_score, snippet, chunk_offset, text_length, limited): the best chunk of each record, earliest on ties."""
    found = parts.join(scores.where(F.col("score") >= minimum), "chunk")
    first = Window.partitionBy("id").orderBy(F.desc("score"), "offset")
    best = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    total = best.agg(F.count("*").alias("n_best"))
    top = best.orderBy(F.desc("score"), F.col("id").cast("string")).limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col("id").cast("string"))))
    lengths = records.select("id", F.length("text").alias("text_length"))
    out = top.join(lengths, "id").join(F.broadcast(total), F.lit(True))
    return out.select("rank", "id", F.col("score").alias("semantic_score"), F.substring("part", 1, SNIPPET).alias("snippet"), F.col("offset").alias("chunk_offset"), "text_length", (F.col("n_best") > limit).alias("limited"))


def tfidf_scores(parts: DataFrame, query: str) -> DataFrame:
    """(chunk, score) of chunks that share a term with the query."""
    counts = term_counts(parts, "chunk", F.col("part"))
    vocab = vocabulary(counts, parts.count())
    asked = weighted(term_counts(query_of(parts.sparkSession, query), "q", F.col("text")), vocab, "q")
    docs = weighted(counts, vocab, "chunk")
    return docs.join(F.broadcast(asked.select("term", F.col("w").alias("v"))), "term").groupBy("chunk").agg(score(F.sum(F.col("w") * F.col("v"))).alias("score"))


def search(records: DataFrame, query: str, limit: int = 100, minimum: float = 0.05) -> DataFrame:
    """TF-IDF search; see best_hits."""
    parts = corpus_chunks(records)
    return best_hits(parts, tfidf_scores(parts, query), records, limit, minimum)


def gram_times(rows: DataFrame, q):
    """A'A q of rows (v: array of (i, w)) that make the matrix A; the blocks of each partition's part are added up on the executors."""
    import numpy as np

    size, wide = q.shape
    step = -(-size // 16)
    held = rows.sparkSession.sparkContext.broadcast(q)

    def part(frames):
        import pandas as pd

        of, out = held.value, np.zeros((size, wide))
        for pdf in frames:
            for i, w in zip(pdf["i"], pdf["w"]):
                out[i] += np.outer(w, w @ of[i])
        yield pd.DataFrame({"at": range(0, size, step), "part": [out[at : at + step].tobytes() for at in range(0, size, step)]})

    def added(pdf):
        import pandas as pd

        return pd.DataFrame({"at": pdf["at"][:1], "part": [sum(np.frombuffer(x) for x in pdf["part"]).tobytes()]})

    parts = rows.select(F.col("v.i").alias("i"), F.col("v.w").alias("w")).mapInPandas(part, "at int, part binary")
    got = sorted(parts.groupBy("at").applyInPandas(added, "at int, part binary").collect())
    held.unpersist()
    return np.concatenate([np.frombuffer(r["part"]).reshape(-1, wide) for r in got])


def right_vectors(rows: DataFrame, n: int, size: int, k: int):
    """size x k: the leading right singular vectors of n rows (v: array of (i, w)), each only if its value is over zero.

    The smaller of the two matrices of inner products is solved whole up to WHOLE
    rows; beyond that by a block Krylov method with restarts (Rayleigh-Ritz over
    BLOCKS blocks), until the residuals of all k are under TOLERANCE.
    """
    import numpy as np

    if n <= WHOLE:
        held = rows.select(F.col("v.i").alias("i"), F.col("v.w").alias("w")).collect()
        chunk = np.repeat(np.arange(len(held)), [len(r["i"]) for r in held])
        term = np.concatenate([np.asarray(r["i"], dtype=np.int64) for r in held])
        weight = np.concatenate([np.asarray(r["w"]) for r in held])
        order = np.argsort(term, kind="stable")
        inner = np.zeros((len(held), len(held)))
        for at in np.split(order, np.flatnonzero(np.diff(term[order])) + 1):
            inner[np.ix_(chunk[at], chunk[at])] += np.outer(weight[at], weight[at])
        values, left = np.linalg.eigh(inner)
        values, left = values[::-1][:k], left[:, ::-1][:, :k]
        sure = values > values[0] * 1e-12
        left = left[:, sure] / np.sqrt(values[sure])
        right = np.zeros((size, left.shape[1]))
        for c, r in enumerate(held):
            right[r["i"]] += np.outer(r["w"], left[c])
        return right
    if size <= WHOLE:
        values, vectors = np.linalg.eigh(gram_times(rows, np.eye(size)))
        return vectors[:, ::-1][:, :k][:, values[::-1][:k] > values[-1] * 1e-12]
    wide = min(k + BESIDE, size // (BLOCKS + 1))
    basis = [np.linalg.qr(np.random.default_rng(0).standard_normal((size, wide)))[0]]
    images = []
    while True:
        images.append(gram_times(rows, basis[-1]))
        whole, image = np.hstack(basis), np.hstack(images)
        inner = whole.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:wide], turn[:, ::-1][:, :wide]
        vectors, image = whole @ turn, image @ turn
        residual = image - vectors * values
        if np.linalg.norm(residual[:, :k], axis=0).max() <= TOLERANCE * values[0]:
            return vectors[:, :k][:, values[:k] > values[0] * 1e-12]
        more = residual
        if len(basis) == BLOCKS:
            basis, images, whole = [vectors], [image], vectors
        else:
            more = images[-1]
        for _ in range(2):
            more = np.linalg.qr(more - whole @ (whole.T @ more))[0]
        basis.append(more)


def lsa_scores(parts: DataFrame, query: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(chunk, score) by latent semantic analysis: cosines in the space of the leading singular vectors.

    The vectors are those of the matrix itself, so scores differ from a
    randomised method's in their last digits. A corpus too small for two
    dimensions is scored by TF-IDF.
    """
    import numpy as np

    n = parts.count()
    counts = term_counts(parts, "chunk", F.col("part"))
    vocab = vocabulary(counts, n).withColumn("i", (F.row_number().over(Window.orderBy("term")) - 1).cast("int")).persist()
    size = vocab.count()
    k = min(dimensions, n - 1, size - 1)
    if k < 2:
        vocab.unpersist()
        return tfidf_scores(parts, query)
    place = vocab.select("term", "i")
    rows = weighted(counts, vocab.select("term", "idf"), "chunk").join(place, "term").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("v")).persist()
    right = right_vectors(rows, n, size, k)  # MAX_TERMS x DIMENSIONS at most
    asked = weighted(term_counts(query_of(parts.sparkSession, query), "q", F.col("text")), vocab.select("term", "idf"), "q").join(place, "term").select("i", "w").collect()
    q = sum((r["w"] * right[r["i"]] for r in asked), np.zeros(right.shape[1]))
    q = q / (np.linalg.norm(q) or 1.0)
    held = parts.sparkSession.sparkContext.broadcast((right, q))

    def cosine(frames):
        import pandas as pd

        v, asked_ = held.value
        for pdf in frames:
            out = []
            for i, w in zip(pdf["i"], pdf["w"]):
                d = w @ v[i]
                out.append(float(d @ asked_ / (np.linalg.norm(d) or 1.0)))
            yield pd.DataFrame({"chunk": pdf["chunk"], "score": out})

    out = rows.select("chunk", F.col("v.i").alias("i"), F.col("v.w").alias("w")).mapInPandas(cosine, "chunk string, score double")
    return out.select("chunk", score(F.col("score")).alias("score"))


def lsa_search(records: DataFrame, query: str, limit: int = 100, minimum: float = 0.05) -> DataFrame:
    parts = corpus_chunks(records)
    return best_hits(parts, lsa_scores(parts, query), records, limit, minimum)


def vector_search(vectors: DataFrame, query: list[float], limit: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(rank, id, score): cosines of stored unit vectors with a query vector, for texts encoded elsewhere."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*[F.lit(x / norm) for x in query])
    dot = F.aggregate(F.zip_with(vec_col, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    own = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    top = vectors.select(F.col(id_col).alias("id"), score(dot / own).alias("score")).orderBy(F.desc("score"), F.col("id").cast("string")).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col("id").cast("string"))))


def sentences(text: Column, most: int = 300) -> Column:
    """Sentences of more than 15 characters, the first `most`."""
    parts = F.split(F.substring(text, 1, MAX_TEXT), rf"(?<=[.!?])[{SPACE}]+|\n+", -1)
    return F.slice(F.filter(F.transform(parts, stripped), lambda p: F.length(p) > 15), 1, most)


def summaries(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, summary): the n sentences nearest to the mean of all, in their order, joined by line breaks."""
    if not 1 <= n <= 10:
        raise InputError("a summary has 1 to 10 sentences")
    # Dealt by id once, while rows are texts: every grouping, window and join below is by id and more, and stays in place.
    # The number is given, as sizes of texts say little about the rows made of them.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(parts, "id")
    cut = dealt.select("id", sentences(F.coalesce("text", F.lit(""))).alias("p"))
    each = cut.select("id", F.posexplode("p").alias("i", "s"))
    counts = cut.select("id", F.size("p").alias("n"), F.posexplode("p").alias("i", "s")).select("id", "i", "n", F.explode(tokens(F.col("s"))).alias("term"))
    counts = counts.groupBy("id", "i", "n", "term").agg(F.count("*").alias("tf"))
    by_term, by_sentence = Window.partitionBy("id", "term"), Window.partitionBy("id", "i")
    raw = counts.withColumn("x", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.count("*").over(by_term))) + 1.0))
    unit = raw.withColumn("w", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(by_sentence)))
    scores = unit.withColumn("m", F.sum("w").over(by_term) / F.col("n")).groupBy("id", "i").agg(F.sum(F.col("w") * F.col("m")).alias("score"))
    # Rounded, so that sums in another order rank alike.
    ranked = each.join(scores, ["id", "i"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "i")))
    kept = ranked.where(F.col("r") <= n).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"))
    out = dealt.select("id").join(kept, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.array_join(F.col("p.s"), "\n"), F.lit("")).alias("summary"))


def fingerprint(records: DataFrame) -> DataFrame:
    """(fingerprint): a digest of all records in id order, made of digests of each, so it is one small row a record before the last step."""
    each = records.select("id", F.sha2(F.to_json(F.array(F.col("id").cast("string"), F.coalesce("name", F.lit("")), F.coalesce("text", F.lit("")))), 256).alias("h"))
    parts = each.groupBy(F.pmod(F.xxhash64("id"), F.lit(4096)).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))
