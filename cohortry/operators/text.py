"""Documents to TF-IDF rows to dense embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.columns import col, dense_index, token_count
from cohortry.functions.partials import PART_SCHEMA, matrix_parts, summed_rows
from cohortry.operators.profiling import detect_text_column, text_scores, vectorizer_choice
from cohortry.session import cut_lineage, spread_out, take_bounded

MIN_DOCUMENTS = 20
MAX_TERMS = 20_000
MIN_DOCUMENT_FREQUENCY = 2
SVD_DIMENSIONS = 100
WORD = r"[\p{L}\p{N}_]{2,}"  # maximal runs of at least two word characters
MAX_FREQUENCIES = 200_000
SPARSE_CHUNK = 20_000  # non-zeros multiplied at a time inside a task
PROJECTED_ROWS = 1_024  # documents projected at a time


def english_stop_words() -> list[str]:
    """Spark's own English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def join_text_columns(df: DataFrame, columns: list[str], name: str = "document") -> DataFrame:
    """First column twice, the others once, joined by ". ", blanks left out."""
    parts = [F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) for c in [columns[0], *columns]]
    return df.withColumn(name, F.concat_ws(". ", F.filter(F.array(*parts), lambda x: x != "")))


def usable_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents with at least one character after trimming."""
    return documents.where(F.length(F.trim(col(text))) >= 1)


def corpus_facts(documents: DataFrame, text: str = "text") -> dict:
    row = usable_documents(documents, text).agg(F.count("*").alias("n"), F.avg(token_count(col(text))).alias("a")).first()
    return {"n_docs": row["n"], "avg_tokens": row["a"] or 0.0, "enough": row["n"] >= MIN_DOCUMENTS}


def with_terms(documents: DataFrame, text: str, stop_words: Iterable[str], ngrams: int = 2, name: str = "terms") -> DataFrame:
    """Lower-cased words without stop words, followed by their bigrams."""
    work = documents.withColumn("_words", F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0)))
    stops = list(stop_words)
    if stops:
        remover = StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=stops, caseSensitive=True)
        work = remover.transform(work).drop("_words").withColumnRenamed("_kept", "_words")
    if ngrams < 2:
        return work.withColumnRenamed("_words", name)
    work = NGram(n=2, inputCol="_words", outputCol="_pairs").transform(work)
    return work.withColumn(name, F.concat("_words", "_pairs")).drop("_words", "_pairs")


@dataclass
class Corpus:
    """TF-IDF rows ``(id, idx, val)`` sorted by term id, and the vocabulary ``(term_id, term, df, idf)``."""

    rows: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_terms: int


def _weighted_terms(documents, key, text, stop_words, ngrams, min_df, max_terms, sublinear, numbered=False):
    """``id, term_id, term, tf, w`` before normalisation, the vocabulary, and the document count.

    Without ``max_terms`` there is a ``term_id`` only if it is asked for by ``numbered``: from 0, rarest terms first; texts
    then stay where they are, as they come from a join by id.
    """
    stops = english_stop_words() if stop_words is None else stop_words
    n_docs = documents.count()
    filled = documents.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("_text"))
    # texts are dealt out by id once; counts, norms and rows per id then stay where they are
    spark = documents.sparkSession
    parts = max(filled.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = with_terms(filled if numbered else filled.repartition(parts, "id"), "_text", stops, ngrams)
    # explode() infers a filter on the words, which is moved to the scan and cuts every text into words once more
    exploded = listed.select("id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    counts = exploded.groupBy("id", "term").agg(F.count("*").alias("tf")).persist(StorageLevel.MEMORY_AND_DISK)
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    tf = F.col("tf").cast("double")
    weight = (F.log(tf) + 1.0 if sublinear else tf) * F.col("idf")
    if max_terms is None:  # every term: the vocabulary grows with the corpus, so it is joined and gets no numbers
        vocabulary = stats.select("term", "df", idf.alias("idf"))
        if numbered:
            vocabulary = dense_index(vocabulary, "df", "term", name="term_id", start=0)
        return counts.join(vocabulary, "term").withColumn("w", weight), vocabulary, n_docs
    chosen = stats.orderBy(F.desc("cf"), "term").limit(max_terms)
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("term")) - 1  # at most max_terms rows
    vocabulary = cut_lineage(chosen.select(order.alias("term_id"), "term", "df", idf.alias("idf")))
    return counts.join(F.broadcast(vocabulary), "term").withColumn("w", weight), vocabulary, n_docs


def term_weights(
    documents: DataFrame,
    key: str,
    text: str = "text",
    stop_words: Iterable[str] | None = None,
    ngrams: int = 2,
    min_df: int = MIN_DOCUMENT_FREQUENCY,
    max_terms: int | None = MAX_TERMS,
    sublinear: bool = True,
) -> tuple[DataFrame, DataFrame, int]:
    """Long table ``id, term_id, term, df, tf, tfidf`` (L2 rows), the vocabulary, and the document count.

    The counts are combined on the map side; only a vocabulary bounded by
    ``max_terms`` is broadcast. With ``max_terms=None`` all terms count, and
    there is no ``term_id``.
    """
    weighted, vocabulary, n_docs = _weighted_terms(documents, key, text, stop_words, ngrams, min_df, max_terms, sublinear)
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    number = ["term_id"] if max_terms is not None else []
    long = weighted.join(norms, "id").select("id", *number, "term", "df", "tf", (F.col("w") / F.col("norm")).alias("tfidf"))
    return long, vocabulary, n_docs


@dataclass
class TermWeights:
    """Weights of terms whose ids ascend with document frequency."""

    starts: np.ndarray  # from this term id on, terms weigh tf times this idf
    idf: np.ndarray

    def of(self, idx: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[np.searchsorted(self.starts, idx, "right") - 1]


def weighed_texts(documents: DataFrame, key: str, text: str, stop_words: Iterable[str] | None = None) -> tuple[DataFrame, TermWeights]:
    """``id, norm, n, terms``: every text's words packed into one row; words of no other text count in ``norm`` alone."""
    weighted, vocabulary, n_docs = _weighted_terms(documents, key, text, stop_words, 1, 1, None, False, numbered=True)
    # as many rows as there are different frequencies: at most the root of twice the words
    sizes = sorted((r["df"], r["n"]) for r in take_bounded(vocabulary.groupBy("df").agg(F.count("*").alias("n")), MAX_FREQUENCIES, "document frequencies"))
    starts = np.cumsum([0] + [n for _, n in sizes])[:-1]
    idf = np.log((1.0 + n_docs) / (1.0 + np.array([df for df, _ in sizes], dtype=float))) + 1.0
    shared = F.when(F.col("df") > 1, F.struct(F.col("term_id").cast("int").alias("i"), F.col("tf").cast("int").alias("n")))
    packed = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sort_array(F.collect_list(shared)).alias("t"))
    kind = dict(packed.dtypes)["id"]

    def pack(batches):
        for pdf in batches:
            packs = [pack_terms(np.array(i, dtype=np.uint32), np.array(n, dtype=np.uint32)) for i, n in zip(pdf["i"], pdf["n"])]
            yield pd.DataFrame({"id": pdf["id"], "norm": pdf["norm"], "n": [len(i) for i in pdf["i"]], "terms": packs})

    listed = packed.where(F.size("t") > 0).select("id", "norm", F.col("t.i").alias("i"), F.col("t.n").alias("n"))
    return cut_lineage(listed.mapInPandas(pack, f"id {kind}, norm double, n int, terms binary")), TermWeights(starts, idf)


def pack_terms(idx: np.ndarray, tf: np.ndarray) -> bytes:
    """Steps between ascending ids, and counts, lowest bytes first: most of the others are zero, which moved rows leave out."""
    both = np.stack([np.diff(idx, prepend=np.uint32(0)), tf]).astype("<u4")
    return np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_terms(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<i4").reshape(2, -1)
    return np.cumsum(both[0], dtype=np.int32), both[1]


def tfidf(
    documents: DataFrame,
    key: str,
    text: str = "text",
    stop_words: Iterable[str] | None = None,
    ngrams: int = 2,
    min_df: int = MIN_DOCUMENT_FREQUENCY,
    max_terms: int = MAX_TERMS,
    sublinear: bool = True,
) -> Corpus:
    """One sparse unit row per document; documents without a known term keep an empty row."""
    weighted, vocabulary, n_docs = _weighted_terms(documents, key, text, stop_words, ngrams, min_df, max_terms, sublinear)
    packed = weighted.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    every = documents.select(col(key).alias("id")).join(packed, "id", "left")
    t = F.coalesce(F.col("t"), F.array().cast("array<struct<term_id:int,w:double>>"))
    rows = every.select(
        "id", F.transform(t, lambda x: x["term_id"]).alias("idx"), F.transform(t, lambda x: x["w"] / F.col("norm")).alias("val")
    )
    return Corpus(spread_out(cut_lineage(rows)).persist(StorageLevel.MEMORY_AND_DISK), vocabulary, n_docs, vocabulary.count())


# ---------------------------------------------------------------------------
# sparse rows times small dense matrices, inside tasks
# ---------------------------------------------------------------------------


def sparse_pieces(pdf: pd.DataFrame):
    """Split a batch into (ids, idx, val, start offsets) pieces of bounded non-zeros."""
    sizes = np.array([len(x) for x in pdf["idx"]], dtype=int)
    at = 0
    while at < len(pdf):
        end, total = at, 0
        while end < len(pdf) and (end == at or total + sizes[end] <= SPARSE_CHUNK):
            total += sizes[end]
            end += 1
        part = pdf.iloc[at:end]
        idx = np.concatenate([np.asarray(x, dtype=np.int64) for x in part["idx"]]) if total else np.zeros(0, dtype=np.int64)
        val = np.concatenate([np.asarray(x, dtype=float) for x in part["val"]]) if total else np.zeros(0)
        doc = np.repeat(np.arange(end - at), sizes[at:end])
        yield part["id"].to_numpy(), idx, val, doc, end - at
        at = end


NARROW = 16  # columns up to which sums are counted column by column, without sorting


def times(idx, val, doc, n, dense: np.ndarray) -> np.ndarray:
    """X @ dense for the piece."""
    out = np.zeros((n, dense.shape[1]))
    if dense.shape[1] <= NARROW:
        for j in range(dense.shape[1]):
            out[:, j] = np.bincount(doc, val * dense[idx, j], n)
    elif len(idx):
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[starts]] = np.add.reduceat(dense[idx] * val[:, None], starts, axis=0)
    return out


def transposed_times(total: np.ndarray, idx, val, doc, dense: np.ndarray) -> None:
    """total += X.T @ dense for the piece."""
    if dense.shape[1] <= NARROW:
        for j in range(dense.shape[1]):
            total[:, j] += np.bincount(idx, val * dense[doc, j], len(total))
    elif len(idx):
        order = np.argsort(idx, kind="stable")
        sorted_idx = idx[order]
        starts = np.flatnonzero(np.r_[True, sorted_idx[1:] != sorted_idx[:-1]])
        total[sorted_idx[starts]] += np.add.reduceat(dense[doc[order]] * val[order][:, None], starts, axis=0)


@dataclass
class Svd:
    components: np.ndarray  # terms x dims
    singular: np.ndarray
    explained: float


def truncated_svd(corpus: Corpus, dims: int = SVD_DIMENSIONS, iterations: int = 5, oversample: int = 10, seed: int = 42) -> Svd:
    """Randomised range finding on X'X: one pass per iteration, state = terms x (dims + oversample) for each core."""
    dims = max(2, min(dims, corpus.n_terms - 1, corpus.n_docs - 1))
    width = min(dims + oversample, corpus.n_terms)
    v = corpus.n_terms
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(v, width)))[0]
    sc = corpus.rows.sparkSession.sparkContext
    rows = corpus.rows.select("idx", "val").coalesce(sc.defaultParallelism)  # a task returns a whole matrix, so there is one per core

    def gram(basis: np.ndarray) -> np.ndarray:
        shipped = sc.broadcast(basis)

        def task(batches):
            total, touched, held = np.zeros((v, width)), np.zeros(v, dtype=bool), shipped.value
            for pdf in batches:
                for idx, val in zip(pdf["idx"], pdf["val"]):  # the rows of one document's terms stay in a core's cache
                    total[idx] += val[:, None] * (val @ held[idx])
                    touched[idx] = True
            yield from matrix_parts(total, touched)

        out = summed_rows(rows.mapInPandas(task, PART_SCHEMA), v, width)
        shipped.unpersist()
        return out

    z = gram(q)
    for _ in range(iterations):
        q = np.linalg.qr(z)[0]
        z = gram(q)
    values, small = np.linalg.eigh((q.T @ z + z.T @ q) / 2.0)
    order = np.argsort(values)[::-1][:dims]
    components = q @ small[:, order]
    flip = np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(order))])
    components = components * np.where(flip == 0, 1.0, flip)
    singular = np.sqrt(np.clip(values[order], 0.0, None))
    return Svd(components, singular, _explained(corpus, components, singular))


def _explained(corpus: Corpus, components: np.ndarray, singular: np.ndarray) -> float:
    n = corpus.n_docs
    cell = F.explode(F.arrays_zip("idx", "val")).alias("c")
    per = corpus.rows.select(cell).select("c.*").groupBy("idx").agg(F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"))
    rows = per.toPandas()  # vocabulary-sized
    mean = np.zeros(corpus.n_terms)
    mean[rows["idx"].to_numpy(dtype=int)] = rows["s"].to_numpy() / n
    total = float(rows["q"].sum()) / n - float((mean**2).sum())
    kept = float(((singular**2) / n - (mean @ components) ** 2).sum())
    return kept / total if total > 0 else 0.0


def project(corpus: Corpus, svd: Svd, normalise: bool = True) -> DataFrame:
    """(id, features): document coordinates, unit length unless told otherwise."""
    shipped = corpus.rows.sparkSession.sparkContext.broadcast(svd.components)
    kind = dict(corpus.rows.dtypes)["id"]

    def task(batches):
        for pdf in batches:
            for at in range(0, len(pdf), PROJECTED_ROWS):
                part = pdf.iloc[at : at + PROJECTED_ROWS]
                x = np.array([val @ shipped.value[idx] for idx, val in zip(part["idx"], part["val"])])
                if normalise:
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    x = x / np.where(norm == 0, 1.0, norm)
                yield pd.DataFrame({"id": part["id"], "features": list(x)})

    return corpus.rows.mapInPandas(task, f"id {kind}, features array<double>")


# ---------------------------------------------------------------------------
# choosing and running a method
# ---------------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


def encode(documents: DataFrame, key: str, text: str, load_encoder: Callable[[], Encoder], batch: int = 256) -> DataFrame:
    """(id, features) from a caller's sentence encoder, loaded once per task."""
    kind = dict(documents.dtypes)[key]

    def task(batches):
        encoder = load_encoder()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "features": [np.asarray(v, dtype=float) for v in encoder([t.strip() for t in part["text"]])]})

    return documents.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("text")).mapInPandas(task, f"id {kind}, features array<double>")


@dataclass
class PreparedText:
    documents: DataFrame  # id, document
    vectors: DataFrame  # id, features
    make_corpus: Callable[[], Corpus]
    method: str
    fallback: bool
    explained: float | None
    facts: dict

    @cached_property
    def corpus(self) -> Corpus:
        """Term rows, which topic models and cluster descriptions read; an encoder needs none, so they are made when asked for."""
        return self.make_corpus()


def prepare_text(
    df: DataFrame,
    key: str,
    text_columns: list[str] | None = None,
    method: str | None = None,
    purpose: str = "",
    load_encoder: Callable[[], Encoder] | None = None,
    svd_dims: int = SVD_DIMENSIONS,
    stop_words: Iterable[str] | None = None,
) -> PreparedText:
    """Detect or join the text, keep usable documents, choose (or force) a method, vectorise."""
    named = [c for c in text_columns or [] if c in df.columns]
    if len(named) > 1:
        joined = join_text_columns(df, named)
    else:
        source = named[0] if named else detect_text_column(text_scores(df), 5.0, 0.0)
        if source is None:
            raise ValueError("no free-text column found")
        joined = df.withColumn("document", F.coalesce(col(source), F.lit("")))
    documents = usable_documents(joined, "document").select(col(key).alias("id"), "document")
    facts = corpus_facts(documents, "document")
    if not facts["enough"]:
        raise ValueError(f"only {facts['n_docs']} usable documents; need at least {MIN_DOCUMENTS}")
    choice = vectorizer_choice(facts["n_docs"], facts["avg_tokens"], purpose, load_encoder is not None)
    wanted = method or choice["method"]

    def make_corpus() -> Corpus:
        return tfidf(documents, "id", "document", stop_words=stop_words)

    if wanted == "transformer" and load_encoder is not None:
        return PreparedText(documents, encode(documents, "id", "document", load_encoder), make_corpus, "transformer", False, None, facts)
    corpus = make_corpus()
    svd = truncated_svd(corpus, svd_dims)
    vectors = cut_lineage(project(corpus, svd))
    return PreparedText(documents, vectors, lambda: corpus, "tfidf_svd", wanted == "transformer", svd.explained, facts)


def embedding_columns(vectors: DataFrame, key: str = "id") -> DataFrame:
    """Wide view: ``emb_0 .. emb_n``."""
    d = len(take_bounded(vectors.select("features").limit(1), 1, "row")[0][0])
    return vectors.select(key, *[F.element_at("features", i + 1).alias(f"emb_{i}") for i in range(d)])
