"""Search, evaluation and answers over stored indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import document_of
from quarry.operators import evaluation, retrieval
from quarry.operators.embedding import Embedder, embed

TOP_CHUNKS, TOP_DOCUMENTS = 30, 5


def _optional(spark: SparkSession, path: str | None, read) -> object | None:
    """What `read` gives, None if nothing lies there."""
    try:
        return read() if path else None
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


@dataclass
class Retriever:
    """vectors (chunk_id, v) must be there; without a sparse index, hybrid search is dense alone, and without chunks (chunk_id, text) or scorer nothing is reranked."""

    vectors: DataFrame
    index: retrieval.Bm25Index | None = None
    chunks: DataFrame | None = None
    scorer: retrieval.Scorer | None = retrieval.jaccard
    embedder: Embedder | None = None
    expand: retrieval.Expander | None = None

    @classmethod
    def load(cls, spark: SparkSession, vectors: str, index: str | None = None, chunks: str | None = None, **hooks) -> Retriever:
        """From the paths of Parquet tables, in any file system that Spark reads; a missing index or missing chunks are left out, missing vectors raise."""
        return cls(spark.read.parquet(vectors), _optional(spark, index, lambda: retrieval.Bm25Index.load(spark, index)), _optional(spark, chunks, lambda: spark.read.parquet(chunks)), **hooks)

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int = 5, depth: int = retrieval.DEPTH, with_payload: bool = False) -> DataFrame:
        """qid, rank, chunk_id, score of queries (qid, query, and qv unless the encoder is to make it)."""
        if "qv" not in queries.columns:
            asked = retrieval.expanded(queries, self.expand)
            v = embed(asked.select(F.col("qid").alias("chunk_id"), F.col("query").alias("text")), self.embedder)
            queries = queries.join(v.select(F.col("chunk_id").alias("qid"), F.col("v").alias("qv")), "qid")
        if mode == "bm25" and self.index is None:
            raise ValueError("there is no sparse index")
        hits = retrieval.search(queries, self.chunks if mode == "rerank" else None, self.vectors, mode, k, self.scorer, self.index, depth, self.expand)
        return retrieval.with_payload(hits, self.chunks) if with_payload and self.chunks is not None else hits

    def _documents(self, questions: DataFrame, mode: str, top_chunks: int, top_documents: int) -> DataFrame:
        """qid, rank, doc_id: reranked lists are three times as long as the documents that are wanted."""
        k = top_documents * 3 if mode == "rerank" else top_chunks
        hits = self.search(questions.select("qid", F.col("question").alias("query"), *(["qv"] if "qv" in questions.columns else [])), mode, k, top_chunks)
        return hits.select("qid", "rank", document_of(F.col("chunk_id").cast("string")).alias("doc_id"))

    def evaluate(self, questions: DataFrame, mode: str = "rerank", top_chunks: int = TOP_CHUNKS, top_documents: int = TOP_DOCUMENTS) -> DataFrame:
        """recall, precision, f2 over questions (qid, question, answer)."""
        truth = questions.select("qid", F.col("answer").cast("array<string>").alias("answer"))
        asked = questions.where(F.size(F.coalesce("answer", F.array())) > 0)
        return evaluation.macro(truth, self._documents(asked, mode, top_chunks, top_documents), top_documents)

    def answers(self, questions: DataFrame, mode: str = "rerank", top_chunks: int = TOP_CHUNKS, top_documents: int = TOP_DOCUMENTS) -> DataFrame:
        """qid and answer (document ids) of every question; any mode but rerank is hybrid."""
        return evaluation.answers(questions, self._documents(questions, mode if mode == "rerank" else "hybrid", top_chunks, top_documents), top_documents)
