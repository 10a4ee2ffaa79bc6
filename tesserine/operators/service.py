"""What a search service offers, as functions over tables: search, questions, repositories, health."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import answers, packs, planner, postings, rag, repos
from tesserine.operators.models import Factory
from tesserine.operators.vectors import l2_normalized
from tesserine.plans.staging import staged


@dataclass(frozen=True)
class Settings:
    """Limits of filter, rerank and answer; values out of range are refused."""

    threshold: int = 3
    min_survivors: int = 8
    variance_bypass: float = 0.15
    hybrid_alpha: float = 0.3
    recall: int = 100
    evidence: int = 8

    def __post_init__(self) -> None:
        ranges = {"threshold": (0, 4), "min_survivors": (1, None), "variance_bypass": (0, 1), "hybrid_alpha": (0, 1), "recall": (1, None), "evidence": (1, None)}
        for name, (low, high) in ranges.items():
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} must be {low} or more" if high is None else f"{name} must lie between {low} and {high}")


@dataclass
class Service:
    """A search over chunks (id, repo_id, rel_path, language, primary_symbol, all_symbols, all_roles, start_line, end_line, summary_en, text), embeddings (id, embedding) and routers.

    embed turns one question into a vector on the driver; index holds the chunks, router_index
    the router documents by repo_id.
    """

    chunks: DataFrame
    embeddings: DataFrame
    index: postings.Index
    embed: object
    routers: DataFrame
    guides: DataFrame
    router_index: postings.Index | None = None
    settings: Settings = field(default_factory=Settings)

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def plan(self, question: str) -> dict:
        """The plan of one question."""
        return planner.heuristic_plan(self.spark.createDataFrame([(question,)], "question string")).first().asDict(recursive=True)

    def route(self, question: str, repo: str | None = None, version: str = "v1", most: int = 2) -> list[str]:
        """The repositories to search: the one named, else those whose router documents match; none means all."""
        if repo:
            return [repo]
        if self.router_index is None:
            return []
        return [r.key for r in rag.routed(self.router_index, question, rag.table_of(version, "router"), most).collect()]

    def search(self, question: str, k: int = 10, repo: str | None = None, version: str = "v1", semantic_only: bool = False, all_texts: bool = False) -> DataFrame:
        """The best k chunks of a question, with true scores."""
        plan, repositories = self.plan(question), self.route(question, repo, version)
        held = [(c["field"], c["term"], float(c["boost"])) for c in plan["bm25_should"] if c["field"] in self.index.stats]
        vector = self.spark.createDataFrame([([float(x) for x in self.embed(plan["hyde_passage"] or question)],)], "v array<double>").select(l2_normalized(F.col("v"))).first()[0]
        return rag.hybrid_search(
            self.chunks, self.embeddings, self.index, vector, held, plan["clarified_query"], repositories, plan["language"], plan["identifiers"], plan["file_hints"], semantic_only, k, None if all_texts else rag.WITH_TEXT
        )

    def simple_search(self, question: str, repo: str | None = None) -> DataFrame:
        return self.search(question, 10, repo)

    def recall(self, question: str, most: int | None = None) -> DataFrame:
        """Search as rows that the filter-rerank plan takes, with the fused score as the retriever's."""
        hits = self.search(question, most or self.settings.recall, all_texts=True)
        named = hits.withColumnRenamed("score", "retriever_score").withColumn("query", F.lit(question))
        for name, value in (("chunk_hash", F.lit(None).cast("string")), ("primary_kind", F.lit("")), ("summary_en", F.lit(None).cast("string"))):
            named = named if name in named.columns else named.withColumn(name, value)
        return named

    def ask(self, question: str, answer_model: Factory, filter_model: Factory | None = None, rerank_model: Factory | None = None) -> DataFrame:
        """(query, answer, ...): by filter, rerank and evidence where a filter model is given, else by evidence of the best chunks."""
        asked = self.spark.createDataFrame([(question, question)], "query string, question string")
        if filter_model is not None:
            return rag.answered(asked, self.recall(question), filter_model, rerank_model, answer_model, self.settings.recall, self.settings.evidence)
        hits = staged(self.recall(question, self.settings.evidence), "hits")
        return answers.evidence_answers(asked, packs.evidence(hits, "query", ["rank"], self.settings.evidence), answer_model)

    def context(self, repositories: Sequence[str]) -> DataFrame:
        """Router documents of the repositories that have one, with texts and lists cut short."""
        return router_contexts(self.routers.where(F.col("repo_id").isin(*repositories)))

    def missing_guides(self, repositories: Sequence[str]) -> DataFrame:
        wanted = self.spark.createDataFrame([(r,) for r in repositories], "repo_id string")
        return wanted.join(self.guides.select("repo_id"), "repo_id", "left_anti")

    def repositories(self) -> DataFrame:
        return repos.listed(self.routers)

    def health(self) -> dict:
        """Whether the tables can be read."""
        return {"status": "ok" if not self.chunks.isEmpty() else "empty", "fields": sorted(self.index.stats)}


def router_contexts(routers: DataFrame) -> DataFrame:
    """Router documents as a prompt shows them: titles of 200 characters, summaries of 1000, lists and terms cut."""
    from tesserine.functions.text import truncate

    held = lambda c, kind: F.col(c) if c in routers.columns else F.lit(None).cast(kind)
    text = lambda c, n: truncate(F.coalesce(held(c, "string"), F.lit("")), n).alias(c)
    some = lambda c, n: F.slice(F.coalesce(held(c, "array<string>"), F.array().cast("array<string>")), 1, n).alias(c)
    return routers.select("repo_id", text("short_title", 200), text("summary", 1000), some("languages", 5), some("tech_stack", 10), some("modules", 15), some("important_files", 12), text("key_symbols", 400), text("keywords", 300))
