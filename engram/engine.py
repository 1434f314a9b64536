"""A memory as one object: tables in, tables out, every method a plan over DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions.frames import kept
from engram.operators import analysis, graph, ingest, jobs, packing, quality, retrieval, search, store, write
from engram.sources import tables as T


class MemoryEngine:
    """Writes replace `tables`; reads leave them. `save` and `open` keep them as Parquet."""

    def __init__(self, spark: SparkSession, tables: T.MemoryTables | None = None, weights: S.Weights = S.Weights(), packing_config: S.Packing = S.Packing(), embedder=search.hash_embed) -> None:
        self.spark, self.tables = spark, tables or T.empty_tables(spark)
        self.weights, self.packing, self.embedder = weights, packing_config, embedder
        self.maintenance = jobs.Maintenance()

    @classmethod
    def open(cls, spark: SparkSession, root: str, **how) -> MemoryEngine:
        return cls(spark, T.read_tables(spark, root), **how)

    def save(self, root: str) -> None:
        T.write_tables(self.tables, root)

    # writes

    def store(self, messages: DataFrame, now, config: write.StoreConfig = write.StoreConfig()) -> None:
        m = messages if "embedding" in messages.columns else search.embed(messages, embedder=self.embedder)
        self.tables = write.store_batch(self.tables, m, now, config)

    def ingest(self, messages: DataFrame, now) -> DataFrame:
        """Gives the rows that could not be read."""
        self.tables, dead = write.ingest_batch(self.tables, messages, now, self.embedder)
        return dead

    def promote(self, ids: DataFrame, now) -> DataFrame:
        return self._move(store.promote(self.tables.nodes, ids, now))

    def archive(self, ids: DataFrame, now) -> DataFrame:
        return self._move(store.archive(self.tables.nodes, ids, now))

    def supersede(self, pairs: DataFrame, now) -> DataFrame:
        return self._move(store.supersede(self.tables.nodes, pairs, now))

    def contradict(self, pairs: DataFrame, now) -> DataFrame:
        return self._move(store.contradict(self.tables.nodes, pairs, now))

    def resolve(self, pairs: DataFrame, now) -> DataFrame:
        return self._move(store.resolve(self.tables.nodes, self.tables.edges, pairs, now))

    def reinforce(self, hits: DataFrame, now) -> None:
        self.tables = replace(self.tables, nodes=store.reinforce(self.tables.nodes, hits, now))

    def _move(self, moved: store.Moved) -> DataFrame:
        t = replace(self.tables, nodes=moved.nodes)
        t = replace(t, edges=t.edges.unionByName(moved.edges)) if moved.edges is not None else t
        self.tables = replace(t, operations=t.operations.unionByName(moved.operations)) if moved.operations is not None else t
        return moved.rejected

    def feedback(self, signals: DataFrame) -> None:
        rows = T.migrate(signals, S.FEEDBACK)
        self.tables = replace(self.tables, feedback=rows if self.tables.feedback is None else self.tables.feedback.unionByName(rows))

    # reads

    def get_node(self, node_id: str, any_state: bool = False) -> DataFrame:
        return store.get_node(self.tables.nodes, node_id, any_state)

    def query_nodes(self, **how) -> DataFrame:
        return store.query_nodes(self.tables.nodes, **how)

    def get_event(self, event_id: str) -> DataFrame:
        return T.event(self.tables.events, event_id)

    def events(self, user_id: str, **how) -> DataFrame:
        return T.events_by_user(self.tables.events, user_id, **how)

    def neighborhood(self, seeds: DataFrame, **how) -> DataFrame:
        return graph.neighborhood(self.tables.nodes, self.tables.edges, seeds, **how)

    def chain(self, seeds: DataFrame) -> DataFrame:
        return graph.chain_report(self.tables.nodes, self.tables.edges, seeds)

    def snapshots(self, valid=None) -> DataFrame:
        return graph.snapshots(self.tables.nodes, self.tables.edges, valid)

    def retrieve(self, queries: DataFrame, now, **how) -> DataFrame:
        """queries: (query_id, query, user_id) and maybe time_from, time_to, embedding -> ranked candidates. The request is
        noted among the operations."""
        q = queries if "embedding" in queries.columns else search.embed(queries, "query", self.embedder)
        out = kept(retrieval.retrieve(self.tables.nodes, self.tables.edges, self.tables.vectors, self.tables.documents, analysis.analyze(q, now), now, self.weights, self.packing, **how))
        noted = retrieval.retrieval_log(out, now, weights=self.weights.version(), scopes=",".join(how.get("scopes") or []) or None, mode=how.get("mode", "default"))
        self.tables = replace(self.tables, operations=self.tables.operations.unionByName(T.migrate(noted, S.OPERATIONS)))
        return out

    def hints(self, queries: DataFrame, now, scopes: list[str]) -> DataFrame:
        """The best candidates outside these scopes."""
        q = queries if "embedding" in queries.columns else search.embed(queries, "query", self.embedder)
        return retrieval.hints(self.tables.nodes, self.tables.edges, self.tables.vectors, self.tables.documents, analysis.analyze(q, now), now, scopes, self.weights, self.packing)

    def _documents(self) -> DataFrame:
        if self.tables.documents is not None:
            return self.tables.documents
        return self.tables.nodes.select(F.col("id").alias("node_id"), "content", "user_id", "node_type", "scope")

    def search(self, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Plain vector and lexical hits side by side."""
        q = queries if "embedding" in queries.columns else search.embed(queries, "query", self.embedder)
        return search.vector_topk_batch(self.tables.vectors, q, k), search.bm25(self._documents(), q, k)

    def context(self, queries: DataFrame, now, **how) -> DataFrame:
        """Ranked results as text for a prompt."""
        return packing.format_for_llm(graph.counterparts(self.retrieve(queries, now, **how), self.tables.edges), queries, now)

    def pack(self, ranked: DataFrame) -> DataFrame:
        return packing.greedy_pack(ranked, self.packing)

    # upkeep

    def organize(self, now, names: list[str] | None = None, config: jobs.Organizer = jobs.Organizer(), budget_seconds: float | None = None) -> list[jobs.Result]:
        return self._took(jobs.organize(self.tables, now, names, config, budget_seconds))

    def end_session(self, now) -> list[jobs.Result]:
        return self._took(jobs.end_session(self.tables, now))

    def maintain(self, now) -> list[jobs.Result] | None:
        done = self.maintenance.maybe_run(self.tables, now)
        return self._took(done) if done else None

    def _took(self, results: list[jobs.Result]) -> list[jobs.Result]:
        self.tables = results[-1].tables if results else self.tables
        self.weights = next((r.output for r in results if isinstance(r.output, S.Weights)), self.weights)
        return results

    def consolidate_knowledge(self, now, least: int = 3, budget_tokens: int = 500) -> DataFrame:
        """Adds a summary node per name that is spoken of often; gives the profiles."""
        found = ingest.knowledge_profiles(self.tables.nodes, least, budget_tokens)
        nodes = ingest.profile_nodes(found, now)
        self.tables = replace(self.tables, nodes=self.tables.nodes.unionByName(nodes))
        return found

    def quality(self, now, days: int = 30) -> DataFrame:
        signals = self.tables.feedback if self.tables.feedback is not None else self.spark.createDataFrame([], S.FEEDBACK)
        return quality.feedback_rates(quality.recent(signals, now, days))
