"""A job's stages under an installation's policy and the job's own settings: every field has its effect here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.settings import JobSettings, Policy, PolicyError
from . import graph as G
from . import ingest as I
from . import ledger as L
from . import reason as R
from . import semantic as S
from .scratch import Scratch


@dataclass(frozen=True)
class JobRun:
    policy: Policy = field(default_factory=Policy)
    job: JobSettings = field(default_factory=JobSettings)

    def __post_init__(self):
        if self.job.domain and self.job.domain.strip().lower() not in {d.strip().lower() for d in self.policy.allowed_domains}:
            raise PolicyError(f"the job's domain {self.job.domain} is not allowed")

    def slices(self, sources: DataFrame, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
        """Blocks of at most the policy's sentences and tokens."""
        return I.slice_sources(sources, id_col, text_col, self.policy.sentences_per_block, self.policy.tokens_per_block)

    def pairs(self, triples: DataFrame) -> DataFrame:
        """Pair edges without excluded entities, noise and hubs; written, since paths read them many times."""
        scratch = Scratch(triples.sparkSession, "job")
        edges = G.without_noise(G.structural_edges(triples, list(self.job.excluded_entities)))
        return scratch.write(G.suppress_hubs(scratch.write(G.pair_edges(edges)), self.policy.hub_degree))

    def explore(self, triples: DataFrame, affected: DataFrame | None = None) -> DataFrame:
        """Hypotheses of a job's triples.

        Excluded entities leave before the graph is built; seeds keep paths that start or
        end in one, together with affected nodes (column node) of a new version; the
        stoplist drops middles, preferred predicates raise confidence.
        """
        pairs, seeds = self.pairs(triples), list(self.job.seeds) or None
        if seeds is not None and affected is not None:
            seeds = R.effective_seeds(seeds, affected)
        found = R.hypotheses_of(R.discovery_paths(pairs, seeds, list(self.job.stoplist)), "query" if self.job.seeds else "explore")
        if self.job.preferred_predicates:
            found = R.boost(found, list(self.job.preferred_predicates), self.policy.predicate_boost)
        return R.filter_hypotheses(found, least=self.policy.min_confidence)

    def consolidate(self, edges: DataFrame, blocks: DataFrame, vectors: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return S.merge(edges, blocks, vectors, self.policy.merge_similarity, nodes)

    def consolidate_more(
        self, nodes: DataFrame, edges: DataFrame, blocks: DataFrame, new_edges: DataFrame, new_blocks: DataFrame, vectors: DataFrame
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        return S.merge_incrementally(nodes, edges, blocks, new_edges, new_blocks, vectors, self.policy.merge_similarity)

    def duplicates(self, candidates: DataFrame, papers: DataFrame) -> DataFrame:
        return L.find_duplicates(candidates, papers, self.policy.fingerprint_similarity)

    def domains(self, pairs: DataFrame, known: DataFrame, answers: DataFrame) -> DataFrame:
        """The job's domain, else the known one, else an allowed answer."""
        return L.resolve_domains(pairs, self.job.domain or None, known, answers, self.policy.allowed_domains)

    def top_pairs(self, hypotheses: DataFrame) -> DataFrame:
        return R.top_pairs(hypotheses, self.policy.top_hypotheses)

    def leads(self, hypotheses: DataFrame) -> DataFrame:
        return R.diverse_leads(hypotheses, self.policy.leads)

    def searches(self, leads: DataFrame) -> DataFrame:
        """Searches for leads (job_id, source, target) within the job's focus areas."""
        return L.search_texts(leads, self.job.focus_areas)
