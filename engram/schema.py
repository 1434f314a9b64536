"""Domains, constants and table schemas of the memory model."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# --- fixed values: they must equal the published model's for equal results

NODE_TYPES = ["entity", "event", "fact", "decision", "preference", "task", "summary", "note", "instruction"]
EDGE_TYPES = ["relates_to", "supersedes", "derived_from", "mentions", "part_of", "caused_by", "supports", "contradicts", "has_fact"]
SCOPES = ["personal", "project", "organisation", "agent", "system", "sandbox"]
SOURCE_TYPES = ["user_stated", "user_demonstrated", "system_inferred", "external_document", "tool_output"]
TRANSITIONS = {
    "tentative": ["stable", "superseded", "contested", "archived"],
    "stable": ["superseded", "contested", "archived"],
    "contested": ["stable", "deprecated", "archived"],
    "superseded": ["archived"],
    "deprecated": ["archived"],
    "archived": [],
}
EPISTEMIC_WEIGHTS = {"observed": 1.0, "asserted": 0.9, "inferred": 0.7, "hypothetical": 0.3, "conditional": 0.5, "deprecated": 0.1, "unverified": 0.5}
EPISTEMIC_FALLBACK = 0.7
DECAY_LAMBDA = {"permanent": 0.0, "slow": 0.005, "medium": 0.020, "fast": 0.070, "rapid": 0.200}
DECAY_FALLBACK = 0.020
EPISTEMIC_DECAY = {"observed": "slow", "asserted": "medium", "inferred": "fast", "hypothetical": "rapid", "conditional": "medium", "deprecated": "permanent", "unverified": "rapid"}
CONFIDENCE_PRIOR = {
    ("observed", "user_stated"): 0.90,
    ("observed", "user_demonstrated"): 0.85,
    ("observed", "system_inferred"): 0.70,
    ("observed", "external_document"): 0.75,
    ("observed", "tool_output"): 0.80,
    ("asserted", "user_stated"): 0.80,
    ("asserted", "user_demonstrated"): 0.75,
    ("asserted", "system_inferred"): 0.60,
    ("asserted", "external_document"): 0.65,
    ("asserted", "tool_output"): 0.70,
    ("inferred", "user_demonstrated"): 0.60,
    ("inferred", "system_inferred"): 0.55,
    ("inferred", "external_document"): 0.50,
    ("inferred", "tool_output"): 0.55,
    ("hypothetical", "user_stated"): 0.35,
    ("hypothetical", "system_inferred"): 0.25,
    ("hypothetical", "external_document"): 0.30,
    ("unverified", "system_inferred"): 0.20,
    ("unverified", "external_document"): 0.25,
    ("unverified", "tool_output"): 0.30,
}
CONFIDENCE_FALLBACK = 0.50
TTL_DAYS = {"event": 365, "decision": 180, "task": 90, "summary": 365, "note": 90}
ACTIVE = ["tentative", "stable"]
LIVE = ["tentative", "stable", "contested"]
PREDICATE_CLASSES = {"works_at": ["employed_by", "employed_at", "joined"], "lives_in": ["resides_in", "located_in"], "role": ["position", "title"]}
ALIASES = {
    "javascript": ["js", "ecmascript"],
    "typescript": ["ts"],
    "python": ["py"],
    "machine learning": ["ml"],
    "artificial intelligence": ["ai"],
    "natural language processing": ["nlp"],
    "application programming interface": ["api"],
    "continuous integration": ["ci"],
    "continuous deployment": ["cd"],
    "continuous integration/continuous deployment": ["ci/cd", "cicd"],
    "database": ["db"],
    "postgresql": ["postgres", "pg"],
    "mongodb": ["mongo"],
    "kubernetes": ["k8s"],
    "amazon web services": ["aws"],
    "google cloud platform": ["gcp"],
    "microsoft azure": ["azure"],
    "operating system": ["os"],
    "user interface": ["ui"],
    "user experience": ["ux"],
    "representational state transfer": ["rest"],
    "graphql": ["gql"],
    "hypertext markup language": ["html"],
    "cascading style sheets": ["css"],
    "structured query language": ["sql"],
}

#: Words that oscillation keywords leave out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need must"
    " i me my we our you your he she it they them their his her its and or but if then so for to of in on at by with from as"
    " into about that this these those not no all any some very just also too much more most"
).split()
#: Words that the keyword fan-out of counting queries leaves out.
FAN_OUT_STOP_WORDS = (
    "how many much total did do have has the and or in on at to of for with from last past all what list count number been"
    " was were are is my me few spend spent any some each every a an that this those these it its"
).split()
#: Capitalised words that name nothing.
NO_NAMES = (
    "The This That What When Where How Who Why Does Did Has Have Was Will Can Could Would Should May Also Just Very Really"
    " Some Most Each Every After Before Since Until About From Into Over With Note Image Observation Known Facts"
).split()
JOBS = ["promote", "decay_sweep", "archive", "deduplicate", "alias_resolve", "summarize", "feedback_apply", "centrality_boost", "tombstone_sweep", "snapshot_generation", "consolidate"]


@dataclass(frozen=True)
class Weights:
    """Terms of the composite score; the six additive ones sum to 1."""

    semantic: float = 0.25
    lexical: float = 0.20
    graph: float = 0.20
    recency: float = 0.10
    salience: float = 0.10
    confidence: float = 0.15
    epistemic: float = 0.05
    paths: float = 0.0
    recency_lambda: float = 0.02
    temporal_boost: float = 0.15
    relevance_floor: float = 0.35
    node_type_boost: dict = field(default_factory=lambda: {"fact": 1.15, "preference": 1.15, "decision": 1.10, "summary": 1.10, "instruction": 1.10})

    def __post_init__(self) -> None:
        if abs(self.semantic + self.lexical + self.graph + self.recency + self.salience + self.confidence - 1) > 1e-6:
            raise ValueError("the additive weights must sum to 1")

    def version(self) -> str:
        parts = (self.semantic, self.lexical, self.graph, self.recency, self.salience, self.confidence, self.epistemic, self.paths, self.recency_lambda)
        return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:12]

    def with_recency(self, share: float, least_lambda: float = 0.0) -> Weights:
        """More recency, taken from semantic and lexical in proportion."""
        more = share - self.recency
        if more <= 0:
            return replace(self, recency_lambda=max(self.recency_lambda, least_lambda))
        base = self.semantic + self.lexical
        return replace(self, recency=share, semantic=self.semantic - more * self.semantic / base, lexical=self.lexical - more * self.lexical / base, recency_lambda=max(self.recency_lambda, least_lambda))


@dataclass(frozen=True)
class Packing:
    budget: int = 4096
    overhead: int = 100
    chars_per_token: float = 4.2
    graph_cap: int = 150
    vector_k: int = 500
    lexical_k: int = 500
    hops: int = 3
    window: int = 3
    window_top: int = 20
    window_decay: float = 0.85
    cross_scope: int = 5
    aggregation_factor: int = 3
    aggregation_most: int = 2000


_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType())}


def struct(fields: str) -> T.StructType:
    """A schema from `name kind` pairs; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(","))])


EVENTS = struct("id string, timestamp timestamp_ntz, role string, content string, content_hash string, user_id string, session_id string, scope string, metadata string, created_at timestamp_ntz, event_time timestamp_ntz")
NODES = struct(
    "id string, node_type string, user_id string, session_id string, scope string, content string, metadata string, confidence double, salience double, lifecycle_state string,"
    " valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_by string, evidence_refs array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, epistemic_type string,"
    " source_type string, decay_profile string, last_reinforced_at timestamp_ntz, reinforcement_boost double, salience_base double, confidence_base double, pinned boolean, ttl_days int, event_time timestamp_ntz"
)
EDGES = struct("id string, source_id string, target_id string, edge_type string, user_id string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, provenance_event_id string, metadata string, created_at timestamp_ntz")
OPERATIONS = struct("id string, op_type string, target_id string, payload string, actor_id string, namespace_id string, created_at timestamp_ntz")
VECTORS = struct("node_id string, user_id string, embedding array<float>, model string, version string, dim int")
FEEDBACK = struct("query string, surfaced_node_ids array<string>, signal_type string, correction_content string, timestamp timestamp_ntz")
