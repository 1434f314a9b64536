"""Column expressions: time, decay, scoring terms, packing terms, text tests. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram import schema as S


def at(when) -> Column:
    return when if isinstance(when, Column) else F.lit(str(when)).cast("timestamp_ntz")


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b as a double."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(86400000000.0)


def lookup(values: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def decay_lambda(profile: Column) -> Column:
    return lookup(S.DECAY_LAMBDA, profile, S.DECAY_FALLBACK)


def effective_salience(now, pinned_adds_boost: bool = False, exempt_states: bool = True) -> Column:
    """Salience after decay. The ranking form keeps the base of pinned, permanent, archived and deprecated rows; the
    maintenance form (`pinned_adds_boost`) gives pinned rows base plus boost and knows no state."""
    sb, boost = F.col("salience_base"), F.col("reinforcement_boost")
    t = F.greatest(days_between(F.col("last_reinforced_at"), at(now)), F.lit(0.0))
    moved = clamp(sb * F.exp(-decay_lambda(F.col("decay_profile")) * t) + boost * F.exp(F.lit(-0.1) * t))
    if pinned_adds_boost:
        return F.when(F.col("pinned"), F.least(sb + boost, F.lit(1.0))).otherwise(moved)
    return F.when(_still(exempt_states), sb).otherwise(moved)


def effective_confidence(now, observed_inclusive: bool = False, exempt_states: bool = True) -> Column:
    """Confidence after decay at half the rate; observed rows keep it for 180 days (that day too if inclusive)."""
    cb = F.col("confidence_base")
    t = F.greatest(days_between(F.col("last_reinforced_at"), at(now)), F.lit(0.0))
    fresh = (t <= 180) if observed_inclusive else (t < 180)
    moved = F.when((F.col("epistemic_type") == "observed") & fresh, clamp(cb)).otherwise(clamp(cb * F.exp(-decay_lambda(F.col("decay_profile")) * t / 2)))
    return F.when(F.col("pinned") if observed_inclusive else _still(exempt_states), cb).otherwise(moved)


def _still(states: bool) -> Column:
    out = F.col("pinned") | (F.col("decay_profile") == "permanent")
    return out | F.col("lifecycle_state").isin("archived", "deprecated") if states else out


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot / length)


def token_estimate(text: Column, per: float = 4.2) -> Column:
    return F.when(F.length(text) > 0, F.ceil(F.length(text) / F.lit(per))).otherwise(F.lit(0)).cast("long")


def section(node_type: Column, state: Column) -> Column:
    out = F.when(state == "contested", "contested_claims")
    for kinds, name in ((["instruction"], "system_instructions"), (["entity"], "entity_snapshots"), (["fact", "note"], "stable_facts"), (["decision"], "recent_decisions"), (["task"], "active_tasks"), (["summary"], "summaries")):
        out = out.when(node_type.isin(kinds), name)
    return out.otherwise("provenance_refs")


def render(level: str) -> Column:
    """A candidate's text at a level of detail."""
    content, short = F.col("content"), F.substring("content", 1, 200)
    return {
        "full": content,
        "prose": F.when(F.length(content) > 0, F.expr("substring(content, 1, cast(floor(length(content) * 0.8) as int))")).otherwise(content),
        "structured": F.concat(F.lit("type: "), F.col("node_type"), F.lit(", content: "), short, F.when(F.length(content) > 200, "...").otherwise("")),
        "key_value": F.concat(F.lit("id: "), F.col("id"), F.lit(", type: "), F.col("node_type"), F.lit(", confidence: "), F.col("confidence").cast("string")),
        "reference": F.concat_ws(":", "node_type", "id"),
    }[level]


def days_ago(event: Column, question: Column) -> Column:
    """By calendar days: `today`, `yesterday`, days, `1 week ago`; then about how many weeks (under 60 days), months (of 30.44
    days) or years (of 365.25), with the days in brackets; `in n days` for what lies ahead."""
    d = F.datediff(question, event)
    days = d.cast("string")
    about = lambda n, unit: F.concat(F.lit("~"), n.cast("string"), F.lit(f" {unit} ago ("), days, F.lit(" days)"))
    return (
        F.when(d < 0, F.concat(F.lit("in "), (-d).cast("string"), F.lit(" days")))
        .when(d == 0, "today")
        .when(d == 1, "yesterday")
        .when(d < 7, F.concat(days, F.lit(" days ago")))
        .when(d == 7, "1 week ago")
        .when(d < 14, about(F.lit(1), "week"))
        .when(d < 60, about(F.floor(d / 7).cast("int"), "weeks"))
        .when(d < 365, about(F.round(d / F.lit(30.44), 1), "months"))
        .otherwise(about(F.round(d / F.lit(365.25), 1), "years"))
    )


# --- text tests; the phrases are fixed values

UPDATE_LANGUAGE = r"(?i)(?:changed\s+to|switched\s+to|migrated\s+(?:from|to)|moved\s+to|replaced|updated\s+to|now\s+uses|no\s+longer|rewritten|upgraded\s+to|new\s+\S+\s+is|effective\s+immediately)"
CURRENT_STATE = r"(?i)(?:\b(?:current|currently|now|latest|today|at\s+the\s+moment|these\s+days|presently)\b|\bso\s+far\b|\busually\b|\btypically\b|\bnormally\b|\bmost\s+recently\b|\bright\s+now\b|^(?:do|does|am|are|have|has)\s+I\b|\bdo\s+I\s+(?:go|have|use|own|keep|play|attend|work)\b)"
EPISODIC = r"(?i)\b(?:recently|last\s+time|the\s+other\s+day|earlier\s+today|yesterday|this\s+(?:morning|afternoon|evening|week)|just\s+(?:now|told|said|mentioned|asked)|remember\s+when|did\s+(?:I|we)\s+(?:talk|discuss|mention|say))\b"
AGGREGATION_WORDS = r"(?i)\b(?:how\s+many|how\s+much|total|count|list\s+all|sum)\b"
AGGREGATION = r"(?i)\b(?:how\s+many|how\s+much|how\s+often|total|count|all\s+the\s+times|every\s+time|list\s+all|all\s+of\s+the)\b"
ENTITY_START = r"(?i)^\s*(?:who|what\s+is|what\s+are)\b"
TEMPORAL = r"(?i)\b(?:when|last|before|after|recent|recently|ago|yesterday|today|tomorrow|earlier|later|since|until|prior)\b"
RELATIONAL = r"(?i)\b(?:related\s+to|connected\s+to|linked\s+to|between|associated\s+with)\b"
FACTUAL = r"(?i)\b(?:what|how|why|does|is\s+it\s+true|fact|facts)\b"
PROPER_NOUN = r"(?<!^)(?<![.!?]\s)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = rf"(?i)\b(?:(?:{MONTHS})(?:\s+\d{{1,2}}(?:,?\s+\d{{4}})?)?|\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|\d{{1,2}}\s+(?:{MONTHS})(?:\s+\d{{4}})?|(?:19|20)\d{{2}})\b"
CHANGES = [
    r"\bmigrat(?:ed?|e)\s+(?:from\s+)?(.+?)\s+to\s+",
    r"\bswitch(?:ed)?\s+(?:from\s+)?(.+?)\s+to\s+",
    r"\bmov(?:ed?|e)\s+(?:from\s+)?(.+?)\s+to\s+",
    r"\breplac(?:ed?|e)\s+(.+?)\s+with\s+",
    r"\bno\s+longer\s+(?:using|used|use)\b",
    r"\bdeprecated\b",
    r"\bwent\s+back\s+(?:to|from)\b",
    r"\babandoned\b",
    r"\bphased?\s+out\b",
    r"\bis\s+(?:now\s+)?(?:obsolete|retired)\b",
]


def intent(query: Column) -> Column:
    dated = query.rlike(DATE)
    return (
        F.when(query.rlike(ENTITY_START) | query.rlike(PROPER_NOUN), "entity_lookup")
        .when(query.rlike(TEMPORAL) | dated, "temporal")
        .when(query.rlike(RELATIONAL), "relational")
        .when(query.rlike(FACTUAL), "factual")
        .otherwise("semantic")
    )


def entities(query: Column) -> Column:
    """Runs of capitalised words inside a sentence, then quoted strings; distinct, in order."""
    quoted = [F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in (r'"([^"]+)"', r"'([^']+)'")]
    return F.array_distinct(F.concat(F.regexp_extract_all(query, F.lit(PROPER_NOUN), F.lit(1)), *quoted))


def change_signal(content: Column) -> Column:
    return content.rlike("(?i)" + "|".join(CHANGES))


def superseded_terms(content: Column) -> Column:
    """Lower-cased phrases that a text says are gone, and the words of phrases of several words."""
    phrases = F.concat(*[F.regexp_extract_all(content, F.lit("(?i)" + p), F.lit(1)) for p in CHANGES[:4]])
    phrases = F.transform(phrases, lambda x: F.lower(F.trim(x)))
    words = F.transform(phrases, lambda x: F.when(F.size(F.split(x, r"\s+")) > 1, F.split(x, r"\s+")).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(phrases, F.flatten(words)))


def context_type(query: Column) -> Column:
    current = r"(?i)(?:\b(?:current|currently|now|presently|these\s+days)\b|\bmost\s+recently\b|\bright\s+now\b|\bafter\s+(?:\w+\s+)?(?:recent|latest)\b|\bdo\s+I\s+(?:have|keep|use|own|play|work)\b)"
    timed = r"(?i)\b(?:when|before|after|ago|first|last|order|earliest|latest|how long|how many (?:days|weeks|months|years))\b"
    return F.when(query.rlike(AGGREGATION) | query.rlike(AGGREGATION_WORDS), "aggregation").when(query.rlike(current), "knowledge_update").when((intent(query) == "temporal") | query.rlike(timed), "temporal").otherwise("default")
