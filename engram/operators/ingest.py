"""Messages to memory: inference of types, extraction, grounding, entities, facts and their conflicts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.functions.frames import kept
from engram.operators import match
from engram.sources.tables import migrate

EXTRACTION, LINKS = "array<struct<subject:string,predicate:string,object:string>>", "array<struct<source:string,kind:string,target:string>>"


def epistemic_of(node_type: Column) -> Column:
    return F.when(node_type == "summary", "inferred").when(node_type.isin("event", "instruction"), "observed").otherwise("asserted")


def source_of(role: Column) -> Column:
    return F.when(F.lower(role).isin("assistant", "system"), "system_inferred").otherwise("user_stated")


def confidence_prior(epistemic: Column, source: Column, overrides: dict | None = None) -> Column:
    table = {f"{e}|{s}": p for (e, s), p in (S.CONFIDENCE_PRIOR | (overrides or {})).items()}
    return X.lookup(table, F.concat_ws("|", epistemic, source), S.CONFIDENCE_FALLBACK)


def store(messages: DataFrame, now) -> DataFrame:
    """(id, content, user_id, session_id, role, node_type, scope, ...) as nodes; given values win over inferred ones."""
    have = lambda c: F.col(c) if c in messages.columns else F.lit(None).cast("string")
    kind = F.coalesce(have("node_type"), F.lit("note"))
    df = messages.withColumns({"node_type": kind, "epistemic_type": F.coalesce(have("epistemic_type"), epistemic_of(kind)), "source_type": F.coalesce(have("source_type"), source_of(F.coalesce(have("role"), F.lit("user"))))})
    prior = confidence_prior(F.col("epistemic_type"), F.col("source_type"))
    prior = F.when(F.col("node_type") == "instruction", F.greatest(prior, F.lit(0.7))).otherwise(prior)
    given = F.col("confidence").cast("double") if "confidence" in messages.columns else F.lit(None).cast("double")
    profile = F.when(F.col("node_type") == "instruction", "slow").otherwise(X.lookup(S.EPISTEMIC_DECAY, F.col("epistemic_type"), "medium"))
    ttl = F.try_element_at(F.create_map(*[F.lit(x) for kv in S.TTL_DAYS.items() for x in kv]), F.col("node_type"))
    c = F.coalesce(given, prior)
    out = df.withColumns({"confidence": c, "confidence_base": c, "salience": F.lit(0.5), "salience_base": F.lit(0.5), "decay_profile": profile, "ttl_days": ttl, "lifecycle_state": F.lit("tentative"), "created_at": X.at(now), "updated_at": X.at(now), "valid_from": X.at(now), "last_reinforced_at": X.at(now), "evidence_refs": F.col("evidence_refs") if "evidence_refs" in messages.columns else F.array("id")})
    return migrate(out, S.NODES)


def qa_pairs(turns: DataFrame, most: int = 1000) -> DataFrame:
    """(conv_id, turn, role, text): a turn with the one before it where the role changes and both are short."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    prev = turns.withColumns({"prev_role": F.lag("role").over(w), "prev_text": F.lag("text").over(w)})
    return prev.where((F.col("prev_role") != F.col("role")) & (F.length("prev_text") + F.length("text") < most)).select("conv_id", "turn", F.concat_ws("\n", "prev_text", "text").alias("content"))


_NAME = r"[A-Z][\w-]*(?: [A-Z][\w-]*)*"


def extract(events: DataFrame) -> DataFrame:
    """The offline extractor: `X works at|lives in|is|uses|likes Y` sentences as facts, capitalised runs as entities,
    `X <verb> Y` between two such runs as relationships, the first sentence as the summary."""

    def parts(pattern: str) -> list[Column]:
        return [F.regexp_extract_all("content", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]

    def triples(p: list[Column], fields: tuple[str, str, str], middle) -> Column:
        return F.zip_with(F.arrays_zip(p[0].alias("s"), p[1].alias("p")), p[2], lambda a, o: F.struct(a["s"].alias(fields[0]), middle(a["p"]).alias(fields[1]), F.trim(o).alias(fields[2])))

    def where(words: str, found: Column) -> Column:
        """The patterns are tried on texts that hold one of their words."""
        none = [~F.contains("content", F.lit(f" {w} ")) for w in words.split("|")]
        return F.when(reduce(and_, none), F.array().cast(EXTRACTION if words == verbs else LINKS)).otherwise(found)

    verbs, kinds = "works at|lives in|joined|resides in|located in|is|uses|likes", "supports|contradicts|knows|manages|helps"
    facts = triples(parts(rf"({_NAME}) ({verbs}) ([\w][\w .+-]*?)(?=[.,;!?]|$)"), ("subject", "predicate", "object"), lambda v: F.replace(v, F.lit(" "), F.lit("_")))
    links = triples(parts(rf"({_NAME}) ({kinds}) ({_NAME})"), ("source", "kind", "target"), lambda v: v)
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(rf"\b({_NAME})"), F.lit(1)))
    return events.withColumns({"facts": where(verbs, facts), "entities": names, "relationships": where(kinds, links), "summary": F.regexp_extract("content", r"^\s*([^.!?]*[.!?]?)", 1)})


def grounded(extracted: DataFrame) -> DataFrame:
    """Entities whose name, facts whose subject and relationships whose both ends stand in the text, whatever their case."""
    text = F.lower("content")
    said = lambda x: F.contains(text, F.lower(x))
    out = {"entities": F.filter("entities", said), "facts": F.filter("facts", lambda f: said(f["subject"]))}
    if "relationships" in extracted.columns:
        out["relationships"] = F.filter("relationships", lambda r: said(r["source"]) & said(r["target"]))
    return extracted.withColumns(out)


def upsert_entities(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """mentions: (user_id, name) and maybe entity_type -> (user_id, key, entity_type, id, name, is_new): an entity per user,
    lower-cased name and type, known or new. A node tells its type in its metadata."""
    kind = F.col("entity_type") if "entity_type" in mentions.columns else F.lit("unknown")
    kind_of = F.coalesce(F.get_json_object("metadata", "$.entity_type"), F.lit("unknown"))
    known = nodes.where("node_type = 'entity'").where(F.col("lifecycle_state").isin(S.LIVE)).groupBy("user_id", F.lower(F.trim("content")).alias("key"), kind_of.alias("entity_type")).agg(F.min("id").alias("known_id"))
    # distinct first: that is hashed, while the least of strings sorts every mention
    told = mentions.select("user_id", F.trim("name").alias("name"), F.lower(F.trim("name")).alias("key"), kind.alias("entity_type")).distinct()
    found = told.groupBy("user_id", "key", "entity_type").agg(F.min("name").alias("name")).join(known, ["user_id", "key", "entity_type"], "left")
    made = F.sha2(F.concat_ws("|", "user_id", F.lit("entity"), "key", "entity_type"), 256)
    return found.select("user_id", "key", "entity_type", F.coalesce("known_id", made).alias("id"), "name", F.col("known_id").isNull().alias("is_new"))


def canonical_predicate(p: Column) -> Column:
    same = {e: c for c, es in S.PREDICATE_CLASSES.items() for e in es}
    p = F.lower(F.trim(p))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in same.items() for x in kv]), p), p)


def fact_conflicts(facts: DataFrame, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """facts: (id, user_id, subject, predicate, object, temporal_intent and what `order` names): each fact with the first later
    one of the same subject and predicate class whose object differs, and what follows: contradict an assertion, else supersede.

    Newest first, the start of the next run of equal objects is carried back over the run before it. Keys are columns of their
    own, so both passes over a key's facts share one shuffle and one sort. A column `fresh` keeps conflicts with fresh facts only.
    """
    rows = facts.withColumns({"_subject": F.lower(F.trim("subject")), "_predicate": canonical_predicate(F.col("predicate")), "_object": F.lower(F.trim("object"))})
    w = Window.partitionBy("user_id", "_subject", "_predicate").orderBy(*map(F.desc, order))
    more = [F.lag("fresh").over(w).alias("fresh")] if "fresh" in facts.columns else []
    later = F.struct(F.lag("id").over(w).alias("id"), F.lag("temporal_intent").over(w).alias("intent"), *more)
    rows = rows.withColumn("turn", F.when((F.row_number().over(w) > 1) & ~F.col("_object").eqNullSafe(F.lag("_object").over(w)), later))
    rows = rows.withColumn("next", F.last("turn", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("next.fresh" if more else "next IS NOT NULL")
    return rows.select(F.col("id").alias("old_id"), F.col("next.id").alias("new_id"), F.when(F.col("next.intent") == "assertion", "contradict").otherwise("supersede").alias("action"))


def facts_of(nodes: DataFrame) -> DataFrame:
    """Active facts among nodes, as `fact_conflicts` takes them; `seen` orders those of one batch."""
    told = F.from_json("metadata", "subject string, predicate string, object string, temporal_intent string").alias("f")
    rows = nodes.where((F.col("node_type") == "fact") & F.col("lifecycle_state").isin(S.ACTIVE)).select("id", "user_id", "created_at", "event_time", F.try_element_at("evidence_refs", F.lit(1)).alias("seen"), told)
    # a generator keeps what is asked of the fields above it, so a text is parsed once and not once a field and filter
    return rows.select("id", "user_id", "created_at", "event_time", "seen", F.inline(F.array("f"))).where("predicate IS NOT NULL")


def new_conflicts(known: DataFrame, new: DataFrame, few: int = 100_000) -> DataFrame:
    """(old_id, new_id, action) of facts among the nodes `known` and `new` that a fact among `new` contradicts or replaces: of one
    batch in the order of what they say of their time, then of their events. Of `few` new facts the subjects and predicates are
    sent to the known ones, which leaves others out; more of them meet the known ones in the shuffle that orders both."""
    told, fresh = facts_of(known), facts_of(new)
    if new.where("node_type = 'fact'").limit(few + 1).count() <= few:
        about = lambda f: f.withColumns({"about": F.lower(F.trim("subject")), "what": canonical_predicate(F.col("predicate"))})
        told = about(told).join(F.broadcast(about(fresh).select("user_id", "about", "what")), ["user_id", "about", "what"], "left_semi").select(*told.columns)
    both = told.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
    return fact_conflicts(both, ("created_at", "event_time", "seen", "id"))


def materialise(extracted: DataFrame, nodes: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Grounded extractions (event id, user_id, content, entities, facts, relationships), a row per event, as new nodes and their
    edges: has_fact from subject to fact, and relationships between entities (of a kind without an edge type: relates_to)."""
    from engram.operators.store import _edge_rows

    linked = "relationships" in extracted.columns
    parts = [F.col("entities"), F.transform("facts", lambda f: f["subject"]), *([F.transform("relationships", lambda r: r["source"]), F.transform("relationships", lambda r: r["target"])] if linked else [])]
    names = extracted.select("user_id", F.explode(F.array_distinct(F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull())))).alias("name"))
    ents = kept(upsert_entities(names, nodes))
    when = F.col("timestamp") if "timestamp" in extracted.columns else F.lit(None).cast("timestamp_ntz").alias("timestamp")
    # what a text says twice is one fact, the first
    said = lambda f: F.concat_ws(" ", f["subject"], f["predicate"], f["object"])
    own = extracted.withColumn("_said", F.transform("facts", said)).withColumn("facts", F.filter("facts", lambda f, i: F.array_position("_said", said(f)) == i + 1))
    facts = own.select(F.col("id").alias("event_id"), "user_id", when, F.explode("facts").alias("f")).select("event_id", "user_id", "timestamp", "f.*").withColumn("key", F.lower(F.trim("subject")))
    facts = facts.withColumn("metadata", F.to_json(F.struct(*[c for c in ("subject", "predicate", "object", "temporal_intent") if c in facts.columns])))
    facts = facts.withColumn("content", F.concat_ws(" ", "subject", "predicate", "object")).withColumn("id", F.sha2(F.concat_ws("|", "event_id", "content"), 256))
    entity = ents.where("is_new").select("id", "user_id", F.col("name").alias("content"), F.lit("entity").alias("node_type"), F.to_json(F.struct("entity_type")).alias("metadata"), F.lit(0.5).alias("confidence"))
    new = store(entity, now).withColumn("decay_profile", F.lit("slow")).unionByName(store(facts.select("id", "user_id", "content", "metadata", F.col("timestamp").alias("event_time"), F.array("event_id").alias("evidence_refs"), F.lit("fact").alias("node_type")), now))
    by_key = ents.select("user_id", "key", F.col("id").alias("entity_id"))
    edges = _edge_rows(facts.join(by_key, ["user_id", "key"]), "entity_id", "id", "has_fact", now)
    if linked:
        links = extracted.select("user_id", F.explode("relationships").alias("r")).select("user_id", "r.*").where("kind IS NOT NULL")
        end = lambda side: by_key.select("user_id", F.col("key").alias(f"_{side}"), F.col("entity_id").alias(f"{side}_id"))
        ends = links.withColumns({"_source": F.lower(F.trim("source")), "_target": F.lower(F.trim("target"))}).join(end("source"), ["user_id", "_source"]).join(end("target"), ["user_id", "_target"])
        kind = F.when(F.col("kind").isin("supports", "contradicts"), F.col("kind")).otherwise(F.lit("relates_to"))
        edges = edges.unionByName(_edge_rows(ends, "source_id", "target_id", kind, now).dropDuplicates(["id"]))  # texts may say it again
    return new, edges


def store_supersedence(new: DataFrame, neighbours: DataFrame) -> DataFrame:
    """new: (id, content); neighbours: (query_id = id of new, node_id, content): what a change notice makes old."""
    told = new.where(X.change_signal(F.col("content"))).select(F.col("id").alias("new_id"), X.superseded_terms(F.col("content")).alias("terms"))
    near = told.join(neighbours.withColumnRenamed("query_id", "new_id"), "new_id")
    return near.where(F.exists("terms", lambda t: F.contains(F.lower("content"), t))).select(F.col("node_id").alias("old_id"), "new_id")


def knowledge_profiles(nodes: DataFrame, least: int = 3, budget_tokens: int = 500) -> DataFrame:
    """(user_id, name, profile, notes): a text per user and name that occurs `least` times, from the notes that hold the name
    in any case: distinct by their first 80 letters, in order of time, until one would pass the budget."""
    live = nodes.where(F.col("lifecycle_state").isin(S.ACTIVE)).select("id", "user_id", F.trim("content").alias("content"), F.coalesce("event_time", "created_at").alias("t"))
    names = live.select("user_id", F.explode(F.regexp_extract_all("content", F.lit(r"\b([A-Z][a-z]{2,})\b"), F.lit(1))).alias("name")).where(~F.col("name").isin(S.NO_NAMES))
    often = names.groupBy("user_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    said = match.holding_own(live.select(F.col("user_id").alias("owner"), "id", F.lower("content").alias("text")), often.select(F.col("user_id").alias("owner"), F.lower("name").alias("pattern")))
    named = often.withColumn("pattern", F.lower("name")).join(said.withColumnRenamed("owner", "user_id"), ["user_id", "pattern"]).select("user_id", "name", "id")
    rows = live.join(named, ["user_id", "id"])
    key = F.substring(F.lower("content"), 1, 80)
    rows = rows.groupBy("user_id", "name", key.alias("key")).agg(F.min(F.struct("t", "id", "content")).alias("x"), F.count("*").alias("c"))
    w = Window.partitionBy("user_id", "name")
    head = F.concat(F.lit("[Knowledge Profile: "), "name", F.lit("]"))
    used = F.length(head) + F.sum(F.length("x.content") + 2).over(w.orderBy("x.t", "x.id").rowsBetween(Window.unboundedPreceding, 0))
    over = (used > 4 * budget_tokens).cast("int")
    rows = rows.withColumns({"related": F.sum("c").over(w), "over": over}).where("related >= 2")
    rows = rows.withColumn("gone", F.max("over").over(w.orderBy("x.t", "x.id").rowsBetween(Window.unboundedPreceding, 0))).where("gone = 0")
    listed = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(F.lit("- "), x["content"]))  # bounded by the budget
    return rows.groupBy("user_id", "name").agg(F.concat_ws("\n", F.concat(F.lit("[Knowledge Profile: "), F.first("name"), F.lit("]")), listed).alias("profile"), F.count("*").alias("notes"))


def profile_nodes(profiles: DataFrame, now) -> DataFrame:
    """Profiles as summary nodes, observed by the system."""
    rows = profiles.select(F.sha2(F.concat_ws("|", F.lit("profile"), "user_id", "name"), 256).alias("id"), "user_id", F.col("profile").alias("content"), F.lit("summary").alias("node_type"), F.lit("personal").alias("scope"), F.lit(0.8).alias("confidence"), F.lit("observed").alias("epistemic_type"), F.lit("system_inferred").alias("source_type"), F.to_json(F.struct(F.col("name").alias("entity_name"))).alias("metadata"))
    worth = {"salience": F.lit(0.7), "salience_base": F.lit(0.7), "evidence_refs": F.array().cast("array<string>")}
    return store(rows, now).withColumns(worth)
