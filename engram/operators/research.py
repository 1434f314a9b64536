"""Prototype operators: hypervectors, tag-weighted retrieval, phrase supersedence, topic narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators import match


def seeded_hv(name: Column, dim: int = 256) -> Column:
    """A vector of +1 and -1 that a name determines."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.pmod(F.xxhash64(name, i), F.lit(2)) == 0, 1.0).otherwise(-1.0))


def bind(a: Column, b: Column) -> Column:
    """Element-wise product; its own inverse on +1 and -1."""
    return F.zip_with(a, b, lambda x, y: x * y)


def permute(v: Column, by: int = 1) -> Column:
    n = F.size(v)
    k = F.pmod(F.lit(by), n)
    return F.when(k == 0, v).otherwise(F.concat(F.slice(v, n - k + 1, k), F.slice(v, F.lit(1), n - k)))


def normalise(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def quantise(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))


#: Endings that are cut off, longest first, where three letters stay; fixed values.
SUFFIXES = (
    "mentation ization isation fulness ousness iveness lessly ments ation ition iness ously ment ness able ible tion sion ally edly"
    " ling ings ing ies ous ful ive ity ers est ent ant ly ed er es s"
).split()


def stem(word: Column) -> Column:
    """A word without its ending."""
    out = None
    for end in SUFFIXES:
        fits = F.endswith(word, F.lit(end)) & (F.length(word) - len(end) >= 3)
        short = F.substr(word, F.lit(1), F.length(word) - len(end))
        out = F.when(fits, short) if out is None else out.when(fits, short)
    return F.when(F.length(word) <= 3, word).otherwise(out.otherwise(word))


def text_words(text: Column, stop_words: list[str]) -> Column:
    """Stemmed words of a text without stop words (all of them if nothing else is left), and its pairs of neighbours."""
    raw = F.filter(F.transform(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()\[\]{}]+|[.,;:!?\"'()\[\]{}]+$", "")), lambda w: w != "")
    kept = F.filter(raw, lambda w: ~w.isin(stop_words))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(raw), stem)


def text_hv(words: Column, dim: int = 256) -> Column:
    """The normalised sum of the vectors of all words and of the products of neighbours; one word is its own vector."""
    place = lambda w, i: F.when(F.pmod(F.xxhash64(w, i), F.lit(2)) == 0, 1.0).otherwise(-1.0)

    def at(i: Column) -> Column:
        ones = F.aggregate(words, F.lit(0.0), lambda s, w: s + place(w, i))
        twos = F.aggregate(F.sequence(F.lit(1), F.size(words) - 1), F.lit(0.0), lambda s, j: s + place(F.element_at(words, j), i) * place(F.element_at(words, j + 1), i))
        return ones + F.when(F.size(words) > 1, twos).otherwise(0.0)

    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)
    return F.when(F.size(words) == 1, v).otherwise(normalise(v))


def time_hv(t: Column, dim: int = 256) -> Column:
    """A time as the sum of year, month, day and hour, each bound to its slot: times that share parts are alike."""
    parts = [F.date_format(t, f) for f in ("yyyy", "MM", "dd", "HH")]
    bound = [bind(seeded_hv(F.lit(slot), dim), seeded_hv(F.concat(F.lit(f"{slot}:"), p), dim)) for slot, p in zip(("year", "month", "day", "hour"), parts, strict=True)]
    total = bound[0]
    for b in bound[1:]:
        total = F.zip_with(total, b, lambda x, y: x + y)
    return normalise(total)


def promoted(records: DataFrame, day: int, after: int = 7) -> DataFrame:
    """Tentative records of `after` days or more become stable."""
    due = (F.col("lifecycle_state") == "tentative") & (F.lit(day) - F.col("day") >= after)
    return records.withColumn("lifecycle_state", F.when(due, "stable").otherwise(F.col("lifecycle_state")))


def bundle(df: DataFrame, by: str, vector: str = "hv", weight: str | None = None) -> DataFrame:
    """The normalised (weighted) sum of a group's vectors: element-wise partial sums, no list of vectors."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = df.select(by, F.posexplode(vector).alias("i", "x"), w.alias("w")).groupBy(by, "i").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"])
    return sums.groupBy(by).agg(v.alias("v")).select(by, normalise(F.col("v")).alias("hv"))


def bundle_words(df: DataFrame, by: str, words: str = "words", dim: int = 256) -> DataFrame:
    """`bundle` of the `seeded_hv` of every word in an array column, repeats counted. Each place is one sum over the
    exploded words, so a task's partial sums are all that is shuffled: a vector a row, whatever the length of its text."""
    place = lambda i: F.sum(F.when(F.pmod(F.xxhash64("word", F.lit(i)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias(f"s{i}")
    sums = df.select(by, F.explode(words).alias("word")).groupBy(by).agg(*[place(i) for i in range(dim)])
    return sums.select(by, F.array(*[F.col(f"s{i}") for i in range(dim)]).alias("v")).select(by, normalise(F.col("v")).alias("hv"))


def tag_score(df: DataFrame, query_tags: Column, query_day: Column, node_type: Column, content_similarity: Column) -> DataFrame:
    """.15 content, .50 tags, .10 time, .10 type, .15 lifecycle, times confidence."""
    tags = F.when(F.size(query_tags) > 0, F.size(F.array_intersect("tags", query_tags)) / F.size(query_tags)).otherwise(0.0)
    time = F.exp(-0.01 * F.abs(query_day - F.col("day")))
    state = F.when(F.col("lifecycle_state") == "stable", 1.0).when(F.col("lifecycle_state") == "tentative", 0.7).otherwise(0.1)
    total = 0.15 * content_similarity + 0.5 * tags + 0.1 * time + 0.1 * F.when(F.col("node_type") == node_type, 1.0).otherwise(0.0) + 0.15 * state
    return df.withColumn("score", total * F.col("confidence"))


def phrase_supersedence(notes: DataFrame) -> DataFrame:
    """notes: (id, user_id, day, content). A `from A to B` notice makes older notes of A old, unless they hold B."""
    found = r"(?i)\b(?:migrated|switched|moved|changed)\s+from\s+(.+?)\s+to\s+([\w .+-]+)"
    told = notes.select(F.col("id").alias("new_id"), "user_id", F.col("day").alias("new_day"), F.lower(F.regexp_extract("content", found, 1)).alias("was"), F.lower(F.trim(F.regexp_extract("content", found, 2))).alias("now")).where("was <> ''")
    texts = notes.select(F.col("user_id").alias("owner"), "id", F.lower("content").alias("text"))
    held = match.holding_own(texts, told.select(F.col("user_id").alias("owner"), F.col("was").alias("pattern")))
    named = held.select(F.col("owner").alias("user_id"), F.col("id").alias("old_id"), F.col("pattern").alias("was")).join(told, ["user_id", "was"])
    old = notes.select(F.col("id").alias("old_id"), "user_id", "day", F.lower("content").alias("text"))
    return named.join(old, ["user_id", "old_id"]).where("day < new_day AND NOT contains(text, now)").select("old_id", "new_id")


def narratives(notes: DataFrame) -> DataFrame:
    """notes: (topic, id, day, content) -> the current statement of each topic and its history in order."""
    last = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("day"), F.desc("id")))
    rows = notes.withColumn("n", last)
    return rows.groupBy("topic").agg(F.max(F.when(F.col("n") == 1, F.col("content"))).alias("current_state"), F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("day", "id", "content")))), lambda x: x["content"]).alias("history"))


# --- fixed values: signals, patterns and words that must be as published for equal narratives

MIGRATION_SIGNALS = ["migrated", "switched", "moved", "replaced", "no longer", "deprecated", "went back", "changed from", "migration"]
TRANSITION_TAGS = ["migration", "deprecated", "legacy", "removed"]
TOPIC_PREFIX = {"editor": "My primary", "preference": "My", "database": "Our", "api": "Our", "infrastructure": "Our", "testing": "Our", "team": "Our"}
FROM_TO = (
    r"(?i)(?:migrated?|migration|switched|moved|replaced|changed|completed\s+\w+\s+migration)\s+(?:\w+\s+)*?from\s+([\w\s]+?)\s+to\s+([\w\s]+?)"
    r"(?:\s+(?:for|using|on|with)\s+(.*?))?(?:\.|,|$)"
)
BACK_TO = r"(?i)(?:went\s+back\s+to|returned\s+to)\s+([\w\s]+?)(?:\s+from\s+([\w\s]+?))?(?:\.|,|$)"
DEPRECATED = r"(?i)([\w\s]+?)\s+is\s+(?:no\s+longer|deprecated)"
BENEFIT = r"(?i)for\s+(better\s+.*?|improved\s+.*?|faster\s+.*?)(?:\.|,|$)"


def changes(notes: DataFrame) -> DataFrame:
    """notes: (topic, id, day, content, tags) with what each says of a change: kind (migration, return, deprecation, or null for a
    plain fact), old and new subject, reason. Row by row; what a deprecation leaves in place is for `narrative_entries`."""
    c = F.col("content")
    part = lambda pattern, i: F.nullif(F.trim(F.regexp_extract(c, pattern, i)), F.lit(""))
    lower_tags = F.transform("tags", lambda t: F.lower(t))
    own = F.try_element_at(F.filter("tags", lambda t: (F.lower(t) != F.col("topic")) & ~F.lower(t).isin(TRANSITION_TAGS)), F.lit(1))
    moved = F.arrays_overlap(lower_tags, F.array(*map(F.lit, TRANSITION_TAGS)))
    for sign in MIGRATION_SIGNALS:
        moved = moved | F.lower(c).contains(sign)
    back, there, gone = part(BACK_TO, 1), part(FROM_TO, 2), part(DEPRECATED, 1)
    kind = F.when(back.isNotNull(), "return").when(there.isNotNull(), "migration").when(gone.isNotNull(), "deprecation").otherwise("migration")
    subject = F.coalesce(F.when(back.isNotNull(), back).otherwise(there), own)
    reason = F.coalesce(F.when(back.isNull() & there.isNotNull(), part(FROM_TO, 3)), F.rtrim(part(BENEFIT, 1), F.lit(".")))
    old = F.when(back.isNotNull(), part(BACK_TO, 2)).when(there.isNotNull(), part(FROM_TO, 1)).otherwise(gone)
    told = F.coalesce(moved, F.lit(False)) & F.col("topic").isNotNull() & subject.isNotNull()
    return notes.withColumns({"kind": F.when(told, kind), "old_subject": F.when(told, old), "new_subject": F.when(told, subject), "reason": F.when(told, reason), "own": own})


def settled(topic: Column, kind: Column, subject: Column, reason: Column) -> Column:
    """The sentence that a change leaves as settled."""
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOPIC_PREFIX.items() for x in kv]), topic), F.lit("Our"))
    clean = F.rtrim(F.trim(reason), F.lit(".,;: "))
    return F.concat(prefix, F.lit(" "), topic, F.lit(" is "), subject, F.when((kind != "return") & clean.isNotNull() & (clean != ""), F.concat(F.lit(" with "), clean)).otherwise(""), F.lit("."))


def narrative_entries(notes: DataFrame) -> DataFrame:
    """notes: (topic, id, day, content, tags) -> (topic, no, id, day, summary, subject, old_state, new_state): each topic's history.

    In order of day and id, a topic's first note opens it, every change after that settles a new state, and a deprecation of a
    topic that is there changes nothing, as the topic has its subject already. The first note comes from an aggregate; only
    changes, not all notes of a topic, are put in order.
    """
    rows = changes(notes.where("topic IS NOT NULL"))
    first = rows.groupBy("topic").agg(F.min(F.struct("day", "id", "content", "kind", "new_subject", "own")).alias("f")).select("topic", "f.*")
    opened = first.select("topic", F.lit(0).alias("step"), "id", "day", F.coalesce("new_subject", "own", F.lit("unknown")).alias("subject"), F.when(F.col("kind").isNotNull(), F.concat(F.lit("Initial state: "), "new_subject")).otherwise(F.col("content")).alias("new_state"))
    opened = opened.withColumn("summary", F.concat(F.lit("Initial: "), "subject"))
    later = rows.where("kind IS NOT NULL").join(first.select("topic", F.col("id").alias("first_id")), "topic").where("kind <> 'deprecation' OR id = first_id")
    summary = F.concat(F.initcap("kind"), F.lit(": "), F.coalesce("old_subject", F.lit("?")), F.lit(" → "), "new_subject")
    updates = later.select("topic", F.lit(1).alias("step"), "id", "day", F.col("new_subject").alias("subject"), settled(F.col("topic"), F.col("kind"), F.col("new_subject"), F.col("reason")).alias("new_state"), summary.alias("summary"))
    w = Window.partitionBy("topic").orderBy("day", "id", "step")
    every = opened.unionByName(updates).withColumns({"no": F.row_number().over(w), "old_state": F.lag("new_state").over(w)})
    return every.select("topic", "no", "id", "day", "summary", "subject", "old_state", "new_state")


def narrative_sections(entries: DataFrame) -> DataFrame:
    """(topic, current_state, current_subject, last_updated, entries) of each topic."""
    last = entries.groupBy("topic").agg(F.max(F.struct("no", "new_state", "subject", "day")).alias("x"))
    return last.select("topic", F.col("x.new_state").alias("current_state"), F.col("x.subject").alias("current_subject"), F.col("x.day").alias("last_updated"), F.col("x.no").cast("long").alias("entries"))
