"""Budgeted packing of ranked results, and text for a prompt."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X

LEVELS = ["full", "prose", "structured", "key_value", "reference"]
#: Results that a text shows.
MOST = 50


def tier() -> Column:
    """Order of packing: instructions, pinned rows and active tasks, several paths, the rest."""
    task = (F.col("node_type") == "task") & F.col("lifecycle_state").isin(S.ACTIVE)
    return F.when(F.col("node_type") == "instruction", 0).when((F.col("salience") == 1.0) | task, 1).when(F.col("path_count") >= 2, 2).otherwise(3)


def with_costs(df: DataFrame, per: float = 4.2) -> DataFrame:
    """Adds section, tier, score per token and the cost of every level of detail."""
    costs = {f"cost_{lv}": X.token_estimate(X.render(lv), per) for lv in LEVELS}
    out = df.withColumns(costs | {"section": X.section(F.col("node_type"), F.col("lifecycle_state")), "tier": tier()})
    return out.withColumn("str", F.col("composite_score") / F.greatest(F.col("cost_full"), F.lit(1)))


def packing_order() -> list[Column]:
    """Tiers; within one by rank, by score per token (ties by rank), or by score."""
    by = F.when(F.col("tier") == 1, -F.col("rank").cast("double")).when(F.col("tier") == 2, F.col("str")).otherwise(F.col("composite_score"))
    return [F.col("tier"), F.desc(by), F.when(F.col("tier") == 2, F.col("rank")), F.col("id")]


def greedy_pack(df: DataFrame, config: S.Packing = S.Packing(), min_level: str = "reference") -> DataFrame:
    """Each candidate in packing order takes the most faithful level that the budget left allows.

    The choice depends on all earlier ones, so a query is folded in one task; rows carry costs, not texts, and
    a query's candidates are bounded by the caps of retrieval.
    """
    levels = LEVELS[: LEVELS.index(min_level) + 1]
    rows = with_costs(df, config.chars_per_token).withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy(*packing_order())))
    slim = rows.select("query_id", "id", "no", "section", *[F.col(f"cost_{lv}").cast("long") for lv in levels])
    budget = config.budget - config.overhead

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in pdf.sort_values("no").itertuples():
            for lv in levels:
                cost = getattr(r, f"cost_{lv}")
                if cost <= left:
                    out.append((r.query_id, r.id, r.no, r.section, lv, cost))
                    left -= cost
                    break
        return pd.DataFrame(out, columns=["query_id", "id", "no", "section", "level", "tokens"])

    return slim.groupBy("query_id").applyInPandas(fold, "query_id string, id string, no long, section string, level string, tokens long")


def prefix_pack(df: DataFrame, budget: int) -> DataFrame:
    """The full-text form: rows of a query in packing order while their running cost fits."""
    w = Window.partitionBy("query_id").orderBy(*packing_order())
    rows = with_costs(df).withColumns({"no": F.row_number().over(w), "used": F.sum("cost_full").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where(F.col("used") <= budget)


def bundle(packed: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row per query and section: texts in packing order, and tokens. Bounded by the budget of packing."""
    text = F.coalesce(*[F.when(F.col("level") == lv, X.render(lv)) for lv in LEVELS])
    rows = packed.join(candidates.select("query_id", "id", "content", "node_type", "confidence"), ["query_id", "id"]).withColumn("text", text)
    return rows.groupBy("query_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]).alias("texts"), F.sum("tokens").alias("tokens"))


def system_instructions(bundles: DataFrame) -> DataFrame:
    """The instructions of every query's bundle as a block of text."""
    rows = bundles.where("section = 'system_instructions'")
    bullets = F.array_join(F.transform("texts", lambda t: F.concat(F.lit("- "), t)), "\n")
    return rows.select("query_id", F.concat(F.lit("## System Instructions\n"), bullets, F.lit("\n")).alias("text"))


# --- dates a question speaks of; words and weekdays are fixed values

NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "a": 1, "an": 1}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
UNIT_DAYS = {"weeks": 7, "months": 30, "days": 1, "years": 365}


def time_offsets(query: Column, question: Column) -> Column:
    """A `COMPUTED:` line for the first `N units ago` of each unit, for `last <weekday>` and for the weekend; empty without any."""
    today = question.cast("date")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    lines = []
    for unit, size in UNIT_DAYS.items():
        word = F.lower(F.regexp_extract(query, rf"(?i)(\d+|{'|'.join(NUMBERS)})\s+{unit[:-1]}s?\s+ago", 1))
        n = F.coalesce(X.lookup(NUMBERS, word, None), word.try_cast("int"))
        back = n * size
        lines.append(F.concat(F.lit("COMPUTED: '"), n.cast("string"), F.lit(f" {unit} ago' from "), day(today), F.lit(" = approximately "), day(F.date_sub(today, back)), F.lit(" ("), back.cast("string"), F.lit(" days before)")))
    name = F.lower(F.regexp_extract(query, rf"(?i)last\s+({'|'.join(WEEKDAYS)})", 1))
    wanted = F.array_position(F.array(*map(F.lit, WEEKDAYS)), name) - 1
    gone = F.pmod(F.weekday(today) - wanted, F.lit(7)).cast("int")
    back = F.when(name != "", F.when(gone == 0, 7).otherwise(gone))
    lines.append(F.concat(F.lit("COMPUTED: 'last "), F.initcap(name), F.lit("' from "), day(today), F.lit(" = "), day(F.date_sub(today, back)), F.lit(" ("), back.cast("string"), F.lit(" days before)")))
    gone = F.pmod(F.weekday(today) + 2, F.lit(7)).cast("int")
    back = F.when(query.rlike(r"(?i)past\s+weekend|the\s+weekend"), F.when(gone == 0, 7).otherwise(gone))
    lines.append(F.concat(F.lit("COMPUTED: 'past weekend' = Saturday "), day(F.date_sub(today, back)), F.lit(" ("), back.cast("string"), F.lit(" days before "), day(today), F.lit(")")))
    return F.concat_ws("\n", *lines)


# --- texts; headings and hints are fixed values

KNOWLEDGE_UPDATE_HEAD = (
    "IMPORTANT: Entries are in chronological order (oldest first, newest last).\n"
    "When the same attribute appears multiple times with different values, the MOST RECENT entry supersedes all earlier ones. "
    "ALWAYS use the latest value — earlier values are outdated.\n\n"
)
AGGREGATION_RULES = (
    "IMPORTANT COUNTING RULES:\n"
    "- Count ONLY items that EXACTLY match the question's criteria.\n"
    "- Two mentions of the same item = 1 count (not 2).\n"
    "- If an entry is about a related but different topic, do NOT count it.\n"
    "- List each qualifying item before giving the final count.\n"
)
GUIDANCE_HEAD = (
    "## Reasoning Guidance\n"
    '- Connect information across entries: if entry A says "grandma in Sweden" and entry B says "moved from home country", conclude "moved from Sweden".\n'
    '- Combine evidence: mentions of "son", "daughter", "youngest child" across entries may indicate 3 children total.\n'
)
GUIDANCE = {
    "knowledge_update": "- When values change over time, ONLY the most recent is correct.\n",
    "aggregation": "- Count only items that EXACTLY match the question's criteria.\n",
}
PROFILE_SECTIONS = [("preference", "Preferences"), ("fact", "Known Facts"), ("instruction", "Learned Rules")]
CONFLICT_HEAD = "## Conflicting Information\nThe following items have unresolved contradictions. Prefer the more recent or higher-confidence version.\n"

_TIME = "coalesce(event_time, created_at)"


def _shown(rows: DataFrame, most: int) -> DataFrame:
    return rows.where(F.col("rank") <= most).withColumn("t", F.expr(_TIME))


def _day(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    """rows: query_id, i (place), n -> query_id, n, body. At most `most` rows a query."""
    listed = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))
    return rows.groupBy("query_id").agg(F.max("n").alias("n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("body"))


def _numbered(rows: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("query_id")
    return rows.withColumns({"i": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})


def _entry(mark: Column) -> Column:
    return F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] ("), _day(F.col("t")), mark, F.lit(") "), F.col("content"))


def _ago(question) -> Column:
    return F.concat(F.lit(", "), X.days_ago(F.col("t"), X.at(question))) if question is not None else F.lit("")


def _dated_head(queries: DataFrame, question) -> DataFrame:
    """query_id, head: the question's day and the dates it speaks of."""
    if question is None:
        return queries.select("query_id", F.lit("").alias("head"))
    offsets = time_offsets(F.col("query"), X.at(question))
    today = F.concat(F.lit("Today's date: "), _day(X.at(question)), F.lit("\n"))
    return queries.select("query_id", F.concat(today, F.when(offsets != "", F.concat(offsets, F.lit("\n"))).otherwise("")).alias("head"))


def format_temporal(rows: DataFrame, queries: DataFrame, question=None, most: int = MOST) -> DataFrame:
    """A query's results by time, each with how long ago it was."""
    body = _lines(_numbered(_shown(rows, most), "t", "rank"), _entry(_ago(question)))
    gap = F.lit("\n" if question is not None else "")
    return body.join(_dated_head(queries, question), "query_id").select("query_id", F.concat("head", gap, "body").alias("text"))


def format_updates(rows: DataFrame, most: int = MOST) -> DataFrame:
    """By time; the last is the value to use, the two before it are recent, those more than five from the end older."""
    i = F.col("i") - 1
    mark = F.when(i == F.col("n") - 1, " [MOST RECENT — USE THIS VALUE]").when(i >= F.col("n") - 3, " [RECENT]").when(i < F.col("n") - 5, " [OLDER]").otherwise("")
    body = _lines(_numbered(_shown(rows, most), "t", "rank"), _entry(mark))
    return body.select("query_id", F.concat(F.lit(KNOWLEDGE_UPDATE_HEAD), "body").alias("text"))


def aggregation_lines(rows: DataFrame) -> DataFrame:
    """Distinct by the first 100 characters of the lower-cased, trimmed text; the earliest is kept."""
    key = F.substring(F.lower(F.trim("content")), 1, 100)
    first = F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.expr(_TIME), "id"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def format_aggregation(rows: DataFrame, queries: DataFrame, question=None, most: int = MOST) -> DataFrame:
    """Distinct results by time, and how to count them."""
    body = _lines(_numbered(aggregation_lines(_shown(rows, most)), "t", "rank"), _entry(_ago(question)))
    intro = F.concat(F.lit("AGGREGATION TASK: The question asks for a count, total, or list.\nBelow are "), F.col("n").cast("string"), F.lit(" unique entries (duplicates removed) in chronological order.\n" + AGGREGATION_RULES))
    return body.join(_dated_head(queries, question), "query_id").select("query_id", F.concat(intro, "head", F.lit("\n"), "body").alias("text"))


def format_default(rows: DataFrame, question=None, most: int = MOST) -> DataFrame:
    """A query's results by rank, with their days."""
    body = _lines(_numbered(_shown(rows, most), "rank"), _entry(F.lit("")))
    head = F.concat(F.lit("Today's date: "), _day(X.at(question)), F.lit("\n\n")) if question is not None else F.lit("")
    return body.select("query_id", F.concat(head, "body").alias("text"))


def profile(rows: DataFrame, most: int = MOST) -> DataFrame:
    """query_id, text: active preferences, facts and instructions among the results, surest first; tentative ones are marked."""
    kept = _shown(rows, most).where(F.col("node_type").isin([k for k, _ in PROFILE_SECTIONS]) & F.col("lifecycle_state").isin(S.ACTIVE))
    line = F.concat(F.lit("- "), "content", F.when(F.col("lifecycle_state") == "tentative", " (tentative)").otherwise(""))
    parts = []
    for kind, title in PROFILE_SECTIONS:
        own = F.array_sort(F.collect_list(F.when(F.col("node_type") == kind, F.struct((-F.col("confidence")).alias("c"), "rank", line.alias("line")))))
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"### {title}\n"), F.array_join(F.transform(own, lambda x: x["line"]), "\n"))))
    return kept.groupBy("query_id").agg(F.concat(F.lit("## User Profile\n"), F.concat_ws("\n", *parts), F.lit("\n")).alias("text"))


def conflicts(rows: DataFrame, most: int = MOST) -> DataFrame:
    """query_id, text: each contested pair once, the newer text first; a lone side says so."""
    shown = _shown(rows, most)
    a = shown.where("conflict_flag AND counterpart_id IS NOT NULL").select("query_id", "id", "counterpart_id", "content", "t", "rank")
    b = shown.select("query_id", F.col("id").alias("counterpart_id"), F.col("content").alias("other"), F.col("t").alias("other_t"), F.col("rank").alias("other_rank"), F.when(F.col("conflict_flag"), F.col("counterpart_id")).alias("back"))
    pairs = a.join(b, ["query_id", "counterpart_id"], "left").where("other IS NULL OR NOT (back <=> id) OR rank < other_rank")
    newer = F.col("t") >= F.col("other_t")
    both = F.concat(F.lit('- NEWER: "'), F.when(newer, F.col("content")).otherwise(F.col("other")), F.lit('" vs OLDER: "'), F.when(newer, F.col("other")).otherwise(F.col("content")), F.lit('"'))
    line = F.when(F.col("other").isNull(), F.concat(F.lit('- CONTESTED: "'), "content", F.lit('" (contradicting memory not in results)'))).otherwise(both)
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return pairs.groupBy("query_id").agg(F.concat(F.lit(CONFLICT_HEAD), F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def format_for_llm(rows: DataFrame, queries: DataFrame, question=None, hint: str | None = None, most: int = MOST, include_profile: bool = True) -> DataFrame:
    """queries: (query_id, query) -> query_id, kind, text. The body follows the kind of question (or `hint`); profile,
    conflicts and, beyond three results, hints for reasoning stand above it."""
    kind = queries.select("query_id", "query", F.lit(hint).alias("kind") if hint else X.context_type(F.col("query")).alias("kind"))
    shown = rows.where(F.col("rank") <= most).join(kind.select("query_id", "kind"), "query_id")
    of = lambda k: shown.where(F.col("kind") == k)
    body = format_temporal(of("temporal"), queries, question, most).unionByName(format_updates(of("knowledge_update"), most))
    body = body.unionByName(format_aggregation(of("aggregation"), queries, question, most)).unionByName(format_default(of("default"), question, most))
    out = kind.join(body, "query_id", "left")
    if not include_profile:
        return out.select("query_id", "kind", F.coalesce("text", F.lit("")).alias("text"))
    flagged = shown if "conflict_flag" in rows.columns else shown.withColumns({"conflict_flag": F.lit(False), "counterpart_id": F.lit(None).cast("string")})
    extra = profile(shown, most).withColumnRenamed("text", "profile").join(conflicts(flagged, most).withColumnRenamed("text", "conflicts"), "query_id", "full")
    n = shown.groupBy("query_id").agg(F.count("*").alias("n"))
    out = out.join(extra, "query_id", "left").join(n, "query_id", "left")
    guidance = F.when(F.col("n") > 3, F.concat(F.lit(GUIDANCE_HEAD), X.lookup(GUIDANCE, F.col("kind"), "")))
    above = F.array_compact(F.array("profile", "conflicts", guidance))
    whole = F.when(F.size(above) > 0, F.concat(F.array_join(above, "\n"), F.lit("\n## Retrieved Memory\n"), "text")).otherwise(F.col("text"))
    return out.select("query_id", "kind", F.coalesce(whole, F.lit("")).alias("text"))
