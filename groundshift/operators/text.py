"""Natural-language metric questions: plans, validation, retrieval, number provenance, causal lint and answers."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metrics and the phrases that name them, in order of precedence.
ALIASES = (
    ("spearman_rho", ("spearman", "rank correlation")),
    ("morans_i", ("moran",)),
    ("hotspot_count", ("hotspot", "hot spot")),
    ("tree_to_built_ha", ("tree to built", "tree-to-built", "tree-to-built-up")),
    ("urban_expansion_ha", ("urban expansion", "urban gain", "built-up gain")),
    ("vegetation_loss_ha", ("vegetation loss", "veg loss")),
    ("ndvi_decline_ha", ("ndvi decline", "ndvi difference")),
    ("valid_pixel_t1_pct", ("valid-pixel coverage", "valid pixel coverage")),
)
METRICS = (*(m for m, _ in ALIASES), "valid_pixel_t2_pct")
TOOLS = ("retrieve_method", "read_result")
AOI = "Dehradun"
# Phrases that make a question unanswerable, and phrases that a narrative must not use.
REFUSED = r"\b(cause\w*|lead to|leads to|led to|result\w* in|forecast\w*|predict\w*|will flood|flood risk|responsible for)\b"
CAUSAL = ("cause", "caused", "causes", "causing", "led to", "lead to", "leads to", "resulted in", "results in", "will flood", "flood risk", "responsible for", "drove", "drives", "triggered", "triggers", "due to", "because of")
REFUSED_REASON = "Causal claims and flood forecasts are outside the supported fixture workflow."
UNKNOWN_REASON = "No supported metric was identified."
# What counts as a number in a narrative, and the units that may follow one.
NUMBER = r"(?<![A-Za-z_])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"
UNIT_AFTER = r"(?i)^\s*(%|percent\b|ha\b|hectares?\b|km²|km2\b|km\^2\b)"
# The messages of plan validation, in the order of the checks.
PLAN_MESSAGES = (
    "ready plans must use query_result intent",
    "ready plan metric_id is not allowlisted",
    "epoch must be null, t1, or t2",
    "AOI is not allowlisted",
    "ready plan must request exactly the allowlisted retrieval/result tools",
    "ready plan must not contain a refusal reason",
    "refused plan needs a reason",
    "refused plan must not request tools or metrics",
    "status must be ready or refuse",
)
PLAN_FIELDS = ("status", "intent", "metric_id", "epoch", "aoi", "tools")
#: Words that retrieval ignores; any list can be given instead.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "its", "not", "of", "on", "or", "than", "that", "the", "their", "then", "there", "these", "this", "to", "was", "were", "what", "when", "which", "will", "with")


def plan_column(query: Column) -> Column:
    """The seven-field plan of a question, from ordered aliases; nothing but built-in string functions."""
    text = F.lower(query)
    named = F.coalesce(*[F.when(_any(text, phrases), F.lit(metric)) for metric, phrases in ALIASES])
    epoch = F.when(text.rlike(r"\b(t1|2018[- ]?19)\b"), "t1").when(text.rlike(r"\b(t2|2024[- ]?25)\b"), "t2")
    metric = F.when((named == "valid_pixel_t1_pct") & epoch.eqNullSafe(F.lit("t2")), "valid_pixel_t2_pct").otherwise(named)
    refused, none = text.rlike(REFUSED), F.lit(None).cast("string")
    tools = F.array(*[F.lit(t) for t in TOOLS])

    def plan(ready: bool, reason: str | None) -> Column:
        values = {"status": F.lit("ready" if ready else "refuse"), "intent": F.lit("query_result") if ready else none, "metric_id": metric if ready else none, "epoch": epoch if ready else none, "aoi": F.when(text.contains(AOI.lower()), AOI) if ready else none, "tools": tools if ready else F.array().cast("array<string>"), "refusal_reason": F.lit(reason).cast("string")}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    return F.when(refused, plan(False, REFUSED_REASON)).when(named.isNull(), plan(False, UNKNOWN_REASON)).otherwise(plan(True, None))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def plan_errors(plan: str) -> Column:
    """All errors of a plan struct, in order; empty for a valid one."""
    p = lambda f: F.col(f"{plan}.{f}")
    ready, refuse = F.coalesce(p("status") == "ready", F.lit(False)), F.coalesce(p("status") == "refuse", F.lit(False))
    asked = F.array_sort(F.array_distinct(F.coalesce(p("tools"), F.array().cast("array<string>"))))
    allowed = F.array(*[F.lit(t) for t in sorted(TOOLS)])
    found = [
        ready & ~p("intent").eqNullSafe(F.lit("query_result")),
        ready & ~F.coalesce(p("metric_id").isin(*METRICS), F.lit(False)),
        ready & ~F.coalesce(p("epoch").isin("t1", "t2"), F.lit(True)),
        ready & ~F.coalesce(p("aoi") == AOI, F.lit(True)),
        ready & (asked != allowed),
        ready & p("refusal_reason").isNotNull(),
        refuse & (F.coalesce(F.trim(p("refusal_reason")), F.lit("")) == ""),
        refuse & (~F.coalesce(F.size(p("tools")) == 0, F.lit(False)) | p("metric_id").isNotNull()),
        ~ready & ~refuse,
    ]
    return F.array_compact(F.array(*[F.when(wrong, message) for wrong, message in zip(found, PLAN_MESSAGES, strict=True)]))


def planner_prompt(query: Column) -> Column:
    """The prompt that a language model would get to make a plan; calling one is left to the user."""
    head = f"Return one JSON object with the keys {', '.join((*PLAN_FIELDS, 'refusal_reason'))}. status is ready or refuse. Allowed metrics: {', '.join(METRICS)}. Allowed tools: {', '.join(TOOLS)}. epoch is t1, t2 or null. Refuse causal claims and forecasts. Never state numbers. Question: "
    return F.concat(F.lit(head), query)


def missing_fields(plan_json: Column) -> Column:
    """Required keys that a JSON plan lacks, sorted; null if it is no object."""
    keys = F.json_object_keys(plan_json)
    return F.array_sort(F.array_except(F.array(*[F.lit(f) for f in (*PLAN_FIELDS, "refusal_reason")]), keys))


def number_key(text: Column) -> Column:
    """Canonical plain text of a number: no commas, percent sign, plus sign or superfluous zeros; null if it is none."""
    t = F.regexp_replace(F.regexp_replace(text, ",", ""), "%$", "")
    whole = F.regexp_replace(F.regexp_extract(t, r"^[-+]?(\d+)", 1), r"^0+(\d)", "$1")
    part = F.regexp_replace(F.regexp_extract(t, r"\.(\d+)$", 1), "0+$", "")
    plain = F.concat(F.when(t.startswith("-"), "-").otherwise(""), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.when(t.rlike(r"^[-+]?\d+(\.\d+)?$"), plain)


def unit_of_path(path: Column) -> Column:
    key = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(key.rlike("(_ha|_hectares)$"), "ha").when(key.rlike("(_km2|_km²)$"), "km2").when(key.rlike("(_pct|_percent)$"), "percent").when(key.rlike("_fraction$"), "fraction").when(key.rlike("(_year$|^year$)"), "year")


def display_unit(name: Column) -> Column:
    return F.when(name.endswith("_ha"), "ha").when(name.endswith("_pct"), "%").otherwise("")


def json_numbers(text: Column) -> Column:
    """array<struct<path, number>> of all numbers in a JSON tree, depth first; booleans and nulls don't count."""

    def walk(value, path: str, out: list) -> list:
        if isinstance(value, bool) or value is None:
            return out
        if isinstance(value, (int, Decimal)):
            out.append({"path": path, "number": format(Decimal(value).normalize(), "f")})
        elif isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}", out)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}[{i}]", out)
        return out

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else walk(json.loads(t, parse_float=Decimal), "$", []))

    return F.pandas_udf(run, "array<struct<path:string,number:string>>")(text)


def number_sources(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One row for each number of each JSON tree: id, path, number, unit, and its place in depth-first order."""
    out = df.select(id_col, F.posexplode(json_numbers(F.col(json_col))).alias("pos", "x"))
    return out.select(id_col, "pos", "x.path", "x.number", unit_of_path(F.col("x.path")).alias("unit"))


def lookup_metric(sources: DataFrame, id_col: str, metric: str) -> DataFrame:
    """The first number, depth first, whose key is the metric; values inside lists don't count."""
    hit = sources.filter(~F.col("path").contains("[") & (F.element_at(F.split("path", r"\."), -1) == metric))
    return hit.groupBy(id_col).agg(F.min_by("number", "pos").alias("value"))


def number_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Numbers of a text with the unit stated after them: id, pos, token, number, stated_unit."""
    # The text after each token is found by cutting the text at the tokens.
    pieces = F.split(text_col, NUMBER)
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(NUMBER), F.lit(0))
    pairs = F.zip_with(tokens, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda t, r: F.struct(t.alias("token"), F.coalesce(r, F.lit("")).alias("rest")))
    out = df.select(id_col, F.posexplode(F.filter(pairs, lambda p: p["token"].isNotNull())).alias("pos", "t"))
    raw = F.lower(F.regexp_extract("t.rest", UNIT_AFTER, 1))
    unit = F.when(raw.isin("%", "percent"), "percent").when(raw.startswith("ha") | raw.startswith("hectare"), "ha").when(raw != "", "km2").when(F.col("t.token").endswith("%"), "percent")
    return out.select(id_col, "pos", F.col("t.token").alias("token"), number_key(F.col("t.token")).alias("number"), unit.alias("stated_unit"))


def provenance(tokens: DataFrame, sources: DataFrame, id_col: str) -> DataFrame:
    """Verdict on each token: reason is null if the number is in the results under a unit that fits."""
    known = sources.groupBy(id_col, "number").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.collect_set("unit").alias("units"), F.count_if(F.col("unit").isNull()).alias("bare"))
    met = tokens.join(known, [id_col, "number"], "left")
    stated = F.col("stated_unit").isNotNull()
    reason = (
        F.when(F.col("paths").isNull(), "numeric_value_not_in_results")
        .when(stated & (F.col("bare") == 0) & ~F.array_contains("units", F.col("stated_unit")), "unit_mismatch")
        .when(stated & (F.col("bare") > 0), "unit_not_declared_in_results")
    )
    return met.select(id_col, "pos", "token", "number", "stated_unit", reason.alias("reason"))


def causal_terms(text: Column, terms: tuple[str, ...] = CAUSAL) -> Column:
    """Blacklisted phrases in a text as whole words, whatever their case, in the order of the list."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)(^|\W){t}(\W|$)"), F.lit(t)) for t in terms]))


def grams(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of two and more letters or digits without stop words, then pairs of what is left."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop_words))
    # A lambda variable, so that the text is cut into words once.
    both = F.transform(F.array(words), lambda w: F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y))))
    return F.filter(F.element_at(both, 1), lambda g: g.isNotNull())


def tfidf_topk(chunks: DataFrame, questions: DataFrame, top_k: int = 3, digits: int = 9) -> DataFrame:
    """The top_k chunks (chunk_id, text) of each question (query_id, text) by cosine of smooth tf-idf; zero scores go last of all.

    Term weights come from group-bys; only terms of a question are joined with the chunks that hold them, and scores
    are summed before the exchange. A chunk's norm covers all its terms.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    tf = chunks.select("chunk_id", F.explode(grams(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    n = chunks.agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weights = tf.join(idf, "term").select("chunk_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    qtf = questions.select("query_id", F.explode(grams(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    qw = qtf.join(idf, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("q"))
    qnorm = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    dots = weights.join(qw, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    scored = dots.join(norms, "chunk_id").join(qnorm, "query_id").select("query_id", "chunk_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), digits).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.filter("score > 0").withColumn("rank", place).filter(F.col("rank") <= top_k)


def answers(questions: DataFrame, chunks: DataFrame, results: dict[str, float | int]) -> DataFrame:
    """Plan, validate, retrieve, look up, narrate, check: one row for each question (query_id, text)."""
    table = F.create_map(*[F.lit(v) for k, x in results.items() for v in (k, str(x))]) if results else F.create_map().cast("map<string,string>")
    planned = questions.withColumn("plan", plan_column(F.col("text"))).withColumn("errors", plan_errors("plan"))
    cited = tfidf_topk(chunks, questions).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda c: c["chunk_id"]).alias("found"))
    out = planned.join(cited, "query_id", "left")
    ready = F.col("plan.status") == "ready"
    value = F.try_element_at(table, F.col("plan.metric_id"))
    citations = F.when(ready, F.coalesce("found", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({"value": F.when(ready, value), "citations": citations})
    evidence = F.when(F.size("citations") > 0, F.concat(F.lit(" Evidence: "), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), ", "), F.lit("."))).otherwise("")
    narrative = (
        F.when(~ready, F.concat(F.lit("Request declined: "), "plan.refusal_reason"))
        .when(F.col("value").isNull(), F.concat(F.lit("No recorded result is available for "), "plan.metric_id", F.lit("."), evidence))
        .otherwise(F.concat(F.lit("Recorded "), "plan.metric_id", F.lit(": "), "value", F.lit("."), evidence))
    )
    status = F.when(F.size("errors") > 0, "invalid_plan").when(~ready, "refused").when(F.col("value").isNull(), "result_missing").otherwise("answered")
    return out.select("query_id", status.alias("status"), F.col("plan.metric_id").alias("metric_id"), F.col("plan.epoch").alias("epoch"), narrative.alias("narrative"), "citations", (F.size("errors") == 0).alias("plan_valid"), (F.size(causal_terms(narrative)) == 0).alias("lint_passed"))


def answer_provenance(answered: DataFrame, results: dict[str, float | int]) -> DataFrame:
    """query_id and whether all numbers of the narrative are in the results with fitting units."""
    tree = json.dumps(results)
    sources = number_sources(answered.select("query_id", F.lit(tree).alias("tree")), "query_id", "tree")
    verdicts = provenance(number_tokens(answered, "query_id", "narrative"), sources, "query_id")
    bad = verdicts.groupBy("query_id").agg(F.count_if(F.col("reason").isNotNull()).alias("bad"))
    return answered.select("query_id").join(bad, "query_id", "left").select("query_id", (F.coalesce("bad", F.lit(0)) == 0).alias("passed"))


def gold_match(plans: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of plans (id, plan) that agree with the gold plan in each field, in all fields, and that are valid."""
    both = plans.join(gold.select("id", F.col("plan").alias("gold")), "id").withColumn("errors", plan_errors("plan"))
    same = {f: F.col(f"plan.{f}").eqNullSafe(F.col(f"gold.{f}")) for f in PLAN_FIELDS}
    every = F.lit(True)
    for s in same.values():
        every = every & s
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    return both.agg(F.count("*").alias("n"), *[rate(s).alias(f"{f}_rate") for f, s in same.items()], rate(every).alias("all_fields_rate"), rate(F.size("errors") == 0).alias("valid_rate"))


def same_ids(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether two tables have the same keys."""
    return not left.join(right, key, "left_anti").limit(1).count() and not right.join(left, key, "left_anti").limit(1).count()
