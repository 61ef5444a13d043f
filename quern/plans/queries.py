"""Registered queries of the operators for graded completions, pairs, tokens and reports.  Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import answers, kernels, rates, scoring
from quern.operators import bootstrap, chains, grouping, joins, masks, metrics, quantiles, sampling, seams, token_rows, validation
from quern.plans import views as v
from quern.sources import cache, readers, shared
from quern.streaming import commits, ledger, stateful

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


# -- chains of steps ---------------------------------------------------------------------


@query
def chain_alignment(spark, sf_dir):
    out = chains.align(v.chain_pairs(spark, sf_dir), keep=["chain_id"])
    return out.select("chain_id", *[F.col(c).cast("long").alias(c) for c in ("n_gold", "n_response", "matched", "reworded", "missing", "extra")])


@query
def chain_step_report(spark, sf_dir):
    out = chains.align(v.chain_pairs(spark, sf_dir), keep=["chain_id"]).withColumn("reversed", F.col("chain_id") % 4 == 0)
    return rounded(chains.chain_report(out, ["reversed"]), "step_recall", "step_precision")


# -- answers and scores ------------------------------------------------------------------


@query
def grade_accuracy_by_source(spark, sf_dir):
    graded = readers.grade(v.completions(spark, sf_dir))
    return rounded(metrics.accuracy(graded, ["checkpoint", "source"]), "accuracy", "parse_success_rate")


@query
def grade_accuracy_rollup(spark, sf_dir):
    graded = readers.grade(v.completions(spark, sf_dir))
    return rounded(metrics.accuracy_rollup(graded, ["checkpoint", "source"]), "accuracy", "parse_success_rate")


@query
def finchain_grade_reasons(spark, sf_dir):
    df = v.completions(spark, sf_dir)
    g = df.withColumn("grade", scoring.graded(answers.marked(F.col("completion")), F.col("gold_answer")))
    return g.groupBy("source", F.col("grade.reason").alias("reason")).agg(F.count("*").alias("n"))


@query
def grade_summary(spark, sf_dir):
    df = v.completions(spark, sf_dir).withColumn("grade", scoring.graded(answers.marked(F.col("completion")), F.col("gold_answer")))
    return rounded(metrics.grade_summary(df), "parse_success_rate", "final_answer_accuracy")


@query
def answer_normalise(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    text = v.money(F.col("value"))
    big = F.format_number(F.col("value") * 100, 2)
    forms = F.array(F.concat(F.lit(" $"), text, F.lit(". ")), F.concat(text, F.lit("%")), F.concat(F.lit("−"), big, F.lit(",;")), F.concat(F.lit("$$"), big, F.lit("%%")))
    df = e.select("event_id", F.posexplode(forms).alias("form", "raw"))
    return df.select("event_id", F.col("form").cast("long").alias("form"), answers.normal(F.col("raw")).alias("answer"))


@query
def hash_answers(spark, sf_dir):
    df = v.completions(spark, sf_dir)
    return df.select("example_id", answers.hash_gold(F.col("completion")).alias("gold"), answers.hash_generated(F.col("completion")).alias("generated"), answers.hash_or_number(F.col("completion")).alias("loose"))


@query
def math_boxed_extract(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    u = F.col("user_id").cast("string")
    text = (
        F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("is \\boxed{\\frac{"), n, F.lit("}{"), u, F.lit("}} ok")))
        .when(F.pmod("event_id", F.lit(5)) == 1, F.concat(F.lit("our $\\boxed "), n, F.lit("$.")))
        .when(F.pmod("event_id", F.lit(5)) == 2, F.concat(F.lit("\\boxed{1} then \\fbox{x} then \\boxed{"), n))
        .when(F.pmod("event_id", F.lit(5)) == 3, F.concat(F.lit("\\fbox{"), u, F.lit("} and }")))
        .otherwise(F.concat(F.lit("\\boxed{ $"), n, F.lit("$ }")))
    )
    return e.select("event_id", answers.boxed_gold(text).alias("gold"), answers.boxed_generated(text).alias("generated"))


@query
def math_score_ladder(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    k = F.pmod("event_id", F.lit(6))
    predicted = (
        F.when(k == 0, F.concat(F.lit("\\dfrac{"), n, F.lit("}{"), u, F.lit("}")))
        .when(k == 1, F.concat(F.lit("\\left("), n, F.lit(", 2\\right)")))
        .when(k == 2, F.concat(n, F.lit("\\text{ m}")))
        .when(k == 3, F.concat(F.lit("x="), n))
        .when(k == 4, F.concat(n, F.lit(".00")))
        .otherwise(F.concat(n, F.lit("\\text{ m}\\text{ s}")))
    )
    gold = F.when(k == 0, F.concat(F.lit("\\frac{"), n, F.lit("}{"), u, F.lit("}"))).when(k == 1, F.concat(F.lit("("), n, F.lit(",2)"))).when((k == 4) & (F.pmod("user_id", F.lit(2)) == 0), F.concat(n, F.lit("1"))).otherwise(n)
    df = e.select(k.alias("form"), scoring.score_boxed(predicted, gold).alias("correct"), scoring.normalise_failed(predicted, gold).alias("failed"))
    return df.groupBy("form").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if("failed").alias("n_failed"))


@query
def latex_normal_forms(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    n = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("\\tfrac1"), F.lit("2 + \\sqrt3 "), n), F.concat(n, F.lit("/7")), F.concat(F.lit(".5 \\%"), n), F.concat(F.lit("y = "), n, F.lit("^\\circ")), F.concat(F.lit("\\sqrt"), F.lit("")), F.concat(F.lit("0"), F.lit(".5")))
    df = p.select("p_partkey", F.posexplode(forms).alias("form", "raw"))
    return df.select("p_partkey", F.col("form").cast("long").alias("form"), scoring.latex_normal(F.col("raw")).alias("answer"), scoring.latex_fault(F.col("raw")).alias("fault"))


@query
def decimal_scores(spark, sf_dir):
    """Equal decimals of ordinary length in the JVM, the rest exactly."""
    e = v.table(spark, sf_dir, "events")
    a = v.money(F.col("value"))
    k = F.pmod("event_id", F.lit(4))
    b = F.when(k == 0, F.concat(a, F.lit("000"))).when(k == 1, F.concat(F.lit("0"), a)).when(k == 2, F.concat(a, F.lit("e0"))).otherwise(F.lit("nan"))
    df = scoring.scored(e.select("event_id", a.alias("a"), b.alias("b"), k.alias("form")), "hash", "a", "b")
    return df.groupBy("form").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


@query
def difficulty_category(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") < 10, F.concat(F.lit("Level "), F.pmod("p_size", F.lit(8)).cast("string"))).when(F.col("p_size") < 20, F.lit("Medium")).when(F.col("p_size") < 30, F.lit(" HARD ")).when(F.col("p_size") < 40, F.lit("unknown")).otherwise(F.pmod("p_size", F.lit(7)).cast("string"))
    category = answers.category_slug(F.concat(F.col("p_type"), F.lit(" & "), F.col("p_name")))
    return p.select(answers.difficulty(raw).alias("difficulty"), category.alias("category")).groupBy("difficulty", "category").agg(F.count("*").alias("n"))


@query
def difficulty_levels(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("Level "), F.when(F.pmod("p_partkey", F.lit(9)) == 0, F.lit("?")).otherwise(F.pmod("p_size", F.lit(8)).cast("string")))
    return p.select(answers.level(raw).alias("difficulty"), answers.level_fault(raw).alias("fault")).groupBy("difficulty", "fault").agg(F.count("*").alias("n"))


# -- validation, sources ---------------------------------------------------------------------


def _flawed(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    k = F.pmod("doc_id", F.lit(11))
    df = d.select(
        F.col("doc_id").cast("string").alias("id"), F.when(k == 1, "other").otherwise("math").alias("source"), F.when(k == 2, "").otherwise(F.col("text")).alias("prompt"),
        F.when((k == 3) | (k == 1), F.lit(None)).otherwise(F.col("text")).alias("response"), F.lit("1").alias("final_answer"), F.when(k == 4, 9).when(k == 5, F.lit(None)).otherwise(3).alias("difficulty"),
    )
    return validation.validate(df)


@query
def reject_reasons(spark, sf_dir):
    return rounded(validation.reject_counts(_flawed(spark, sf_dir)), "pct")


@query
def accepted_examples(spark, sf_dir):
    """Written and counted in one pass; what was written is counted again to compare."""
    path = shared.folder(spark, "accepted")
    reasons = [name for name, _ in validation.example_faults()]
    counts = validation.write_accepted(_flawed(spark, sf_dir), path, reasons, "examples")
    told = spark.createDataFrame(list(counts.items()), "state string, n long").where("n > 0")
    return told.unionByName(spark.read.parquet(path).agg(F.lit("written").alias("state"), F.count("*").alias("n")))


@query
def math_skip_reasons(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    k = F.pmod("event_id", F.lit(9))
    raw = e.select(
        F.col("event_id").alias("ordinal"), F.when(k == 3, "").otherwise("q").alias("problem"), F.when(k == 0, "none").when(k == 1, "\\boxed{}").otherwise("\\boxed{4}").alias("solution"),
        F.when((k == 2) | (k == 0), "Level 9").when(k == 5, "Level ?").otherwise("Level 2").alias("level"), F.lit("Number Theory").alias("type"),
    )
    return rounded(validation.reject_counts(readers.boxed_examples(raw, "train")), "pct")


@query
def source_examples(spark, sf_dir):
    """Rows of a table with any accepted field names, as examples."""
    e = v.completions(spark, sf_dir)
    raw = e.select(
        F.col("example_id").alias("line"), F.when(F.col("source") == "math", "").otherwise(F.concat(F.lit("q"), F.col("example_id").cast("string"))).alias("problem"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("prompt"),
        F.col("completion").alias("trace"), F.when(F.col("source") == "gsm8k", F.concat(F.lit(" $"), F.col("gold_answer"), F.lit(". "))).alias("gold_answer"), F.lit("medium").alias("level"), F.col("checkpoint").alias("topic"), F.lit("").alias("domain"),
    )
    df = readers.chain_examples(raw, "train")
    return df.select("id", "prompt", "final_answer", "difficulty", "category", "domain", "reject_reason")


@query
def selected_sources(spark, sf_dir):
    r = v.completions(spark, sf_dir)
    frames = {s: (lambda s=s: r.where(F.col("source") == s).select("example_id", "source")) for s in ("gsm8k", "math", "finchain")}
    both = readers.load_selected(["math", "gsm8k"], frames)
    return both.groupBy("source_place", "source").agg(F.count("*").alias("n"), F.max("example_id").alias("last_id"))


@query
def source_budgets(spark, sf_dir):
    r = v.rollouts(spark, sf_dir)
    b = grouping.budget(F.col("source"), 256, {"math": 768})
    return r.select("source", b.cast("long").alias("budget")).groupBy("source", "budget").agg(F.count("*").alias("n"))


@query
def listed_counts(spark, sf_dir):
    return metrics.counts_for(v.rollouts(spark, sf_dir), ["gsm8k", "math", "finchain", "other"])


# -- samples and splits --------------------------------------------------------------------------


@query
def sample_exact_n(spark, sf_dir):
    return sampling.sample_exact(v.sizes(spark, sf_dir), 50, "doc_id").select("doc_id", "lang", "n_tokens")


@query
def first_documents(spark, sf_dir):
    return sampling.head(v.sizes(spark, sf_dir), 10, "doc_id").select("doc_id", "lang", "n_tokens")


@query
def document_at_place(spark, sf_dir):
    """Random access by position, in order of length."""
    rows = readers.with_ordinal(v.sizes(spark, sf_dir).select("doc_id", "n_tokens"), "n_tokens", "doc_id")
    return sampling.at(rows, 100, "ordinal").select("doc_id", "n_tokens", "ordinal")


@query
def balanced_prompts(spark, sf_dir):
    return sampling.balanced_sample(v.sizes(spark, sf_dir), 50, ["en", "de", "fr", "es"], "doc_id", source="lang").select("doc_id", "lang")


@query
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(v.sizes(spark, sf_dir), 5, "doc_id").select("doc_id", "source", "is_val")


@query
def strided_shards(spark, sf_dir):
    df = v.sizes(spark, sf_dir)
    parts = [sampling.shard(df, k, 4, "doc_id").agg(F.lit(k).cast("long").alias("rank"), F.count("*").alias("n"), F.sum("n_tokens").cast("long").alias("tokens")) for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def document_batches(spark, sf_dir):
    df = v.sizes(spark, sf_dir).withColumn("batch", sampling.batch_number("doc_id", 8))
    return metrics.token_counts(df, "batch", "n_tokens")


@query
def retention_top_n(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    name = F.when(F.pmod("o_orderkey", F.lit(10)) == 0, F.concat(F.lit("note-"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("step-"), F.col("o_orderkey").cast("string")))
    return sampling.retained(o.select(name.alias("path"), "o_totalprice"), 3, best="step-7").select("path", "o_totalprice")


@query
def latest_checkpoint(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    return sampling.latest(o.select(F.concat(F.lit("step-"), F.col("o_orderkey").cast("string")).alias("path")))


@query
def epoch_positions(spark, sf_dir):
    """Two epochs over the documents: each document's place in the order of each epoch."""
    df = sampling.epoch_places(v.sizes(spark, sf_dir).select("doc_id"), 2, "doc_id")
    return df.select("doc_id", F.col("epoch").cast("long").alias("epoch"), "place")


# -- groups and pairs -----------------------------------------------------------------------------


@query
def completion_group_census(spark, sf_dir):
    return grouping.group_census(v.rollouts(spark, sf_dir))


@query
def completion_totals(spark, sf_dir):
    return grouping.completion_totals(v.rollouts(spark, sf_dir))


@query
def pair_yield_gate(spark, sf_dir):
    return rounded(grouping.yield_gate(v.rollouts(spark, sf_dir), 0.3), "pair_yield")


@query
def preference_pairs_all(spark, sf_dir):
    return grouping.all_pairs(v.rollouts(spark, sf_dir))


@query
def preference_pairs_capped(spark, sf_dir):
    return grouping.all_pairs(v.rollouts(spark, sf_dir), cap=2)


@query
def preference_pair_texts(spark, sf_dir):
    r = v.rollouts(spark, sf_dir).withColumn("completion", F.concat(F.lit("#### "), v.money(F.col("value"))))
    return grouping.with_texts(grouping.all_pairs(r, cap=2), r).select("prompt_id", "chosen_index", "rejected_index", "chosen", "rejected")


@query
def preference_pairs_ordered(spark, sf_dir):
    return grouping.in_order(grouping.all_pairs(v.rollouts(spark, sf_dir)))


@query
def user_pairs_drawn(spark, sf_dir):
    """A user's events as one prompt: far more pairs than are drawn."""
    df = v.rollouts(spark, sf_dir).select("user_id", "event_id", "correct")
    return grouping.drawn_pairs(df, 50, "user_id", "event_id").select("user_id", "chosen_index", "rejected_index")


@query
def one_to_one_pairs(spark, sf_dir):
    return grouping.one_to_one_pairs(v.rollouts(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query
def opd_best_worst(spark, sf_dir):
    return rounded(grouping.best_worst(v.rollouts(spark, sf_dir)), "success_rate")


@query
def opd_value_margin(spark, sf_dir):
    r = v.rollouts(spark, sf_dir).withColumn("reward", F.col("value"))
    return grouping.best_worst(r, min_margin=50.0).select("prompt_id", "chosen_order", "rejected_order", r6("margin").alias("margin"))


@query
def dpo_examples(spark, sf_dir):
    pairs = grouping.best_worst(v.rollouts(spark, sf_dir)).withColumn("metadata", F.create_map(F.lit("bucket"), F.col("bucket"), F.lit("opd_weight"), F.lit("old")))
    df = grouping.add_metadata(grouping.to_dpo_example(pairs), {"run": "one"})
    return df.select("prompt_id", F.col("chosen_grade.reward").alias("chosen_reward"), F.col("metadata")["opd_weight"].alias("weight"), F.col("metadata")["run"].alias("run"), F.size("metadata").cast("long").alias("n_metadata"))


@query
def rollout_buckets(spark, sf_dir):
    b = grouping.bucketed(v.rollouts(spark, sf_dir))
    extra = rates.extra_samples(F.col("bucket")).cast("long")
    return b.groupBy("bucket", extra.alias("extra"), rates.adaptive_weight(F.col("bucket")).alias("weight")).agg(F.count("*").alias("prompts"), F.sum("n").cast("long").alias("samples"))


@query
def resample_plan(spark, sf_dir):
    plan = grouping.resample_plan(grouping.bucketed(v.rollouts(spark, sf_dir)))
    return plan.select("prompt_id", F.col("sample_index").cast("long").alias("sample_index"))


@query
def grpo_advantages(spark, sf_dir):
    return rounded(grouping.with_advantages(v.rollouts(spark, sf_dir), single="drop").select("ordinal", "prompt_id", "advantage"), "advantage")


@query
def grpo_centred(spark, sf_dir):
    return rounded(grouping.with_advantages(v.rollouts(spark, sf_dir), normalize=False, single="drop").select("ordinal", "advantage"), "advantage")


@query
def first_appearance_order(spark, sf_dir):
    r = v.rollouts(spark, sf_dir)
    return r.select("prompt_id", grouping.first_appearance().alias("first_order")).distinct()


@query
def sample_expansion(spark, sf_dir):
    d = v.sizes(spark, sf_dir).select("doc_id", "lang")
    return grouping.expand_samples(d, 4).groupBy("lang", F.col("sample_index").cast("long").alias("sample_index")).agg(F.count("*").alias("n"))


@query
def checkpoint_source_grid(spark, sf_dir):
    r = v.completions(spark, sf_dir)
    return joins.grid(r.select("checkpoint").distinct(), r.select("source").distinct())


@query
def zip_generations(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").withColumnRenamed("event_id", "ordinal")
    both = joins.zip_strict(e.select("ordinal", "event_type"), e.select("ordinal", "value"))
    return rounded(both.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query
def attach_reference_scores(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    scores = e.select("event_id", (-F.col("value") / 100).alias("ref_logp"))
    out = joins.attach(e.select("event_id", "event_type"), scores, "event_id", ["ref_logp"])
    return rounded(out.groupBy("event_type").agg(F.sum("ref_logp").alias("total")), "total")


@query
def train_without_benchmark(spark, sf_dir):
    d, b = v.table(spark, sf_dir, "documents"), v.table(spark, sf_dir, "benchmark")
    marked = d.select("doc_id", F.when(F.pmod("doc_id", F.lit(50)) == 0, F.lit("held out text")).otherwise(F.col("text")).alias("prompt"))
    held = b.select(F.col("text").alias("prompt")).unionByName(spark.createDataFrame([(" Held out text ",)], "prompt string"))
    return joins.disjoint(marked, held).agg(F.count("*").alias("n"), F.sum("doc_id").cast("long").alias("ids"))


@query
def split_membership(spark, sf_dir):
    split = sampling.stratified_split(v.sizes(spark, sf_dir), 10, "doc_id", source="lang")
    val = split.where("is_val").select("doc_id")
    train, both = joins.members(v.sizes(spark, sf_dir), val, "doc_id", keep=False), joins.members(v.sizes(spark, sf_dir), val, "doc_id")
    count = lambda df, part: df.groupBy("lang").agg(F.count("*").alias("n")).withColumn("part", F.lit(part))
    return count(train, "train").unionByName(count(both, "val"))


@query
def cache_misses(spark, sf_dir):
    r = v.rollouts(spark, sf_dir)
    wanted = r.select("prompt_id", "event_type", cache.row_key("prompt_id", "event_type").alias("key"))
    known = wanted.where(F.pmod(F.length("prompt_id"), F.lit(2)) == 0)
    return cache.missing(wanted, known, ["key"]).select("prompt_id", "event_type")


@query
def bucketed_cache_misses(spark, sf_dir):
    """Requests against a cache in buckets: half of them are there, the rest is answered and appended, then none is missing."""
    r = v.rollouts(spark, sf_dir)
    wanted = r.select("prompt_id", "event_type", cache.row_key("prompt_id", "event_type").alias("key"))
    store = cache.Bucketed(spark, shared.folder(spark, "requests"), "key string, prompt_id string, event_type string", buckets=8)
    store.append(wanted.where(F.pmod(F.length("prompt_id"), F.lit(2)) == 0))
    first = shared.written(store.missing(wanted).select("prompt_id", "event_type", F.lit(1).cast("long").alias("round")), "missing")
    store.append(wanted)
    return first.unionByName(store.missing(wanted).select("prompt_id", "event_type", F.lit(2).cast("long").alias("round")))


@query
def reused_summary(spark, sf_dir):
    graded = metrics.accuracy(readers.grade(v.completions(spark, sf_dir)), ["checkpoint", "source"])
    wanted = v.completions(spark, sf_dir).select("checkpoint", "source").distinct()
    have, need = metrics.reuse(graded.where("source <> 'math'"), wanted, ["checkpoint", "source"])
    return have.select("checkpoint", "source", F.lit("reused").alias("state")).unionByName(need.select("checkpoint", "source", F.lit("missing").alias("state")))


@query
def split_coverage(spark, sf_dir):
    whole = v.sizes(spark, sf_dir)
    split = sampling.stratified_split(whole, 5, "doc_id")
    return joins.split_faults(split.where("not is_val"), split.where("is_val"), whole, "doc_id")


@query
def generated_completions(spark, sf_dir):
    """Four samples a prompt by a stand-in for a model."""
    t = v.turns(spark, sf_dir).select("conv_id", "turn", "prompt")
    out = seams.generate(grouping.expand_samples(t, 4), lambda prompts: [f"#### {len(p)}" for p in prompts])
    return out.select("conv_id", "turn", F.col("sample_index").cast("long").alias("sample_index"), answers.hash_generated(F.col("completion")).alias("answer"))


@query
def custom_tokenizer(spark, sf_dir):
    t = v.turns(spark, sf_dir)
    ids = seams.token_ids(F.col("prompt"), lambda text: [len(w) for w in text.split(" ")])
    return t.select("conv_id", "turn", F.size(ids).cast("long").alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query
def method_comparison(spark, sf_dir):
    c = readers.grade(v.completions(spark, sf_dir))
    summary = metrics.accuracy(c, ["checkpoint"])
    totals = c.groupBy("checkpoint").agg(F.sum(F.length("completion")).cast("long").alias("tokens"), F.sum(F.col("value") / 100).alias("sec"))
    out = metrics.known(metrics.comparison(summary, totals, ["checkpoint"]), "tokens")
    return rounded(out.withColumn("cost", rates.dollars(F.col("sec"), F.lit(0.44))), "accuracy", "parse_success_rate", "sec", "cost")


# -- reports -----------------------------------------------------------------------------------------


@query
def length_stats_all(spark, sf_dir):
    return rounded(metrics.length_stats(v.sizes(spark, sf_dir), "n_tokens"), "mean")


@query
def value_places(spark, sf_dir):
    """Values of orders at places in order, exact, in each priority; prices have many different values."""
    o = v.table(spark, sf_dir, "orders").withColumn("price", F.sqrt("o_totalprice") - 250)
    places = {"least": lambda n: F.lit(0), "p10": lambda n: F.floor(n * 0.1), "p50": lambda n: F.floor(n / 2), "p999": lambda n: F.floor(n * 0.999), "beyond": lambda n: n}
    return quantiles.at_places(o, "price", places, ["o_orderpriority"])


@query
def length_stats_by_lang(spark, sf_dir):
    return rounded(metrics.length_stats(v.sizes(spark, sf_dir), "n_tokens", ["lang"]), "mean")


@query
def sft_length_stats(spark, sf_dir):
    t = v.turns(spark, sf_dir).select(F.length("prompt").alias("prompt"), F.length("response").alias("response"))
    return rounded(metrics.column_length_stats(t, ["prompt", "response"]), "mean")


@query
def value_frequency(spark, sf_dir):
    r = v.rollouts(spark, sf_dir).withColumn("category", F.when(F.col("event_type") != "error", F.col("event_type")))
    return metrics.frequency(r, "category")


@query
def eval_summary(spark, sf_dir):
    graded = readers.grade(v.completions(spark, sf_dir))
    tokens = graded.groupBy("checkpoint", "source").agg(F.sum(F.length("completion")).cast("long").alias("generated_tokens_decoded"), (F.count("*") * F.max(F.length("completion"))).cast("long").alias("generated_tokens"))
    return rounded(metrics.accuracy(graded, ["checkpoint", "source"]).join(tokens, ["checkpoint", "source"]), "accuracy", "parse_success_rate")


@query
def run_cost(spark, sf_dir):
    c = v.completions(spark, sf_dir).select(F.length("completion").alias("tokens"), F.length("gold_answer").alias("decoded"), (F.col("value") / 100).alias("sec"))
    return rounded(metrics.cost_summary(metrics.run_totals(c, "tokens", "decoded", "sec"), 5400, 0.44), "generation_sec", "tokens_per_sec", "cost")


@query
def run_estimate(spark, sf_dir):
    r = v.rollouts(spark, sf_dir)
    by = r.groupBy("source").agg(F.count("*").alias("n")).withColumn("budget", grouping.budget(F.col("source"), 256, {"math": 768}))
    return rounded(metrics.estimate(by, 3), "hours")


@query
def loss_pivot(spark, sf_dir):
    r = v.rollouts(spark, sf_dir).groupBy(F.col("event_type").alias("arm"), "source").agg(F.avg("value").alias("loss"))
    return rounded(metrics.pivoted(r, "arm", "source", "loss", ["gsm8k", "math", "finchain"]), "gsm8k", "math", "finchain")


@query
def trajectory_with_base(spark, sf_dir):
    c = v.completions(spark, sf_dir)
    by = c.withColumn("checkpoint", F.concat(F.col("checkpoint"), F.lit("-only-"), (F.pmod("user_id", F.lit(4)) * 500).cast("string"))).groupBy("checkpoint", "source").agg(F.avg("value").alias("loss"))
    base = c.groupBy("source").agg(F.avg("value").alias("loss")).withColumn("checkpoint", F.lit("base"))
    return rounded(metrics.trajectory(base, by).select("arm", "step", "source", "loss"), "loss")


@query
def lr_schedule(spark, sf_dir):
    """Each event as a step of a run of 2001."""
    steps = v.table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(2001)).alias("step"))
    return rounded(steps.withColumn("scale", rates.warmup_cosine(F.col("step"), 200, 2000)), "scale")


@query
def count_window_throughput(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    useful = F.when(F.col("event_type") != "error", F.length("props")).otherwise(0)
    out = metrics.count_windows(e, "event_id", 10, {"tokens": F.sum(useful).cast("long"), "seconds": F.sum(F.col("value") / 100)})
    return rounded(out.withColumn("per_sec", rates.throughput(F.col("tokens"), F.col("seconds"))), "seconds", "per_sec")


@query
def metadata_json(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query
def failure_table(spark, sf_dir):
    graded = readers.grade(v.completions(spark, sf_dir)).withColumn("day", F.pmod("example_id", F.lit(10)))
    return rounded(metrics.per_group_accuracy(graded, ["source", "checkpoint", "day"]), "accuracy")


@query
def gold_self_check(spark, sf_dir):
    """Gold answers verify, corrupted ones don't."""
    c = v.completions(spark, sf_dir)
    same, off = scoring.score_marked(F.col("gold_answer"), F.col("gold_answer")), scoring.score_marked(F.concat(F.lit("9"), F.col("gold_answer")), F.col("gold_answer"))
    return c.groupBy("source").agg(F.count("*").alias("n"), F.count_if(same).alias("verified"), F.count_if(off).alias("corrupt_verified"))


@query
def pass_at_k(spark, sf_dir):
    return rounded(metrics.pass_at_k(v.rollouts(spark, sf_dir), 3), "pass_at_k")


@query
def bootstrap_ci(spark, sf_dir):
    return rounded(bootstrap.bootstrap_ci(v.rollouts(spark, sf_dir), "reward", "ordinal", keys=["source"]), "mean", "lo", "hi")


@query
def bootstrap_user_values(spark, sf_dir):
    """Many keys, and a value that is no share."""
    return rounded(bootstrap.bootstrap_ci(v.table(spark, sf_dir, "events").withColumn("root", F.sqrt(F.abs("value"))), "root", "event_id", rounds=40, seed=7, keys=["user_id"]), "mean", "lo", "hi")


@query
def cost_per_accuracy_point(spark, sf_dir):
    by = metrics.accuracy(readers.grade(v.completions(spark, sf_dir)), ["checkpoint"])
    return by.select("checkpoint", r6(metrics.cost_per_point(F.lit(3.5), F.col("accuracy"), F.lit(0.1))).alias("per_point"))


# -- tokens and losses ---------------------------------------------------------------------------------


def _batched(spark, sf_dir):
    return v.sizes(spark, sf_dir).withColumn("batch", sampling.batch_number("doc_id", 8))


@query
def pack_documents(spark, sf_dir):
    return token_rows.pack_lengths(_batched(spark, sf_dir), "batch", "doc_id", "n_tokens", 2048)


@query
def pack_languages(spark, sf_dir):
    """Batches that grow with the table."""
    df = v.sizes(spark, sf_dir).withColumn("batch", F.coalesce("lang", F.lit("")))
    return token_rows.pack_lengths(df, "batch", "doc_id", "n_tokens", 2048)


@query
def packed_row_stats(spark, sf_dir):
    rows = token_rows.pack_lengths(_batched(spark, sf_dir), "batch", "doc_id", "n_tokens", 2048).groupBy("batch", "row_no").agg(F.max("end").alias("used"), F.count("*").alias("docs"))
    return rows.groupBy("batch").agg(F.count("*").alias("rows"), (F.count("*") * F.max("used")).cast("long").alias("rectangular"), F.sum("used").cast("long").alias("tokens"), F.max("docs").alias("most_docs"))


def _packed(spark, sf_dir):
    """Whole turns, packed by conversation: only a turn longer than a row is cut, by the operator."""
    t = v.turns(spark, sf_dir)
    ids = token_rows.char_ids(F.concat("prompt", "response"))
    df = t.select("conv_id", "turn", ids.alias("ids"), F.length("prompt").alias("prompt_length"), F.lit("math").alias("source"), F.col("turn").cast("string").alias("example_id"))
    return token_rows.pack_rows(df, "conv_id", "turn", 2048, separator=99)


@query
def packed_rows(spark, sf_dir):
    """Packed rows: width, labels, positions and documents as sums."""
    p = _packed(spark, sf_dir)
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("conv_id", "row_no", F.size("input_ids").cast("long").alias("width"), F.size("boundaries").cast("long").alias("docs"), F.size(F.filter("labels", lambda x: x != kernels.IGNORED)).cast("long").alias("labels"), total("attention_mask").alias("used"), total("position_ids").alias("positions"))


@query
def isolated_attention(spark, sf_dir):
    """Number of visible positions of each packed row, counted on its mask, which is intervals and not a square of 2048 x 2048."""
    return _packed(spark, sf_dir).select("conv_id", "row_no", masks.visible(masks.of_doc_ids(F.col("doc_ids"))).alias("visible"))


@query
def attention_intervals(spark, sf_dir):
    """The mask itself: which keys each position of each packed row sees."""
    rows = _packed(spark, sf_dir).withColumn("mask", masks.of_doc_ids(F.col("doc_ids")))
    out = masks.positions(rows, "mask", "conv_id", "row_no")
    return out.select("conv_id", "row_no", F.col("query").cast("long").alias("query"), F.col("first_key").cast("long").alias("first_key"))


@query
def pad_and_mask(spark, sf_dir):
    t = v.turns(spark, sf_dir)
    df = t.select("conv_id", "turn", F.length("prompt").alias("p"), F.length("response").alias("r"), token_rows.char_ids(F.concat("prompt", "response")).alias("ids"))
    df = df.withColumn("labels", token_rows.masked_labels(F.col("ids"), F.col("p")))
    df = df.withColumn("padded", token_rows.padded(F.col("labels"), F.col("p") + F.col("r") + 5, kernels.IGNORED))
    return df.select("conv_id", "turn", F.size("padded").cast("long").alias("width"), metrics.useful_tokens(F.col("padded")).cast("long").alias("useful"))


@query
def sft_serialise(spark, sf_dir):
    t = v.turns(spark, sf_dir)
    p, r = token_rows.serialise_prompt(F.col("prompt")), token_rows.serialise_response(F.col("response"))
    return t.select("conv_id", "turn", F.length(p).cast("long").alias("prompt_chars"), F.length(F.concat(p, r)).cast("long").alias("total_chars"), F.md5(F.concat(p, r)).alias("digest"))


@query
def encoded_pairs(spark, sf_dir):
    """Two answers to a prompt encoded, cut to a window, masked and padded to one width a batch: the response against an answer that
    repeats the prompt; a prompt that fills the window is skipped.
    """
    t = v.turns(spark, sf_dir)
    prompt, chosen, rejected = token_rows.char_ids(F.col("prompt")), token_rows.char_ids(F.col("response")), token_rows.char_ids(F.col("prompt"))
    df = token_rows.encode_pairs(t, prompt, chosen, rejected, 2048, policy="skip").withColumn("batch", sampling.batch_number("conv_id", 8))
    df = token_rows.collate_pairs(df, "batch")
    return df.select("conv_id", "turn", F.col("width").cast("long").alias("width"), metrics.useful_tokens(F.col("chosen_labels")).cast("long").alias("chosen_useful"), metrics.useful_tokens(F.col("rejected_labels")).cast("long").alias("rejected_useful"), F.size("rejected_input_ids").cast("long").alias("rejected_width"))


@query
def parameter_bands(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.when(F.pmod("p_size", F.lit(3)) == 0, ".bias").when(F.pmod("p_size", F.lit(3)) == 1, ".qbias").otherwise(".weight"))
    return p.select(token_rows.parameter_band(name, F.pmod("p_size", F.lit(4))).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def _logprobs(spark, sf_dir):
    return v.logits(spark, sf_dir).withColumn("logp", kernels.token_logprob(F.col("embedding"), F.col("label")))


@query
def token_logprob(spark, sf_dir):
    return rounded(_logprobs(spark, sf_dir).select("vec_id", "logp"), "logp")


@query
def sequence_logprob(spark, sf_dir):
    """Sequences of five positions; the labels of the first two are the prompt's. A last one that breaks off in the prompt has nothing to sum."""
    label = F.when(F.pmod("vec_id", F.lit(5)) < 2, kernels.IGNORED).otherwise(F.col("label"))
    df = v.logits(spark, sf_dir).withColumns({"seq": F.floor(F.col("vec_id") / 5).cast("long"), "label": label})
    return rounded(token_rows.sequence_logprob(df, "seq", "vec_id", "embedding", "label", policy="skip"), "logp")


@query
def masked_ce(spark, sf_dir):
    label = F.when(F.pmod("vec_id", F.lit(3)) == 0, kernels.IGNORED).otherwise(F.col("label"))
    df = v.logits(spark, sf_dir).select(F.pmod("vec_id", F.lit(6)).alias("part"), kernels.token_logprob(F.col("embedding"), label).alias("logp"))
    return rounded(df.groupBy("part").agg(F.coalesce(-F.avg("logp"), F.lit(0.0)).alias("loss"), F.count("logp").alias("tokens")), "loss")


@query
def perplexity(spark, sf_dir):
    df = _logprobs(spark, sf_dir).select(F.col("label").cast("long").alias("label"), (-F.col("logp")).alias("nll"), F.lit(1).alias("one"))
    return rounded(metrics.token_weighted_loss(df, "nll", "one", ["label"]), "loss", "perplexity")


@query
def val_loss_two_ways(spark, sf_dir):
    df = _logprobs(spark, sf_dir).select((-F.col("logp")).alias("nll"), F.lit(1).alias("one"), F.floor(F.col("vec_id") / 7).cast("long").alias("batch"))
    return rounded(metrics.mean_of_batch_means(df, "batch", "nll").withColumnRenamed("loss", "batch_mean").crossJoin(metrics.token_weighted_loss(df, "nll", "one").select(F.col("loss").alias("token_mean"))), "batch_mean", "token_mean")


@query
def dpo_loss(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    x = F.col("value")
    pc, pr, rc, rr = -x / 50, -F.pmod(x * 7, F.lit(400.0)) / 50, -x / 60, -F.pmod(x * 3, F.lit(300.0)) / 60
    df = e.select("event_type", kernels.dpo_loss(pc, pr, rc, rr, 0.2).alias("loss"), kernels.dpo_margin(pc, pr, rc, rr).alias("margin"), (0.2 * (pc - rc)).alias("chosen"), (0.2 * (pr - rr)).alias("rejected"))
    out = df.groupBy("event_type").agg(F.avg("loss").alias("loss"), F.avg((F.col("margin") > 0).cast("double")).alias("accuracy"), F.avg("margin").alias("margin"), F.avg("chosen").alias("chosen_reward"), F.avg("rejected").alias("rejected_reward"))
    return rounded(out, "loss", "accuracy", "margin", "chosen_reward", "rejected_reward")


@query
def grpo_token_loss(spark, sf_dir):
    df = grouping.with_advantages(v.rollouts(spark, sf_dir), single="drop")
    p, old, ref = -F.col("value") / 300, -F.pmod(F.col("value") * 3, F.lit(500.0)) / 400, -F.pmod(F.col("value") * 5, F.lit(500.0)) / 350
    mask = (F.col("event_type") != "error").cast("double")
    df = df.select("source", mask.alias("m"), kernels.grpo_term(p, old, ref, F.col("advantage"), 0.2, 0.05).alias("loss"), kernels.kl_estimate(p, ref).alias("kl"), kernels.ratio(p, old).alias("ratio"))
    return rounded(kernels.masked_loss(df, ["loss", "kl", "ratio"], "m", ["source"]), "loss", "kl", "ratio")


# -- streaming (extensions) -------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(v.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")


@query
def ledger_daily_window(spark, sf_dir):
    """The event table as a stream, by day and type, into a ledger that takes each batch once; of each window the last version."""
    root = shared.folder(spark, "ledger")
    ledger.run_upsert(ledger.windowed(_event_stream(spark, sf_dir)), f"{root}/state", commits.sink(f"{root}/out"))
    versions = commits.read(spark, f"{root}/out", spark.createDataFrame([], "start timestamp, event_type string, n long, total double").schema)
    out = commits.latest(versions, ["start", "event_type"])
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), "total")


def _streamed(spark, name, df):
    """What a stateful stream gives for all that is there; a second run from the checkpoint adds nothing."""
    stateful.use_rocks(spark)
    root = shared.folder(spark, name)
    for _ in range(2):
        ledger.run_available(df, f"{root}/out", f"{root}/state")
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@query
def stream_count_windows(spark, sf_dir):
    return rounded(_streamed(spark, "windows", stateful.count_windows(_event_stream(spark, sf_dir), "event_type", "value", "event_id", 64)), "total")


@query
def stream_first_requests(spark, sf_dir):
    return _streamed(spark, "requests", stateful.first_of_each(_event_stream(spark, sf_dir), ["user_id", "event_type"], "event_id")).select("event_id", "user_id", "event_type")


@query
def stream_sessions(spark, sf_dir):
    """Sessions of users that are over by the last event's time."""
    out = _streamed(spark, "sessions", stateful.sessions(_event_stream(spark, sf_dir).withColumn("name", F.col("user_id").cast("string")), "name", "ts", "value", 6 * 3_600_000))
    ms = lambda c: F.unix_millis(c)
    return rounded(out.select("name", ms("start").alias("start"), ms("end").alias("end"), "n", "total"), "total")


def queries() -> dict[str, Query]:
    from quern.plans import round_trips  # noqa: F401  registers its own

    return dict(_QUERIES)
