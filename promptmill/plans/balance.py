"""Balancing a labelled prompt table: quotas, generation, filters, de-duplication, metrics, gates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixedvalues as fv
from ..operators import dedup, lsh, semantic, stats
from ..operators.profile import output_rows
from ..operators.sampling import stratified_seeds, weighted_class_draw
from ..session import lookup, materialize
from . import generate as gen


class BalanceResult(NamedTuple):
    """``failures`` has a row for each request that gave no text: stage, seq, intent_disc, error."""
    augmented: DataFrame
    metrics: DataFrame
    report: DataFrame
    failures: DataFrame | None = None


def plan_quotas(counts: DataFrame, target_coverage: float = fv.TARGET_COVERAGE,
                max_new_per_class: int | None = None) -> DataFrame:
    """New rows per class from ``intent_disc, n``: ``n_wanted``, the gap to the largest class times the target share, rounded
    half to even, and ``n_new``, the same unless the caller sets a most per class. The largest class is found by a window
    over the class counts."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(float(target_coverage)) / 100.0))
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))
    wanted = F.bround((largest - F.col("n")) * share).cast("bigint")
    most = wanted if max_new_per_class is None else F.least(wanted, F.lit(max_new_per_class).cast("bigint"))
    return counts.select("intent_disc", "n", wanted.alias("n_wanted"), most.alias("n_new"))


def plan_total(quotas: DataFrame) -> DataFrame:
    return quotas.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("total_new"))


def novel_budget(n_seeds, total_new, ratio: float = fv.NOVEL_RATIO):
    """Rows of the novel stage, from columns: at most max(10, a tenth of the seeds) and at most the ratio of
    the planned rows."""
    return F.least(F.greatest(F.lit(10), F.floor(n_seeds / 10)),
                   F.floor(F.lit(ratio) * F.greatest(total_new, F.lit(1)))).cast("bigint")


def attach_first_attributes(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Class and score of the first generated row with the same raw text."""
    first = items.groupBy("prompt").agg(F.min_by(F.struct("intent_disc", "intent_cont"), "item").alias("a"))
    return texts.join(first, "prompt", "left").select(
        *texts.columns, F.col("a.intent_disc").alias("intent_disc"), F.col("a.intent_cont").alias("intent_cont"))


def score_fallback(rows: DataFrame, class_means: DataFrame) -> DataFrame:
    """Own score, else the mean of the class."""
    joined = lookup(rows, class_means, "intent_disc")
    return joined.withColumn("intent_cont", F.coalesce("intent_cont", "class_mean")).drop("class_mean")


def coverage_percent(n_unique, planned):
    """100 * unique / planned, 100 when nothing was planned."""
    return F.when(planned > 0, F.lit(100.0) * n_unique / planned).otherwise(100.0)


def quality_gates(metrics: DataFrame, min_coverage: float = fv.MIN_COVERAGE_PERCENT, max_cv: float = fv.MAX_CLASS_CV_PERCENT,
                  low: float = fv.MIN_SIMILARITY, high: float = fv.MAX_SIMILARITY,
                  max_duplicates: float = fv.MAX_DUPLICATE_RATIO) -> DataFrame:
    """One flag per gate, ``all_pass``, and the names of the failed gates. A missing metric fails."""
    def value(name: str, missing: float):
        return F.coalesce(F.col(name), F.lit(missing)) if name in metrics.columns else F.lit(missing)
    gates = {
        "coverage_ok": value("coverage_percent", 0.0) >= min_coverage,
        "class_cv_ok": value("class_histogram_cv_percent", 100.0) <= max_cv,
        "similarity_ok": value("paraphrase_mean_similarity", 0.0).between(low, high),
        "duplicates_ok": value("duplicate_ratio", 1.0) <= max_duplicates,
    }
    every = F.lit(True)
    for flag in gates.values():
        every = every & flag
    failed = F.array_join(F.array_compact(F.array(*[F.when(~flag, F.lit(name)) for name, flag in gates.items()])), ",")
    return metrics.select("*", *[flag.alias(name) for name, flag in gates.items()], every.alias("all_pass"),
                          failed.alias("failed_gates"))


def format_counts(counts: DataFrame) -> DataFrame:
    """Class counts as one text, largest first (one entry per class)."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "intent_disc", "n")))
    return counts.agg(F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda e: F.concat(
        e.getField("intent_disc").cast("string"), F.lit(": "), e.getField("n").cast("string"))), ", "), F.lit("}")).alias("counts"))


def report_lines(facts: DataFrame) -> DataFrame:
    """``line, label, value``: the ten labelled lines of a run, from its one row of facts."""
    def decimals(name: str, places: int):
        return F.format_string(f"%.{places}f", F.col(name))
    values = [
        F.concat(F.col("target_coverage").cast("string"), F.lit("%")), F.col("original_rows").cast("string"),
        F.col("planned_new").cast("string"),
        F.concat(F.col("generated_total").cast("string"), F.lit(" (unique "), F.col("generated_unique").cast("string"), F.lit(")")),
        F.concat(decimals("coverage_percent", 2), F.lit("%")), decimals("paraphrase_mean_similarity", 3),
        decimals("duplicate_ratio", 3), decimals("duplicate_ratio_vs_source", 3), decimals("class_histogram_cv_percent", 2),
        F.col("class_counts")]
    return facts.select(F.posexplode(F.array(*[
        F.struct(F.lit(label).alias("label"), v.alias("value")) for label, v in zip(fv.REPORT_LABELS, values)]))
        .alias("line", "e")).select("line", "e.label", "e.value")


def report_text(reports: list[DataFrame]) -> DataFrame:
    """``value``: the lines of all runs in order, with a line of dashes between runs."""
    rows = None
    for i, report in enumerate(reports):
        part = report.select(F.lit(i).alias("run"), "line", F.concat("label", F.lit(": "), "value").alias("value"))
        if i:
            part = part.unionByName(report.sparkSession.range(1).select(
                F.lit(i).alias("run"), F.lit(-1).alias("line"), F.lit("---").alias("value")))
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy("run", "line").select("value")


METRICS = ["coverage_percent", "paraphrase_mean_similarity", "duplicate_ratio", "class_histogram_cv_percent"]


def seed_table(source: DataFrame, per_class: int, max_seeds: int | None, policy: str, seed: int) -> DataFrame:
    """Seeds numbered in class order: ``seed_id, prompt, intent_disc``; at most ``per_class`` rows of each class."""
    rows = stratified_seeds(source.select("row_id", "prompt", "intent_disc"), per_class, max_seeds, seed, policy)
    w = Window.partitionBy(F.lit(0)).orderBy("intent_disc", "seed_rank")
    return rows.select((F.row_number().over(w) - 1).cast("bigint").alias("seed_id"), "prompt", "intent_disc")


def finish(items: DataFrame, kept_pairs: DataFrame, source: DataFrame, counts: DataFrame, class_means: DataFrame,
           planned: int, target_coverage: float, near_threshold: float = 0.9, failures: DataFrame | None = None,
           known: DataFrame | None = None) -> BalanceResult:
    """Remove repeats inside and against the source, fill in scores, measure. ``items`` are the generated
    rows of all stages, ``kept_pairs`` the paraphrases with their cosine."""
    unique = materialize(lsh.dedup_near(items, "item", "prompt", near_threshold))
    final = materialize(dedup.dedup_against(unique, source, "prompt", "item", known=known))
    # The row kept for a text is the first generated row with it, so its own class and score are the ones
    # that attach_first_attributes would find.
    augmented = materialize(output_rows(score_fallback(final, class_means), "item"))
    mean_similarity = semantic.mean_pair_similarity(kept_pairs, kept_pairs).scalar()
    sizes = [part.agg(F.count("*").alias("n")).scalar() for part in (items, unique, final)]
    total, n_unique, n_final = sizes
    ratio = lambda kept, rows: F.when(rows == 0, 0.0).otherwise(1 - kept / F.greatest(rows, F.lit(1)))
    planned_column = F.lit(planned)
    facts = materialize(source.sparkSession.range(1).select(
        F.lit(target_coverage).alias("target_coverage"), counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).scalar().alias("original_rows"),
        planned_column.alias("planned_new"), total.alias("generated_total"), n_final.alias("generated_unique"),
        coverage_percent(n_final, planned_column).alias("coverage_percent"), mean_similarity.alias("paraphrase_mean_similarity"),
        ratio(n_unique, total).alias("duplicate_ratio"), ratio(n_final, n_unique).alias("duplicate_ratio_vs_source"),
        stats.class_cv_percent(augmented).scalar().alias("class_histogram_cv_percent"),
        format_counts(counts).scalar().alias("class_counts")))
    return BalanceResult(augmented, facts.select(*METRICS), report_lines(facts), failures)


class SourceFacts(NamedTuple):
    """What all runs over one table have in common: class counts, mean scores of the classes, the texts' signatures."""
    counts: DataFrame
    class_means: DataFrame
    signatures: DataFrame


def source_facts(source: DataFrame) -> SourceFacts:
    return SourceFacts(materialize(stats.class_counts(source.where(F.col("intent_disc").isNotNull()))),
                       materialize(stats.class_mean_score(source)), materialize(dedup.signatures(source, "prompt")))


def balance_dataset(source: DataFrame, generator: gen.Generator = gen.rule_based, target_coverage: float = fv.TARGET_COVERAGE,
                    max_new_per_class: int | None = None, min_similarity: float = fv.MIN_SIMILARITY,
                    max_similarity: float = fv.MAX_SIMILARITY, novel_ratio: float = fv.NOVEL_RATIO,
                    per_class: int = fv.SEEDS_PER_CLASS, max_seeds: int | None = None, policy: str = "per_class",
                    seed: int = 42, run: int = 1, facts: SourceFacts | None = None) -> BalanceResult:
    """The whole flow over ``row_id, prompt, intent_disc, intent_cont``. Generated rows are written once,
    before anything reads them, so a generator that is not repeatable is still called once per request. ``facts``: those of the source, if an
    earlier run has them."""
    counts, class_means, known = facts if facts is not None else source_facts(source)
    quotas = materialize(plan_quotas(counts, target_coverage, max_new_per_class))
    seeds = materialize(seed_table(source, per_class, max_seeds, policy, seed))
    # The scores of the seeds only. The seeds are a written table, so Spark knows whether they are small enough to broadcast.
    seed_rows = source.join(seeds.select("prompt").distinct(), "prompt", "left_semi")
    seed_scores = materialize(stats.prompt_score_lookup(seed_rows))
    size = quotas.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("t")).select(
        "t", novel_budget(F.lit(seeds.count()), F.col("t"), novel_ratio).alias("k")).first()

    made = [gen.made_from_seeds("paraphrase", seeds, generator, seed_scores, min_similarity, run),
            gen.made_from_seeds("syntax", seeds, generator, seed_scores, run=run)]
    if size["t"] > 0:
        made.append(gen.made_conditional(quotas, class_means, generator, run))
    if size["k"] > 0:
        made.append(gen.made_novel(weighted_class_draw(quotas, size["k"], seed, [run]), class_means, generator, run))
    # Every request is called once; what failed stays beside what came back.
    everything = made[0]
    for part in made[1:]:
        everything = everything.unionByName(part, allowMissingColumns=True)
    good, failed = gen.drop_failed(materialize(everything))
    failures = failed.select("stage", "seq", "intent_disc", "error")
    items = gen.items(good, "seed_prompt")
    is_pair = F.col("stage") == "paraphrase"
    paraphrased = materialize(semantic.pair_similarity(items.where(is_pair), "seed_prompt", "prompt"))
    kept_pairs = semantic.similarity_band(paraphrased, min_similarity, max_similarity)
    rows = items.where(~is_pair).drop("seed_prompt").unionByName(kept_pairs.drop("cosine", "seed_prompt"))
    return finish(materialize(rows), kept_pairs, source, counts, class_means, int(size["t"]), target_coverage, failures=failures, known=known)


def repeat_runs(source: DataFrame, runs: int = 1, **options) -> tuple[BalanceResult, DataFrame]:
    """Several runs with different draws; their rows below each other with the run number, their reports
    one after the other, the metrics and gates of the last run."""
    seed = options.pop("seed", 42)
    facts = source_facts(source)
    results = [balance_dataset(source, seed=seed + i, run=i + 1, facts=facts, **options) for i in range(runs)]
    rows = failures = None
    for i, result in enumerate(results):
        part, failed = (t.withColumn("run", F.lit(i + 1)) for t in (result.augmented, result.failures))
        rows = part if rows is None else rows.unionByName(part)
        failures = failed if failures is None else failures.unionByName(failed)
    last = results[-1].metrics
    return BalanceResult(rows, last, report_text([r.report for r in results]), failures), quality_gates(last)


def balance_until_gates(source: DataFrame, attempts: int = 3, **options) -> tuple[BalanceResult, DataFrame]:
    """Repeat the run with new draws until the gates pass, at most ``attempts`` times."""
    seed, facts = options.pop("seed", 42), source_facts(source)
    for attempt in range(attempts):
        result = balance_dataset(source, seed=seed + attempt, run=attempt + 1, facts=facts, **options)
        gates = materialize(quality_gates(result.metrics).withColumn("attempt", F.lit(attempt + 1)))
        if gates.first()["all_pass"]:
            break
    return result, gates


def combined_dataset(source: DataFrame, augmented: DataFrame) -> DataFrame:
    """Source rows and new rows, first of every prompt; new rows in the order they were generated."""
    run = F.col("run") if "run" in augmented.columns else F.lit(1)
    new = augmented.withColumn("row_id", run.cast("bigint") * (1 << 50) + F.col("item")).drop("run", "item")
    return dedup.combine(source, new).drop("row_id")
