"""Generation of new rows: requests as columns, a pluggable generator over partitions, tidy-up."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..session import lookup

# A generator takes the messages of one request and a dict of parameters (the stage and a number that
# tells requests apart) and returns one line of text; raising loses only that row.
Generator = Callable[[list[dict], dict], str]
# A batch generator is loaded once per Python worker and task: it takes an iterator of frames with the columns ``messages`` and
# ``number`` and yields, for each of them, a frame with ``text`` and ``error`` in the same order. It may hold a client
# open or send many requests at a time.
BatchGenerator = Callable[[Iterator[pd.DataFrame], dict], Iterator[pd.DataFrame]]

STAGE_RANK = {"paraphrase": 0, "syntax": 1, "conditional": 2, "brainstorm": 3}
# Room for the sequence numbers of one stage in the order of all generated rows.
STAGE_ROOM = 1 << 44


def _messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def build_request(stage: str, text: Column | None = None, label: Column | None = None, min_similarity: float = 0.82) -> Column:
    """Messages of one request as an array of (role, content)."""
    if stage == "paraphrase":
        return _messages("Say the same thing in other words, in one line without quotes.", F.format_string(
            f"Text: %s\nStay close in meaning (cosine of at least {min_similarity}).", text))
    if stage == "syntax":
        return _messages("Change the grammatical structure and keep the meaning.", F.format_string("Text: %s\nOne line.", text))
    if stage == "conditional":
        return _messages("Write a plausible prompt for an assistant.", F.format_string("Class: %s\nOne line, no list.", label.cast("string")))
    if stage == "brainstorm":
        return _messages("Write a prompt unlike the usual ones.", F.lit("One line, no list."))
    if stage == "classify":
        return _messages("Rate the intent of the text.", F.format_string("Text: %s", text))
    raise ValueError(f"unknown stage {stage}")


RESPONSE_SCHEMA = ("choices array<struct<message struct<content string>>>, "
                   "usage struct<prompt_tokens bigint, completion_tokens bigint, total_tokens bigint>")


def parse_response(body) -> Column:
    """``text`` and token usage from a chat response in JSON."""
    r = F.from_json(body, RESPONSE_SCHEMA)
    usage = r.getField("usage")
    first = F.get(r.getField("choices"), F.lit(0))
    return F.struct(first.getField("message").getField("content").alias("text"),
                    usage.getField("prompt_tokens").alias("prompt_tokens"),
                    usage.getField("completion_tokens").alias("completion_tokens"),
                    usage.getField("total_tokens").alias("total_tokens"))


OPENERS = ["Please explain", "Describe briefly", "Give an overview of", "Compare the views on", "Summarise",
           "List the main points of", "Show an example of", "Discuss the limits of"]
SUBJECTS = ["river ecology", "medieval trade", "battery storage", "urban gardens", "early printing", "coastal weather",
            "public libraries", "bridge design", "bee keeping", "folk music", "number theory", "glass making"]
ANGLES = ["for a beginner", "with two sources", "in a short paragraph", "from a historical view", "for a school class",
          "with practical advice", "and its open questions", "for a local newspaper"]


def rule_based(messages: list[dict], params: dict) -> str:
    """Deterministic default generator: rewrites a given text by moving its first words to the end,
    otherwise puts together opener, subject and angle chosen by a hash of the request."""
    content = messages[-1]["content"]
    seed = hashlib.sha256(f"{params.get('stage')}|{params.get('number')}|{content}".encode()).digest()
    if content.startswith("Text: "):
        words = content[6:].rsplit("\n", 1)[0].split()
        turn = 1 if params.get("stage") == "paraphrase" else max(1, len(words) // 2)
        return " ".join(words[turn:] + words[:turn])
    pick = lambda options, i: options[seed[i] % len(options)]
    return f"{pick(OPENERS, 0)} {pick(SUBJECTS, 1)} {pick(ANGLES, 2)}, case {int.from_bytes(seed[4:8], 'big')}"


def one_by_one(generator: Generator) -> BatchGenerator:
    """The batch form of a generator that takes one request at a time."""
    def run(batches: Iterator[pd.DataFrame], params: dict) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for request, number in zip(batch["messages"], batch["number"]):
                try:
                    texts.append(generator([dict(m) for m in request], {**params, "number": number}))
                    errors.append(None)
                except Exception as error:  # one failing call loses its own row only
                    texts.append(None)
                    errors.append(repr(error))
            yield pd.DataFrame({"text": texts, "error": errors}, dtype=object)
    run.is_batch = True
    return run


def batch_generator(run: BatchGenerator) -> BatchGenerator:
    """Marks a function as a batch generator (a decorator)."""
    run.is_batch = True
    return run


def run_generator(requests: DataFrame, generator: Generator | BatchGenerator, params: dict, keep: list[str],
                  messages: str = "messages") -> DataFrame:
    """Run the generator over the requests and add ``text`` and ``error``. A column ``number`` of the requests is handed
    on. Parallelism is the partitioning of the requests. A batch generator must give as many rows as it was sent."""
    schema = requests.select(*keep).schema.add("text", "string").add("error", "string")
    batched = generator if getattr(generator, "is_batch", False) else one_by_one(generator)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = deque()

        def sent() -> Iterator[pd.DataFrame]:
            for batch in batches:
                waiting.append(batch[keep])
                yield pd.DataFrame({"messages": batch[messages], "number": batch["number"] if "number" in batch else None})
        for made in batched(sent(), params):
            own = waiting.popleft()
            if len(made) != len(own):
                raise ValueError(f"the generator gave {len(made)} rows for {len(own)} requests")
            yield own.assign(text=made["text"].to_numpy(), error=made["error"].to_numpy())
        if waiting:
            raise ValueError("the generator left requests without an answer")

    return requests.mapInPandas(run, schema)


def drop_failed(generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a text, and the failed ones with their error."""
    return (generated.where(F.col("error").isNull() & F.col("text").isNotNull()).drop("error"),
            generated.where(F.col("error").isNotNull() | F.col("text").isNull()))


def items(made: DataFrame, *extra: str) -> DataFrame:
    """Generated rows in their common schema; ``item`` orders all rows of all stages."""
    rank = F.create_map(*[F.lit(x) for pair in STAGE_RANK.items() for x in pair])
    return made.select(
        (F.element_at(rank, F.col("stage")).cast("bigint") * STAGE_ROOM + F.col("seq")).alias("item"), "stage",
        tx.clean_output("text").alias("prompt"), "intent_disc", "intent_cont", *extra)


def _made(stage: str, requests: DataFrame, generator: Generator | BatchGenerator, keep: list[str], rank: str | None = None) -> DataFrame:
    """What came back for each request of a stage, failures included."""
    return run_generator(_spread(requests, "seq"), generator, {"stage": stage}, keep).withColumn("stage", F.lit(rank or stage))


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Requests over all tasks (a generator call is far dearer than the shuffle of a request)."""
    return df.repartition(key)


def made_from_seeds(stage: str, seeds: DataFrame, generator: Generator | BatchGenerator, seed_scores: DataFrame | None = None,
                    min_similarity: float = 0.82, run: int = 1) -> DataFrame:
    """One request per seed (``seed_id, prompt, intent_disc``); what is made takes over the seed's score."""
    if seed_scores is None:
        seeds = seeds.withColumn("intent_cont", F.lit(None).cast("double"))
    else:
        seeds = seeds.join(seed_scores.select("prompt", F.col("seed_score").alias("intent_cont")), "prompt", "left")
    requests = seeds.select(
        F.col("seed_id").alias("seq"), F.col("prompt").alias("seed_prompt"), "intent_disc", "intent_cont",
        (F.col("seed_id") + F.lit(run) * 1_000_003).alias("number"),
        build_request(stage, F.col("prompt"), min_similarity=min_similarity).alias("messages"))
    return _made(stage, requests, generator, ["seq", "seed_prompt", "intent_disc", "intent_cont"])


def generate_from_seeds(stage: str, seeds: DataFrame, generator: Generator | BatchGenerator, seed_scores: DataFrame | None = None,
                        min_similarity: float = 0.82, run: int = 1) -> DataFrame:
    """One new row per seed whose request did not fail."""
    return items(drop_failed(made_from_seeds(stage, seeds, generator, seed_scores, min_similarity, run))[0], "seed_prompt")


def pair_with_seed(generated: DataFrame, seeds: DataFrame, key: str = "seed_id") -> DataFrame:
    """Generated row next to its seed."""
    return generated.join(seeds, key)


BLOCK = 1024


def quota_rows(quotas: DataFrame) -> DataFrame:
    """``seq, intent_disc``: as many rows per class as its quota, classes by falling size. Long quotas
    are unrolled in two steps, so one class is spread over many tasks."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "intent_disc").rowsBetween(Window.unboundedPreceding, -1)
    placed = quotas.withColumn("_from", F.coalesce(F.sum("n_new").over(w), F.lit(0))).where("n_new > 0")
    blocks = placed.select("intent_disc", "n_new", "_from",
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_new") - 1, F.lit(BLOCK).cast("bigint"))).alias("_b"))
    inner = F.sequence(F.col("_b"), F.least(F.col("_b") + (BLOCK - 1), F.col("n_new") - 1))
    return (blocks.repartition("intent_disc", "_b").select("intent_disc", "_from", F.explode(inner).alias("_i"))
            .select((F.col("_from") + F.col("_i")).alias("seq"), "intent_disc"))


def made_conditional(quotas: DataFrame, class_means: DataFrame, generator: Generator | BatchGenerator, run: int = 1) -> DataFrame:
    """One request per quota row; what is made takes the mean score of its class."""
    rows = lookup(quota_rows(quotas), class_means, "intent_disc")
    requests = rows.select("seq", "intent_disc", F.col("class_mean").alias("intent_cont"),
                           (F.col("seq") + F.lit(run) * 1_000_003).alias("number"),
                           build_request("conditional", label=F.col("intent_disc")).alias("messages"))
    return _made("conditional", requests, generator, ["seq", "intent_disc", "intent_cont"])


def generate_conditional(quotas: DataFrame, class_means: DataFrame, generator: Generator | BatchGenerator, run: int = 1) -> DataFrame:
    """Quota rows per class."""
    return items(drop_failed(made_conditional(quotas, class_means, generator, run))[0])


def made_novel(draws: DataFrame, class_means: DataFrame, generator: Generator | BatchGenerator, run: int = 1) -> DataFrame:
    """One request per class draw (``draw, intent_disc``)."""
    rows = lookup(draws.select(F.col("draw").alias("seq"), "intent_disc"), class_means, "intent_disc")
    requests = rows.select("seq", "intent_disc", F.col("class_mean").alias("intent_cont"),
                           (F.col("seq") + F.lit(run) * 1_000_003).alias("number"), build_request("brainstorm").alias("messages"))
    return _made("brainstorm", requests, generator, ["seq", "intent_disc", "intent_cont"])


def generate_novel(draws: DataFrame, class_means: DataFrame, generator: Generator | BatchGenerator, run: int = 1) -> DataFrame:
    """One row per class draw."""
    return items(drop_failed(made_novel(draws, class_means, generator, run))[0])


def generate_two_stage(quotas: DataFrame, class_means: DataFrame, generator: Generator | BatchGenerator, run: int = 1) -> DataFrame:
    """Conditional rows in two calls: first a concept sentence, then the prompt made of it."""
    concepts = generate_conditional(quotas, class_means, generator, run)
    requests = concepts.select((F.col("item") - STAGE_RANK["conditional"] * STAGE_ROOM).alias("seq"), "intent_disc", "intent_cont",
                               F.col("item").alias("number"), build_request("syntax", F.col("prompt")).alias("messages"))
    return items(drop_failed(_made("syntax", requests, generator, ["seq", "intent_disc", "intent_cont"], "conditional"))[0])


def best_of_k(candidates: DataFrame, low: float, high: float, keep: int = 2) -> DataFrame:
    """Of several candidates per seed (``seed_id, candidate, seed_prompt, prompt``) those inside the
    similarity band, least similar first."""
    w = Window.partitionBy("seed_id").orderBy("cosine", "candidate")
    scored = candidates.withColumn("cosine", vec.dot(vec.hash_unit("seed_prompt"), vec.hash_unit("prompt")))
    return (scored.where(F.col("cosine").between(low, high)).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= keep))


def diverse_of_k(candidates: DataFrame, low: float, high: float, keep: int = 2) -> DataFrame:
    """Of several candidates per seed (``seed_id, candidate, seed_prompt, prompt``) those inside the similarity band that differ most from
    each other: first the one least like the seed, then always the one whose greatest similarity to those taken is least.
    A seed has a handful of candidates, which stay together in one array."""
    shaped = candidates.select("seed_id", "candidate", vec.dot(vec.hash_unit("seed_prompt"), vec.hash_unit("prompt")).alias("cosine"),
                               vec.hash_unit("prompt").alias("v"))
    empty = F.array().cast("array<struct<near:double,cosine:double,candidate:int,v:array<double>>>")
    listed = shaped.where(F.col("cosine").between(low, high)).groupBy("seed_id").agg(F.collect_list(F.struct(
        F.col("cosine").alias("near"), "cosine", F.col("candidate").cast("int").alias("candidate"), F.col("v").cast("array<double>").alias("v"))).alias("left"))
    state = F.struct(F.col("left"), empty.alias("taken"))

    def take(s: Column, _: Column) -> Column:
        def picked(best: Column) -> Column:
            rest = F.filter(s["left"], lambda x: x["candidate"] != best["candidate"])
            nearer = F.transform(rest, lambda x: F.struct(
                F.when(F.size(s["taken"]) == 0, vec.dot(x["v"], best["v"])).otherwise(F.greatest(x["near"], vec.dot(x["v"], best["v"]))).alias("near"),
                x["cosine"].alias("cosine"), x["candidate"].alias("candidate"), x["v"].alias("v")))
            return F.struct(nearer.alias("left"), F.concat(s["taken"], F.array(best)).alias("taken"))
        # ordered by near, cosine and candidate
        return F.when(F.size(s["left"]) == 0, s).otherwise(tx.let(F.array_min(s["left"]), picked))
    done = listed.select("seed_id", F.aggregate(F.sequence(F.lit(1), F.lit(keep)), state, take).alias("s"))
    return done.select("seed_id", F.posexplode("s.taken").alias("at", "t")).select(
        "seed_id", F.col("t.candidate").alias("candidate"), (F.col("at") + 1).alias("rank"), F.col("t.near").alias("nearest"))


def language_quality(df: DataFrame, text: str, blocked: list[str]) -> DataFrame:
    """Flags of unusable texts: a blocked word, a word repeated at once, no letters."""
    words = F.split(F.lower(text), r"(?U)\W+")
    return (df.withColumn("has_blocked", F.arrays_overlap(words, F.array(*[F.lit(w) for w in blocked])))
            .withColumn("has_stutter", F.lower(text).rlike(r"(?U)\b(\w+)\s+\1\b"))
            .withColumn("no_letters", ~F.col(text).rlike(r"\p{L}"))
            .withColumn("usable", ~(F.col("has_blocked") | F.col("has_stutter") | F.col("no_letters"))))
