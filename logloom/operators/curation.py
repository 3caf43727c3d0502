"""Curation of simulated trajectories: statistics, screening, ranking, judging, formatting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import canonical_json, task_order, word_ngrams, words
from logloom.operators.ordering import group_positions
from logloom.session import drop, materialize

# Fixed values of the screening rules.
LONG_TURNS, MANY_CALLS = 20, 15
TIERS = {"low": 0, "medium": 1, "high": 2}
NORMAL_ENDS = ["user_stop", "agent_stop"]


def _calls(m: Column) -> Column:
    return F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>"))


def _has_text(m: Column) -> Column:
    return F.coalesce(m["content"].rlike(r"(?U)\S"), F.lit(False))


def message_stats(messages: Column) -> dict[str, Column]:
    """Counts over a trajectory's messages; null or empty messages count 0."""
    role = lambda m, r: m["role"].eqNullSafe(F.lit(r))
    calls = F.aggregate(F.filter(messages, lambda m: role(m, "assistant")), F.lit(0), lambda a, m: a + F.size(_calls(m)))
    return {
        "message_count": F.when(messages.isNotNull(), F.size(messages)).otherwise(0),
        "assistant_turns": F.coalesce(F.size(F.filter(messages, lambda m: role(m, "assistant"))), F.lit(0)),
        "user_turns": F.coalesce(F.size(F.filter(messages, lambda m: role(m, "user"))), F.lit(0)),
        "tool_call_count": F.coalesce(calls, F.lit(0)),
        "tool_error_count": F.coalesce(F.size(F.filter(messages, lambda m: role(m, "tool") & F.coalesce(m["error"], F.lit(False)))), F.lit(0)),
        "mixed_count": F.coalesce(F.size(F.filter(messages, lambda m: role(m, "assistant") & (F.size(_calls(m)) > 0) & _has_text(m))), F.lit(0)),
    }


def assistant_tokens(messages: Column, usage: bool = True) -> dict[str, Column]:
    """Turns that the model made (with usage or calls; a fixed greeting has neither), their completion tokens and the longest prompt.

    ``usage`` tells whether messages have ``usage(prompt_tokens, completion_tokens)``.
    """
    own = F.filter(F.coalesce(messages, F.array()), lambda m: m["role"].eqNullSafe(F.lit("assistant")))
    used = (lambda m: m["usage"].isNotNull()) if usage else (lambda m: F.lit(False))
    part = lambda name: F.transform(own, lambda m: m["usage"][name].cast("long")) if usage else F.array().cast("array<bigint>")
    return {
        "turns": F.size(F.filter(own, lambda m: used(m) | (F.size(_calls(m)) > 0))), "completion_tokens": F.aggregate(part("completion_tokens"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))),
        "max_prompt_tokens": F.coalesce(F.array_max(part("prompt_tokens")), F.lit(0)),
    }


def simplify_messages(df: DataFrame, key: str) -> DataFrame:
    """One row a message: content is null where an assistant calls tools, error is false unless told."""
    rows = df.select(key, F.posexplode("messages").alias("pos", "m"))
    m = F.col("m")
    calls = F.when(m["role"] == "assistant", F.size(_calls(m))).otherwise(0)
    return rows.select(
        key, "pos", m["role"].alias("role"), F.when((m["role"] == "assistant") & (calls > 0), F.lit(None)).otherwise(m["content"]).alias("content"),
        F.when(m["role"] == "tool", m["tool_call_id"]).alias("tool_call_id"), F.when(m["role"] == "tool", F.coalesce(m["error"], F.lit(False))).alias("error"), calls.cast("int").alias("calls"),
    )


def _listed(*tests: tuple[Column, str]) -> Column:
    """The names whose test holds, sorted and once each."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())))


def screen(df: DataFrame) -> DataFrame:
    """Adds ``hard_reasons``, ``review_flags`` and ``hard_pass`` by the screening rules.

    A null reward, ending or count of turns is not a good one, a null db_match
    passes, null messages are missing ones.
    """
    messages = F.col("messages")
    assistant = F.filter(messages, lambda m: m["role"].eqNullSafe(F.lit("assistant")))
    bad_call = lambda c: (F.length(F.coalesce(c["name"], F.lit(""))) == 0) | ~F.coalesce(F.schema_of_variant(F.try_parse_json(c["arguments"])).startswith("OBJECT"), F.lit(False))
    any_ = lambda test: F.coalesce(F.exists(assistant, test), F.lit(False))
    hard = _listed(
        (~F.col("outcome.reward").eqNullSafe(F.lit(1.0)), "reward_zero"), (F.col("outcome.db_match") == F.lit(False), "db_mismatch"),
        (~F.coalesce(F.col("outcome.termination_reason").isin(NORMAL_ENDS), F.lit(False)), "abnormal_termination"), (messages.isNull() | (F.size(messages) == 0), "missing_messages"),
        (F.coalesce(F.col("stats.assistant_turns"), F.lit(0)) == 0, "missing_assistant_turn"), (any_(lambda m: F.exists(_calls(m), bad_call)), "malformed_tool_call"),
    )
    flags = _listed(
        (any_(lambda m: F.size(_calls(m)) > 1), "parallel_tool_calls"), (any_(lambda m: (F.size(_calls(m)) > 0) & _has_text(m)), "text_with_tool_call"),
        (F.col("stats.tool_error_count") > 0, "tool_error_needs_review"), (F.col("stats.assistant_turns") > LONG_TURNS, "long_trajectory"), (F.col("stats.tool_call_count") > MANY_CALLS, "many_tool_calls"),
    )
    return df.withColumn("hard_reasons", hard).withColumn("review_flags", flags).withColumn("hard_pass", F.size("hard_reasons") == 0)


def tier_order(tier: Column) -> Column:
    t = F.lower(F.trim(tier))
    out = F.lit(len(TIERS))
    for name, i in TIERS.items():
        out = F.when(t == name, i).otherwise(out)
    return out


def rank_key() -> list[Column]:
    """What orders candidates of a task; the trajectory id settles ties."""
    return [(~F.col("hard_pass")).asc(), F.size("review_flags").asc(), F.col("stats.tool_error_count").asc_nulls_last(), F.col("stats.assistant_turns").asc_nulls_last(), F.col("stats.tool_call_count").asc_nulls_last(), tier_order(F.col("tier")).asc(), F.col("trial").asc_nulls_last(), F.col("trajectory_id").asc()]


def rank_by_task(screened: DataFrame, task: Column) -> DataFrame:
    """``trajectory_id, task_id, task_rank`` (from 1); rows without a task are left out."""
    keys = {f"k{i}": k for i, k in enumerate([F.when(F.col("hard_pass"), 0).otherwise(1), F.size("review_flags"), F.coalesce("stats.tool_error_count", F.lit(1 << 30)), F.coalesce("stats.assistant_turns", F.lit(1 << 30)), F.coalesce("stats.tool_call_count", F.lit(1 << 30)), tier_order(F.col("tier")), F.coalesce("trial", F.lit(1 << 30))])}
    rows = screened.select("trajectory_id", task.alias("task_id"), "hard_pass", *[v.alias(k) for k, v in keys.items()]).filter("task_id IS NOT NULL")
    return group_positions(rows, F.col("task_id"), [*[F.col(k).asc() for k in keys], F.col("trajectory_id").asc()], "task_rank").select("trajectory_id", "task_id", F.col("task_rank").cast("int").alias("task_rank"), "hard_pass")


def judge_decision(confidence: Column, checks: Sequence[Column], tool_error_resolved: Column, has_tool_errors: Column, threshold: float = 0.8) -> Column:
    """needs_human_review below the threshold, accepted if all checks hold, else rejected; null for no usable confidence."""
    all_hold = F.lit(True)
    for c in checks:
        all_hold = all_hold & F.coalesce(c, F.lit(False))
    all_hold = all_hold & (~has_tool_errors | F.coalesce(tool_error_resolved, F.lit(False)))
    usable = confidence.isNotNull() & ~F.isnan(confidence)
    return F.when(usable & (confidence < threshold), "needs_human_review").when(usable & all_hold, "accepted").when(usable, "rejected")


def quality_score(confidence: Column, stats: Column, flags: Column) -> Column:
    """Confidence less penalties for tool errors, length and many calls; never below 0."""
    off = 0.02 * F.least(stats["tool_error_count"], F.lit(3)) + 0.002 * F.greatest(stats["assistant_turns"] - 10, F.lit(0))
    for flag in ("long_trajectory", "many_tool_calls"):
        off = off + F.when(F.array_contains(flags, flag), 0.04).otherwise(0.0)
    return F.greatest(confidence - off, F.lit(0.0))


def training_messages(df: DataFrame, greetings: Sequence[str], system_prompt: str) -> DataFrame:
    """``messages`` for training: no canned greeting at the start, no user message at the end, the system prompt before all."""
    m = F.col("messages")
    first = F.when((F.get(m, F.lit(0))["role"] == "assistant") & F.get(m, F.lit(0))["content"].isin(list(greetings)), 2).otherwise(1)
    last = F.coalesce(F.array_max(F.transform(m, lambda x, i: F.when(~x["role"].eqNullSafe(F.lit("user")), i + 1))), F.lit(0))
    kept = F.slice(m, first, F.greatest(last - first + 1, F.lit(0)))
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"), F.lit(None).cast("int").alias("turn_idx"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("boolean").alias("error"), F.array().cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls")))
    return df.filter(F.size(m) > 0).withColumn("messages", F.concat(head, kept))


def conversation_errors(messages: Column) -> Column:
    """What a training conversation breaks, sorted: its ends, the order of roles, calls and their results."""
    pairs = F.zip_with(F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), F.slice(messages, 2, F.size(messages)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    with_call = lambda m: m["role"].eqNullSafe(F.lit("assistant")) & (F.size(_calls(m)) > 0)
    want = lambda p: F.when(p["a"]["role"] == "system", "user").when(p["a"]["role"] == "user", "assistant").when(p["a"]["role"] == "tool", "assistant").when(with_call(p["a"]), "tool").otherwise("user")
    ids = F.array_sort(F.flatten(F.transform(F.filter(messages, with_call), lambda m: F.transform(_calls(m), lambda c: c["id"]))))
    answers = F.array_sort(F.transform(F.filter(messages, lambda m: m["role"] == "tool"), lambda m: m["tool_call_id"]))
    end = F.element_at(messages, -1)
    return _listed(
        (F.size(messages) < 3, "too_short"), (~F.get(messages, F.lit(0))["role"].eqNullSafe(F.lit("system")), "no_system"), (~(end["role"].eqNullSafe(F.lit("assistant")) & (F.size(_calls(end)) == 0)), "bad_end"),
        (F.exists(pairs, lambda p: ~p["b"]["role"].eqNullSafe(want(p))), "bad_transition"), (F.exists(messages, lambda m: F.size(_calls(m)) > 1), "parallel_calls"), (~ids.eqNullSafe(answers), "unpaired_calls"),
    )


def loose_error(messages: Column) -> Column:
    """The first thing that the looser check of a conversation minds; null for none: roles and turns in order, then pairs, then no assistant."""
    blank = lambda m: ~_has_text(m)
    of = lambda m: F.when(~F.coalesce(m["role"].isin("system", "user", "assistant", "tool"), F.lit(False)), "unsupported role").when((m["role"] == "assistant") & (blank(m) == (F.size(_calls(m)) == 0)), "neither or both of text and calls")
    turn = F.get(F.filter(F.transform(messages, of), lambda e: e.isNotNull()), F.lit(0))
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    ids = F.array_sort(F.flatten(F.transform(own, lambda m: F.transform(_calls(m), lambda c: c["id"]))))
    answers = F.array_sort(F.transform(F.filter(messages, lambda m: m["role"] == "tool"), lambda m: m["tool_call_id"]))
    return F.coalesce(turn, F.when(~ids.eqNullSafe(answers), "calls and results don't pair"), F.when(F.size(own) == 0, "no assistant"))


def turn_error(m: Column, requestor: Column | None = None) -> Column:
    """Why a session refuses a message: an assistant or user turn has either text or calls, assistants call for themselves, users call nothing."""
    text, call = _has_text(m), F.size(_calls(m)) > 0
    for_others = (requestor != "assistant") if requestor is not None else F.lit(False)
    own = F.when(~text & ~call, "empty").when(text & call, "text and calls")
    return F.when(m["role"] == "assistant", own.when(call & for_others, "calls for another")).when(m["role"] == "user", own.when(call, "users call nothing"))


def recoveries(df: DataFrame, key: str) -> DataFrame:
    """One row for each failed call and what came next.

    ``missing_response``, ``ask_user`` (a user message strictly before the next
    call), ``abandon`` (no further call), ``alternate_tool``, ``exact_retry``
    or ``corrected_retry``.  All inside one row's message array: no shuffle.
    """
    calls = F.flatten(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", F.transform(_calls(m), lambda c, j: F.struct(i.alias("at"), j.alias("n"), c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments")))).otherwise(F.array().cast("array<struct<at:int,n:int,id:string,name:string,arguments:string>>"))))
    answers = F.transform(F.filter(F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), m["tool_call_id"].alias("id"), F.coalesce(m["error"], F.lit(False)).alias("error"), i.alias("at"))), lambda m: m["role"] == "tool"), lambda m: F.struct(m["id"].alias("id"), m["error"].alias("error"), m["at"].alias("at")))
    users = F.filter(F.transform("messages", lambda m, i: F.when(m["role"] == "user", i)), lambda x: x.isNotNull())
    rows = df.select(key, calls.alias("calls"), answers.alias("answers"), users.alias("users")).select(key, "calls", "answers", "users", F.posexplode("calls").alias("ord", "c"))
    found = rows.select(key, "ord", "c", "users", F.get("calls", F.col("ord") + 1).alias("nx"), F.get(F.filter("answers", lambda a: a["id"] == F.col("c.id")), F.lit(0)).alias("r"))
    failed = found.filter(F.col("r").isNull() | F.col("r.error"))
    asked = F.array_min(F.filter("users", lambda u: u > F.col("r.at")))
    same = canonical_json(F.col("nx.arguments")).eqNullSafe(canonical_json(F.col("c.arguments")))
    kind = (
        F.when(F.col("r").isNull(), "missing_response").when(asked.isNotNull() & (F.col("nx").isNull() | (asked < F.col("nx.at"))), "ask_user").when(F.col("nx").isNull(), "abandon")
        .when(~F.col("nx.name").eqNullSafe(F.col("c.name")), "alternate_tool").when(same, "exact_retry").otherwise("corrected_retry")
    )
    return failed.select(key, "ord", F.col("c.name").alias("name"), kind.alias("recovery"))


def text_of(messages: Column) -> Column:
    """User and assistant text of a trajectory, in order."""
    said = F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (F.length(m["content"]) > 0))
    return F.array_join(F.transform(said, lambda m: m["content"]), " ")


def grams(messages: Column) -> Column:
    return word_ngrams(words(text_of(messages)))


def trace(messages: Column) -> Column:
    """The hashes of an assistant's calls in order: name and canonical arguments."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.flatten(F.transform(own, lambda m: F.transform(_calls(m), lambda c: F.xxhash64(F.coalesce(c["name"], F.lit("")), F.coalesce(canonical_json(c["arguments"]), c["arguments"], F.lit(""))))))


def match_ratio(a: Column, b: Column) -> Column:
    """Twice the matched elements over all of two sequences; 1 where both are empty."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, list(p), list(q)).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(ratios, "double")(a, b)


#: Eligible rows that one task chooses from; a larger pool is chosen from pick by pick, with the same result.
MOST_ELIGIBLE = 20_000


def select_greedily(eligible: DataFrame, target: int, least: int) -> DataFrame:
    """The two-phase greedy choice: ``trajectory_id, task_id, phase, score, selected_index``.

    ``eligible(trajectory_id, task_id, tier, quality, task_rank, grams, trace)``.
    Each pick changes the scores of the rest, so picks follow one another.  A
    pick changes only the scores of its own task and, alike, of all rows of a
    tier.  So of a large pool the best row of each task and tier is enough to
    choose from, and after a pick only its task is looked at again.  Tasks with
    fewer than ``least`` rows give what they have; a pool smaller than
    ``target`` is chosen whole.
    """
    if eligible.count() > MOST_ELIGIBLE:
        return eligible.sparkSession.createDataFrame(list(_stepwise(eligible, target, least)), _CHOSEN)  # at most ``target`` rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_greedy(pdf, target, least)), columns=["trajectory_id", "task_id", "phase", "score", "selected_index"])

    return eligible.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, _CHOSEN)


_CHOSEN = "trajectory_id string, task_id string, phase string, score double, selected_index int"


class _Balance:
    """What all picks so far say of the next one's score."""

    def __init__(self, target: int) -> None:
        self.quota = {"low": target // 4, "medium": target // 2}
        self.quota["high"] = target - self.quota["low"] - self.quota["medium"]
        self.taken: dict[str, int] = {}
        self.per_task: dict[str, int] = {}
        self.count = 0

    def score(self, r: dict) -> tuple:
        q = self.quota.get(r["tier"], 0)
        need = max(q - self.taken.get(r["tier"], 0), 0) / max(q, 1)
        combined = 0.70 * r["quality"] + 0.20 * (1 - r["near"]) + 0.06 * need + 0.04 / (self.per_task.get(r["task_id"], 0) + 1)
        return combined, -r["task_rank"], r["trajectory_id"]

    def take(self, best: dict, phase: str) -> tuple:
        won = self.score(best)[0]
        self.taken[best["tier"]] = self.taken.get(best["tier"], 0) + 1
        self.per_task[best["task_id"]] = self.per_task.get(best["task_id"], 0) + 1
        self.count += 1
        return best["trajectory_id"], best["task_id"], phase, round(won, 6), self.count


def _likeness(a: dict, b: dict) -> float:
    """Similarity of two rows whose ``grams`` are sets and ``trace`` lists."""
    union = len(a["grams"] | b["grams"])
    text = len(a["grams"] & b["grams"]) / union if union else 1.0
    return 0.75 * text + 0.25 * SequenceMatcher(None, a["trace"], b["trace"]).ratio()


def _stepwise(eligible: DataFrame, target: int, least: int) -> Iterator[tuple]:
    """The picks of ``_greedy`` from a pool of any size: the driver holds the best rows of some tasks and the picks, nothing else."""
    rows, state = materialize(eligible, "eligible", by=["task_id"]), _Balance(target)
    head = F.struct("trajectory_id", "task_id", "tier", "quality", "task_rank", "near")
    best_of = lambda df: df.groupBy("task_id", "tier").agg(F.max_by(head, F.struct(0.70 * F.col("quality") + 0.20 * (1 - F.col("near")), -F.col("task_rank"), "trajectory_id")).alias("r")).select("r.*")
    bests = materialize(best_of(rows.withColumn("near", F.lit(0.0))), "bests")
    pool: dict[tuple[str, str], dict] = {}
    picked: dict[str, list[dict]] = {}

    def hold(found: DataFrame) -> None:
        pool.update({(r.task_id, r.tier): r.asDict() for r in found.collect()})

    def pick(best: dict, phase: str) -> tuple:
        task = best["task_id"]
        full = rows.filter((F.col("task_id") == task) & (F.col("trajectory_id") == best["trajectory_id"])).select("grams", "trace").first()
        own = picked.setdefault(task, [])
        own.append({"id": best["trajectory_id"], "grams": set(full.grams), "trace": list(full.trace)})
        for key in [k for k in pool if k[0] == task]:
            del pool[key]

        def near(grams: pd.Series, trace: pd.Series) -> pd.Series:
            return pd.Series([max(_likeness({"grams": set(g), "trace": list(t)}, p) for p in own) for g, t in zip(grams, trace, strict=True)], dtype=float)

        left = rows.filter((F.col("task_id") == task) & ~F.col("trajectory_id").isin([p["id"] for p in own]))
        out = state.take(best, phase)
        hold(best_of(left.withColumn("near", F.pandas_udf(near, "double")("grams", "trace"))))
        return out

    tasks = [r.task_id for r in bests.select("task_id").distinct().orderBy(*task_order(F.col("task_id"))).limit(target).collect()]
    hold(bests.filter(F.col("task_id").isin(tasks)))
    for task in tasks:
        for _ in range(least):
            held = [r for k, r in pool.items() if k[0] == task]
            if held and state.count < target:
                yield pick(max(held, key=state.score), "task_coverage")
    # Untouched tasks: no more than ``target`` of a tier can be picked, so their best of each tier are enough.
    fresh = bests.filter(~F.col("task_id").isin(list(picked)))
    ranked = group_positions(fresh, F.col("tier"), [F.col("quality").desc(), F.col("task_rank").asc(), F.col("trajectory_id").desc()], "place").filter(F.col("place") <= target).drop("place")
    for key in [k for k in pool if k[0] not in picked]:
        del pool[key]
    hold(ranked)
    while state.count < target and pool:
        yield pick(max(pool.values(), key=state.score), "global_diversity")
    drop(rows, bests)


def _greedy(pdf: pd.DataFrame, target: int, least: int) -> Iterator[tuple]:
    rows, state = [dict(zip(pdf.columns, r, strict=True)) for r in pdf.itertuples(index=False)], _Balance(target)
    by_task: dict[str, list[dict]] = {}
    for r in rows:
        r["grams"], r["trace"], r["near"] = set(r["grams"]), list(r["trace"]), 0.0
        by_task.setdefault(r["task_id"], []).append(r)

    def pick(pool: list[dict], phase: str) -> tuple:
        best = max(pool, key=state.score)
        by_task[best["task_id"]].remove(best)
        for other in by_task[best["task_id"]]:
            other["near"] = max(other["near"], _likeness(other, best))
        return state.take(best, phase)

    for task in sorted(by_task, key=lambda t: (not t.isdigit(), int(t) if t.isdigit() else 0, t)):
        for _ in range(least):
            if by_task[task] and state.count < target:
                yield pick(by_task[task], "task_coverage")
    # One best row a task is enough for the next pick: only the picked task's scores change within it, the tier term changes for all.
    while state.count < target and any(by_task.values()):
        yield pick([max(pool, key=state.score) for pool in by_task.values() if pool], "global_diversity")
