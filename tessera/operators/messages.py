"""Parsing and packing of turns (survey P25-P33, R2-R11, R13) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import routing, text as tx

from .packets import skill_cards
from .sampling import segmented

SEARCH, ANSWER, SKILL = r"(?is)<search>(.*?)</search>", r"(?is)<answer>(.*?)</answer>", r"(?is)<skill>(.*?)</skill>"
#: Skills whose presence raises the copies of a row in focus mode.
CRITICAL = ("bridge-entity-search", "relation-chain-decomposition", "parallel-attribute-compare", "bridge-comparison-planning", "multihop-yes-no-verification", "temporal-range-extract", "temporal-anchor-carry-forward", "sequential-hop-checkpointing")
#: Core skills of multi-hop rows.
MULTI_CORE = ("bridge-entity-search", "bridge-comparison-planning", "bridge-disambiguate-then-hop", "relation-chain-decomposition", "parallel-attribute-compare", "multihop-yes-no-verification", "temporal-anchor-carry-forward", "temporal-range-extract", "sequential-hop-checkpointing", "re-anchored-long-hop-decomposition", "derived-kinship-inference-join", "reconstructed-chain-verification")
#: Core skills of single-hop rows.
SINGLE_CORE = ("single-entity-relation-lookup", "surface-name-resolution", "forced-choice-option-resolution", "temporal-range-extract", "conflict-check")
#: Multi-hop data sets.
MULTI_SETS = ("hotpotqa", "2wiki", "musique")
DEFAULT_TAG = "answer-grounding-check"
#: Follow-up of a retrieval turn, in our words.
FOLLOW_UP = "<information>\n{}\n</information>"


def _fill(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def render(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` marks, filled from columns; nulls are empty."""
    out, rest = [], template
    while rest:
        before, open_, after = rest.partition("{")
        name, close, tail = after.partition("}")
        if open_ and close and name in parts:
            out += [F.lit(before), F.coalesce(parts[name].cast("string"), F.lit(""))]
            rest = tail
        else:
            out.append(F.lit(before + open_))
            rest = after
    return F.concat(*out) if out else F.lit("")


def _s(value: Column) -> Column:
    return tx.strip(F.coalesce(value, F.lit("")))


def split_contents(document: Column) -> Column:
    """R2: struct<contents, title, text array<string>> -> struct<title, text>.

    ``contents`` has the title in its first line; without it, title and the joined texts take its place.
    """
    joined = F.concat(F.coalesce(document["title"], F.lit("")), F.lit("\n"), F.coalesce(F.array_join(document["text"], " "), F.lit("")))
    whole = F.coalesce(document["contents"], tx.strip(joined))
    end = F.instr(whole, "\n")
    return F.struct(
        F.when(end > 0, F.substring(whole, F.lit(1), end - 1)).otherwise(whole).alias("title"),
        F.when(end > 0, F.substring(whole, end + 1, F.length(whole))).otherwise(F.lit("")).alias("text"),
    )


def passages(docs: Column, quoted: bool = False) -> Column:
    """``Doc i(Title: T) text`` lines of array<struct<title, text>>; quotes around titles are taken off or set."""

    def title(d: Column) -> Column:
        plain = F.regexp_replace(_s(d["title"]), '^"+|"+$', "")
        return F.concat(F.lit('"'), plain, F.lit('"')) if quoted else plain

    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), title(d), F.lit(") "), _s(d["text"]))), "\n")


def parse_turn(text: Column) -> Column:
    """The first of a search and an answer tag: struct<action, query, kept>, the text cut after it."""
    plain = _s(text)
    search, answer = F.regexp_instr(plain, F.lit(SEARCH)), F.regexp_instr(plain, F.lit(ANSWER))
    seek = (search > 0) & ((answer == 0) | (search < answer))

    def upto(pattern: str, at: Column) -> Column:
        return F.substring(plain, F.lit(1), at - 1 + F.length(F.regexp_substr(plain, F.lit(pattern))))

    kept = F.when(seek, upto(SEARCH, search)).when(answer > 0, upto(ANSWER, answer)).otherwise(plain)
    return F.struct(F.when(seek, "search").otherwise("final").alias("action"), F.when(seek, _s(F.regexp_extract(plain, SEARCH, 1))).alias("query"), tx.strip(kept).alias("kept"))


def last_answer(text: Column) -> Column:
    return _s(F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANSWER), 1), F.lit(-1)))


def prediction(transcript: Column, final_turn: Column) -> Column:
    """The last answer tag of the transcript, else of the final turn; nothing where only a search tag dangles; else
    the final turn itself."""
    low, whole, last = F.lower(_s(final_turn)), F.coalesce(transcript, F.lit("")), F.coalesce(final_turn, F.lit(""))
    dangling = tx.any_cue(low, ("<search", "</search>")) | low.isin("/search", "search")
    return F.when(whole.rlike(ANSWER), last_answer(whole)).when(last.rlike(ANSWER), last_answer(last)).when(dangling, "").otherwise(_s(last))


def skills(text: Column, first_only: bool = False) -> Column:
    """Skills named in skill tags, split at bars, distinct in order; or the first one."""
    found = tx.distinct_in_order(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SKILL), 1), lambda s: F.split(s, r"\|"))))
    return F.get(found, F.lit(0)) if first_only else found


def markup_title(html: Column) -> Column:
    """R4 on pages: the text of the title element."""
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def step_action(step: Column) -> Column:
    """Search or answer of a teacher's step."""
    raw, query, answer = F.lower(_s(step["action"])), _s(step["query"]), _s(step["draft_answer"])
    return F.when(raw == "search", "search").when((raw == "verify") & (query != ""), "search").when(raw.isin("verify", "answer"), "answer").when(query != "", "search").when(answer != "", "answer").otherwise("search")


def skill_tags(step: Column, most: int) -> Column:
    """P28."""
    named = tx.distinct_in_order(F.concat(F.array(step["primary_skill"]), F.coalesce(step["support_skills"], F.array().cast("array<string>"))))
    return F.slice(F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(DEFAULT_TAG))), 1, max(1, most))


def quality_score(steps: Column, meta: Column, origin: Column, failed: Column) -> Column:
    """P25: 100 and what steps, the last skill and the question's marks add or take."""
    n = F.size(steps)
    last = F.coalesce(F.try_element_at(steps, F.lit(-1))["primary_skill"], F.lit(""))

    def when(c: Column, points: int) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)

    score = F.lit(100) + F.when(n.isin(4, 5), 18).when(n.isin(3, 6), 12).when(n == 7, 4).otherwise(-4) + when(~last.isin(*routing.SUPPORT_ONLY), 8) + when(meta["estimated_hops"] >= 3, 6)
    for mark, points in (("has_comparison", 5), ("is_yes_no", 4), ("has_temporal_anchor", 4), ("has_superlative", 3), ("has_kinship", 3), ("has_forced_choice", 2), ("looks_relation_chain", 2)):
        score = score + when(meta[mark], points)
    return score + when(origin == "failure_replay", -2) + when(failed, -4)


def repeat_factor(dataset: Column, first_skill: Column, meta: Column, origin: Column, focus: str | None = None, focus_times: int = 2, bonus: int = 1, most: int = 4) -> Column:
    """Copies of a row, in focus mode for one data set, else balanced."""

    def on(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), bonus).otherwise(0)

    hard = meta["has_comparison"] | meta["is_yes_no"] | meta["has_temporal_anchor"] | meta["has_forced_choice"] | meta["looks_relation_chain"] | (meta["estimated_hops"] >= 3)
    if focus is not None:
        own = F.when(dataset == focus, F.greatest(F.lit(1), F.lit(focus_times)) + on(hard | first_skill.isin(*CRITICAL))).otherwise(1)
    else:
        single, multi = dataset.isin(*routing.SINGLE_HOP), dataset.isin(*MULTI_SETS)
        own = F.lit(1) + on(single) + on(hard) + on(single & ((meta["estimated_hops"] <= 1) | meta["has_alias_cue"] | first_skill.isin(*SINGLE_CORE))) + on(multi & first_skill.isin(*MULTI_CORE))
    return tx.clamp(own + on(origin == "failure_replay"), 1, most)


def turn_weights(messages: Column, final_only: bool = False) -> Column:
    """A weight for each message: 1 for supervised assistant turns, else 0."""
    last = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i).otherwise(-1)))
    return F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & ((i == last) if final_only else F.lit(True)), 1.0).otherwise(0.0))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pack_retrieval(system: str, intro: Column, steps: Column, question: Column, final_answer: Column, most_chars: int = 4000, most_tags: int = 2) -> Column:
    """Messages in the style of retrieval tags."""

    def turn(s: Column) -> Column:
        tags = F.concat(F.lit("<skill>"), F.array_join(skill_tags(s, most_tags), "|"), F.lit("</skill>\n"))
        query = F.when(_s(s["query"]) != "", _s(s["query"])).otherwise(_s(question))
        answer = F.when(_s(s["draft_answer"]) != "", _s(s["draft_answer"])).otherwise(_s(final_answer))
        body = F.when(step_action(s) == "search", F.concat(F.lit("<search>"), query, F.lit("</search>"))).otherwise(F.concat(F.lit("<answer>"), answer, F.lit("</answer>")))
        back = _s(s["retrieved"])
        return F.array_compact(F.array(_message("assistant", F.concat(tags, body)), F.when(back != "", _message("user", _fill(FOLLOW_UP, F.substring(back, 1, most_chars))))))

    return F.concat(F.array(_message("system", F.lit(system)), _message("user", intro)), F.flatten(F.transform(steps, turn)))


#: Closing request of the styles that ask for one action as JSON, in our words.
NEXT_ACTION = "Give the next action as one JSON object."


def _named_first(question: Column, dataset: Column, skills_: Column, more: Column | None = None) -> Column:
    parts = [F.lit("Question: "), _s(question), F.lit("\nDataset: "), F.coalesce(dataset, F.lit("")), *([] if more is None else [more])]
    return F.concat(*parts, F.lit("\nCandidate primary skills: "), F.array_join(F.coalesce(skills_, F.array().cast("array<string>")), ", "), F.lit(f"\n{NEXT_ACTION}"))


def _retrieved(s: Column, most_chars: int) -> Column:
    back = _s(s["retrieved"])
    return F.when(back != "", _message("user", F.concat(F.lit("Retriever results:\n"), F.substring(back, 1, most_chars), F.lit(f"\n{NEXT_ACTION}"))))


def pack_json(question: Column, dataset: Column, hops: Column, candidates: Column, steps: Column, most_chars: int = 4000) -> Column:
    """Messages in the style of JSON actions; candidates distinct in order, unknown hops are called so."""
    told = F.concat(F.lit("\nEstimated hops: "), F.coalesce(hops.cast("string"), F.lit("unknown")))
    none = F.array().cast("array<string>")

    def turn(s: Column) -> Column:
        texts = {n: ("text", F.coalesce(s[n], F.lit(""))) for n in ("primary_skill", "action", "query", "draft_answer")}
        shown = [("primary_skill", texts), ("support_skills", {"support_skills": ("texts", F.coalesce(s["support_skills"], none))}), ("action", texts), ("query", texts), ("checkpoint", None), ("draft_answer", texts)]
        pairs = [F.lit('"checkpoint": {}') if own is None else tx.json_pair(n, *own[n]) for n, own in shown]
        return F.array_compact(F.array(_message("assistant", F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))), _retrieved(s, most_chars)))

    first = _message("user", _named_first(question, dataset, tx.distinct_in_order(candidates), told))
    return F.concat(F.array(first), F.flatten(F.transform(steps, turn)))


def pack_simple(question: Column, dataset: Column, candidates: Column, steps: Column, most_chars: int = 8000) -> Column:
    """An intro, then each step in a loose notation, its values not escaped, and what it retrieved."""

    def turn(s: Column) -> Column:
        support = F.transform(F.coalesce(s["support_skills"], F.array().cast("array<string>")), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
        own = {"primary_skill": None, "support_skills": F.concat(F.lit("["), F.array_join(support, ", "), F.lit("]")), "action": None, "query": None, "draft_answer": None}
        lines = [F.concat(F.lit(f'  "{n}": '), c if c is not None else F.concat(F.lit('"'), F.coalesce(s[n], F.lit("")), F.lit('"'))) for n, c in own.items()]
        return F.array_compact(F.array(_message("assistant", F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))), _retrieved(s, most_chars)))

    return F.concat(F.array(_message("user", _named_first(question, dataset, candidates))), F.flatten(F.transform(steps, turn)))


#: Lines of a packed user turn that the two-phase form replaces, by their start or as a whole.
REPLACED_STARTS, REPLACED_LINE = ("Recommended skills:", "Start with <skill>"), "Stop immediately after the closing tag."
#: Requests of the two phases, in our words.
CHOOSE = "Name the skills for the next turn inside one <select_skill> tag, with bars between them."
ACT = "Act with these skills now: {}"


def first_tag_skills(text: Column) -> Column:
    """The distinct skills of the first skill tag."""
    return tx.distinct_in_order(F.split(F.regexp_extract(F.coalesce(text, F.lit("")), SKILL, 1), r"\|"))


def _with_index(content: Column, index: Column) -> Column:
    def stays(line: Column) -> Column:
        return ~(tx.starts_with_any(tx.strip(line), REPLACED_STARTS) | (tx.strip(line) == REPLACED_LINE))

    base = tx.strip(F.array_join(F.filter(F.split(content, r"\r\n|\r|\n"), stays), "\n"))
    return tx.strip(F.concat(base, F.lit("\n\n"), index, F.lit(f"\n\n{CHOOSE}")))


def repack_two_phase(rows: DataFrame, bank: Column, index: Column, system: str = "", most_chars: int = 900) -> DataFrame:
    """Each assistant turn becomes a choice of its skills, their cards, and the turn itself.

    ``rows``: id and messages array<struct<role, content>>; ``bank``: map of skill to card text. ``packed`` has the new
    messages, ``drop_reason`` the fault of the first message that has one, in which case ``packed`` is null.
    """
    none = F.array().cast("array<struct<role:string,content:string>>")
    known = F.map_keys(bank)

    def fault(said: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            ids = first_tag_skills(m["content"])
            before = F.get(said, F.greatest(i - 1, F.lit(0)))["role"]
            answered = F.when((i == 0) | (before != "user"), "assistant_without_user")
            wrong = F.when(F.size(ids) == 0, "missing_skill_tag").when(F.size(F.array_except(ids, known)) > 0, "unknown_skill").otherwise(answered)
            return F.when(m["role"] == "assistant", wrong).when(m["role"] != "user", F.concat(F.lit("unsupported_role_"), m["role"]))

        return F.get(F.array_compact(F.transform(said, one)), F.lit(0))

    def parts(m: Column) -> Column:
        ids, content = first_tag_skills(m["content"]), _s(m["content"])
        chosen = _message("assistant", F.concat(F.lit("<select_skill>"), F.array_join(ids, "|"), F.lit("</select_skill>")))
        cards = F.concat(skill_cards(ids, bank, most_chars), F.lit("\n\n"), _fill(ACT, F.array_join(ids, "|")))
        turn = F.array(chosen, _message("user", cards), _message("assistant", content))
        return F.when(m["role"] == "assistant", turn).otherwise(F.array(_message("user", _with_index(content, index))))

    whole = F.transform(F.coalesce("messages", none), lambda m: F.struct(F.coalesce(m["role"], F.lit("None")).alias("role"), m["content"].alias("content")))
    said = rows.withColumn("__all", F.size(whole)).withColumn("__said", F.filter(whole, lambda m: m["role"] != "system"))
    turns = F.size(F.filter("__said", lambda m: m["role"] == "assistant"))
    reason = F.when(F.col("__all") == 0, "missing_messages").otherwise(F.coalesce(fault(F.col("__said")), F.when(turns == 0, "no_assistant_turns")))
    packed = F.concat(F.array(_message("system", F.lit(system))), F.flatten(F.transform("__said", parts)))
    judged = said.withColumn("drop_reason", reason).withColumn("action_turns", F.when(F.col("drop_reason").isNull(), turns))
    return judged.withColumn("packed", F.when(F.col("drop_reason").isNull(), packed)).drop("__all", "__said")


def ordered_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) -> messages in order of turn."""
    return turns.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def prompt_rows(rows: DataFrame, split: str, instruction: str) -> DataFrame:
    """Nested rows for reinforcement learning from (id, question, golden_answers, dataset)."""
    q = routing.with_question_mark(F.col("question"))
    prompt = F.array(_message("user", F.concat(F.lit(instruction), F.lit("\n"), q)))
    name = routing.dataset_name(F.col("dataset"))
    # Data sets are few and of any size, so a row's place in its own comes from a sort by ranges.
    rows = segmented(rows, ["dataset"], ["id"])
    order = F.col("__rank") - 1
    budget = routing.search_budget(F.col("question"), F.col("dataset"), F.lit(None).cast("int"))
    extra = F.struct(F.lit(split).alias("split"), order.alias("index"), budget.alias("search_budget"), name.alias("source_dataset"), F.col("id").cast("string").alias("source_id"))
    model = F.struct(F.lit("rule").alias("style"), F.struct(F.col("golden_answers").alias("target")).alias("ground_truth"))
    return rows.select(F.col("id").cast("string").alias("id"), q.alias("question"), "golden_answers", name.alias("data_source"), prompt.alias("prompt"), F.lit("fact-reasoning").alias("ability"), model.alias("reward_model"), extra.alias("extra_info"))
