"""Metadata, skill routing and question types (survey P16-P24, P30-P32) as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

#: Patterns over the lower-cased question.
YES_NO = r"^(are|is|was|were|do|does|did|has|have|had|can|could|should|would)\b"
SUPERLATIVE = r"\b(first|largest|smallest|highest|lowest|oldest|youngest|top)\b"
ALIAS = r"\b(real name|full name|nickname|alternate name|also known as|formerly|stage name)\b"
TIME_OR_NUMBER = r"\b(when|what year|date|how many|how much|population|duration|height|age|count)\b"
KINSHIP = r"\b(mother|father|spouse|wife|husband|daughter|son|grandfather|grandmother|maternal|paternal|in-law)\b"
FORCED_CHOICE = r"\bor\b"
COMPARISON = r"\b(compare|same|both|older|younger|earlier|later|more|less|higher|lower)\b"
TEMPORAL_ANCHOR = r"\b(before|after|during|when|year|date|season|last|next|former|current)\b"
RELATION_CHAIN = (
    r"\b(director|author|founder|creator|composer|performer|writer|actor|actress|producer|mother|father|spouse|wife|husband|country|city|state|county"
    r"|birthplace|date of birth|death|school|university|alma mater)\b.*\b(of|who|whose|where)\b"
)
HOP_CONNECTOR = r"\b(of|who|whose|where|that|after|before|during|in which)\b"
#: Patterns of the evaluation router.
EVAL_COMPARISON = r"\b(compare|same|both|older|younger|earlier|later|more|less|higher|lower|born first|released first|came out first)\b"
DERIVED_KINSHIP = r"\b(maternal|paternal|grandfather|grandmother|great grandfather|great grandmother|mother-in-law|father-in-law|in-law)\b"
RELATION_OF = (
    r"\b(director|author|founder|creator|composer|performer|writer|actor|actress|producer|father|mother|spouse|wife|husband|place of birth|date of birth"
    r"|nationality|alma mater|school|university|burial|headquarters|country|city|state|county)\b.*\bof\b"
)
CONNECTOR = r"\b(of|whose|where|that|after|before|during|while)\b"
RELATION_MENTION = (
    r"\b(director|author|founder|creator|composer|performer|writer|actor|actress|producer|father|mother|spouse|wife|husband|country|city|state|county"
    r"|school|university|burial|death|birth)\b"
)
EVAL_TIME_OR_NUMBER = r"\b(when|what year|date|how many|how much|population|duration|height|age)\b"
CONSTRAINED = r"\b(which|what|who)\b.*\b(of|in|with|from|for)\b"
BRIDGE_LIKE = r"\b(which|who|what)\b.*\b(of|whose|from|in|with)\b"
ORGANISATION = r"\b(company|organization|network|team|university|corporation)\b"
EVAL_YES_NO_STARTS = ("are ", "is ", "was ", "were ", "do ", "does ", "did ", "has ", "have ", "had ", "can ", "could ")
#: Skills that only support, and skills whose presence rules out a verifier used as planner.
SUPPORT_ONLY = ("conflict-check", "reconstructed-chain-verification", "verbatim-evidence-span", "answer-grounding-check")
PLANNING = ("bridge-entity-search", "relation-chain-decomposition", "parallel-attribute-compare", "sequential-hop-checkpointing", "re-anchored-long-hop-decomposition")
SINGLE_HOP = ("nq", "triviaqa")


def low(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit("")))


def task_family(dataset: Column) -> Column:
    """P16."""
    return F.when(dataset.isin(*SINGLE_HOP), "singlehop").otherwise("multihop")


def estimated_hops(question: Column, decomposition_size: Column, hop_count: Column) -> Column:
    """By decomposition, else by hop count, else by connectors of the question."""
    hits = tx.count_matches(low(question), HOP_CONNECTOR)
    by_words = F.when(hits >= 3, 4).when(hits == 2, 3).when(hits == 1, 2).otherwise(1)
    return F.when(decomposition_size > 0, decomposition_size).when(hop_count > 0, hop_count).otherwise(by_words).cast("int")


def _follows(q: Column, pattern: str) -> Column:
    """Whether ``pattern``, one word and then another on the same line, occurs; in time linear in the text.

    Searched as it is, every left word of a line that lacks the right one walks to the line's end again. Here a line is
    entered at its start and its first left word is kept (an atomic group): what follows it holds all that follows others.
    """
    left, right = pattern.split(r"\b.*\b")
    return q.rlike(rf"(?Um)^(?>.*?{left}\b).*\b{right}")


def question_marks(question: Column) -> dict[str, Column]:
    """The eight booleans of the metadata summary."""
    q = low(question)
    patterns = {
        "is_yes_no": YES_NO, "has_alias_cue": ALIAS, "has_superlative": SUPERLATIVE, "has_kinship": KINSHIP,
        "has_forced_choice": FORCED_CHOICE, "has_comparison": COMPARISON, "has_temporal_anchor": TEMPORAL_ANCHOR,
    }
    return {name: tx.has(q, p) for name, p in patterns.items()} | {"looks_relation_chain": _follows(q, RELATION_CHAIN)}


def metadata_summary(
    question: Column, dataset: Column, question_type: Column, hops: Column, level: Column | None = None, flags: Column | None = None,
    wh_word: Column | None = None, entity_bin: Column | None = None, token_bin: Column | None = None, error_tag: Column | None = None,
) -> Column:
    """P18 as a struct of 16 keys, and the error tag for failure records; what is not given is null, flags are empty."""
    none = F.lit(None).cast("string")
    own = {"task_family": task_family(dataset), "estimated_hops": hops, "question_type": F.coalesce(question_type, F.lit("unknown"))}
    own |= {"level": none if level is None else level, "flags": F.coalesce(F.array().cast("array<string>") if flags is None else flags, F.array().cast("array<string>"))}
    own |= {n: none if c is None else c for n, c in (("wh_word", wh_word), ("entity_bin", entity_bin), ("token_bin", token_bin))}
    last = {} if error_tag is None else {"failure_error_tag": error_tag}
    return F.struct(*[c.alias(n) for n, c in (own | question_marks(question) | last).items()])


def _first(chosen: Column, legal: Column, limit: int = 5) -> Column:
    return F.slice(F.array_intersect(F.array_distinct(chosen), legal), 1, limit)


def primary_skills(question: Column, question_type: Column, dataset: Column, hops: Column, legal: Column) -> Column:
    """Skills by ordered rules, legal ones only, the first five."""
    kind = F.lower(F.coalesce(question_type, F.lit("")))
    facts = question_marks(question) | {"time": tx.has(low(question), TIME_OR_NUMBER), "words": tx.word_count(question), "hops": hops}
    return tx.let(F.struct(*[c.alias(n) for n, c in facts.items()]), lambda m: _primary(m, kind, dataset, legal))


def _primary(m: Column, kind: Column, dataset: Column, legal: Column) -> Column:
    hops = m["hops"]
    single, compare = task_family(dataset) == "singlehop", kind == "comparison"
    bridges = F.array_contains(legal, "bridge-entity-search")
    deep = (hops >= 3) | m["has_temporal_anchor"]
    chosen = tx.choices(
        (m["has_alias_cue"], "surface-name-resolution"),
        (m["has_superlative"], "superlative-ranking-match"),
        (m["has_forced_choice"] & single, "forced-choice-option-resolution"),
        (m["has_kinship"], "derived-kinship-inference-join"),
        (compare & deep, "bridge-comparison-planning"),
        (compare & ~deep, "parallel-attribute-compare"),
        (compare & m["is_yes_no"], "multihop-yes-no-verification"),
        (kind == "bridge", "bridge-entity-search"),
        (kind.isin("bridge", "compositional"), "relation-chain-decomposition"),
        (kind == "compositional", "sequential-hop-checkpointing"),
        (hops >= 4, "re-anchored-long-hop-decomposition"),
        (hops >= 3, "sequential-hop-checkpointing"),
        ((hops == 2) & bridges, "bridge-entity-search"),
        ((hops == 3) | ((hops == 2) & bridges), "relation-chain-decomposition"),
        (m["has_temporal_anchor"] & (hops >= 2), "temporal-anchor-carry-forward"),
        (m["time"], "temporal-range-extract"),
        (m["words"] >= 12, "multi-constraint-query-anchoring"),
        (single, "single-entity-relation-lookup"),
        (~single, "bridge-entity-search"),
        (~single, "relation-chain-decomposition"),
    )
    found = _first(chosen, legal)
    return F.when(F.size(found) > 0, found).otherwise(F.array_intersect(F.array(F.lit("single-entity-relation-lookup")), legal))


def support_skills(legal: Column) -> Column:
    """P20."""
    return F.array_intersect(F.array(*[F.lit(s) for s in SUPPORT_ONLY]), legal)


def failure_tag(question: Column, prediction: Column, wrong_skills: Column) -> Column:
    """The first kind of failure that fits."""
    q, joined = low(question), F.lower(F.array_join(wrong_skills, "|"))
    verifier = tx.any_cue(joined, ("verbatim-evidence-span", "answer-grounding-check")) & ~tx.any_cue(joined, PLANNING)
    said = F.lower(tx.strip(prediction)).isin("yes", "no")
    return (
        F.when(verifier, "verifier_as_planner")
        .when(tx.has(q, ALIAS), "alias_route_error")
        .when(tx.has(q, KINSHIP), "kinship_route_error")
        .when(tx.has(q, YES_NO), "yesno_aggregation_error")
        .when(said, "stopped_on_wrong_answer_type")
        .when(tx.has(q, SUPERLATIVE), "comparison_or_ranking_route_error")
        .when(tx.word_count(q) >= 14, "long_question_route_error")
        .otherwise("generic_route_error")
    )


def _type_facts(q: Column, question: Column) -> dict[str, Column]:
    patterns = {"compare": EVAL_COMPARISON, "ranking": SUPERLATIVE, "alias": ALIAS, "time_num": EVAL_TIME_OR_NUMBER}
    facts = {name: tx.has(q, p) for name, p in patterns.items()}
    return facts | {"constrained": _follows(q, CONSTRAINED), "yesno": tx.starts_with_any(q, EVAL_YES_NO_STARTS), "choice": F.contains(q, F.lit(" or ")), "words": tx.word_count(question)}


def _type(m) -> Column:
    named = F.when(m["yesno"], "yesno").when(m["compare"], "compare").when(m["choice"], "forced_choice").when(m["ranking"], "ranking").when(m["alias"], "alias").when(m["time_num"], "time_num")
    return named.when((m["words"] >= 12) | m["constrained"], "constraint_heavy").otherwise("fact")


def question_type(question: Column) -> Column:
    """P22."""
    return tx.let(low(question), lambda q: _type(_type_facts(q, q)))


def connector_count(question: Column) -> Column:
    """P23."""
    return tx.count_matches(low(question), CONNECTOR)


def explicit_relation(question: Column) -> Column:
    return _follows(low(question), RELATION_OF)


def _long(m) -> Column:
    return (m["links"] >= 4) | (m["mentions"] >= 3) | ((m["words"] >= 18) & (m["links"] >= 3))


def _hop_facts(q: Column) -> dict[str, Column]:
    return {"links": tx.count_matches(q, CONNECTOR), "mentions": tx.count_matches(q, RELATION_MENTION)}


def long_hop(question: Column) -> Column:
    return tx.let(low(question), lambda q: _long(_hop_facts(q) | {"words": tx.word_count(q)}))


def initial_skills(question: Column, available: Column) -> Column:
    """The evaluation router's skills, the first five that are available."""
    q = low(question)
    extra = {"derived": DERIVED_KINSHIP, "kinship": KINSHIP, "anchor": TEMPORAL_ANCHOR, "company": ORGANISATION}
    facts = _type_facts(q, question) | _hop_facts(q) | {name: tx.has(q, p) for name, p in extra.items()}
    facts |= {"bridge": _follows(q, BRIDGE_LIKE), "relation": _follows(q, RELATION_OF)}
    # All facts of a question are found once; the rules then look at booleans only.
    return tx.let(F.struct(*[c.alias(n) for n, c in facts.items()]), lambda m: _initial(m, available))


def _initial(m: Column, available: Column) -> Column:
    kind, far, relation, compare, anchor = _type(m), _long(m), m["relation"], m["compare"], m["anchor"]
    bridge = relation | m["bridge"]
    rules = [
        (kind == "yesno", "multihop-yes-no-verification"),
        (compare & bridge, "bridge-comparison-planning"),
        (compare, "parallel-attribute-compare"),
        (m["derived"] | (m["kinship"] & relation & far), "derived-kinship-inference-join"),
        (bridge, "bridge-entity-search"),
        (relation, "relation-chain-decomposition"),
        (far, "sequential-hop-checkpointing"),
        (far & anchor, "temporal-anchor-carry-forward"),
        (far, "re-anchored-long-hop-decomposition"),
        (far, "reconstructed-chain-verification"),
        (kind == "alias", "surface-name-resolution"),
        (kind == "ranking", "superlative-ranking-match"),
        (kind.isin("time_num", "ranking") | anchor, "temporal-range-extract"),
        ((kind == "forced_choice") & ~compare, "forced-choice-option-resolution"),
        (kind == "constraint_heavy", "multi-constraint-query-anchoring"),
    ]
    main = F.array_intersect(F.array_distinct(tx.choices(*rules)), available)
    lookup = F.when(F.size(main) == 0, F.array(F.lit("single-entity-relation-lookup"))).otherwise(main)
    tail = tx.choices((m["company"], "conflict-check"), (F.lit(True), "answer-grounding-check"))
    return _first(F.concat(lookup, tail), available)


def search_budget(question: Column, dataset: Column, explicit: Column) -> Column:
    """An explicit budget clamped to 1..5, else by data set, cues and length."""
    q, n = low(question), tx.word_count(question)
    cue = tx.any_cue(q, ("same", "both", "older", "younger", "earlier", "later", " or "))
    open_ = F.least(F.lit(3) + F.when(cue, 1).otherwise(0) + F.when(n >= 18, 1).otherwise(0), F.lit(5))
    flat = F.when(n <= 12, 2).otherwise(3)
    return F.when(F.coalesce(explicit, F.lit(0)) != 0, tx.clamp(explicit, 1, 5)).when(F.coalesce(dataset, F.lit("")).isin("nq", "triviaqa", "popqa"), flat).otherwise(open_).cast("int")


def dataset_name(name: Column) -> Column:
    """P31."""
    return F.when(name == "2wiki", "2wikimultihopqa").when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)


def with_question_mark(question: Column) -> Column:
    """P32."""
    plain = tx.strip(question)
    return F.when((plain != "") & ~F.endswith(plain, F.lit("?")), F.concat(plain, F.lit("?"))).otherwise(plain)
