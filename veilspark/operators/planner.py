"""Plans of balanced synthetic corpora and documents from templates.

Allocation works on a few numbers and runs on the driver; a plan of any length is generated as a DataFrame from the
allocation, and documents are generated map-only. Values follow from hashes of the row's seed, so a plan gives the
same documents on any cluster.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.scalars import field_title, seed_of

# Shares that plans must keep.
SPLIT_SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}
LANGUAGE_SHARES = {"en": 0.50, "de": 0.50}
POSITIVE_RATE, BLANK_RATE, MOST_POSITIVE = 0.12, 0.05, 0.24


def allocate(total: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers that add up to ``total`` by largest remainders; ties keep the order of ``shares``."""
    if total < 0 or not shares or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("total must not be negative and shares must add up to 1")
    exact = {k: total * v for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(shares, key=lambda k: exact[k] - out[k], reverse=True)[: total - sum(out.values())]:
        out[k] += 1
    return out


def allocate_table(df: DataFrame, group: str, total: Column, key: str, share: Column) -> DataFrame:
    """The same for any number of groups as a plan: (group, key, count). Ties go by key."""
    from pyspark.sql import Window

    exact = df.withColumns({"_x": total * share, "_t": total}).withColumn("_n", F.floor("_x").cast("long"))
    w = Window.partitionBy(group)
    left = F.round(F.max("_t").over(w) - F.sum("_n").over(w))
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.col("_x") - F.col("_n"), 9)), key))
    return exact.withColumn("count", F.col("_n") + (rank <= left).cast("long")).select(group, key, "count")


def scenario_counts(n: int) -> dict[str, dict[str, int]]:
    """Positives and negatives of each split for a scenario of n documents; a split with one class is an error."""
    if n <= 0:
        raise ValueError("a scenario needs documents")
    totals = allocate(n, SPLIT_SHARES)
    positive = allocate(round(n * POSITIVE_RATE), {s: c / n for s, c in totals.items()})
    out = {s: {"positive": positive[s], "negative": c - positive[s]} for s, c in totals.items()}
    bad = [s for s, c in out.items() if sum(c.values()) and not all(c.values())]
    if bad:
        raise ValueError(f"splits {bad} would hold one class only")
    return out


def _dealt(counts: Mapping[str, int], n: int) -> list[str]:
    """``counts`` laid out over n places so that each value is spread evenly."""
    places = sorted(((i + 0.5) / c, k) for k, c in counts.items() for i in range(c))
    return [k for _, k in places][:n]


def scenario_plan(scenario: str, number: int, n: int, combinations: Sequence[Sequence[str]], variants: Sequence[str], seed: int = 42) -> list[dict]:
    """Requests of one scenario: entity combinations in turn, languages and variants by share, blank forms only
    among negatives."""
    filled = [v for v in variants if v != "blank"]
    if not filled or not combinations:
        raise ValueError("a scenario needs a filled variant and a combination of entities")
    out, turn = [], 0
    for split, parts in scenario_counts(n).items():
        for label, count in parts.items():
            yes = label == "positive"
            blank = 0 if yes or "blank" not in variants else round(count * BLANK_RATE)
            kinds = allocate(count - blank, {v: 1 / len(filled) for v in filled}) | ({"blank": blank} if blank else {})
            for language, variant in zip(_dealt(allocate(count, LANGUAGE_SHARES), count), _dealt(kinds, count)):
                out.append({"scenario": scenario, "language": language, "contains_personal_data": yes, "entity_types": sorted(combinations[turn % len(combinations)]) if yes else [], "recommended_split": split, "variant": variant, "scenario_seed": seed + number * 1000, "row": len(out)})
                turn += yes
    return out


def top_up(plan: list[dict], combinations: Mapping[str, Sequence[Sequence[str]]], targets: Mapping[str, Mapping[str, int]]) -> tuple[list[dict], list[str]]:
    """Turns negatives into positives until each entity has its target in each split, and tells what falls short.

    A split of a scenario keeps a negative and at most MOST_POSITIVE positives. The greedy choice depends on what was
    chosen before and a plan is a few thousand rows, so this runs on the driver.
    """
    plan = [dict(r) for r in plan]
    size = Counter((r["scenario"], r["recommended_split"]) for r in plan)
    positive = Counter((r["scenario"], r["recommended_split"]) for r in plan if r["contains_personal_data"])
    have = Counter((e, r["recommended_split"]) for r in plan for e in r["entity_types"])
    free: dict[tuple[str, str], list[dict]] = {}
    for r in plan:
        if not r["contains_personal_data"] and r["variant"] != "blank":
            free.setdefault((r["scenario"], r["recommended_split"]), []).append(r)
    short = []
    for entity in sorted(targets):
        places = sorted(s for s, cs in combinations.items() if any(entity in c for c in cs))
        for split, target in sorted(targets[entity].items()):
            open_places = list(places)
            while have[entity, split] < target and open_places:
                scenario = min(open_places, key=lambda s: (positive[s, split] / max(size[s, split], 1), s))
                at = scenario, split
                if not free.get(at) or size[at] - positive[at] < 2 or (positive[at] + 1) / size[at] > MOST_POSITIVE:
                    open_places.remove(scenario)
                    continue
                r = free[at].pop()
                chosen = min((c for c in combinations[scenario] if entity in c), key=lambda c: (len(c), sorted(c)))
                r |= {"contains_personal_data": True, "entity_types": sorted(chosen)}
                positive[at] += 1
                have.update((e, split) for e in chosen)
            if have[entity, split] < target:
                short.append(f"{entity}/{split}: got {have[entity, split]} of {target}")
    return plan, short


PLAN_DDL = "scenario string, language string, contains_personal_data boolean, entity_types array<string>, recommended_split string, variant string, scenario_seed long, row long"


def plan_table(spark: SparkSession, plan: list[dict]) -> DataFrame:
    return spark.createDataFrame(plan, PLAN_DDL).withColumn("row_seed", seed_of("scenario_seed", "row"))


def plan_violations(plan: DataFrame) -> DataFrame:
    """(check, count) of requests that contradict themselves, in one pass."""
    n = F.size("entity_types")
    rules = {
        "positive_without_entities": F.col("contains_personal_data") & (n == 0),
        "negative_with_entities": ~F.col("contains_personal_data") & (n > 0),
        "blank_positive": F.col("contains_personal_data") & (F.col("variant") == "blank"),
        "unknown_language": ~F.col("language").isin(*LANGUAGE_SHARES),
        "unknown_split": ~F.col("recommended_split").isin(*SPLIT_SHARES),
        "repeated_entity": F.size(F.array_distinct("entity_types")) < n,
    }
    wide = plan.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("count")) for k in rules])).alias("r")).select("r.*")


def _pick(seed: Column, field: str, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(seed, F.lit(field)), F.lit(len(values))) + 1).cast("int"))


def _digits(seed: Column, field: str, n: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(seed, F.lit(field)), F.lit(10**n)).cast("string"), n, "0")


def value_of(entity: str, seed: Column) -> Column:
    """A made-up value of an entity type; numbers and names follow from the seed."""
    first, last = _pick(seed, "first", ("Agnes", "Bruno", "Carla", "Emre", "Freya", "Hugo", "Ivo", "Nele")), _pick(seed, "last", ("Adlorn", "Brenk", "Corvel", "Dunhart", "Ewerling", "Fosk", "Grehn", "Holdau"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64(seed, F.lit("day")), F.lit(2000)).cast("int"))
    return {
        "PERSON": F.concat_ws(" ", first, last),
        "EMAIL_ADDRESS": F.lower(F.concat(first, F.lit("."), last, F.lit("@mail.example"))),
        "PHONE_NUMBER": F.concat(F.lit("+49 30 "), _digits(seed, "phone", 7)),
        "LOCATION": _pick(seed, "place", ("Altfurt", "Birkenau", "Cranwick", "Dornbeck")),
        "IBAN_CODE": F.concat(F.lit("DE"), _digits(seed, "iban1", 10), _digits(seed, "iban2", 10)),
        "CREDIT_CARD": F.concat(F.lit("4"), _digits(seed, "card", 15)),
        "PASSPORT": F.concat(F.lit("P"), _digits(seed, "passport", 8)),
        "NRP": _pick(seed, "nation", ("German", "French", "Polish", "Dutch")),
        "DATE_TIME": F.date_format(day, "yyyy-MM-dd"),
        "IP_ADDRESS": F.concat(F.lit("192.0.2."), F.pmod(F.xxhash64(seed, F.lit("ip")), F.lit(255)).cast("string")),
        "URL": F.concat(F.lit("https://intranet.example/"), _digits(seed, "url", 5)),
        "MEDICAL_LICENSE": F.concat(F.lit("Medical ID "), _digits(seed, "licence", 6)),
    }[entity]


def paired(values: Column) -> Column:
    """The values of one field (a map of entity type to value) as one text: a name with an address of mail, a phone
    number or an account beside it, a single value as it is, others joined by semicolons."""
    at = lambda k: F.try_element_at(values, F.lit(k))
    person = at("PERSON")
    return (
        F.when(person.isNotNull() & at("EMAIL_ADDRESS").isNotNull(), F.concat(person, F.lit(" ("), at("EMAIL_ADDRESS"), F.lit(")")))
        .when(person.isNotNull() & at("PHONE_NUMBER").isNotNull(), F.concat(person, F.lit(", "), at("PHONE_NUMBER")))
        .when(person.isNotNull() & at("IBAN_CODE").isNotNull(), F.concat(person, F.lit("; IBAN: "), at("IBAN_CODE")))
        .otherwise(F.array_join(F.map_values(values), "; "))
    )


# What records say about how they were made.
MADE_BY = {"field": ("openrouter_gpt4o_mini_field", "field_llm_v1"), "document": ("openrouter_gpt4o_mini_document", "llm_rewrite_v1"), "template": ("faker_archetype_v1", "template_v1")}
FALLBACK = "faker_archetype_fallback"


def generation_metadata(scenario: Column, variant: Column, rewritten: Column, succeeded: Column, free_text: Sequence[str], whole: Sequence[str]) -> Column:
    """{generator, prompt_version} of a record: a rewriter's for scenarios with free text (not blank forms) or whole
    documents, with a fallback where it failed; else the template's."""

    def made(kind: str) -> Column:
        generator, version = MADE_BY[kind]
        ok = F.coalesce(succeeded, F.lit(False))
        return F.struct(F.when(ok, generator).otherwise(FALLBACK).alias("generator"), F.when(ok, version).otherwise(f"{version}_fallback").alias("prompt_version"))

    plain = F.struct(*[F.lit(v).alias(n) for n, v in zip(("generator", "prompt_version"), MADE_BY["template"])])
    fielded = rewritten & scenario.isin(*free_text) & ~F.coalesce(variant == "blank", F.lit(False))
    return F.when(fielded, made("field")).when(rewritten & scenario.isin(*whole), made("document")).otherwise(plain)


def passport_dates(birth: Column, issue: Column, expiry: Column, fixed: str | None, seed: Column) -> dict[str, Column]:
    """Dates with birth before issue before expiry: issued to adults for ten years of 365 days; ``fixed`` names the one
    that stays."""
    adult, valid = 18 * 365, 10 * 365
    more = F.pmod(F.xxhash64(seed, F.lit("age")), F.lit(365 * 40)).cast("int")
    if fixed == "date_of_birth":
        issued = F.date_add(F.date_add(birth, adult), more)
        return {"date_of_birth": birth, "issue_date": issued, "expiry_date": F.date_add(issued, valid)}
    issued = F.date_sub(expiry, valid) if fixed == "expiry_date" else issue
    return {"date_of_birth": F.date_sub(F.date_sub(issued, adult), more), "issue_date": issued, "expiry_date": F.date_add(issued, valid)}


def documents(plan: DataFrame, entities: Sequence[str]) -> DataFrame:
    """A document for each request: a title and a line for each entity; blank forms have labels only."""
    seed = F.col("row_seed")
    values = F.create_map(*[x for e in entities for x in (F.lit(e), value_of(e, seed))])
    title = field_title("scenario")
    lines = F.transform("entity_types", lambda e: F.concat(field_title(e), F.lit(": "), F.try_element_at(values, e)))
    body = F.when(F.col("variant") == "blank", F.array(F.lit("Name:"), F.lit("Date:"))).when(F.size("entity_types") > 0, lines).otherwise(F.array(F.concat(F.lit("Reference: REF-"), _digits(seed, "ref", 7))))
    number = F.concat(F.lit("SYN-"), F.upper("scenario"), F.lit("-"), F.lpad(F.col("row").cast("string"), 4, "0"))
    text = F.concat(title, F.lit("\n\n"), F.array_join(body, "\n"))
    flags = {f"{e}_yes_no": F.when(F.array_contains("entity_types", e), "yes").otherwise("no") for e in entities}
    n = F.size("entity_types")
    return plan.withColumns({"document_id": number, "full_text": text, "primary_pii_type": F.when(n == 0, "NONE").when(n == 1, F.get("entity_types", F.lit(0))).otherwise("MULTIPLE"), "pii_count": n} | flags)
