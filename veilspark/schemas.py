"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from dataclasses import dataclass

from veilspark.operators.detect import SPANS

DATASET_COLUMNS = (
    "document_id", "file_name", "document_type", "scenario_type", "language", "source_system",
    "responsible_owner", "owner_email", "data_source", "file_created_date", "last_modified_date", "dataset_created_at",
    "file_size_mb", "full_text", "contains_personal_data", "PERSON_yes_no", "EMAIL_ADDRESS_yes_no", "PHONE_NUMBER_yes_no",
    "LOCATION_yes_no", "IBAN_CODE_yes_no", "CREDIT_CARD_yes_no", "PASSPORT_yes_no", "NRP_yes_no", "DATE_TIME_yes_no",
    "IP_ADDRESS_yes_no", "URL_yes_no", "MEDICAL_LICENSE_yes_no", "personal_data_categories", "primary_pii_type", "category_count",
    "pii_count", "difficulty", "edge_case", "challenge_category", "retention_period_exceeded_3y", "recommended_split",
    "synthetic", "synthetic_generator", "generation_prompt_version", "human_reviewed", "review_status", "review_notes",
    "dataset_version", "labeling_notes",
)
_TYPES = {"file_created_date": "date", "last_modified_date": "date", "dataset_created_at": "date", "file_size_mb": "double", "category_count": "int", "pii_count": "int"}
DATASET_DDL = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in DATASET_COLUMNS)
MANIFEST_DDL = "document_id string, scenario_type string, variant string, language string, contains_personal_data string, entity_types string, recommended_split string, difficulty string, challenge_category string, edge_case boolean, scenario_seed long, row_seed long"
PREDICTION_DDL = f"entities {SPANS}, per_type_conf map<string,double>, detected_categories array<string>, strong_pii_categories array<string>, potential_pii_categories array<string>, detected_pii boolean, detected_any_pii boolean, has_person_hint boolean, route string, routing_reason string, needs_llm_review boolean"


@dataclass(frozen=True)
class Field:
    """A column of a report: name, type, default and the name it is read from."""

    name: str
    dtype: str
    default: object = None
    source: str | None = None

    @property
    def read_from(self) -> str:
        return self.source or self.name


METADATA = tuple(Field(n, "string", "") for n in ("run_id", "dataset_version", "strategy", "provider", "model_family", "model_name", "prompt_version", "prediction_source"))
ROUTING = (Field("documents_total", "long", 0), Field("documents_sent_to_review", "long", 0), Field("documents_resolved_locally", "long", 0), Field("routing_rate", "double", 0.0), Field("local_processing_rate", "double", 0.0))
EVALUATION = tuple(Field(n, "double", 0.0) for n in ("accuracy", "precision", "recall", "f1")) + tuple(Field(n, "long", 0) for n in ("n", "TP", "TN", "FP", "FN"))
USAGE = tuple(Field(f"llm_{n}", "long", 0) for n in ("requests_attempted", "requests_successful", "prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens", "cached_tokens")) + (Field("llm_reported_cost", "double", 0.0),)
BENCHMARK_ORDER = tuple(f.name for f in METADATA + EVALUATION + ROUTING + USAGE)


def fields(names: list[str], groups: tuple[tuple[Field, ...], ...] = (METADATA, ROUTING, EVALUATION, USAGE)) -> list[Field]:
    """Fields by name; an unknown name is an error."""
    known = {f.name: f for g in groups for f in g}
    bad = [n for n in names if n not in known]
    if bad:
        raise KeyError(f"unknown fields {bad}")
    return [known[n] for n in names]


def defaults(group: tuple[Field, ...]) -> dict[str, object]:
    return {f.name: f.default for f in group}
