"""Settings of the stages, with their defaults. The word lists and thresholds are fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Textual nulls of the in-memory style (compared lower-cased, stripped, white space collapsed) and of the SQL style (lower-cased, trimmed).
MEMORY_NULLS = ("", "n/a", "n\\a", "nan", "-nan", "null", "none", "nil", "<na>", "<n/a>", "#n/a", "#n/a n/a", "#na", "-1.#ind", "1.#ind", "-1.#qnan", "1.#qnan")
SQL_NULLS = ("", "null", "none", "n/a", "na", "nan")
#: Textual nulls of uploaded CSV files, compared as they are.
CSV_NULLS = ("", "NULL", "null", "None", "none", "N/A", "n/a", "NA", "na")

#: Parts of names that mark measures, which aren't parts of a composite key, and references that don't count.
MEASURE_PARTS = ("minute", "time", "second", "day", "month", "year", "age", "status", "stage", "round", "week", "amount", "price", "total", "qty", "quantity", "count", "score", "rating")
BAD_REFERENCE_PARTS = ("minute", "second", "hour", "status", "flag", "qty", "count", "number_of")


@dataclass(frozen=True)
class PruneConfig:
    null_ratio: float = 0.98
    top1_ratio: float = 0.999
    small_domain: int = 50
    long_avg: float = 120.0
    long_max: int = 250
    key_tokens: tuple[str, ...] = ("id", "key", "code", "ref", "seq", "no", "num", "uuid", "guid")
    measure_tokens: tuple[str, ...] = ("amount", "price", "total", "qty", "quantity", "score", "rating", "count", "cost", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years")
    date_tokens: tuple[str, ...] = ("date", "time", "timestamp", "created", "updated", "modified")
    negative_tokens: tuple[str, ...] = ("description", "comment", "comments", "note", "notes", "remark", "remarks", "message", "summary", "detail", "details", "content", "body", "text", "html", "xml", "json", "payload", "blob", "image", "file", "attachment")
    payload_tokens: tuple[str, ...] = ("payload", "blob", "image", "file", "document", "content", "body", "attachment")


@dataclass(frozen=True)
class StrictConfig:
    families: tuple[str, ...] = ("int", "string")
    min_distinct_child: int = 10
    min_distinct_string: int = 20
    min_non_null: int = 20
    min_distinct_coverage: float = 0.90
    min_row_coverage: float = 0.0
    max_null_ratio: float = 0.95
    min_unique_ratio: float = 0.02
    apply_prune: bool = True
    sketch_size: int = 512
    sketch_risk: float = 1e-12


@dataclass(frozen=True)
class SoftConfig:
    min_distinct_coverage: float = 0.80
    min_row_coverage: float = 0.80
    alt_distinct_coverage: float = 0.95
    alt_row_coverage: float = 0.60
    min_matched_rows: int = 200
    min_non_null: int = 20
    min_distinct: int = 10
    max_null_ratio: float = 0.95
    parent_non_null: float = 0.30
    parent_unique: float = 0.60
    routing_sim: float = 0.30
    max_parents: int = 20
    small_domain: int = 30
    small_domain_sim: float = 0.65
    small_domain_top1: float = 0.50
    top1_distinct: int = 50
    max_top1: float = 0.90
    placeholder_top1: float = 0.75
    placeholders: tuple[str, ...] = ("0", "00", "000", "999", "9999", "999999", "unknown", "null")
    key_pattern: str = r"(?:^id$|id$|_id$|key$|_key$|code$|_code$|ref$|_ref$|seq$|_seq$|no$|_no$|num$|_num$|uuid$|guid$)"
    max_width: int = 18
    max_abs_int: int = 2_147_483_647


@dataclass(frozen=True)
class ScoreConfig:
    distinct: float = 0.75
    row: float = 0.20
    name: float = 0.05
    range: float = 0.10
    small_domain: float = 0.20
    measure: float = 0.60
    measure_parts: tuple[str, ...] = ("minute", "min", "time", "second", "day", "month", "year", "age", "score", "rating", "stage", "round", "week", "status", "flag", "type", "count", "qty", "quantity", "amount", "price", "total")


@dataclass(frozen=True)
class SelectConfig:
    min_score: float = 0.90
    max_edges_per_fk: int = 3
    optional_null_ratio: float = 0.01
    one_to_one_ratio: float = 0.999999


@dataclass(frozen=True)
class MissingConfig:
    orphan_warn: float = 0.01
    orphan_fail: float = 0.05
    childless_warn: float = 0.05
    childless_fail: float = 0.20
    required_multiplier: float = 1.0
    sentinel_texts: tuple[str, ...] = ("unknown", "unk", "na", "n/a", "null", "none", "missing")
    sentinel_ints: tuple[int, ...] = (-1, 0, 999, 9999, 99999, 999999, 888888)


@dataclass(frozen=True)
class DefaultConfig:
    top_k: int = 3
    ratio: float = 0.20
    heavy_ratio: float = 0.50
    small_fk_distinct: int = 5
    min_non_null: int = 20
    partner_distinct: int = 10
    partner_ratio: float = 0.20
    partner_overall: int = 20
    #: Columns of a parent that may call one of its rows a dummy.
    parent_labels: tuple[str, ...] = ()
    sentinel_texts: tuple[str, ...] = ("unknown", "unk", "na", "n/a", "n.a.", "nan", "null", "none", "nil", "missing", "undefined", "unset", "not_set", "notset", "not applicable", "not_applicable", "not available", "not_available", "default", "other", "misc", "tbd", "todo", "?", "??")
    sentinel_ints: tuple[int, ...] = (-1, 0, 99, 999, 9999, 99999, 999999, 88, 8888, 888888)


@dataclass(frozen=True)
class EngineConfig:
    prune: PruneConfig = field(default_factory=PruneConfig)
    strict: StrictConfig = field(default_factory=StrictConfig)
    soft: SoftConfig = field(default_factory=SoftConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    select: SelectConfig = field(default_factory=SelectConfig)
    missing: MissingConfig = field(default_factory=MissingConfig)
    defaults: DefaultConfig = field(default_factory=DefaultConfig)
    #: How many columns of a table the search for composite keys takes at most; None: all.
    composite_columns: int | None = None
