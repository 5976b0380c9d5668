"""Table schemas of the store, and the settings of a run."""

from __future__ import annotations

import os
from dataclasses import dataclass

TABLES = {
    "meta": "key string, value string",
    "product": "id bigint, sku string, url_key string, default_price double",
    "product_name": "product_id bigint, lang string, name string, norm_name string",
    "category": "id bigint, parent_id bigint",
    "category_name": "category_id bigint, lang string, name string, norm_name string",
    "product_category": "product_id bigint, category_id bigint",
    "catalog_term": "term string, lang string, product_count bigint",
    "search_event": "id bigint, raw_query string, norm_query string, script string, result_count int, results_ar array<string>, results_en array<string>, result_signature string, occurred_at timestamp_ntz, session_id string, clicked_rank int, converted boolean",
    "query_count": "query string, norm_query string, count bigint",
    "query_state": "day date, norm_query string, display_query struct<occurred_at:timestamp_ntz,id:bigint,v:string>, script struct<occurred_at:timestamp_ntz,id:bigint,v:string>, intended_term struct<occurred_at:timestamp_ntz,id:bigint,v:string>, dominant_category struct<occurred_at:timestamp_ntz,id:bigint,v:string>, searches bigint, results bigint, results_n bigint, zero bigint, zero_n bigint, unfilled bigint, miss bigint, miss_n bigint, coherence double, coherence_n bigint, scored bigint, dissatisfied bigint, rapid bigint, clicked bigint, under_filled bigint, coverage bigint, intended_coverage bigint, correction_distance int, signatures array<string>, sessions array<string>, retrieval_gap boolean, min_results int, first_seen timestamp_ntz, last_seen timestamp_ntz",
    "query_tail": "day date, next_day date, norm_query string, scored int, dissatisfied int, rapid int",
    "title_map": "norm_name string, product_id bigint",
    "term_reach": "short string, match string",
    "term_completion": "prefix string, completion string, completion_lang string, completion_support bigint",
    "name_gram": "gram string, product_id bigint, lang string",
    "suggestion": "id bigint, kind string, source_term string, target_term string, lang string, confidence double, rationale string, evidence string, status string, created_at string, updated_at string, reviewer string, review_note string",
    "digest": "id bigint, period_start string, period_end string, generated_at string, narrative_source string, body_md string, metrics string",
}
#: Tables that are kept by day.
DAILY = ("search_event", "query_state", "query_tail")
#: Tables that a reload leaves alone.
KEPT = ("suggestion", "digest")

#: Source tables and the positions of the columns that are read.
SOURCES = {
    "recommendations_searches": {"id": 0, "query": 1, "ar": 2, "en": 3, "count": 4, "at": 5},
    "recommendations_querycount": {"query": 1, "count": 2},
    "catalog_product": {"id": 0, "sku": 2, "url_key": 5, "price": 6},
    "catalog_productname": {"name": 1, "language": 2, "product_id": 4},
    "catalog_category": {"id": 0, "parent": 1},
    "catalog_categoryname": {"name": 1, "language": 2, "category_id": 3},
    "catalog_product_categories": {"product_id": 1, "category_id": 2},
}
#: The columns of the source tables, in the order in which a dump writes them; the first is the key.
DATABASE = {
    "recommendations_searches": ["id", "query", "ar_results", "en_results", "num_results", "created_at"],
    "recommendations_querycount": ["id", "query", "count"],
    "catalog_product": ["id", "created_at", "sku", "image", "updated_at", "url_key", "default_price", "default_special_price"],
    "catalog_productname": ["id", "name", "language", "created_at", "product_id"],
    "catalog_category": ["id", "parent_category_id", "created_at", "integration_id", "updated_at"],
    "catalog_categoryname": ["id", "name", "language", "category_id"],
    "catalog_product_categories": ["id", "product_id", "category_id"],
}


@dataclass(frozen=True)
class Settings:
    """Explicit settings; nothing is cached for the process."""

    store: str = "store"
    result_cap: int = 5
    session_gap_seconds: int = 1800
    #: The live database; its password is read when it is needed and kept nowhere.
    database_url: str = ""
    database_user: str = ""

    @classmethod
    def from_environment(cls, environment=os.environ) -> Settings:
        def whole(name: str, default: int) -> int:
            text = environment.get(name, "")
            if not text:
                return default
            try:
                return int(text)
            except ValueError:
                raise ValueError(f"{name} must be a whole number, not {text!r}") from None

        return cls(environment.get("QUERYVITALS_STORE", cls.store), whole("QUERYVITALS_RESULT_CAP", cls.result_cap), whole("QUERYVITALS_SESSION_GAP_SECONDS", cls.session_gap_seconds), environment.get("QUERYVITALS_DATABASE_URL", ""), environment.get("QUERYVITALS_DATABASE_USER", ""))
