"""The catalogue tables and what is derived from them, built once for a snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from queryvitals.operators import catalog as C
from queryvitals.plans.stage import written

#: What is derived from the catalogue: its table in the store, and the column by which that is ordered.
DERIVED = {"vocabulary": ("catalog_term", "term"), "title_map": ("title_map", "norm_name"), "reach": ("term_reach", "short"), "best_completions": ("term_completion", "prefix")}


@dataclass(frozen=True)
class Shop:
    product: DataFrame
    product_name: DataFrame
    product_category: DataFrame
    category_name: DataFrame
    #: Stored tables of what would be derived, by name; see ``DERIVED``.
    derived: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.derived.get("vocabulary", C.vocabulary(self.product_name))

    @cached_property
    def title_map(self) -> DataFrame:
        return self.derived.get("title_map", C.title_map(self.product_name))

    @cached_property
    def reach(self) -> DataFrame:
        return self.derived.get("reach", C.reach(self.vocabulary))

    @cached_property
    def best_completions(self) -> DataFrame:
        return self.derived.get("best_completions", C.best_completions(self.vocabulary))

    @cached_property
    def usable_categories(self) -> DataFrame:
        return C.discriminative_categories(self.product_category, self.product)

    @cached_property
    def category_labels(self) -> DataFrame:
        return C.category_labels(self.category_name)

    def staged(self) -> Shop:
        """The same catalogue with its vocabulary and titles written once, for several measures over one snapshot."""
        for name in ("vocabulary", "title_map"):
            if name not in self.derived:
                self.__dict__[name] = written(getattr(self, name))
        return self
