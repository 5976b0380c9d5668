"""Questions in plain words, routed by intent to the measures that answer them."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import catalog as C
from queryvitals.operators import ingest as I
from queryvitals.operators import metrics as M
from queryvitals.operators import reports as R
from queryvitals.operators import review as V
from queryvitals.operators import substrings as G

#: The first intent whose pattern matches wins.
INTENTS = [
    ("compare", r"\bcompare|\bversus\b|\bvs\b|\bbetween\b.*\band\b|change[ds]? since"),
    ("suggestions", r"suggest|synonym|misspell|typo|rule|review"),
    ("coverage", r"\bstock|\bsell\b|catalog|carry|products? for"),
    ("recent", r"recent|latest|last searches|just now"),
    ("profile", r"data cover|dataset|how much data|time range|date range"),
    ("problems", r"worst|problem|fail|broken|bad"),
    ("health", r"health|overview|overall|how (?:is|are|good)"),
]
_QUOTED = re.compile(r"[\"“'«]([^\"”'»]{1,80})[\"”'»]")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


_TEXT, _NUMBER = {"type": "string"}, {"type": "integer", "minimum": 1}
_PERIOD = {"type": "array", "items": {"type": "string", "format": "date"}, "minItems": 2, "maxItems": 2}
TOOLS = {
    "health": ("Totals, rates and the health score of the log.", {}),
    "problems": ("Queries that fail shoppers, the largest impact first.", {"limit": _NUMBER}),
    "detail": ("One query: its scores, the reasons, and its newest results.", {"query": _TEXT}),
    "suggestions": ("Rules that wait for review, or have been decided.", {"status": _TEXT, "kind": _TEXT, "limit": _NUMBER}),
    "coverage": ("Whether the catalogue stocks a word, or one close to it.", {"term": _TEXT}),
    "compare": ("Two periods of the log, metric by metric.", {"first": _PERIOD, "second": _PERIOD}),
    "recent": ("The newest searches.", {"limit": _NUMBER}),
    "profile": ("What the log covers: searches, sessions, times, products.", {}),
}
PREVIEW = 400
#: What is asked back when a comparison names no dates.
ASK_DATES = "Which periods? Two dates (YYYY-MM-DD) name one, which is set against the one before it; four name both."
#: Rows of one answer; an answer that had more says so.
MOST_ROWS = 500


def preview(text: str, most: int = PREVIEW) -> str:
    """The text, cut to ``most`` characters with an ellipsis."""
    return text if len(text) <= most else text[:most] + "…"


class Planner:
    """Tools over one scored log. Every answer is a bounded number of rows."""

    def __init__(self, events: DataFrame, shop, queue: DataFrame, quality: Callable[..., DataFrame] | None = None, grams: DataFrame | None = None):
        """``quality(since, until)`` scores a period, if the caller has a shorter way than the log; ``grams`` is a stored
        index of the product names."""
        self.events, self.shop, self.queue = events, shop, queue
        self._scored = quality or (lambda since=None, until=None: M.query_quality(M.in_period(events, since, until), shop))
        self._quality: DataFrame | None = None
        self._grams = G.postings(shop.product_name, ["product_id", "lang"]) if grams is None else grams
        self.tools: dict[str, Callable] = {
            "health": self.health, "problems": self.problems, "detail": self.detail, "suggestions": self.suggestions,
            "coverage": self.coverage, "compare": self.compare, "recent": self.recent, "profile": self.profile,
        }

    def described(self) -> list[dict]:
        """Name, description and argument schema of each tool."""
        out = []
        for name, tool in sorted(self.tools.items()):
            about, arguments = TOOLS[name]
            need = [a for a, p in inspect.signature(tool).parameters.items() if p.default is inspect.Parameter.empty]
            out.append({"name": name, "description": about, "parameters": {"type": "object", "properties": arguments, "required": need}})
        return out

    @property
    def quality(self) -> DataFrame:
        if self._quality is None:
            self._quality = self._scored()
        return self._quality

    def health(self) -> DataFrame:
        return M.overview(self.quality)

    def problems(self, limit: int = 10) -> DataFrame:
        return M.problem_queries(self.quality, limit).select("display_query", "searches", "severity", "impact", "reason_codes")

    def detail(self, query: str) -> DataFrame:
        norm = T.fold_string(query)
        latest = I.latest_results(self.events.where(F.col("norm_query") == norm))
        return M.reason_texts(self.quality.where(F.col("norm_query") == norm)).join(latest, "norm_query", "left").select("norm_query", "searches", "severity", "impact", "reasons", "results_en", "results_ar")

    def suggestions(self, status: str = "pending", kind: str | None = None, limit: int = 10) -> DataFrame:
        return V.listed(self.queue, status, kind, min(limit, 500)).select("id", "kind", "source_term", "target_term", "confidence")

    def coverage(self, term: str) -> DataFrame:
        norm = T.fold_string(term)
        spark = self.events.sparkSession
        asked = spark.createDataFrame([(norm,)], "term string")
        covered = C.coverage(asked, self.shop.vocabulary).join(C.nearest_terms(asked, self.shop.vocabulary, near_by=self.shop.reach), "term", "left")
        named = G.lookup([norm], self._grams, self.shop.product_name, ["product_id", "lang"]).join(self.shop.product_name, ["product_id", "lang"])
        sample = named.orderBy("product_id", "lang").limit(5).agg(F.collect_list("name").alias("examples"))
        return covered.join(F.broadcast(sample))

    def compare(self, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
        one = lambda p: M.overview(self._scored(*p))
        return M.compare_periods(one(first), one(second))

    def recent(self, limit: int = 10) -> DataFrame:
        return R.recent_searches(self.events, limit).select("id", "raw_query", "occurred_at", "result_count")

    def profile(self) -> DataFrame:
        return R.dataset_profile(self.events, self.shop.product)

    def named_query(self, question: str) -> str | None:
        """Quoted text, else the longest logged query of three characters or more that the question contains."""
        quoted = _QUOTED.search(question)
        if quoted:
            return T.fold_string(quoted.group(1))
        runs = [x for x in G.word_sequences(T.fold_string(question)) if len(x) >= 3]
        if not runs:
            return None
        # A query that the question contains is a run of its words, so runs are looked up and no query is searched.
        asked = self.events.sparkSession.createDataFrame([(x,) for x in runs], "norm_query string")
        row = self.events.select("norm_query").join(F.broadcast(asked), "norm_query", "left_semi").distinct().orderBy(F.desc(F.length("norm_query")), "norm_query").first()
        return row[0] if row else None

    def plan(self, question: str) -> tuple[str, dict]:
        """The tool and its arguments."""
        low = question.lower()
        intent = next((name for name, pattern in INTENTS if re.search(pattern, low)), None)
        dates = _DATE.findall(question)
        if intent == "compare" or len(dates) >= 2:
            periods = date_ranges(dates)
            if periods:
                return "compare", {"first": periods[0], "second": periods[1]}
            if intent == "compare":
                return "compare", {}
        if intent == "coverage":
            term = self.named_query(question) or T.fold_string(question).split(" ")[-1]
            return "coverage", {"term": term}
        if intent in (None, "problems", "health"):
            named = self.named_query(question)
            if named:
                return "detail", {"query": named}
        return intent or "health", {}

    def run(self, tool: str, **arguments) -> dict:
        """A tool's rows as plain data; unknown tools and wrong arguments come back as data too."""
        if tool not in self.tools:
            return {"error": f"unknown tool {tool!r}"}
        try:
            rows = self.tools[tool](**arguments).limit(MOST_ROWS + 1).toJSON().collect()
            out = {"rows": [json.loads(r) for r in rows[:MOST_ROWS]]}
            return out | {"truncated": True} if len(rows) > MOST_ROWS else out
        except (TypeError, ValueError, KeyError) as e:
            return {"error": str(e)}

    def ask(self, question: str) -> tuple[str, str]:
        if not question.strip():
            raise ValueError("a question is needed")
        tool, arguments = self.plan(question)
        if tool == "compare" and not arguments:
            return tool, json.dumps({"question": ASK_DATES})
        return tool, json.dumps(self.run(tool, **arguments), ensure_ascii=False, sort_keys=True)


def date_ranges(dates: list[str]) -> tuple[tuple[str, str], tuple[str, str]] | None:
    """Four dates are two periods; two are one, compared with the one of equal length before it."""
    from datetime import date, timedelta

    if len(dates) >= 4:
        return (dates[0], dates[1]), (dates[2], dates[3])
    if len(dates) >= 2:
        a, b = date.fromisoformat(dates[0]), date.fromisoformat(dates[1])
        width = b - a
        return (str(a - width - timedelta(days=1)), str(a - timedelta(days=1))), (dates[0], dates[1])
    return None
