"""DuckDB SQL for the registered queries, composed from named steps."""

from __future__ import annotations

import re

from queryvitals.sources.surrogate import SHARED

STEPS: dict[str, str] = dict(SHARED)
STEPS |= {
    # The search log.
    "titles": "SELECT s.id, s.raw_query AS norm_query, s.pos, p.p_name AS title_en, CASE WHEN s.id % 2 = 0 THEN lower(p.p_type) ELSE '' END AS title_ar FROM (SELECT id, raw_query, pid, n, shift, unnest(range(0, CAST(result_count AS BIGINT))) AS pos FROM {search}) s JOIN {part} p ON p.p_partkey = (s.pid + s.shift + s.pos) % s.n",
    "sig": "SELECT id, string_agg(title_en, chr(10) ORDER BY title_en) AS joined FROM {titles} GROUP BY id",
    "log": "SELECT s.id, s.ts, s.user_id, s.k, s.raw_query, s.raw_query AS norm_query, CAST(s.result_count AS INTEGER) AS result_count, date_trunc('second', s.ts) AS occurred_at, substr(sha1(coalesce(g.joined, '')), 1, 16) AS result_signature, CASE WHEN event_type = 'click' THEN CAST(s.id % 5 + 1 AS INTEGER) END AS clicked_rank FROM {search} s LEFT JOIN {sig} g USING (id)",
    "sess": "SELECT *, sum(fresh) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session_no FROM (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, id)) > 1800000000, true) THEN 1 ELSE 0 END AS fresh FROM {log})",
    "ev": "SELECT *, 's' || CASE WHEN session_no < 10000 THEN lpad(CAST(session_no AS VARCHAR), 4, '0') ELSE CAST(session_no AS VARCHAR) END AS session_id FROM {sess}",
    "nxt": "SELECT *, lead(norm_query) OVER w AS next_norm_query, epoch(lead(occurred_at) OVER w) - epoch(occurred_at) AS gap, lead(result_signature) OVER w AS next_sig FROM {ev} WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at, id)",
    "fol": "SELECT *, CASE WHEN gap IS NULL THEN 'none' WHEN gap > 300 THEN 'new_intent' WHEN next_norm_query = norm_query THEN 'repeat' ELSE 'reformulation' END AS follow_up, coalesce(next_norm_query = norm_query AND gap < 2.0 AND next_sig = result_signature, false) AS rapid_repeat FROM {nxt}",
    "beh": "SELECT *, NOT rapid_repeat AND follow_up IN ('repeat', 'reformulation') AS dissatisfied FROM {fol}",
    "kind": "SELECT *, CASE WHEN follow_up <> 'reformulation' THEN NULL WHEN (starts_with(next_norm_query, norm_query) OR starts_with(norm_query, next_norm_query)) AND length(norm_query) <> length(next_norm_query) THEN 'refinement' WHEN damerau_levenshtein(norm_query, next_norm_query) <= 2 THEN 'typo_fix' ELSE 'switch' END AS reformulation FROM {beh}",
    # The catalogue.
    "pword": "SELECT DISTINCT product_id, lang, unnest(string_split(lower(name), ' ')) AS term FROM {product_name}",
    "vocab": "SELECT term, lang, count(*) AS product_count FROM {pword} WHERE length(term) >= 2 GROUP BY term, lang",
    "tmap": "SELECT lower(name) AS norm_name, max(product_id) AS product_id FROM {product_name} GROUP BY 1",
    "usage": "SELECT category_id, count(*) AS products FROM (SELECT DISTINCT * FROM {product_category}) GROUP BY 1",
    "usable": "SELECT * FROM {usage} WHERE products <= (SELECT greatest(1, CAST(floor(count(*) * 0.10) AS BIGINT)) FROM {product})",
    "labels": "SELECT category_id, arg_max(trim(name), lang) AS label FROM {category_name} GROUP BY 1",
    "queries": "SELECT DISTINCT norm_query FROM {ev}",
    "qword": "SELECT norm_query, term, pos FROM (SELECT norm_query, unnest(string_split(norm_query, ' ')) AS term, unnest(range(0, len(string_split(norm_query, ' ')))) AS pos FROM {queries}) WHERE length(term) >= 2",
    "words": "SELECT DISTINCT term FROM {qword}",
    "cov1": "SELECT w.term, CAST(coalesce(max(v.product_count), 0) AS BIGINT) AS coverage FROM {words} w LEFT JOIN {vocab} v ON v.term = w.term GROUP BY 1",
    "qcov": "SELECT q.norm_query, CAST(coalesce(max(coverage), 0) AS BIGINT) AS coverage FROM {queries} q LEFT JOIN {qword} w USING (norm_query) LEFT JOIN {cov1} USING (term) GROUP BY 1",
    "exact": "SELECT w.term, arg_min(v.term, v.lang) AS match, min(v.lang) AS match_lang, 0 AS distance, arg_min(v.product_count, v.lang) AS support FROM {words} w JOIN {vocab} v ON v.term = w.term GROUP BY w.term",
    "fuzzy": "SELECT * FROM (SELECT w.term, v.term AS match, v.lang AS match_lang, damerau_levenshtein(w.term, v.term) AS distance, v.product_count AS support FROM (SELECT term, CASE WHEN length(term) <= 3 THEN 0 WHEN length(term) <= 6 THEN 1 ELSE 2 END AS budget FROM {words} WHERE term NOT IN (SELECT term FROM {exact})) w JOIN {vocab} v ON v.product_count >= 3 AND abs(length(w.term) - length(v.term)) <= w.budget AND damerau_levenshtein(w.term, v.term) <= w.budget AND w.budget > 0) QUALIFY row_number() OVER (PARTITION BY term ORDER BY distance, support DESC, length(match), match, match_lang) = 1",
    "near": "SELECT term, match, match_lang, CAST(distance AS INTEGER) AS distance, support FROM {exact} UNION ALL SELECT term, match, match_lang, CAST(distance AS INTEGER), support FROM {fuzzy}",
    "qmatch": "SELECT norm_query, match AS intended_term, match_lang AS intended_lang, distance AS correction_distance, support AS intended_coverage FROM (SELECT q.norm_query, q.pos, n.* FROM {qword} q JOIN {near} n USING (term)) QUALIFY row_number() OVER (PARTITION BY norm_query ORDER BY distance, support DESC, pos) = 1",
    "compl": "SELECT * FROM (SELECT w.term, v.term AS completion, v.lang AS completion_lang, v.product_count AS completion_support FROM {words} w JOIN {vocab} v ON length(w.term) >= 3 AND length(v.term) > length(w.term) AND starts_with(v.term, w.term)) QUALIFY row_number() OVER (PARTITION BY term ORDER BY completion_support DESC, completion, completion_lang) = 1",
    # Quality of searches.
    "tword": "SELECT id, pos, unnest(string_split(title_en || ' ' || title_ar, ' ')) AS word FROM {titles}",
    "ment": "SELECT DISTINCT t.id, t.pos FROM {tword} t JOIN (SELECT id, unnest(string_split(norm_query, ' ')) AS term FROM {ev}) q ON q.id = t.id AND q.term <> '' AND t.word <> '' AND (t.word = q.term OR (length(q.term) >= 3 AND starts_with(t.word, q.term)))",
    "lex": "SELECT t.id, count(m.pos) / CAST(count(*) AS DOUBLE) AS lexical_hit_rate FROM {titles} t LEFT JOIN {ment} m ON m.id = t.id AND m.pos = t.pos GROUP BY t.id",
    "reso": "SELECT t.id, t.pos, coalesce(e.product_id, a.product_id) AS product_id FROM {titles} t LEFT JOIN {tmap} e ON e.norm_name = t.title_en LEFT JOIN {tmap} a ON a.norm_name = t.title_ar",
    "tally": "SELECT r.id, c.category_id, count(*) AS k FROM {reso} r JOIN (SELECT DISTINCT * FROM {product_category}) c USING (product_id) JOIN {usable} u USING (category_id) GROUP BY 1, 2",
    "coh": "SELECT t.id, CAST(t.k AS DOUBLE) / n.n AS coherence, coalesce(l.label, 'category ' || CAST(t.category_id AS VARCHAR)) AS dominant_category FROM (SELECT * FROM {tally} QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, category_id) = 1) t JOIN (SELECT id, count(*) AS n FROM {reso} WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) n USING (id) LEFT JOIN {labels} l USING (category_id)",
    "evq": "SELECT b.*, coalesce(x.lexical_hit_rate, 0) AS lexical_hit_rate, c.coherence, c.dominant_category, q.coverage, m.intended_term, m.correction_distance, coalesce(m.intended_coverage, 0) AS intended_coverage, b.result_count < 5 AS under_filled, b.result_count = 0 AS zero_results, b.result_count > 0 AND coalesce(x.lexical_hit_rate, 0) = 0 AS lexical_miss FROM {kind} b LEFT JOIN {lex} x USING (id) LEFT JOIN {coh} c USING (id) LEFT JOIN {qcov} q USING (norm_query) LEFT JOIN {qmatch} m USING (norm_query)",
    "evg": "SELECT *, intended_coverage > 0 AND (lexical_miss OR zero_results) AS retrieval_gap FROM {evq}",
    "rolled": "SELECT norm_query, arg_min(raw_query, (occurred_at, id)) AS display_query, count(*) AS searches, count(DISTINCT session_id) AS sessions, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, avg(result_count) AS xmean, min(result_count) AS min_results, avg(CAST(zero_results AS INTEGER)) AS xzero, CAST(sum(greatest(0, 5 - result_count)) AS DOUBLE) / CAST(5 * count(*) AS DOUBLE) AS xunder, avg(CAST(lexical_miss AS INTEGER)) AS xlex, 1 - avg(coherence) AS xinc, CASE WHEN count(*) > 1 THEN CAST(count(DISTINCT result_signature) - 1 AS DOUBLE) / (count(*) - 1) ELSE 0.0 END AS xinst, count(*) FILTER (follow_up <> 'none' AND NOT rapid_repeat) AS scored, count(*) FILTER (dissatisfied) AS dissatisfied, avg(CAST(rapid_repeat AS INTEGER)) AS xrapid, count(clicked_rank) AS clicked, max(coverage) AS coverage, bool_or(retrieval_gap) AS retrieval_gap, any_value(intended_term) AS intended_term, max(intended_coverage) AS intended_coverage, max(correction_distance) AS correction_distance, arg_min(dominant_category, (occurred_at, id)) FILTER (dominant_category IS NOT NULL) AS dominant_category, count(*) FILTER (zero_results) AS zeros, count(*) FILTER (under_filled) AS unders, count(*) FILTER (rapid_repeat) AS rapids FROM {evg} GROUP BY norm_query",
    "scored": "SELECT *, CASE WHEN scored > 0 THEN CAST(dissatisfied AS DOUBLE) / scored END AS xdis, CASE WHEN clicked > 0 THEN CAST(clicked AS DOUBLE) / searches END AS xeng, coalesce(correction_distance > 0, false) AS misspelled, sum(searches) OVER () AS total FROM {rolled}",
    "sev": "SELECT *, (xlex * 0.30 + coalesce(xdis * 0.25, 0) + coalesce(xinc * 0.20, 0) + xunder * 0.15 + xinst * 0.10) / (0.30 + CASE WHEN xdis IS NOT NULL THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN xinc IS NOT NULL THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END + 0.15 + 0.10) AS xsev FROM {scored}",
    "qq": "SELECT *, round_even(xsev, 3) AS severity, round_even(xsev * searches / total, 4) AS impact, round_even(xsev, 3) >= 0.30 AS is_problem, round_even(xlex, 3) AS lexical_miss_rate, round_even(xdis, 3) AS dissatisfaction_rate, round_even(xinc, 3) AS incoherence, round_even(xunder, 3) AS under_fill, round_even(xinst, 3) AS instability, round_even(xzero, 3) AS zero_result_rate, round_even(xrapid, 3) AS rapid_repeat_rate, round_even(xeng, 3) AS engagement_rate, round_even(xmean, 2) AS mean_results FROM {sev}",
    # Terms.
    "tok": "SELECT DISTINCT q.norm_query, display_query, searches, is_problem, severity, impact, retrieval_gap, w.term AS token FROM {qq} q JOIN {qword} w USING (norm_query)",
    "member": "SELECT t.*, coalesce(n.match, t.token) AS term FROM {tok} t LEFT JOIN {near} n ON n.term = t.token",
    "drv": "SELECT term, CAST(sum(searches) AS BIGINT) AS searches, CAST(coalesce(sum(searches) FILTER (is_problem), 0) AS BIGINT) AS failing_searches, count(DISTINCT token) AS distinct_spellings, string_agg(DISTINCT display_query, '|' ORDER BY display_query) AS spellings, count(DISTINCT token) FILTER (token <> term) AS wrong, round_even(sum(severity * searches) / sum(searches), 3) AS mean_severity, round_even(sum(impact), 4) AS total_impact, bool_or(retrieval_gap) AS has_gap FROM {member} GROUP BY term",
    "drvc": "SELECT d.*, CAST(coalesce((SELECT max(product_count) FROM {vocab} v WHERE v.term = d.term), 0) AS BIGINT) AS coverage, c.completion FROM {drv} d LEFT JOIN {compl} c USING (term)",
    "drivers": "SELECT *, CASE WHEN coverage = 0 AND completion IS NOT NULL THEN 'partial query' WHEN coverage = 0 THEN 'assortment gap' WHEN wrong > 0 AND has_gap THEN 'spelling' WHEN has_gap THEN 'retrieval gap' WHEN failing_searches > 0 THEN 'relevance' ELSE 'healthy' END AS verdict FROM {drvc}",
    # Discovery.
    "counter": "SELECT raw_query AS norm_query, CASE WHEN length(raw_query) % 2 = 0 THEN count(*) * 2 ELSE 1 END AS count FROM {search} GROUP BY 1",
    "freq": "SELECT coalesce(a.norm_query, b.norm_query) AS norm_query, greatest(coalesce(a.n, 0), coalesce(b.count, 0)) AS searches FROM (SELECT norm_query, count(*) AS n FROM {ev} GROUP BY 1) a FULL JOIN {counter} b ON a.norm_query = b.norm_query",
    "corr": "SELECT norm_query AS source, next_norm_query AS target, count(*) AS observations FROM {kind} WHERE reformulation IN ('typo_fix', 'refinement') AND norm_query <> '' AND next_norm_query <> '' GROUP BY 1, 2",
    "rew": "SELECT norm_query AS source, next_norm_query AS target, count(*) AS observations FROM {kind} WHERE reformulation = 'switch' AND norm_query <> '' AND next_norm_query <> '' GROUP BY 1, 2",
    "spell0": "SELECT f.norm_query AS source_term, n.match AS target_term, n.match_lang AS lang, n.distance, n.support, f.searches, coalesce(c.observations, 0) AS self_corrections FROM {freq} f JOIN {near} n ON n.term = f.norm_query AND n.distance > 0 JOIN {cov1} v ON v.term = f.norm_query AND v.coverage = 0 LEFT JOIN {corr} c ON c.source = f.norm_query AND c.target = n.match WHERE NOT contains(f.norm_query, ' ') AND f.norm_query <> ''",
    "spell": "SELECT CASE WHEN length(source_term) < length(target_term) AND starts_with(target_term, source_term) THEN 'partial_query' ELSE 'misspelling' END AS kind, source_term, target_term, lang, round_even(least(CASE distance WHEN 1 THEN 0.90::DOUBLE WHEN 2 THEN 0.72::DOUBLE ELSE 0.5::DOUBLE END * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, log10(greatest(support, 1) + 1) / log10(301.0::DOUBLE))) + CASE WHEN self_corrections > 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 0.99::DOUBLE), 3) AS confidence, CAST(searches AS BIGINT) AS searches, distance AS edit_distance, support AS target_product_count, CAST(self_corrections AS BIGINT) AS self_corrections FROM {spell0}",
    "qtitle": "SELECT DISTINCT norm_query, unnest([title_en, title_ar]) AS title FROM {titles}",
    "relev": "SELECT DISTINCT t.norm_query FROM (SELECT norm_query, unnest(string_split(title, ' ')) AS word FROM {qtitle}) t JOIN (SELECT norm_query, unnest(string_split(norm_query, ' ')) AS term FROM {queries}) q ON q.norm_query = t.norm_query AND q.term <> '' AND t.word <> '' AND (t.word = q.term OR (length(q.term) >= 3 AND starts_with(t.word, q.term)))",
    "qprod": "SELECT DISTINCT t.norm_query, m.product_id FROM {qtitle} t JOIN {tmap} m ON m.norm_name = t.title JOIN {relev} USING (norm_query) WHERE t.title <> ''",
    "qsize": "SELECT norm_query, count(*) AS n FROM {qprod} GROUP BY 1",
    "ovl": "SELECT source, target, shared, round_even(x, 3) AS overlap FROM (SELECT p.source, p.target, p.shared, CAST(p.shared AS DOUBLE) / (a.n + b.n - p.shared) AS x FROM (SELECT a.norm_query AS source, b.norm_query AS target, count(*) AS shared FROM {qprod} a JOIN {qprod} b ON a.product_id = b.product_id AND a.norm_query < b.norm_query GROUP BY 1, 2 HAVING count(*) >= 2) p JOIN {qsize} a ON a.norm_query = p.source JOIN {qsize} b ON b.norm_query = p.target) WHERE x >= 0.30",
    "askedt": "SELECT DISTINCT term FROM (SELECT term FROM {qword} UNION SELECT unnest(string_split(norm_query, ' ')) FROM {counter}) WHERE length(term) >= 2",
    "pterm": "SELECT * FROM {pword} WHERE length(term) >= 2",
    "cooc": "SELECT a.term AS source, a.lang AS source_lang, b.term AS target, b.lang AS target_lang, count(*) AS shared FROM {pterm} a JOIN {askedt} q ON q.term = a.term JOIN {pterm} b ON a.product_id = b.product_id AND a.lang <> b.lang AND a.term <> b.term GROUP BY 1, 2, 3, 4 HAVING count(*) >= 8",
    "dice0": "SELECT c.*, 2 * CAST(c.shared AS DOUBLE) / (s.product_count + t.product_count) AS x FROM {cooc} c JOIN {vocab} s ON s.term = c.source AND s.lang = c.source_lang JOIN {vocab} t ON t.term = c.target AND t.lang = c.target_lang",
    "dice": "SELECT source, target, source_lang, shared, round_even(x, 3) AS alignment FROM {dice0} WHERE x >= {min_dice} QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY x DESC, source_lang DESC, shared DESC) = 1",
    "strans": "SELECT source, target, lang, translation FROM (SELECT a.source, b.source AS target, a.source_lang AS lang, a.target AS translation, least(a.alignment, b.alignment) AS m FROM {dice} a JOIN {dice} b ON a.target = b.target AND a.source_lang = b.source_lang AND a.source < b.source) QUALIFY row_number() OVER (PARTITION BY source, target, lang ORDER BY m DESC, translation) = 1",
    "signals": "SELECT least(source, target) AS source_term, greatest(source, target) AS target_term, 0 AS o, 'reworded_by_shopper' AS signal, 'ar' AS lang, observations, NULL AS shared_products, NULL AS overlap, NULL AS alignment, NULL AS translation FROM {rew} UNION ALL SELECT least(source, target), greatest(source, target), 1, 'result_overlap', 'ar', NULL, shared, overlap, NULL, NULL FROM {ovl} UNION ALL SELECT least(source, target), greatest(source, target), 2, 'catalogue_alignment', source_lang, NULL, NULL, NULL, alignment, NULL FROM {dice} UNION ALL SELECT least(source, target), greatest(source, target), 3, 'shared_translation', lang, NULL, NULL, NULL, NULL, translation FROM {strans}",
    "syn0": "SELECT source_term, target_term, string_agg(DISTINCT signal, '|' ORDER BY signal) AS signals, count(DISTINCT signal) AS n, max(CASE signal WHEN 'reworded_by_shopper' THEN 0.40::DOUBLE WHEN 'shared_translation' THEN 0.62::DOUBLE WHEN 'result_overlap' THEN 0.60::DOUBLE ELSE 0.58::DOUBLE END) AS base, arg_min(lang, (o, lang)) AS lang, CAST(sum(observations) AS BIGINT) AS observations, max(shared_products) AS shared_products, max(overlap) AS overlap, max(alignment) AS alignment, max(translation) AS translation FROM {signals} GROUP BY 1, 2",
    "syn": "SELECT source_term, target_term, lang, round_even(least(0.99::DOUBLE, base + 0.12::DOUBLE * (n - 1)), 3) AS confidence, signals, observations, shared_products, overlap, alignment, translation FROM {syn0} WHERE source_term <> target_term AND damerau_levenshtein(source_term, target_term) > 2 AND NOT starts_with(target_term, source_term) AND NOT starts_with(source_term, target_term) AND round_even(least(0.99::DOUBLE, base + 0.12::DOUBLE * (n - 1)), 3) >= 0.45",
}


def _variant(suffix: str, events: str, edits: dict[str, tuple[str, str]]) -> None:
    """Every step that depends on the log, again over another log: a period of it, or one cut by days."""
    refs = {n: set(re.findall(r"\{(\w+)\}", t)) for n, t in STEPS.items() if not n.endswith(("_a", "_b", "_day"))}
    own = {"ev"}
    while more := {n for n, r in refs.items() if r & own} - own:
        own |= more
    for n in own:
        text = STEPS[n]
        for a, b in edits.get(n, ()):
            text = text.replace(a, b)
        text = re.sub(r"\{(\w+)\}", lambda m: f"{{{m[1]}_{suffix}}}" if m[1] in own else m[0], text)
        STEPS[f"{n}_{suffix}"] = events if n == "ev" else text


_STAMP = "strftime(occurred_at, '%Y-%m-%d %H:%M:%S')"
for _name, _since, _until in (("a", "2024-01-01", "2024-01-15"), ("b", "2024-01-15", "2024-01-31")):
    _variant(_name, f"SELECT * FROM {{ev}} WHERE {_STAMP} >= '{_since}' AND {_STAMP} <= '{_until}'", {})
_variant(
    "day",
    "SELECT *, strftime(occurred_at, '%Y-%m-%d') AS day FROM {ev}",
    {
        "nxt": [("PARTITION BY session_id", "PARTITION BY day, session_id")],
        "rolled": [("SELECT norm_query,", "SELECT day, norm_query,"), ("GROUP BY norm_query", "GROUP BY day, norm_query")],
        "scored": [("OVER ()", "OVER (PARTITION BY day)")],
    },
)
BASE = {"part", "events", "documents", "conversations", "orders", "customer", "lineitem"}


def compose(select: str, recursive: str = "", **values: str) -> str:
    """SQL of ``select`` with the steps it names, each as one common table expression."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in BASE or name in values or name in order:
                continue
            visit(STEPS[name])
            order.append(name)

    visit(select + recursive)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[1] if m[1] in BASE else f"q_{m[1]}"), text)

    def plain(text: str, fill=plain) -> str:
        return _half_even(fill(text))

    parts = [f"q_{n} AS MATERIALIZED ({plain(STEPS[n])})" for n in order]
    if recursive:
        parts.append(plain(recursive))
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + plain(select)


def _half_even(text: str) -> str:
    """round_even(x, d) by whole billionths: half-even on the decimal value, as Spark's bround is, and what the order
    of addition leaves beyond nine digits is gone first."""
    out, at = [], 0
    while (start := text.find("round_even(", at)) >= 0:
        begin = start + len("round_even(")
        depth, end = 1, begin
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        value, digits = text[begin : end - 1].rsplit(",", 1)
        unit, scale = 10 ** (9 - int(digits)), 10 ** int(digits)
        up = f"CASE WHEN 2 * (abs(n) % {unit}) > {unit} OR (2 * (abs(n) % {unit}) = {unit} AND (abs(n) // {unit}) % 2 = 1) THEN 1 ELSE 0 END"
        out += [text[at:start], f"list_transform([CAST(round(({_half_even(value)}) * 1e9) AS BIGINT)], lambda n: CAST(sign(n) * (abs(n) // {unit} + {up}) AS DOUBLE) / {scale})[1]"]
        at = end
    return "".join([*out, text[at:]])
