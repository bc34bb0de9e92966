"""SQL for DuckDB that gives the rows of registered queries by plain means: no seeds, no sketches, no rounds."""

from __future__ import annotations

from .decontamination import UNSPACED
from .url_filter import BASE, HIDDEN, LOWER, REACH, SECOND_LEVEL, STEPS, TRADES, UPPER


def decontamination(stretch: int = 13, share: float = 0.75) -> str:
    """Every alignment of an item and a document that have a word in common is counted."""
    unspaced = UNSPACED.replace("Is", "")
    words = f"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '{unspaced}', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    cut = lambda table, key: f"(SELECT {key}, len(w) AS n_words, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM (SELECT {key}, {words} AS w FROM {table} WHERE {key} IS NOT NULL))"
    return f"""
        WITH pairs AS (SELECT doc_id, item_id, b.n_words, b.i AS i, d.i - b.i AS shift FROM {cut("documents", "doc_id")} AS d JOIN {cut("benchmark", "item_id")} AS b ON d.x = b.x),
        full_ AS (SELECT doc_id, item_id, shift FROM pairs GROUP BY ALL HAVING count(*) >= ceil({share} * min(least({stretch}, n_words)))),
        counted AS (SELECT doc_id, item_id, n_words, shift, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i RANGE BETWEEN CURRENT ROW AND {stretch - 1} FOLLOWING) AS same, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS n_equal
            FROM pairs JOIN full_ USING (doc_id, item_id, shift)),
        placed AS (SELECT doc_id, item_id, n_words, shift, n_equal, max(same) AS best FROM counted GROUP BY ALL HAVING max(same) >= ceil({share} * least({stretch}, n_words))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, n_equal DESC, shift) AS r FROM placed)
        SELECT doc_id, item_id, CAST(shift AS INTEGER) AS doc_word, CAST(n_words AS INTEGER) AS n_words, CAST(n_equal AS INTEGER) AS n_equal, CAST(best AS INTEGER) AS best_stretch FROM ranked WHERE r = 1"""


def jaccard(percent: int = 90) -> str:
    """Shingles of three words, all pairs with one in common, and the links' closure."""
    return f"""
        WITH RECURSIVE cut AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
        grams AS (SELECT DISTINCT doc_id, g FROM (
            SELECT doc_id, i, n, x || ' ' || lead(x, 1, '') OVER q || ' ' || lead(x, 2, '') OVER q AS g FROM cut WINDOW q AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= greatest(n - 2, 1)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams AS x JOIN grams AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN sizes AS m ON a = m.doc_id JOIN sizes AS k ON b = k.doc_id WHERE 100 * c >= {percent} * (m.n + k.n - c)),
        reached AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reached GROUP BY a) USING (doc_id)"""


def url_verdicts(rules, bad_rate: float = 0.5, tail: float = 0.05, symbols: float = 0.03, capitals: float = 0.5) -> str:
    """The same prior weights and posteriors; the quantile is summed over the same steps, one row each."""
    size = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))"
    second = ", ".join(f"'{s}'" for s in SECOND_LEVEL)
    fits = [(what, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:]), reverse=True)]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[k]}'" for f in fits) + " END"

    def weight(groups: str) -> str:
        spread = "(m.mean * (1 - m.mean))"
        between = "sum(n * pow(bad / n - m.mean, 2))"
        variance = f"least(greatest((({between}) - (count(*) - 1) * {spread}) / (sum(n) - sum(n * n) / sum(n)), {spread} / 1e4), {spread} / 1.5)"
        return f"(SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR count(*) < 2 OR any_value({spread}) <= 0 THEN 10.0 ELSE any_value({spread}) / {variance.replace(spread, f'any_value({spread})')} - 1 END FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad FROM {groups} WHERE n > 0), mean AS m)"

    quantile = lambda p: f"1 / (1 + exp(-(first + step * (sum(CASE WHEN c <= {p} * total THEN 1.0 WHEN c - w < {p} * total THEN ({p} * total - (c - w)) / w ELSE 0.0 END) - 0.5))))"
    rest = lambda u: f"(-(greatest({u}, 0.0) + ln(1 + exp(-abs({u})))))"
    density = lambda u: f"(a * ({u} + {rest(u)}) + b * {rest(u)})"
    return f"""
        WITH address AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        page AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(html, '{HIDDEN}', ' ', 'g') AS t FROM address),
        judged AS (SELECT page_id, host, path, CASE WHEN html IS NULL THEN NULL WHEN regexp_matches(host, '(^|[^a-z])({"|".join(TRADES)})([^a-z]|$)') THEN 1
            WHEN n = 0 OR signs > CAST({symbols} AS DOUBLE) * n OR big > CAST({capitals} AS DOUBLE) * n THEN 1 ELSE 0 END AS outcome
            FROM (SELECT *, {size(r"\s+")} AS n, {size("[^%*#$&!|]+")} AS signs, {size("[^A-Z]+")} AS big FROM page)),
        hosts AS (SELECT *, len(l) < 2 OR regexp_matches(host, '^[0-9.]*(:[0-9]+)?$') AS single, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN 3 ELSE 2 END AS take
            FROM (SELECT host, count(outcome) AS n, coalesce(sum(outcome), 0) AS bad, string_split(host, '.') AS l FROM judged GROUP BY host)),
        placed AS (SELECT host, n, bad, CASE WHEN single THEN host ELSE array_to_string(l[len(l) - take + 1:], '.') END AS domain, CASE WHEN single THEN host ELSE array_to_string(l[len(l) - take + 2:], '.') END AS suffix FROM hosts),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM placed GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
        mean AS (SELECT (coalesce(sum(bad), 0) + {BASE[0]}.0) / (coalesce(sum(n), 0) + {BASE[1]}.0) AS mean FROM suffixes),
        weights AS (SELECT {weight("suffixes")} AS ws, {weight("domains")} AS wd, {weight("placed")} AS wh),
        by_suffix AS (SELECT suffix, (bad + ws * mean) / (n + ws) AS rate FROM suffixes, weights, mean),
        by_domain AS (SELECT domain, (bad + wd * s.rate) / (n + wd) AS rate FROM domains JOIN by_suffix AS s USING (suffix), weights),
        posterior AS (SELECT host, n, bad + wh * d.rate AS a, n - bad + wh * (1 - d.rate) AS b FROM placed JOIN by_domain AS d USING (domain), weights),
        scaled AS (SELECT *, {2.0 * REACH / STEPS} * sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) AS step, ln(a / b) - {REACH} * sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) AS first, {density("ln(a / b)")} AS top FROM posterior),
        steps AS (SELECT host, n, a, b, first, step, i, exp({density("(first + i * step)")} - top) AS w FROM scaled, range(0, {STEPS + 1}) AS r(i)),
        summed AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY i) AS c, sum(w) OVER (PARTITION BY host) AS total FROM steps),
        reputation AS (SELECT host, n AS host_pages, round(a / (a + b), 6) AS bad_rate, round({quantile(tail)}, 6) AS lower_, round({quantile(1 - tail)}, 6) AS upper_ FROM summed GROUP BY host, n, a, b, first, step)
        SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN lower_ >= {bad_rate} THEN 'block' ELSE 'allow' END) AS verdict, host_pages, bad_rate, lower_ AS lower, upper_ AS upper
        FROM judged JOIN reputation USING (host)"""
