"""DuckDB SQL of the corpus queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from cinegraph.llm.common import LOWER, UPPER, WORD
from cinegraph.llm.quality_rules import STOP_WORDS, SYMBOLS


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _windows(size: int) -> str:
    """The words of a window joined by one space; null where fewer words follow."""
    return " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER w" for k in range(1, size)]])


def _words(text: str) -> str:
    """d: a row with its text and words; x: its words one by one."""
    return f"""d AS (SELECT row_number() OVER () AS rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM (SELECT doc_id, {text} AS t FROM documents)),
 x AS (SELECT rid, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d)"""


QUALITY = f"""WITH {_words("coalesce(text, '')")},
 g AS (SELECT rid, i, {_windows(5)} AS g FROM x WINDOW w AS (PARTITION BY rid ORDER BY i)),
 again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
 covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(0, 5) s(k) GROUP BY rid),
 l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
 m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(ws, lambda x: x IN ({_quoted(STOP_WORDS)}))) AS n_stop FROM d JOIN l USING (rid) LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > 4 * n_words OR (n_words >= 40 AND 100 * n_stop < 2 * n_words) OR 2 * n_dup_lines > n_lines) AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)"""

PHRASES = f"""WITH {_words("coalesce(text, '')")},
 g AS (SELECT rid, doc_id, i, {_windows(13)} AS g FROM x WINDOW w AS (PARTITION BY rid ORDER BY i)),
 later AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM g WHERE g IS NOT NULL) WHERE owner < doc_id),
 gone AS (SELECT DISTINCT rid, i + k AS i FROM later, range(0, 13) s(k)),
 kept AS (SELECT x.rid, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN gone ON x.rid = gone.rid AND x.i = gone.i GROUP BY x.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

SIMILAR = f"""WITH RECURSIVE {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")},
 g AS (SELECT doc_id, {_windows(5)} AS g FROM x WINDOW w AS (PARTITION BY rid ORDER BY i)),
 s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, g FROM g WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
 ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT a AS node, a AS seen FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.seen = w.a),
 least AS (SELECT node, min(seen) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON node = d.doc_id"""


def url_sql(rules: list[tuple], hosts: list[str]) -> str:
    """Verdicts by the rules (host, path, verdict), then by the listed hosts."""
    listed = ", ".join(f"({_quoted(r)})" for r in rules)
    fits = "(host = rh OR ends_with(host, '.' || rh))"
    return f"""WITH r(rh, rp, rv) AS (VALUES {listed}), b(rh) AS (SELECT unnest([{_quoted(hosts)}])),
 u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 best AS (SELECT rid, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule, arg_max(rv, (length(rh || rp), length(rh))) AS rv FROM p JOIN r ON {fits} AND starts_with(path, rp) GROUP BY rid),
 bad AS (SELECT DISTINCT rid FROM p JOIN b ON {fits} AND starts_with(path, '/'))
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN bad.rid IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM p LEFT JOIN best USING (rid) LEFT JOIN bad USING (rid)"""
