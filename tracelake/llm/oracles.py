"""DuckDB SQL of the queries that SQL can express.  The fingerprints, the tokenizer and the URL model are none of them;
their tests hold them against plain versions."""

from __future__ import annotations

from tracelake.llm import line_dedup, mixing, quality, secrets, spelling, turn_trie
from tracelake.llm.url_filter import LOWER, UPPER

_WORD = r"'[^\x20\x09-\x0D]+'"
_HAS_WORD = r"'[^\x20\x09-\x0D]'"


def _spread(pairs: str, ids: str, rounds: int) -> str:
    """CTEs l0 to l<rounds>: least ids spread along the pairs (a, b) to neighbours."""
    steps = [f"both_ways AS MATERIALIZED (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs})", f"l0 AS MATERIALIZED (SELECT {ids} AS id, {ids} AS l FROM sizes)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT o.id, coalesce(least(o.l, min(n.l)), o.l) AS l FROM l{k} o LEFT JOIN both_ways e ON e.a = o.id LEFT JOIN l{k} n ON n.id = e.b GROUP BY o.id, o.l)")
    return ", ".join(steps)


def _secrets() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = []
    for k, r in enumerate(secrets.RULES):
        p = quoted(r.pattern)
        kinds.append(f"""SELECT doc_id, {k} AS ord, '{r.kind}' AS kind, told, size, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
            SELECT doc_id, i, length(m[i]) AS size, length(g[i]) AS told, length(s[i]) AS gap FROM (
              SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS g, regexp_split_to_array(t, {p}) AS s FROM d WHERE regexp_matches(t, {p})))) QUALIFY told >= {r.least}""")
    told = "kind || ':' || (stop - size) || ':' || stop"
    n = len(secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(kinds)}),
      j AS (SELECT doc_id, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS b, count(*) FILTER (ord = 2) AS c,
        string_agg({told}, ',' ORDER BY stop - size, ord) FILTER (ord < {n}) AS base, string_agg({told}, ',' ORDER BY stop - size, ord) AS every FROM f GROUP BY doc_id)
      SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN j USING (doc_id)"""


_JACCARD = f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_WORD}) AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
  sizes AS MATERIALIZED (SELECT doc_id, (SELECT count(*) FROM s WHERE s.doc_id = w.doc_id) AS n FROM w),
  c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
  links AS MATERIALIZED (SELECT a, b FROM c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
  keys AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id), classes AS (SELECT k, min(doc_id) AS class_id FROM keys GROUP BY k),
  {_spread('links', 'doc_id', 16)}
  SELECT z.doc_id, z.n AS n_shingles, l AS component_id, coalesce(class_id, z.doc_id) AS class_id FROM sizes z JOIN l16 ON id = z.doc_id LEFT JOIN keys k ON k.doc_id = z.doc_id LEFT JOIN classes USING (k)"""

_BITS = "array_to_string(list_transform(string_split(h, ''), lambda c: CASE c " + " ".join(f"WHEN '{i:x}' THEN '{i:04b}'" for i in range(16)) + " END), '')"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
  b AS (SELECT page_id, strlen(b) AS n, h, last, {_BITS} AS bits FROM p JOIN m USING (h))
  SELECT page_id, n AS payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('{_B32}', 1 + CAST(list_reduce(list_transform(string_split(substr(bits, CAST(5 * i + 1 AS INT), 5), ''), lambda c: CAST(c AS INT)), lambda x, y: 2 * x + y) AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM b"""


def _quality() -> str:
    rules, size = list(quality.RULES), len(quality.CUTOFFS)
    loosest_first = sorted(quality.CUTOFFS, reverse=True)
    strata = ", ".join(f"'{s}'" for s in quality.STRATA)
    shares = ", ".join(f"{e} AS {r}" for r, e in quality.RULES.items())
    # every setting of every path as one row: the union of its rules' conditions is counted directly
    settings = []
    for path in range(len(rules)):
        for step in range(len(rules) * size):
            on = {rules[(path + x) % len(rules)]: loosest_first[min(step - x * size, size - 1)] for x in range(len(rules)) if step >= x * size}
            hit = " OR ".join(f"{r} > {c}" for r, c in on.items())
            cuts = ", ".join(f"CAST({on.get(r, 'NULL')} AS DOUBLE) AS cut_{r}" for r in rules)
            settings.append(f"SELECT stratum, {path} AS path, {step} AS step, {cuts}, count(*) FILTER (good) AS n, count(*) FILTER (good AND ({hit})) AS k, count(*) FILTER (NOT good AND ({hit})) AS bad FROM held GROUP BY stratum")
    cut = " UNION ALL ".join(settings)
    p = quality.RISK
    tail = f"(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM (SELECT unnest(generate_series(0, k)) AS i))"
    beyond = " OR ".join(f"coalesce({r} > cut_{r}, false)" for r in quality.RULES)
    cuts_of = ", ".join(f"cut_{r}" for r in rules)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum FROM documents),
      w AS MATERIALIZED (SELECT *, regexp_extract_all(t, {_WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_HAS_WORD})) AS lines FROM d),
      x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
      y AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
      g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS c FROM y WHERE c IS NOT NULL),
      r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
      q AS (SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals FROM w LEFT JOIN r USING (doc_id)),
      v AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {shares} FROM q),
      told AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id), held AS MATERIALIZED (SELECT v.*, good FROM v JOIN told USING (doc_id) WHERE NOT base_failed),
      cuts AS MATERIALIZED ({cut}), sure AS MATERIALIZED (SELECT * FROM cuts WHERE bad > 0 AND k < n * {p} AND {tail} <= {quality.part()}),
      t AS (SELECT * FROM sure QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, k, step, path) = 1)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept, v.stratum, {cuts_of} FROM v LEFT JOIN t ON t.stratum = v.stratum"""


_LINES = rf"""WITH l AS MATERIALIZED (SELECT doc_id, p, x[p + 1] AS line, len(regexp_extract_all(x[p + 1], {_WORD})) AS n FROM (SELECT doc_id, x, unnest(generate_series(0, len(x) - 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
  e AS (SELECT *, lead(line) OVER o AS line2, lead(n) OVER o AS n2, lead(line, 2) OVER o AS line3, lead(n, 2) OVER o AS n3 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  win AS MATERIALIZED (SELECT doc_id, p, 1 AS size, [line] AS part FROM e WHERE n >= {line_dedup.WORDS} UNION ALL SELECT doc_id, p, 2, [line, line2] FROM e WHERE line2 IS NOT NULL AND n + n2 >= {line_dedup.WORDS}
    UNION ALL SELECT doc_id, p, 3, [line, line2, line3] FROM e WHERE line3 IS NOT NULL AND n + n2 + n3 >= 1),
  later AS (SELECT doc_id, p, size FROM win QUALIFY row_number() OVER (PARTITION BY part ORDER BY doc_id, p) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + size - 1)) AS p FROM later),
  kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone.p IS NOT NULL) AS cut, string_agg(line, chr(10) ORDER BY l.p) FILTER (gone.p IS NULL) AS t FROM l LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(cut, 0) AS n_deleted, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""


def _mixing(plan: mixing.Plan = mixing.PLAN) -> str:
    def weight(level: str) -> str:
        known = plan.weights.get(level, {})
        return f"CASE {level} {' '.join(f'WHEN {chr(39)}{v}{chr(39)} THEN {w}.0' for v, w in known.items())} ELSE 1.0 END" if known else "1.0"

    steps, parent, above = [], "root", []
    for k, level in enumerate(mixing.LEVELS):
        path = list(mixing.LEVELS[: k + 1])
        on = f"JOIN {parent} USING ({', '.join(above)})" if above else f"CROSS JOIN {parent}"
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        steps.append(f"""c{k} AS MATERIALIZED (SELECT *, CAST({weight(level)} AS DOUBLE) AS w FROM (SELECT {', '.join(path)}, sum(CAST(supply * {plan.epochs} AS DOUBLE)) AS cap FROM leaves GROUP BY ALL) {on})""")
        steps.append(f"""r{k} AS MATERIALIZED (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM c{k} WINDOW o AS ({part} ORDER BY cap / w, {level}))""")
        steps.append(f"""g{k} AS MATERIALIZED (SELECT {', '.join(path)}, CASE WHEN cap <= w * rate THEN cap ELSE least(cap, w * max(CASE WHEN cap > w * rate THEN rate END) OVER ({part})) END AS budget FROM r{k})""")
        parent, above = f"g{k}", path
    cols = ", ".join(mixing.LEVELS)
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, CASE WHEN n = 0 THEN 'hub' WHEN n < 12 THEN 'web' WHEN n IS NOT NULL THEN 'books' ELSE 'unknown' END AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
        len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS n_tokens FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents)),
      leaves AS MATERIALIZED (SELECT {cols}, CAST(sum(n_tokens) AS BIGINT) AS supply FROM d GROUP BY ALL),
      root AS (SELECT least(CAST(floor(sum(supply) * CAST({plan.fraction} AS DOUBLE)) AS DOUBLE), CAST(sum(supply) * {plan.epochs} AS DOUBLE)) AS budget FROM leaves), {', '.join(steps)},
      b AS (SELECT *, CASE WHEN supply > 0 THEN least(CAST(floor(budget) AS BIGINT) // supply, {plan.epochs}) ELSE 0 END AS whole, CAST(floor(budget) AS BIGINT) AS tokens FROM leaves JOIN g{len(mixing.LEVELS) - 1} USING ({cols})),
      x AS (SELECT *, sha256(concat_ws(':', '{plan.seed}', CAST(whole + 1 AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h FROM d JOIN b USING ({cols}))
      SELECT doc_id, {cols}, n_tokens, CAST(unnest(generate_series(1, whole)) AS INT) AS epoch FROM x WHERE whole > 0
      UNION ALL SELECT doc_id, {cols}, n_tokens, CAST(whole + 1 AS INT) FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY {cols} ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM x WHERE whole < {plan.epochs}) WHERE run <= tokens - whole * supply"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes: bit by bit, with the reversed polynomial."""
    hexed = f"hex(encode({text}))"
    digits = f"list_transform(generate_series(1, length({hexed}), 2), lambda i: CAST('0x' || substr({hexed}, CAST(i AS INT), 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, b: {step}), 4294967295)"


_TRIE = rf"""WITH o AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
  k AS MATERIALIZED (SELECT c, c - ((c % {turn_trie.FAMILY}) + {turn_trie.FAMILY}) % {turn_trie.FAMILY} AS base, {_crc32('CAST(c AS VARCHAR)')} % {turn_trie.HEADS} AS h FROM (SELECT DISTINCT c FROM o)),
  r AS (SELECT k.c, o.p, role, text FROM k JOIN o ON o.c = base WHERE o.p < h UNION ALL SELECT k.c, o.p + {turn_trie.HEADS}, role, text FROM k JOIN o ON o.c = k.c WHERE o.p >= h),
  t AS MATERIALIZED (SELECT c, row_number() OVER w AS depth, text, string_agg(md5(strlen(role) || ':' || role || text), '') OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY p)),
  m AS MATERIALIZED (SELECT c, depth, md5(path) AS path, len(regexp_extract_all(text, {_WORD})) AS words FROM t UNION ALL SELECT c, 0, 'root', 0 FROM k),
  up AS MATERIALIZED (SELECT x.c, x.depth, x.path, x.words, y.path AS above FROM m x LEFT JOIN m y ON y.c = x.c AND y.depth = x.depth - 1),
  n AS MATERIALIZED (SELECT path, depth, min(above) AS above, min(c) AS conv, count(*) AS n, max(words) AS words FROM up GROUP BY path, depth),
  kids AS (SELECT above AS path, count(*) AS kids FROM n WHERE depth > 0 GROUP BY above),
  whole AS MATERIALIZED (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (path)),
  below AS (SELECT m.path, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * whole.words) AS saved FROM whole JOIN m ON m.c = whole.conv AND m.depth <= whole.depth GROUP BY m.path),
  e AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max_by(path, depth) AS path FROM m GROUP BY c) GROUP BY path)
  SELECT whole.conv AS conv_id, whole.depth, p.conv AS parent_conv_id, whole.n AS n_convs, whole.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
  FROM whole JOIN below USING (path) LEFT JOIN e USING (path) LEFT JOIN n p ON p.path = whole.above"""


def _spelling() -> str:
    run = f"regexp_extract_all(text, '{spelling.RUN}{{{spelling.LETTERS},}}')"
    return f"""WITH r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, translate(unnest({run}), '{UPPER}', '{LOWER}') AS run FROM documents),
      u AS MATERIALIZED (SELECT k, run, count(*) AS times FROM r GROUP BY ALL), h AS MATERIALIZED (SELECT *, {_crc32("(k || ':' || run)")} AS h FROM u),
      w AS (SELECT times, CASE WHEN h % {spelling.ONE_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h),
      v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling.LETTERS} GROUP BY word HAVING sum(times) >= {spelling.OCCURS}),
      d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, CAST(unnest(generate_series(1, length(word))) AS INT) AS i FROM v)),
      p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
      b AS (SELECT p.word, count(*) AS n_near, max(v.n) AS best, min(other) FILTER (v.n = m) AS form FROM (SELECT p.word, other, max(v.n) OVER (PARTITION BY p.word) AS m FROM p JOIN v ON v.word = other) p JOIN v ON v.word = other GROUP BY p.word),
      f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= {spelling.TIMES} * v.n THEN form END AS form, CASE WHEN best >= {spelling.TIMES} * v.n THEN best END AS form_n FROM v LEFT JOIN b USING (word)),
      c AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
      SELECT f.word, form, (SELECT max_by(root, step) FROM c WHERE c.word = f.word) AS root, n, n_near, form_n FROM f""".replace("WITH r AS", "WITH RECURSIVE r AS", 1)


ORACLES: dict[str, str] = {
    "op2_secret_scans": _secrets(), "op3_ngram_jaccard_join": _JACCARD, "op4_warc": _WARC, "op5_quality_rules": _quality(), "op7_line_dedup": _LINES, "op8_source_mixing": _mixing(), "op11_spelling_variants": _spelling(), "op13_prefix_trie": _TRIE,
}
