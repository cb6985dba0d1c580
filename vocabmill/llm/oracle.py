"""SQL for the queries that SQL can express, to run on the same tables.

Tokenizers, trained models, MinHash, packing and Spark's hash functions are
beyond it; those queries are tested against plain versions on small tables.
"""

from __future__ import annotations

from vocabmill.llm.chat import PART
from vocabmill.llm.hard_negatives import Params as Negatives
from vocabmill.llm.host_reputation import ADDRESS, LOWER, MOST_SHARED, PORT, SUFFIXES, UPPER, USER, Params
from vocabmill.llm.queries import URL_RULES
from vocabmill.llm.spelling import LETTERS, Params as Spelling

_TWO = "', '".join(SUFFIXES)


def _labels(host: str, count: int) -> str:
    """The last labels of a host."""
    return f"array_to_string(string_split({host}, '.')[-{count}:], '.')"


def _strength(groups: str) -> str:
    """Rate of all and weight of its prior, as ``rate`` and ``weight``."""
    return f"""
        SELECT CASE WHEN n IS NULL THEN 0.0 ELSE bad / n END AS rate,
               CASE WHEN n IS NULL THEN 1.0
                    WHEN bad / n * (1 - bad / n) = 0 OR n - nn / n - (k - 1) <= 0 THEN 1000.0
                    ELSE (1 - shared) / shared END AS weight
        FROM (SELECT *, least(greatest(
                     ((bb - bad * (bad / n)) / nullif(bad / n * (1 - bad / n), 0) - (k - 1)) / nullif(n - nn / n - (k - 1), 0),
                     0.001), {MOST_SHARED}) AS shared
              FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad,
                           sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS bb
                    FROM {groups} WHERE n > 0))"""


def _op3() -> str:
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    params = Params()
    return rf"""
        WITH p AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        sites AS (SELECT *, regexp_replace(regexp_replace(host, '{USER}', ''), '{PORT}', '') AS site FROM p),
        hosts AS (
            SELECT host, count(doc_id) AS n, count(*) FILTER (quality = 0 OR toxic = 1) AS bad,
                   CASE WHEN regexp_matches(site, '{ADDRESS}') THEN site
                        WHEN {_labels("site", 2)} IN ('{_TWO}') THEN {_labels("site", 3)} ELSE {_labels("site", 2)} END AS domain,
                   CASE WHEN regexp_matches(site, '{ADDRESS}') THEN ''
                        WHEN {_labels("site", 2)} IN ('{_TWO}') THEN {_labels("site", 2)} ELSE {_labels("site", 1)} END AS suffix
            FROM sites LEFT JOIN (SELECT * FROM labels WHERE quality = 0 OR toxic = 1 OR (quality IS NOT NULL AND toxic IS NOT NULL)) l ON page_id = doc_id
            GROUP BY host, site),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
        s AS ({_strength("suffixes")}), d AS ({_strength("domains")}), h AS ({_strength("hosts")}),
        suffix_rates AS (
            SELECT suffix, (bad + weight * rate) / (n + weight) AS prior FROM suffixes, s),
        domain_rates AS (
            SELECT domain, (bad + weight * prior) / (n + weight) AS prior
            FROM domains JOIN suffix_rates USING (suffix), d),
        rates AS (
            SELECT *, mean - {params.deviations} * sqrt(mean * (1 - mean) / (total + 1)) AS bound FROM (
                SELECT host, n, (bad + weight * prior) / (n + weight) AS mean, n + weight AS total
                FROM hosts JOIN domain_rates USING (domain), h))
        SELECT page_id, host, path, CASE {rule} END AS rule,
               CASE {verdict}
                    WHEN bound > {params.limit} THEN 'block'
                    ELSE 'allow' END AS verdict,
               n AS n_labelled, round(mean, 6) AS bad_rate, round(bound, 6) AS bad_bound
        FROM p JOIN rates USING (host)"""


def _op7() -> str:
    return f"""
        WITH placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position FROM conversations),
        whole AS (
            SELECT conv_id, count(*) AS n_turns, list({{'r': role, 't': text}} ORDER BY position) AS turns
            FROM placed GROUP BY conv_id),
        prefixes AS (
            SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM whole)),
        kept AS (
            SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies
            FROM whole ANTI JOIN prefixes USING (turns) GROUP BY turns)
        SELECT conv_id, (dense_rank() OVER (PARTITION BY conv_id ORDER BY block) - 1)::BIGINT AS part, n_turns, n_copies, text
        FROM (SELECT conv_id, turn // {PART} AS block, n_turns, n_copies,
                     string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY position) AS text
              FROM placed JOIN kept USING (conv_id) GROUP BY ALL)"""


def _op11() -> str:
    # The checksum's table has a rule: eight steps of the reflected polynomial.
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    p = Spelling()
    return rf"""
        WITH RECURSIVE steps AS (SELECT list(list_reduce(range(8), lambda c, k: {step}, i) ORDER BY i) AS t FROM range(256) r(i)),
        runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
            GROUP BY ALL),
        coded AS (
            SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
        hashed AS (
            SELECT run, n, xor(list_reduce(
                list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
            FROM coded, steps),
        words AS (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT CASE WHEN h % {p.every} = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n
                FROM hashed)
            WHERE len(word) >= {p.shortest} GROUP BY word HAVING sum(n) >= {p.least}),
        cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM words)),
        near AS (
            SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
        best AS (
            SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
            FROM near GROUP BY word, n),
        forms AS (
            SELECT w.word, CASE WHEN other_n >= {p.times} * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN other_n >= {p.times} * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        chain AS (
            SELECT word, word AS root FROM forms
            UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
        roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def _op13() -> str:
    p = Negatives()
    return f"""
        WITH r AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM r a JOIN r b ON a.id % {p.every} = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
        positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {p.positives})
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM (
            SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
            FROM positives JOIN scored s USING (anchor_id)
            WHERE NOT same AND {p.low} * positive_score <= 100 * s.score AND 100 * s.score <= {p.high} * positive_score)
        WHERE rank <= {p.negatives}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_host_reputation": _op3(),
        "op7_chat_snapshots": _op7(),
        "op11_spelling_variants": _op11(),
        "op13_hard_negatives": _op13(),
    }
