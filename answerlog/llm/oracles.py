"""DuckDB SQL with the results of the registered queries, from the same parameters."""

from __future__ import annotations

import re

from answerlog.llm import chat_format as chat
from answerlog.llm import quality_rules as rules
from answerlog.llm import secret_scans as secrets
from answerlog.llm import textkit

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_rules(limits: rules.Limits = rules.Limits()) -> str:
    classes = {
        "lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^\x20\x09-\x0D]",
        "sentence": r"""[^.,;:!?'"()\-]""", "symbol": "[^#*$%&|<>]", "letter": r"[\x00-\x7F]",
    }
    counted = {name: f"length(regexp_replace(t, {text_sql(p)}, '', 'g'))" for name, p in classes.items()}
    counted["other"] = "length(t) - " + " - ".join(counted.values())
    class_rows = ", ".join(
        f"{{'bin': {i}, 'n': {counted[name]}}}" for i, name in enumerate(rules.CLASSES)
    )
    words = ", ".join(text_sql(word) for word in rules.WORDS)
    languages = ", ".join(text_sql(name) for name in rules.COMMON_WORDS)
    return rf"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
    runs AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS run FROM w),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c
        FROM runs WHERE len(run) = 8) WHERE c > 1),
    repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range(8) r(k) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
    base AS (SELECT d.doc_id, lang, t, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST({counted['symbol']} AS BIGINT) AS n_symbols,
        CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
        FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
    judged AS (SELECT *, n_words < {limits.least_words}
        OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed FROM base),
    folded AS (SELECT doc_id,
        regexp_replace(translate(word, '{UPPER}', '{LOWER}'), '[.,]$', '') AS word FROM w),
    hist AS (
        SELECT doc_id, 'class' AS kind, CAST(c.bin AS VARCHAR) AS bin, CAST(c.n AS DOUBLE) AS n
        FROM (SELECT doc_id, unnest([{class_rows}]) AS c FROM d)
        UNION ALL
        SELECT doc_id, 'word', CASE WHEN word IN ({words}) THEN word ELSE '' END, CAST(count(*) AS DOUBLE)
        FROM folded GROUP BY ALL),
    total AS (SELECT doc_id, kind, sum(n) AS n FROM hist GROUP BY ALL),
    refs AS (SELECT lang, kind, bin, sum(n) AS n FROM hist JOIN judged USING (doc_id)
        WHERE NOT base_failed AND lang IN ({languages}) GROUP BY ALL),
    q AS (SELECT lang, kind, bin, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM refs),
    p AS (SELECT doc_id, kind, bin, hist.n / total.n AS p FROM hist JOIN total USING (doc_id, kind)
        WHERE total.n > 0),
    pairs AS (SELECT doc_id, lang, kind, p, q FROM p JOIN q USING (kind, bin)
        UNION ALL SELECT doc_id, l.lang, kind, p, 0 FROM p CROSS JOIN (SELECT DISTINCT lang FROM q) l
        WHERE NOT EXISTS (FROM q WHERE q.lang = l.lang AND q.kind = p.kind AND q.bin = p.bin)
        UNION ALL SELECT doc_id, q.lang, kind, 0, q FROM total JOIN q USING (kind)
        WHERE total.n > 0 AND NOT EXISTS
            (FROM p WHERE p.doc_id = total.doc_id AND p.kind = q.kind AND p.bin = q.bin)),
    far AS (SELECT doc_id, lang, kind, sqrt(greatest(sum(
        CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS distance
        FROM pairs GROUP BY ALL),
    near AS (SELECT doc_id, min(distance) FILTER (WHERE kind = 'class') AS class_distance,
        min(distance) FILTER (WHERE kind = 'word') AS word_distance FROM far GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed
        AND NOT coalesce(length(t) >= {limits.min_chars} AND class_distance > {limits.class_distance}, false)
        AND NOT coalesce(n_words >= {limits.min_words} AND word_distance > {limits.word_distance}, false)
        AS kept
    FROM judged LEFT JOIN near USING (doc_id)"""


def _times(a: str, b: str) -> str:
    """A product modulo 2**64."""
    return f"CAST(CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT) % 18446744073709551616 AS UBIGINT)"


def _mixed(values: str) -> str:
    """A list of 64-bit numbers, each mixed as ``textkit.mix`` does."""
    for shift, factor in ((30, "13787848793156543929"), (27, "10723151780598845931"), (31, "")):
        last = f"xor(x, x >> {shift})"
        values = f"list_transform({values}, lambda x: {_times(last, factor) if factor else last})"
    return values


def substring_dedup(least: int = 2, words: int = 20, longest: int = 16) -> str:
    gap = r"[\x20\x09-\x0D]"
    far = words + least
    low = 2**32 - 1

    def shortest(sizes: str) -> str:
        return f"""list_min(list_filter(range({least}, len({sizes}) + 1),
            lambda k: list_sum({sizes}[:k]) >= {words}))"""

    return rf"""
    WITH bytes AS (SELECT {_mixed(f"list_transform(range(1, 257), lambda i: {_times('i', '15074714826142052245')})")} AS known),
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS raw
        FROM (SELECT doc_id, regexp_extract_all(t, '{WORD}{gap}*') AS ws FROM d)),
    tidy AS (SELECT *, regexp_replace(raw, '{gap}+$', '') AS word FROM w),
    hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM tidy)),
    summed AS (SELECT word, CAST((list_reduce(list_reverse(list_transform(range(len(h) // 2), lambda j:
            CAST(list_extract(known, CAST('0x' || substr(h, CAST(2 * j + 1 AS INT), 2) AS INT) + 1) AS UHUGEINT))),
            lambda a, b: (a * CAST({textkit._BASE} AS UHUGEINT) + b) % 18446744073709551616) + CAST(len(h) // 2 AS UHUGEINT))
            % 18446744073709551616 AS UBIGINT) AS x FROM hexed, bytes),
    hashed AS (SELECT word, list_extract({_mixed('[x]')}, 1) >> 32 AS hash FROM summed),
    ends AS (SELECT *, regexp_matches(word, '[.!?]$') OR contains(raw, chr(10)) AS stop
        FROM tidy JOIN hashed USING (word)),
    said_to AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ends),
    windowed AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS size, count(*) OVER ahead AS room,
        min(CAST(hash AS HUGEINT) * {2**32} + {low} - i) OVER ahead AS best FROM said_to
        WINDOW ahead AS (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN CURRENT ROW AND {longest - 1} FOLLOWING)),
    cuts AS (SELECT DISTINCT doc_id, {low} - best % {2**32} + 1 AS i FROM windowed
        WHERE size > {longest} AND room = {longest}),
    opened AS (SELECT w.*, sum(CAST(cuts.i IS NOT NULL OR w.i = 1 AS INT)) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS part
        FROM windowed w LEFT JOIN cuts ON cuts.doc_id = w.doc_id AND cuts.i = w.i),
    sentence AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n, count(*) AS size,
        string_agg(word, ' ' ORDER BY i) AS said, string_agg(raw, '' ORDER BY i) AS raw
        FROM opened GROUP BY doc_id, s, part),
    around AS (SELECT *, list(size) OVER next AS sizes, list(said) OVER next AS saids,
        list_reverse(list(size) OVER last) AS back_sizes, list_reverse(list(said) OVER last) AS back_saids FROM sentence
        WINDOW next AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND {far} FOLLOWING),
        last AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN {far} PRECEDING AND CURRENT ROW)),
    sized AS (SELECT *, {shortest('sizes')} AS k, {shortest('back_sizes')} AS back FROM around),
    span AS (SELECT doc_id, n, k, array_to_string(saids[:k], ' ') AS said FROM sized WHERE k IS NOT NULL
        UNION SELECT doc_id, n - back + 1, back, array_to_string(list_reverse(back_saids[:back]), ' ')
        FROM sized WHERE back IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY said ORDER BY doc_id, n) AS place FROM span),
    gone AS (SELECT DISTINCT doc_id, n + j AS n FROM placed, range({far + 1}) r(j)
        WHERE place > 1 AND j < k),
    flagged AS (SELECT s.*, g.doc_id IS NOT NULL AS is_gone
        FROM sentence s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.n = g.n),
    kept AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE is_gone) AS n_removed,
        string_agg(raw, '' ORDER BY n) FILTER (WHERE NOT is_gone) AS body,
        min(n) FILTER (WHERE NOT is_gone) AS head FROM flagged GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences,
        CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
        sha256(CASE WHEN coalesce(n_removed, 0) = 0 THEN t
            WHEN head = 1 THEN regexp_extract(t, '^{gap}*') || body ELSE coalesce(body, '') END) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)"""


def url_filters(url_rules: list[tuple[str, str]], listed_words: list[str]) -> str:
    def fits(rule: str) -> str:
        domain, _, rest = rule.partition("/")
        return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{rest}')"

    by_length = sorted(url_rules, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in by_length)
    action = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in by_length)
    return rf"""
    WITH parts AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS (SELECT *, CASE {rule} END AS rule,
        string_split(host, '.') AS labels FROM parts)
    SELECT page_id, host, path, rule, CASE {action}
        WHEN len(list_filter(labels[:greatest(len(labels) - 1, 1)],
            lambda x: regexp_matches(x, '{"|".join(listed_words)}'))) > 0 THEN 'block'
        ELSE 'allow' END AS verdict
    FROM ruled"""


def secret_scans(reach: int = 200) -> str:
    parts = []
    for number, kind in enumerate([*secrets.KINDS, "scope"]):
        pattern, role = secrets.KINDS.get(kind, (secrets.SCOPE_END, "scope"))
        p = text_sql(pattern)
        value = f"regexp_extract_all(t, {p}, 2)" if kind == "assign" else "f"
        holds = {
            "assign": "length(v) >= 6",
            "weak_secret": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')",
        }.get(kind, "true")
        parts.append(
            f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, '{role}' AS role, i, length(gap) AS gap,
            length(m) AS size, {holds} AS holds FROM (SELECT doc_id, generate_subscripts(f, 1) AS i,
            unnest(f) AS m, unnest(v) AS v, unnest(g[:len(f)]) AS gap FROM (SELECT doc_id, f, {value} AS v, g
            FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS f, string_split_regex(t, {p}) AS g FROM d)))"""
        )
    spans = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in secrets.BASE
    )
    shown = ", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in secrets.BASE)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
    scoped AS (SELECT *, e - size AS s, sum(CASE WHEN kind = 'scope' THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY e - size, kind, i) AS scope FROM placed WHERE holds),
    weak AS (SELECT a.doc_id, a.k, a.kind, a.s, a.e FROM scoped a JOIN scoped b
        ON a.doc_id = b.doc_id AND a.scope = b.scope AND greatest(a.s, b.s) - least(a.e, b.e) <= {reach}
        WHERE a.k BETWEEN 3 AND 5 GROUP BY a.doc_id, a.k, a.kind, a.s, a.e, a.role
        HAVING CASE a.role WHEN 'ident' THEN bool_or(b.role = 'secret')
            WHEN 'secret' THEN bool_or(b.role = 'ident')
            ELSE bool_or(b.role = 'secret') AND bool_or(b.role = 'ident') END),
    spans AS (SELECT doc_id, k, kind, s, e FROM scoped WHERE k < 3 UNION ALL FROM weak),
    found AS (SELECT doc_id, {counts}, {spans} FILTER (WHERE k < 3) AS base, {spans} AS spans
        FROM spans GROUP BY doc_id)
    SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(found.spans, '') AS spans
    FROM d LEFT JOIN found USING (doc_id)"""


def topk_search() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings WHERE len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
        FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 5"""


def fill_in_middle() -> str:
    draws = ", ".join(
        f"CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}"
        for i in range(4)
    )
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {draws} FROM documents),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
            THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y
            ELSE '<P>' || x || '<S>' || z || '<M>' || y END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM p"""


def chat_format(template: chat.Template = chat.Template()) -> str:
    controls = "|".join(re.sub(r"([\[\]/])", r"\\\1", mark) for mark in template.controls())
    marks = {role: len(before) + len(after) + 2 for role, (before, after, _) in template.roles.items()}
    around = " ".join(f"WHEN {text_sql(role)} THEN {size}" for role, size in marks.items())
    others = sum(map(len, template.other)) + 4
    learned = ", ".join(text_sql(role) for role, (_, _, loss) in template.roles.items() if loss)
    steps = " ".join(
        f"WHEN s.state = {text_sql(state)} AND list_extract(roles, s.i + 1) = {text_sql(role)} THEN {text_sql(after)}"
        for state, row in template.states.items() for role, after in row.items()
    )
    found = rf"len(regexp_extract_all(%s, '({controls})'))"
    return rf"""
    WITH RECURSIVE t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
    g AS (SELECT conv_id, count(*) AS n_turns, list(role ORDER BY i) AS roles,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
        CAST(sum(CASE WHEN role IN ({learned}) THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(string_agg(CASE WHEN role IN ({learned}) THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
        CAST(sum(length(text) + {found % 'text'} + CASE role {around}
            ELSE {others} + length(role) + {found % 'role'} END) AS BIGINT) AS formatted_chars
        FROM o GROUP BY conv_id),
    s AS (SELECT conv_id, 0 AS i, {text_sql(template.start)} AS state FROM g
        UNION ALL SELECT s.conv_id, s.i + 1, CASE {steps} ELSE 'broken' END
        FROM s JOIN g ON s.conv_id IS NOT DISTINCT FROM g.conv_id WHERE s.i < n_turns)
    SELECT g.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, state
    FROM g JOIN s ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.i = n_turns"""


def prefix_trie() -> str:
    crc_step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"""
    WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(
            list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: {crc_step})) AS words),
    t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text,
            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
        FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, said) AS i FROM t),
    counts AS (SELECT c, count(*) AS n FROM o GROUP BY c),
    known AS (SELECT c, n, c - c % 5 AS source, xor(4294967295, list_reduce(
            list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
            lambda a, b: xor(a >> 8, list_extract(words, (xor(a, b) & 255) + 1)))) % 9 AS h FROM counts, crc),
    k AS (SELECT known.*, least(h, coalesce(s.n, 0)) AS p FROM known LEFT JOIN counts s ON s.c = known.source),
    r AS (SELECT k.c, i - h + p AS pos, said, octet_length(encode(text)) AS size FROM o JOIN k ON k.c = o.c WHERE i > h
        UNION ALL SELECT k.c, i, said, octet_length(encode(text)) FROM o JOIN k ON k.source = o.c WHERE i <= h
        UNION ALL SELECT c, 0, '', 0 FROM k),
    v AS (SELECT c, pos, size, list(said) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path,
        count(*) OVER (PARTITION BY c) - 1 AS total FROM r),
    n AS (SELECT path, pos, min(c) AS c, count(*) AS n, any_value(size) AS size,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (pos = total), '')) AS ends
        FROM v GROUP BY path, pos),
    kids AS (SELECT list_slice(path, 1, pos) AS path, count(*) AS kids FROM n WHERE pos > 0 GROUP BY 1),
    full_nodes AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids ON kids.path = n.path),
    sums AS (SELECT v.path, sum((u.n - 1) * u.size) AS saved, count(*) FILTER (u.kids = 0) AS leaves
        FROM v JOIN full_nodes u ON u.c = v.c AND u.pos >= v.pos GROUP BY v.path)
    SELECT f.c AS conv_id, f.pos AS depth, up.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children,
        leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
    FROM full_nodes f JOIN sums ON sums.path = f.path
    LEFT JOIN n up ON f.pos > 0 AND up.path = list_slice(f.path, 1, f.pos)"""
