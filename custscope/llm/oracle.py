"""DuckDB SQL that gives the rows of the queries SQL can express."""

from . import chat_format, quality_rules

_BLANK = r"[ \t\n\x0B\x0C\r]"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LEVELS = range(13)
_UNIT = 1 << 24


def _mixing_steps() -> str:
    """One step per size level: what a source still wants and has, its rate, and where its prefix sum stands."""
    steps = ["s0 AS (SELECT rank, target AS wanted, source_size AS to_come, begin AS pos FROM target)"]
    for k in _LEVELS:
        steps.append(f"""
        r{k} AS (
            SELECT s.*, floor(greatest(0::DOUBLE, least(3::DOUBLE, wanted / to_come)) * {_UNIT})::BIGINT AS rate
            FROM s{k} s WHERE to_come > 0
        ), g{k} AS (
            SELECT r.rank, sum(d.size)::BIGINT AS words, count(*) AS n,
                   sum(d.size * ((pos + (place + 1) * rate) // {_UNIT} - (pos + place * rate) // {_UNIT}))::BIGINT AS taken
            FROM r{k} r JOIN placed d ON d.rank = r.rank AND d.level = {k} GROUP BY r.rank
        ), s{k + 1} AS (
            SELECT r.rank, wanted - coalesce(taken, 0) AS wanted, to_come - coalesce(words, 0) AS to_come,
                   (pos + coalesce(n, 0) * rate) % {_UNIT} AS pos
            FROM r{k} r LEFT JOIN g{k} g USING (rank)
        )""")
    return ", ".join(steps)



def _rules() -> str:
    """The threshold table over the columns of CTE `share`."""
    ends = [f"{r.metric} {op} {end}::DOUBLE" for r in quality_rules.RULES for op, end in ((">=", r.low), ("<=", r.high)) if end is not None]
    return " AND ".join(ends)


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_HAS_WORD = r"regexp_matches(s, '[^ \t\n\x0B\x0C\r]')"

def _escaped(text: str) -> str:
    """Length of an escaped text: one more for each backslash and each control string."""
    times = lambda c: f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}"
    return " + ".join([f"length({text})", *(times(c) for c in ("\\", *chat_format.CONTROLS))])


SQL = {
    "op1_line_dedup": rf"""
        WITH line AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents
        ), keyed AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^{_BLANK}+', ''), '{_BLANK}+$', ''), {_AZ}) AS key
            FROM line
        ), common AS (
            SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM (SELECT doc_id, line, place, coalesce(last_id <> doc_id, false) AS gone FROM keyed LEFT JOIN common USING (key))
        GROUP BY doc_id""",
    "op11_spelling_variants": rf"""
        WITH crc_table AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS codes
        ), run AS (
            SELECT doc_id, run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
            WHERE length(run) >= 5 GROUP BY ALL
        ), hexed AS (
            SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM run
        ), coded AS (
            SELECT run, n, xor(4294967295, list_reduce(
                list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]))) AS code
            FROM hexed, crc_table
        ), word AS (
            SELECT word, sum(n)::BIGINT AS n
            FROM (SELECT n, CASE WHEN code % 97 = 0 THEN substr(run, 1, code % length(run)) || substr(run, code % length(run) + 2) ELSE run END AS word FROM coded)
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), cut AS (
            SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM word)
        ), shorter AS (
            SELECT DISTINCT cut.word AS a, cut.n AS a_n, word.word AS b, word.n AS b_n FROM cut JOIN word ON cut.rest = word.word
        ), near AS (
            SELECT x.word AS word, x.n AS n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y USING (pos, rest) WHERE x.word <> y.word
            UNION ALL SELECT a, a_n, b, b_n FROM shorter UNION ALL SELECT b, b_n, a, a_n FROM shorter
        ), best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM near GROUP BY word
        ), formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form,
                   CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
            FROM word LEFT JOIN best USING (word)
        ), path AS (
            WITH RECURSIVE walk AS (
                SELECT word, word AS pos, form AS ahead FROM formed
                UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON formed.word = walk.ahead
            ) SELECT word, pos AS root FROM walk WHERE ahead IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN path USING (word)""",
    "op12_source_mixing": rf"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\x0C\r]+'))::BIGINT AS size FROM documents
        ), ranked AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
        ), filled AS (
            SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS words_left,
                   sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights_left
            FROM (SELECT *, rank % 3 + 1 AS weight FROM ranked)
            WINDOW w AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), target AS (
            SELECT source, rank, source_size, least(3::DOUBLE * source_size, max(words_left / weights_left) OVER () * weight) AS target,
                   ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 6))::BIGINT AS begin
            FROM filled
        ), known AS (
            SELECT doc_id, size, rank, source_size, target, {" + ".join(f"(size * {1 << k} <= source_size)::INT" for k in _LEVELS[1:])} AS level
            FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY rank, level ORDER BY size DESC, doc_id) - 1 AS place FROM known WHERE size > 0
        ), {_mixing_steps()}
        , rates AS ({" UNION ALL ".join(f"SELECT rank, {k} AS level, rate, pos FROM r{k}" for k in _LEVELS)})
        SELECT doc_id, size, source_size, target, (size * ((pos + (place + 1) * rate) // {_UNIT} - (pos + place * rate) // {_UNIT}))::BIGINT AS taken
        FROM placed JOIN rates USING (rank, level)
        UNION ALL SELECT doc_id, size, source_size, target, 0 FROM known WHERE size = 0""",
    "op13_phrase_collocations": rf"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents
        ), worded AS (
            SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM piece
        ), phrase AS (
            SELECT lang, m, phrase, count(*) AS f FROM (
                SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
                FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m))
            GROUP BY ALL
        ), candidate AS (
            SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM phrase WHERE m > 1 AND f >= 30
        ), cut AS (
            SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM candidate) c
            JOIN phrase x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
            JOIN phrase y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
        ), lowest AS (
            SELECT lang, phrase, a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS cut FROM cut GROUP BY ALL
        ), inside AS (
            SELECT lang, phrase, max(a) AS longest FROM (
                SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS phrase
                FROM candidate WHERE m > 2)
            GROUP BY ALL
        ), ranked AS (
            SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank
            FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a
        ), total AS (SELECT lang, sum(f)::BIGINT AS n FROM phrase WHERE m = 1 GROUP BY lang)
        SELECT lang, rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op4_quality_rules": rf"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\x0C\r]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: {_HAS_WORD}) AS lines
            FROM documents
        ), run AS (
            SELECT r, i, words[i:i + 7] AS run FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM doc WHERE len(words) > 8)
        ), again AS (
            SELECT r, i FROM run QUALIFY count(*) OVER (PARTITION BY r, run) > 1
        ), covered AS (
            SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(8)) AS k) GROUP BY r
        ), counted AS (
            SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
                   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
                   len(list_filter(words, lambda w: list_contains([{_STOP}], lower(w)))) AS n_stop,
                   len(list_filter(words, lambda w: ends_with(w, '!!') OR w = '|')) AS n_mark,
                   coalesce(list_sum(list_transform(range(1, len(words)), lambda i: (words[i] = words[i + 1])::INT)), 0) AS n_echo
            FROM doc LEFT JOIN covered USING (r)
        ), share AS (
            SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
                   coalesce(n_mark / nullif(n_words, 0), 0) AS mark_word_ratio, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio,
                   coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio, coalesce(n_echo / nullif(n_words, 0), 0) AS echo_word_ratio,
                   coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
                   n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
            FROM counted
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept FROM share""",
    "op9_ngram_jaccard": rf"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^ \t\n\x0B\x0C\r]+') AS words FROM documents
        ), gram AS (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS i FROM worded)
        ), size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
        link AS (
            SELECT x, y FROM (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM gram a JOIN gram b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL)
            JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * shared >= 85 * (s.n + t.n - shared)
        ), reach AS (
            SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y
        ), least_of AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
        FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN least_of USING (doc_id)""",
    "op10_chat_formatting": f"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum({2 * len(chat_format.DELIMITER)} + {_escaped("role")} + {_escaped("text")})::BIGINT + {len(chat_format.DELIMITER)} AS formatted_chars
        FROM said GROUP BY conv_id""",
}
