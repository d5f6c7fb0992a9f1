"""SQL for DuckDB that each query must agree with, row for row."""

from __future__ import annotations

from catalog.side_tables import COMMUNITIES, IRREGULAR, LEMMAS, LEXICON, SOURCES, STOP_TABLE
from tidemark.functions.fixed_values import AFFECTS, CUSTOM_STOPWORDS, EMOTIONS, ENGLISH_STOPWORDS, NOUN_RULES, POLARITIES

SPACE = r"\t-\r\x1C-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _values(rows) -> str:
    return ", ".join(f"({_quoted(row)})" for row in rows)


def oracle_sql() -> dict[str, str]:
    stop = _quoted(sorted({*ENGLISH_STOPWORDS, *CUSTOM_STOPWORDS}))

    def pieces(source: str, keep: str) -> str:
        """Split at white space first, then strip each piece."""
        return rf"""
            SELECT {keep}, regexp_replace(piece, '[^{WORD}]', '', 'g') AS word
            FROM (SELECT {keep}, unnest(string_split_regex(lower(text), '[{SPACE}]+')) AS piece FROM {source})"""

    def words(source: str, keep: str) -> str:
        return f"SELECT * FROM ({pieces(source, keep)}) WHERE word NOT IN ({stop}) AND length(word) > 1"

    posts = """posts AS (
        SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'a' ELSE 'b' END AS class
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
    class_words = f"{posts}, w AS ({words('posts', 'doc_id, class')})"
    shares = f"""{class_words},
        ca AS (SELECT word, count(*) AS count_a FROM w WHERE class = 'a' GROUP BY word),
        cb AS (SELECT word, count(*) AS count_b FROM w WHERE class = 'b' GROUP BY word),
        m AS (SELECT word, coalesce(count_a, 0) AS count_a, coalesce(count_b, 0) AS count_b
              FROM ca FULL OUTER JOIN cb USING (word)),
        s AS (SELECT word, count_a, count_a / (SELECT sum(count_a) FROM m) AS share_a,
                     count_b, count_b / (SELECT sum(count_b) FROM m) AS share_b,
                     count_a + count_b AS count_total FROM m),
        t AS (SELECT *, CASE WHEN count_b > 0 THEN share_a / share_b END AS ratio,
                     CASE WHEN count_a > 0 AND count_b > 0
                          THEN pow(abs(log2(share_a / share_b)), 3) * share_a * share_b END AS metric
              FROM s)"""

    bands = []
    for band in range(1, 7):
        low, high = f"1e-{band}", f"1e-{band - 1}"
        place = 2 * band
        in_a = f"share_a > {low} AND share_a <= {high} AND share_b > 1e-6"
        in_b = f"share_b > {low} AND share_b <= {high} AND share_a > 1e-6"
        if band != 4:
            bands.append((100 + place, "a_top", band, "ratio", in_a, 4))
        bands.append((101 + place, "a_bottom", band, "-ratio", in_a, 4))
        bands.append((200 + place, "b_top", band, "ratio", in_b, 4))
    absolute = [
        (1, "share_a", 0, "share_a", "true", 5),
        (2, "share_b", 0, "share_b", "true", 5),
        (3, "total", 0, "count_total", "true", 5),
    ]
    metric = [(900, "metric", 0, "metric", "metric IS NOT NULL", 5)]

    def picked(lists) -> str:
        parts = [
            f"""(SELECT {place} AS place, '{rule}' AS rule, {band} AS band, CAST({score} AS DOUBLE) AS score, word,
                 CAST(row_number() OVER (ORDER BY {score} DESC, word) AS INTEGER) AS rank
                 FROM t WHERE {inside} ORDER BY {score} DESC, word LIMIT {k})"""
            for place, rule, band, score, inside, k in lists
        ]
        return " UNION ALL ".join(parts)

    def counted(name: str) -> str:
        return f"sum(CASE WHEN affect = '{name}' THEN 1 ELSE 0 END) AS {name}"

    def part(name: str) -> str:
        absent = "NULL" if name == "anticipation" else "0.0"
        return f"CASE WHEN {name} = 0 THEN {absent} ELSE {name} / hits END AS {name}"

    wide = f"""{class_words},
        lexicon(word, affect) AS (VALUES {_values(LEXICON)}),
        hit AS (SELECT w.doc_id, lexicon.affect FROM w JOIN lexicon ON w.word = lexicon.word),
        n AS (SELECT p.doc_id, p.class, count(h.affect) AS hits, {", ".join(map(counted, AFFECTS))}
              FROM posts p LEFT JOIN hit h ON p.doc_id = h.doc_id GROUP BY p.doc_id, p.class),
        a AS (SELECT doc_id, class, {", ".join(map(part, AFFECTS))} FROM n)"""

    def long(names) -> str:
        return " UNION ALL ".join(f"SELECT doc_id, class, '{name}' AS affect, {name} AS freq FROM a" for name in names)

    def scores(names) -> str:
        return f"""WITH {wide}, l AS ({long(names)}),
            g AS (SELECT class, affect, sum(freq) AS v FROM l GROUP BY class, affect)
            SELECT affect AS emotion, round(v / sum(v) OVER (PARTITION BY class), 9) AS percentage, class FROM g"""

    tfidf = f"""{class_words},
        tf AS (SELECT class, doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
        df AS (SELECT class, word, count(*) AS df FROM tf GROUP BY ALL),
        n AS (SELECT class, count(DISTINCT doc_id) AS n FROM w GROUP BY class),
        x AS (SELECT tf.class, tf.doc_id, tf.word, n.n, tf.tf * (ln((1 + n.n) / (1 + df.df)) + 1) AS x
              FROM tf JOIN df ON tf.class = df.class AND tf.word = df.word JOIN n ON tf.class = n.class),
        len AS (SELECT class, doc_id, sqrt(sum(x * x)) AS len FROM x GROUP BY ALL),
        avgs AS (SELECT x.class, x.word, sum(x.x / len.len) / any_value(x.n) AS tfidf
                 FROM x JOIN len ON x.class = len.class AND x.doc_id = len.doc_id GROUP BY x.class, x.word)"""

    scored = """p AS (
        SELECT vec_id, CASE WHEN label < 4 THEN 1 ELSE 0 END AS label,
               1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) AS score FROM embeddings),
        q AS (SELECT *, CASE WHEN score > 1 - score THEN 1 ELSE 0 END AS prediction FROM p)"""

    def measures(source: str, by: str = "") -> str:
        keys = f"{by}, " if by else ""
        parts = [
            f"""SELECT {keys}{k} AS class,
                sum(CASE WHEN label = {k} AND prediction = {k} THEN 1 ELSE 0 END) AS tp,
                sum(CASE WHEN label <> {k} AND prediction = {k} THEN 1 ELSE 0 END) AS fp,
                sum(CASE WHEN label = {k} AND prediction <> {k} THEN 1 ELSE 0 END) AS fn,
                sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS hits, count(*) AS n
                FROM {source} {"GROUP BY " + by if by else ""}"""
            for k in (0, 1)
        ]
        return f"""SELECT *, CASE WHEN precision + recall > 0
                THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
            FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
                  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, hits / n AS accuracy
                  FROM ({" UNION ALL ".join(parts)}))"""

    listed = _quoted(COMMUNITIES)
    priority = "CASE event_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SOURCES, 1)) + " END"
    order = "CASE event_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(COMMUNITIES, 1)) + " END"
    sampled = """(SELECT user_id FROM (SELECT DISTINCT user_id FROM events)
                  ORDER BY md5('42:' || user_id), user_id LIMIT 10)"""
    trim = f"'^[{SPACE}]+|[{SPACE}]+$', '', 'g'"
    ranks = """SELECT {f} AS feature, c1, c2, c1 + c2 AS c,
        sum(c1 + c2) OVER (PARTITION BY {f} ORDER BY v) - (c1 + c2) AS before FROM vc"""
    auc = f"""{scored}, vc AS (SELECT score AS v, sum(label) AS c1, sum(1 - label) AS c2 FROM q GROUP BY score),
        r AS ({ranks.format(f="'all'")}),
        g AS (SELECT sum(c1) AS n1, sum(c2) AS n2, sum(c1 * (before + (c + 1) / 2)) AS r1 FROM r)"""

    tested = f"""WITH {wide}, l AS ({long(AFFECTS)}),
        vc AS (SELECT affect, freq AS v, sum(CASE WHEN class = 'a' THEN 1 ELSE 0 END) AS c1,
                      sum(CASE WHEN class = 'b' THEN 1 ELSE 0 END) AS c2
               FROM l WHERE freq IS NOT NULL GROUP BY affect, freq),
        r AS ({ranks.format(f="affect")}),
        g AS (SELECT feature, CAST(sum(c1) AS DOUBLE) AS n1, CAST(sum(c2) AS DOUBLE) AS n2,
                     sum(c1 * (before + (c + 1) / 2)) AS r1, CAST(sum(c * c * c - c) AS DOUBLE) AS ties
              FROM r GROUP BY feature),
        u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM g),
        zs AS (SELECT feature, n1, n2, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5e0)
                      / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)"""

    rules = ", ".join(f"({place}, '{suffix}', '{ending}')" for place, (suffix, ending) in enumerate(NOUN_RULES))
    # Every form that two rounds of rules make of a word; the first in the dictionary counts.
    ruled = f"""RECURSIVE w0 AS ({words("documents", "doc_id")}),
        own AS (SELECT word AS surface, count(*) AS n FROM w0 GROUP BY word),
        known AS (SELECT DISTINCT word FROM ({words("benchmark", "item_id")})),
        rules(rule, suffix, ending) AS (VALUES {rules}),
        irregular(surface, lemma) AS (VALUES {_values(IRREGULAR)}),
        forms AS (SELECT surface, 0 AS round, -1 AS rule, surface AS form FROM own
            UNION ALL
            SELECT f.surface, f.round + 1, r.rule, left(f.form, length(f.form) - length(r.suffix)) || r.ending
            FROM forms f JOIN rules r ON suffix(f.form, r.suffix) AND length(f.form) > length(r.suffix) WHERE f.round < 2),
        hits AS (SELECT * FROM forms WHERE form IN (SELECT word FROM known)
            UNION ALL SELECT surface, -1, -1, lemma FROM irregular
            WHERE surface IN (SELECT surface FROM own) AND lemma IN (SELECT word FROM known)),
        lemmas AS (SELECT surface, form AS lemma FROM (
            SELECT *, row_number() OVER (PARTITION BY surface ORDER BY round, length(form), rule, form) AS k FROM hits)
            WHERE k = 1)"""

    def tail(doc: str, n: int) -> str:
        return f"array_to_string({doc}[greatest(len({doc}) - {n - 1}, 1):], ' ')"

    def split_doc(text: str) -> str:
        return f"list_filter(string_split_regex({text}, '[{SPACE}]+'), lambda x: x <> '')"

    return {
        "post_text": "SELECT doc_id, text || ' </s> ' || '' || ' </s> ' || source AS text FROM documents",
        "token_source": """SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN text || ' ' || source ELSE text END AS token
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
        "clean_text_regex": rf"""
            WITH e AS (SELECT page_id, replace(replace(regexp_replace(html, '&amp;?', 'and', 'g'), '&lt;', '<'), '&gt;', '>') AS t
                       FROM pages),
            f AS (SELECT page_id, regexp_replace(t, '([{WORD}]+)([^{WORD} ]+)', '\1 \2', 'g') AS t FROM e),
            g AS (SELECT page_id, regexp_replace(t, '([^{WORD} ]+)([{WORD}]+)', '\1 \2', 'g') AS t FROM f)
            SELECT page_id, regexp_replace(t, {trim}) AS text FROM g""",
        "clean_text_literal": f"""SELECT page_id,
            regexp_replace(replace(replace(replace(html, '&amp;?', 'and'), '&lt;', '<'), '&gt;', '>'), {trim}) AS text
            FROM pages""",
        "tokens": f"""
            WITH p AS ({pieces("(SELECT doc_id, text FROM documents)", "doc_id")}),
            n AS (SELECT doc_id, word, row_number() OVER () AS at FROM p)
            SELECT d.doc_id, CAST(count(n.word) AS INTEGER) AS n_tokens,
                   coalesce(string_agg(n.word, ' ' ORDER BY n.at), '') AS joined
            FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id AND n.word NOT IN ({stop}) AND length(n.word) > 1
            GROUP BY d.doc_id""",
        "stopword_filter": f"""SELECT word, count(*) AS n FROM ({pieces("documents", "doc_id")})
            WHERE length(word) > 1 AND word NOT IN ({_quoted(STOP_TABLE)}) GROUP BY word""",
        "lemma_join": f"""WITH l(surface, lemma) AS (VALUES {_values(LEMMAS)})
            SELECT coalesce(l.lemma, w.word) AS word, count(*) AS n
            FROM ({words("documents", "doc_id")}) w LEFT JOIN l ON w.word = l.surface GROUP BY 1""",
        "lemma_tokens": f"""
            WITH l(surface, lemma) AS (VALUES {_values(LEMMAS)}),
            p AS ({pieces("(SELECT doc_id, text FROM documents)", "doc_id")}),
            n AS (SELECT doc_id, word, row_number() OVER () AS at FROM p),
            k AS (SELECT n.doc_id, n.at, coalesce(l.lemma, n.word) AS word FROM n LEFT JOIN l ON n.word = l.surface
                  WHERE n.word NOT IN ({stop}) AND length(n.word) > 1)
            SELECT d.doc_id, CAST(count(k.word) AS INTEGER) AS n_tokens,
                   coalesce(string_agg(k.word, ' ' ORDER BY k.at), '') AS joined
            FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""",
        "lemma_rules": f"""WITH {ruled} SELECT coalesce(l.lemma, o.surface) AS word, CAST(sum(o.n) AS BIGINT) AS n
            FROM own o LEFT JOIN lemmas l ON o.surface = l.surface GROUP BY 1""",
        "lemma_rules_tokens": f"""WITH {ruled},
            p AS ({pieces("(SELECT doc_id, text FROM documents)", "doc_id")}),
            n AS (SELECT doc_id, word, row_number() OVER () AS at FROM p),
            k AS (SELECT n.doc_id, n.at, coalesce(l.lemma, n.word) AS word FROM n LEFT JOIN lemmas l ON n.word = l.surface
                  WHERE n.word NOT IN ({stop}) AND length(n.word) > 1)
            SELECT d.doc_id, CAST(count(k.word) AS INTEGER) AS n_tokens,
                   coalesce(string_agg(k.word, ' ' ORDER BY k.at), '') AS joined
            FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""",
        "trained_texts": f"""WITH p AS (SELECT doc_id, unnest({split_doc("lower(text)")}) AS word FROM documents),
            k AS (SELECT word FROM p GROUP BY word HAVING count(*) >= 40)
            SELECT d.doc_id, count(k.word) AS known, CAST(16 AS INTEGER) AS dim, true AS is_unit
            FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN k ON p.word = k.word GROUP BY d.doc_id""",
        "encoded_texts": """SELECT doc_id, CAST(length(text) AS BIGINT) AS chars,
            CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS blanks FROM documents""",
        "mlp_checks": """SELECT vec_id, CAST(label < 4 AS INTEGER) AS label, true AS adds_up, true AS is_argmax
            FROM embeddings WHERE substr(md5(CAST(vec_id AS VARCHAR)), 1, 2) < '33'""",
        "last_n_tokens": f"""SELECT doc_id, {tail("p", 50)} AS text
            FROM (SELECT doc_id, {split_doc("text")} AS p FROM documents)""",
        "parse_tolerant": "SELECT source AS author, text AS body, doc_id AS created_utc FROM documents WHERE doc_id % 10 <> 7",
        "parse_strict": """SELECT doc_id, source AS author, text AS selftext, lang AS title, CAST(NULL AS VARCHAR) AS body
            FROM documents""",
        "file_columns": """SELECT doc_id, source || '_x' AS author, source AS folder,
            CASE WHEN lang = 'en' THEN 'comments' ELSE 'submissions' END AS data_type FROM documents""",
        "author_json_roundtrip": """SELECT source AS author, text AS body, doc_id AS created_utc,
            CASE WHEN lang = 'en' THEN 'comments' ELSE 'submissions' END AS kind FROM documents""",
        "author_json_batches": "SELECT source AS author, text AS body, doc_id AS created_utc FROM documents",
        "cohort_by_author": """WITH e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id % 7 = 0)
            SELECT user_id, event_id, 'new' AS kind FROM events WHERE event_type = 'error' AND user_id % 7 = 0
            UNION ALL SELECT user_id, event_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM e)""",
        "line_numbers": """SELECT author, doc_id, line_number FROM (
            SELECT source AS author, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_number
            FROM documents) WHERE doc_id % 7 <> 3""",
        "cut_by_line": f"""WITH l AS (
                SELECT *, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts DESC, event_id DESC) AS line FROM events),
            c AS (SELECT *, min(CASE WHEN event_type IN ({listed}) THEN line END) OVER (PARTITION BY user_id) AS cut FROM l)
            SELECT event_id, user_id FROM c WHERE cut IS NULL OR line < cut""",
        "csv_quoted_lines": """SELECT doc_id, source, 'say "' || source || '",' || chr(10) || text AS text FROM documents""",
        "network_checks": """SELECT vec_id, CAST(label < 4 AS INTEGER) AS label, true AS adds_up, true AS is_argmax FROM (
            SELECT *, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS k, count(*) OVER () AS n FROM embeddings)
            WHERE k <= ceil(0.2e0 * n)""",
        "name_list_roundtrip": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS author FROM events",
        "csv_new_users": """SELECT strftime(f, '%Y-%m-%d') AS day, count(*) AS n
            FROM (SELECT min(ts) AS f FROM events GROUP BY user_id) GROUP BY 1""",
        "stored_word_counts": f"WITH {class_words} SELECT class, word, count(*) AS n FROM w GROUP BY class, word",
        "dataset_roundtrip": """SELECT vec_id, CASE WHEN label < 4 THEN 1 ELSE 0 END AS label,
            CAST(embedding[1] AS DOUBLE) AS first FROM embeddings""",
        "distinct_authors": "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL AND user_id <> 7",
        "author_summary": """SELECT count(*) AS n_events, count(DISTINCT event_type) AS n_types,
            count(DISTINCT user_id) AS n_users FROM events""",
        "first_seen": "SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id",
        "new_users_per_day": """SELECT CAST(date_trunc('day', f) AS TIMESTAMP) AS first, count(*) AS n
            FROM (SELECT min(ts) AS f FROM events GROUP BY user_id) GROUP BY 1""",
        "new_users_per_hour": """SELECT CAST(date_trunc('hour', f) AS TIMESTAMP) AS first, count(*) AS n
            FROM (SELECT min(ts) AS f FROM events GROUP BY user_id) GROUP BY 1""",
        "new_users_exact": """SELECT f AS first, count(*) AS n
            FROM (SELECT min(ts) AS f FROM events GROUP BY user_id) GROUP BY 1""",
        "event_window": """SELECT event_id FROM events
            WHERE ts BETWEEN TIMESTAMP '2024-01-12 00:00:00' AND TIMESTAMP '2024-01-18 00:00:00'""",
        "sample_n": f"SELECT user_id FROM {sampled}",
        "sample_frac_per_group": """SELECT doc_id, source FROM (
            SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n,
                   row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents)
            WHERE k <= round_even(n * 0.1e0, 0)""",
        "first_n_users": """SELECT user_id, count(*) AS n FROM events
            WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 5) GROUP BY user_id""",
        "min_posts_users": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 2",
        "capped_active_users": """SELECT conv_id, turn FROM conversations WHERE conv_id IN (
            SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 5 ORDER BY conv_id LIMIT 30)""",
        "train_test_split": """SELECT vec_id, CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)), 1, 2) < '33'
            THEN 'test' ELSE 'train' END AS split FROM embeddings""",
        "train_test_split_exact": """SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id)
            <= ceil(0.2e0 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM embeddings""",
        "posts_of_authors": f"SELECT event_id, user_id FROM events WHERE user_id IN {sampled}",
        "companion_first_match": f"""
            WITH c AS (SELECT user_id, event_type, {priority} AS p FROM events WHERE event_type IN ({_quoted(SOURCES)})),
            f AS (SELECT user_id, min(p) AS p FROM c
                  WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY user_id)
            SELECT c.user_id, c.event_type AS source, count(*) AS n
            FROM c JOIN f ON c.user_id = f.user_id AND c.p = f.p GROUP BY ALL""",
        "cohort_with_companions": """
            WITH b AS (SELECT user_id, event_type, CAST(NULL AS INTEGER) AS p FROM events WHERE event_type = 'purchase'),
            c AS (SELECT user_id, event_type, CAST(extract(hour FROM ts) AS INTEGER) AS p
                  FROM events WHERE event_type <> 'purchase'),
            r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY p) AS k FROM c
                  WHERE user_id IN (SELECT user_id FROM b))
            SELECT user_id, event_type, p AS priority, count(*) AS n
            FROM (SELECT * FROM b UNION ALL SELECT user_id, event_type, p FROM r WHERE k = 1) GROUP BY ALL""",
        "cut_by_time": f"""SELECT event_id, user_id FROM (
            SELECT *, min(CASE WHEN event_type IN ({listed}) THEN ts END) OVER (PARTITION BY user_id) AS cut FROM events)
            WHERE cut IS NULL OR ts < cut""",
        "cut_by_position": f"""SELECT event_id, user_id FROM (
            SELECT *, min(CASE WHEN event_type IN ({listed}) THEN event_id END) OVER (PARTITION BY user_id) AS cut FROM events)
            WHERE cut IS NULL OR event_id < cut""",
        "cut_by_priority": f"""
            WITH o AS (SELECT *, {order} AS p FROM events),
            f AS (SELECT *, min(p) OVER (PARTITION BY user_id) AS first_p FROM o),
            c AS (SELECT *, min(CASE WHEN p = first_p THEN event_id END) OVER (PARTITION BY user_id) AS cut FROM f)
            SELECT event_id, user_id FROM c WHERE cut IS NULL OR event_id < cut""",
        "cohort_label": "SELECT CASE WHEN toxic = 1 THEN 'a' ELSE 'b' END AS class, count(*) AS n FROM labels GROUP BY 1",
        "author_text": "SELECT conv_id, string_agg(text, '<s> ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
        "author_slices": """SELECT conv_id, turn // 4 AS slice, string_agg(text, '<s> ' ORDER BY turn) AS text
            FROM conversations GROUP BY ALL""",
        "author_last_tokens": f"""SELECT conv_id, {tail("p", 40)} AS text FROM (
            SELECT conv_id, {split_doc("string_agg(text, '<s> ' ORDER BY turn)")} AS p FROM conversations GROUP BY conv_id)""",
        "cut_author_text": """SELECT user_id, string_agg(event_type, '<s> ' ORDER BY ts, event_id) AS event_type FROM (
            SELECT *, min(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id) AS cut FROM events)
            WHERE cut IS NULL OR ts < cut GROUP BY user_id""",
        "word_count": f"WITH {class_words} SELECT class, word, count(*) AS n FROM w GROUP BY class, word",
        "word_shares": f"""WITH {shares} SELECT word, count_a, share_a, count_b, share_b, count_total, ratio,
            CASE WHEN count_a = 0 OR count_b = 0 THEN 1 ELSE 0 END AS one_sided FROM t""",
        "word_metric": f"WITH {shares} SELECT word, round(metric * 1e9, 4) AS metric FROM t",
        "share_extents": f"""WITH {shares},
            e AS (SELECT max(share_a) AS max_a, min(CASE WHEN share_a > 0 THEN share_a END) AS min_a,
                         max(share_b) AS max_b, min(CASE WHEN share_b > 0 THEN share_b END) AS min_b FROM t)
            SELECT round(max_a, 12) AS max_a, round(min_a, 12) AS min_a, round(max_b, 12) AS max_b, round(min_b, 12) AS min_b,
                   round(greatest(max_a, max_b) * 1.1e0, 12) AS scale_max, round(least(min_a, min_b) * 15e0, 12) AS scale_min
            FROM e""",
        "share_hist2d": f"""WITH {shares},
            e AS (SELECT min(share_a) AS la, max(share_a) AS ha, min(share_b) AS lb, max(share_b) AS hb FROM t)
            SELECT CAST(least(floor((share_b - lb) / (hb - lb) * 250), 249) AS INTEGER) AS bx,
                   CAST(least(floor((share_a - la) / (ha - la) * 250), 249) AS INTEGER) AS by,
                   count(*) AS n_words, CAST(sum(count_total) AS BIGINT) AS n_total
            FROM t, e GROUP BY 1, 2""",
        "top_words": f"""WITH {class_words}, c AS (SELECT class, word, count(*) AS n FROM w GROUP BY class, word)
            SELECT class, word, n, rank FROM (
                SELECT *, CAST(row_number() OVER (PARTITION BY class ORDER BY n DESC, word) AS INTEGER) AS rank FROM c) WHERE rank <= 15""",
        "top_words_absolute": f"WITH {shares} SELECT rule, rank, word, round(score, 9) AS score FROM ({picked(absolute)})",
        "top_words_banded": f"WITH {shares} SELECT rule, band, rank, word, round(score, 9) AS score FROM ({picked(bands)})",
        "top_words_metric": f"""WITH {shares} SELECT rank, word, round(score * 1e9, 4) AS metric FROM ({picked(metric)})""",
        "top_words_all": f"""WITH {shares}, l AS ({picked(absolute + bands + metric)})
            SELECT word, rule, band, rank FROM (
                SELECT *, row_number() OVER (PARTITION BY word ORDER BY place, rank) AS k FROM l) WHERE k = 1""",
        "affect_wide": f"""WITH {wide} SELECT doc_id, {", ".join(f"round({n}, 9) AS {n}" for n in AFFECTS)} FROM a""",
        "affect_per_post": f"WITH {wide} SELECT doc_id, affect, round(freq, 9) AS freq FROM ({long(AFFECTS)})",
        "emotion_scores": scores(EMOTIONS),
        "polarity_scores": scores(POLARITIES),
        "mann_whitney": f"""{tested} SELECT feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u,
            round(z, 9) AS z FROM zs""",
        # erfc as a power series, exact to 7 digits up to z = 5.6; beyond, p is 0 to 7 digits.
        "mann_whitney_p": f"""{tested} SELECT feature, round(z, 9) AS z,
            CASE WHEN z IS NULL THEN NULL WHEN z > 5.6 THEN 0.0 ELSE round(least(1.0, 1 - 2 / sqrt(pi()) * list_sum(
                list_transform(range(0, 100), lambda k: pow(-1, k) * pow(z / sqrt(2e0), 2 * k + 1)
                                                        / (gamma(k + 1) * (2 * k + 1))))), 7) END AS p FROM zs""",
        # All ways to choose j of the ranks 1 … i, by their sum.
        "mann_whitney_exact": """WITH RECURSIVE
            o AS (SELECT o_custkey AS feature, o_totalprice AS v, o_orderstatus = 'F' AS first FROM orders
                  WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL),
            r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) AS rank,
                         count(*) OVER (PARTITION BY feature, v) AS same FROM o),
            g AS (SELECT feature, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2,
                         sum(rank) FILTER (first) AS r1 FROM r GROUP BY feature HAVING max(same) = 1),
            u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, least(n1, n2) AS m FROM g WHERE least(n1, n2) BETWEEN 1 AND 8),
            ways AS (SELECT 0 AS i, 0 AS j, 0 AS s, 1e0 AS w
                UNION ALL
                SELECT i + 1 AS i, j + d AS j, s + d * (i + 1) AS s, sum(w) AS w FROM ways, (VALUES (0), (1)) t(d)
                WHERE i < (SELECT max(n1 + n2) FROM u) AND j + d <= 8 GROUP BY i + 1, j + d, s + d * (i + 1))
            SELECT feature, n1, n2, CAST(u AS DOUBLE) AS u, round(least(1e0, 2 * sum(CASE
                WHEN s - m * (m + 1) / 2 <= least(u, n1 * n2 - u) THEN w ELSE 0 END) / sum(w)), 9) AS p
            FROM u JOIN ways ON i = n1 + n2 AND j = m GROUP BY ALL""",
        "tfidf_avg": f"WITH {tfidf} SELECT class, word, round(tfidf, 9) AS tfidf FROM avgs",
        "tfidf_top_terms": f"""WITH {tfidf},
            k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(tfidf, 12) DESC, word) AS k FROM avgs)
            SELECT class, word, round(tfidf, 9) AS tfidf FROM avgs WHERE word IN (SELECT word FROM k WHERE k <= 20)""",
        "embedding_dataset": """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim,
            CASE WHEN label < 4 THEN 1 ELSE 0 END AS label FROM embeddings""",
        "one_hot": """SELECT vec_id, CAST(CASE WHEN label < 4 THEN 0 ELSE 1 END AS FLOAT) AS target_0,
            CAST(CASE WHEN label < 4 THEN 1 ELSE 0 END AS FLOAT) AS target_1 FROM embeddings""",
        "argmax_class": f"WITH {scored} SELECT vec_id, prediction FROM q",
        "class_metrics": f"""WITH {scored} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall,
            round(f1, 9) AS f1, round(accuracy, 9) AS accuracy FROM ({measures("q")})""",
        "batch_metrics": f"""WITH {scored}, b AS (
            SELECT *, (row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1) // 64 AS batch FROM q)
            SELECT class, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
                   round(avg(f1), 9) AS f1, round(avg(accuracy), 9) AS accuracy
            FROM ({measures("b", "batch")}) GROUP BY class""",
        "roc_auc": f"""WITH {auc} SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
            round((r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 9) AS roc_auc FROM g""",
        "accuracy_pct": f"""WITH {scored}, c AS (
            SELECT count(*) AS total, CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM q)
            SELECT total, correct, round(100 * correct / total, 9) AS accuracy,
                   CAST(floor(100 * correct / total) AS BIGINT) AS accuracy_whole FROM c""",
        "result_report": f"""WITH {auc}, f AS (SELECT f1, accuracy FROM ({measures("q")}) WHERE class = 1)
            SELECT CAST(floor(100 * accuracy) AS BIGINT) AS accuracy, round(f1, 9) AS f1,
                   round((r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 9) AS roc_auc FROM g, f""",
    }
