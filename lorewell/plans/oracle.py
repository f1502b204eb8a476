"""The queries in DuckDB's SQL, written apart from the Spark plans."""

_V = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings),
avgs AS (SELECT p, avg(c) AS a FROM (SELECT unnest(x) AS c, unnest(range(0, len(x))) AS p FROM e) GROUP BY p),
cen AS (SELECT list(a / n ORDER BY p) AS c FROM avgs, (SELECT sqrt(sum(a * a)) AS n FROM avgs)),
v0 AS (SELECT vec_id, label, list_transform(range(1, len(x) + 1), lambda i: x[i] - list_dot_product(x, c) * c[i]) AS y FROM e, cen),
v AS (SELECT vec_id AS id, label, list_transform(y, lambda t: t / CASE WHEN list_dot_product(y, y) = 0 THEN 1 ELSE sqrt(list_dot_product(y, y)) END) AS v FROM v0),
ch AS (SELECT id // 10 AS id, id % 10 AS no, v, label FROM v),
m0 AS (SELECT id, p, avg(c) AS a FROM (SELECT id, unnest(v) AS c, unnest(range(0, len(v))) AS p FROM ch) GROUP BY id, p),
mean AS (SELECT id, list(a / n ORDER BY p) AS v FROM m0 JOIN (SELECT id, sqrt(sum(a * a)) AS n FROM m0 GROUP BY id) USING (id) GROUP BY id),
sh AS (SELECT q, n, s, rank FROM (SELECT a.id AS q, b.id AS n, list_dot_product(a.v, b.v) AS s,
    row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS rank FROM mean a JOIN mean b ON a.id <> b.id) WHERE rank <= 60)"""
_LINKS = "li AS (SELECT DISTINCT vec_id // 10 AS src, label::BIGINT AS dst FROM embeddings WHERE vec_id % 10 < 3 AND vec_id // 10 <> label)"
_BOTH = "bo AS (SELECT src AS q, dst AS n FROM li UNION SELECT dst, src FROM li)"
_TAGS = "tg AS (SELECT DISTINCT vec_id // 10 AS id, label::BIGINT AS tag FROM embeddings)"
_SHARED = """
held AS (SELECT tag, count(*) AS held FROM tg GROUP BY tag),
st AS (SELECT a.id AS a, b.id AS b, count(*) AS n_shared, arg_min(tag, held * 1000 + tag) AS top_tag
    FROM tg a JOIN tg b USING (tag) JOIN held USING (tag) WHERE a.id < b.id GROUP BY 1, 2)"""
_COCITE = "cc AS (SELECT a.dst AS a, b.dst AS b, count(*) AS n_sources FROM li a JOIN li b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2)"


def _top(k: int, where: str = "", key: str = "") -> str:
    on = f"a.id <> b.id {key}"
    return f"""WITH {_V}, s AS (SELECT a.id AS q, b.id AS n, list_dot_product(a.v, b.v) AS s FROM v a JOIN v b ON {on})
        SELECT q, n, round(s, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY s DESC, n)::INTEGER AS rank FROM s {where}
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, n) <= {k}"""


def _directed(chunks: str, weight: float, pairs: str) -> str:
    """dir: q, n, d for all pairs in ``pairs`` and their reverses."""
    return f"""
pr AS (SELECT q, n FROM {pairs} UNION SELECT n, q FROM {pairs}),
best AS (SELECT q, n, x.no AS i, max(list_dot_product(x.v, y.v)) AS m FROM pr JOIN {chunks} x ON x.id = q JOIN {chunks} y ON y.id = n GROUP BY 1, 2, 3),
dir AS (SELECT q, n, sum((CASE WHEN i = 0 THEN {weight} ELSE 1 END) * greatest(m, 0)) / sum(CASE WHEN i = 0 THEN {weight} ELSE 1 END) AS d FROM best GROUP BY 1, 2)"""


_SINGLE = """
one AS (SELECT id, count(*) AS c, arg_min(v, no) AS t FROM ch GROUP BY id),
dir1 AS (SELECT q, n, CASE WHEN c = 1 THEN greatest(list_dot_product(t, mean.v), 0) ELSE d END AS d FROM dir JOIN one ON one.id = q JOIN mean ON mean.id = n)"""
_USERS = "u AS (SELECT user_id AS id, epoch_us(max(ts)) // 1000 AS mtime FROM events GROUP BY user_id)"
_INFLECT = """CASE WHEN length(surface) < 4 THEN NULL
    WHEN regexp_matches(surface, '[^aeiou]y$') THEN left(surface, length(surface) - 1) || 'ies'
    WHEN ends_with(surface, 'ies') THEN left(surface, length(surface) - 3) || 'y'
    WHEN regexp_matches(surface, '(ss|x|z|ch|sh)es$') THEN left(surface, length(surface) - 2)
    WHEN regexp_matches(surface, '(ss|us|is)$') THEN surface || 'es'
    WHEN ends_with(surface, 's') THEN left(surface, length(surface) - 1)
    WHEN regexp_matches(surface, '(x|z|ch|sh)$') THEN surface || 'es'
    ELSE surface || 's' END"""
_SURFACES = f"""
na AS (SELECT DISTINCT lower(trim(s)) AS surface, path FROM (SELECT 'parts/' || p_partkey AS path, unnest([p_name, p_brand]) AS s FROM part) WHERE length(s) >= 3),
va AS (SELECT DISTINCT {_INFLECT} AS surface, path FROM na),
su AS (SELECT surface, path, true AS exact FROM na UNION ALL SELECT surface, path, false FROM va WHERE length(surface) >= 3 AND surface NOT IN (SELECT surface FROM na))"""

_BLANK = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _passes(text: str, *passes: tuple[str, str]) -> str:
    for pattern, to in passes:
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return text


def _cleaned(text: str) -> str:
    """Markdown cleaned and stripped, in RE2's syntax."""
    text = _passes(
        text,
        (r"^---\n[\s\S]*?\n---\n?", "chr(10)"), (r"```[\s\S]*?```", "chr(10)"), (r"`[^`]*`", "' '"), (r"!\[\[[^\]]*\]\]", "' '"), (r"!\[[^\]]*\]\([^)]*\)", "' '"),
        (r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"'\2'"), (r"\[\[([^\]]+)\]\]", r"'\1'"), (r"\[([^\]]*)\]\([^)]*\)", r"'\1'"),
        (rf"(?m)^[{_BLANK}]{{0,3}}(#{{1,6}}|>|[-*+]|\d+\.)[{_BLANK}]+", "''"), (r"[*_~]", "''"), (r"<[^>]+>", "' '"),
    )
    inner = _BLANK.replace(r"\n", "")
    return _passes(text, (r"[ \t\f\x0B]+", "' '"), (rf"(?m)[{inner}]+$", "''"), (r"\n{3,}", "chr(10) || chr(10)"), (rf"^[{_BLANK}]+", "''"), (rf"[{_BLANK}]+$", "''"))


_ALL_PAIRS = "ap AS (SELECT a.id AS q, b.id AS n FROM mean a JOIN mean b ON a.id <> b.id)"


def _evaluated(scored: str) -> str:
    """Recall and reciprocal ranks over scored (q, n, s) pairs of all notes."""
    return f"""rk AS (SELECT q, n, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS rank FROM {scored}),
        b AS (SELECT src, avg((rank <= 5)::INT) AS r5, avg((rank <= 10)::INT) AS r10, avg((rank <= 20)::INT) AS r20, 1.0 / min(rank) AS rr
            FROM li JOIN rk ON rk.q = src AND rk.n = dst GROUP BY src)
        SELECT round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(r20), 6) AS recall_20, round(avg(rr)::DOUBLE, 6) AS mrr, count(*) AS n_queries FROM b"""


_BENCH_WORDS = "bw AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 8)"
_PLACES = """
dt AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z]', ' ', 'g'), ' ') AS p FROM documents),
dw AS (SELECT doc_id, unnest(p) AS word, unnest(range(1, len(p) + 1)) AS i FROM dt),
pl AS (SELECT doc_id, word, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(word) - 1 AS start FROM dw)"""

SQL: dict[str, str] = {
    "centroid": f"WITH {_V} SELECT (p - 1)::INTEGER AS pos, round(c[p], 6) AS value FROM (SELECT c, unnest(range(1, len(c) + 1)) AS p FROM cen)",
    "centered_vectors": f"WITH {_V} SELECT id AS vec_id, (p - 1)::INTEGER AS pos, round(v[p], 6) AS value FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS p FROM v)",
    "stage1_topk": _top(12),
    "isolated_area_topk": _top(12, key="AND a.label = b.label"),
    "floor_topk": _top(12, "WHERE s >= 0.2"),
    "near_duplicates": f"WITH {_V} SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.4",
    "note_means": f"WITH {_V} SELECT id AS note_id, (p - 1)::INTEGER AS pos, round(v[p], 6) AS value FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS p FROM mean)",
    "bimax_topk": f"""WITH {_V}, {_directed('ch', 2.0, 'sh')}, {_SINGLE},
        sc AS (SELECT sh.q, sh.n, (a.d + b.d) / 2 AS s FROM sh JOIN dir1 a ON a.q = sh.q AND a.n = sh.n JOIN dir1 b ON b.q = sh.n AND b.n = sh.q)
        SELECT q, n, round(s, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY s DESC, n)::INTEGER AS rank FROM sc
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, n) <= 12""",
    "bimax_eval_variant": f"""WITH {_V}, {_ALL_PAIRS}, {_directed('ch', 2.0, 'ap')}
        SELECT a.q, a.n, round((a.d + b.d) / 2, 6) AS score FROM dir a JOIN dir b ON b.q = a.n AND b.n = a.q""",
    "idea_similarity": f"""WITH {_V}, s10 AS (SELECT q, n FROM sh), {_directed('ch', 2.0, 's10')}, {_SINGLE},
        i0 AS (SELECT id, no // 5 AS no, p, avg(c) AS a FROM (SELECT id, no, unnest(v) AS c, unnest(range(0, len(v))) AS p FROM ch) GROUP BY 1, 2, 3),
        idea AS (SELECT id, no, list(a / n ORDER BY p) AS v FROM i0 JOIN (SELECT id, no, sqrt(sum(a * a)) AS n FROM i0 GROUP BY 1, 2) USING (id, no) GROUP BY 1, 2),
        ib AS (SELECT q, n, x.no AS i, max(list_dot_product(x.v, y.v)) AS m FROM pr JOIN idea x ON x.id = q JOIN idea y ON y.id = n GROUP BY 1, 2, 3),
        idir AS (SELECT q, n, avg(greatest(m, 0)) AS d FROM ib GROUP BY 1, 2)
        SELECT s10.q, s10.n, round(0.7 * (a.d + b.d) / 2 + 0.3 * (x.d + y.d) / 2, 6) AS score FROM s10
        JOIN dir1 a ON a.q = s10.q AND a.n = s10.n JOIN dir1 b ON b.q = s10.n AND b.n = s10.q
        JOIN idir x ON x.q = s10.q AND x.n = s10.n JOIN idir y ON y.q = s10.n AND y.n = s10.q""",
    "structural_boost": f"""WITH {_V}, {_LINKS}, {_BOTH}, {_TAGS}, {_SHARED}, {_COCITE}
        SELECT sh.q, sh.n, round(s + least(0.15, 0.15 * (CASE WHEN bo.q IS NULL THEN 0 ELSE 1 END + 0.25 * least(coalesce(n_shared, 0), 3) + CASE WHEN n_sources > 0 THEN 0.25 ELSE 0 END)), 6) AS score
        FROM sh LEFT JOIN bo ON bo.q = sh.q AND bo.n = sh.n LEFT JOIN st ON st.a = least(sh.q, sh.n) AND st.b = greatest(sh.q, sh.n)
        LEFT JOIN cc ON cc.a = least(sh.q, sh.n) AND cc.b = greatest(sh.q, sh.n) WHERE s >= 0.05""",
    "recall_mrr": f"""WITH {_V}, {_LINKS}, sc AS (SELECT a.id AS q, b.id AS n, list_dot_product(a.v, b.v) AS s FROM mean a JOIN mean b ON a.id <> b.id), {_evaluated('sc')}""",
    "quantize_roundtrip": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        s AS (SELECT *, CASE WHEN list_max(list_transform(x, lambda t: abs(t))) = 0 THEN 1 ELSE list_max(list_transform(x, lambda t: abs(t))) / 127 END AS scale FROM e),
        q AS (SELECT *, list_transform(x, lambda t: greatest(-127, least(127, floor(t / scale + 0.5)))::DOUBLE) AS q FROM s)
        SELECT vec_id, list_sum(q)::INTEGER AS q_sum, round(scale, 6) AS scale, round(list_dot_product(q, x) / sqrt(list_dot_product(q, q)), 6) AS cosine FROM q""",
    "legacy_index": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        s AS (SELECT *, CASE WHEN list_max(list_transform(x, lambda t: abs(t))) = 0 THEN 1 ELSE list_max(list_transform(x, lambda t: abs(t))) / 127 END AS scale FROM e)
        SELECT vec_id, 1::INTEGER AS chunk_count, list_sum(list_transform(x, lambda t: greatest(-127, least(127, floor(t / scale + 0.5)))))::INTEGER AS q_sum,
            round(scale, 6) AS scale, round(x[1], 6) AS first FROM s""",
    "section_split": """WITH s(no, level, breadcrumb) AS (VALUES (0, 0, ''), (1, 1, 'Alpha one'), (2, 2, 'Alpha one > Beta'), (3, 3, 'Alpha one > Beta > Gamma two'), (4, 2, 'Alpha one > Delta'))
        SELECT doc_id, no::INTEGER AS no, level::INTEGER AS level, breadcrumb,
            md5(CASE no WHEN 0 THEN 'lead' WHEN 1 THEN left(t, 300) WHEN 2 THEN concat_ws(chr(10), '```', '# no heading', '```') WHEN 3 THEN '' ELSE substr(t, 301) END) AS text_md5
        FROM (SELECT doc_id, translate(text, '#`~', '   ') AS t FROM documents), s WHERE t IS NOT NULL""",
    "label_propagation": f"""WITH {_V}, {_TAGS}, nb AS (SELECT q AS id, n FROM sh WHERE rank <= 12)
        SELECT nb.id, tag, count(*) AS support, any_value(k) AS neighbors FROM nb JOIN tg t ON t.id = nb.n JOIN (SELECT id, count(*) AS k FROM nb GROUP BY id) z ON z.id = nb.id
        WHERE NOT EXISTS (SELECT 1 FROM tg o WHERE o.id = nb.id AND o.tag = t.tag) GROUP BY nb.id, tag HAVING count(*) >= 3""",
    "suggested_pairs_unlinked": f"""WITH {_V}, {_LINKS}, {_BOTH}, p AS (SELECT least(q, n) AS a, greatest(q, n) AS b, max(s) AS s FROM sh GROUP BY 1, 2)
        SELECT a, b, round(s, 6) AS score FROM p WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.q = a AND bo.n = b) ORDER BY s DESC, a, b LIMIT 50""",
    "orphans_with_closest": """WITH l AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45),
        o AS (SELECT a.p_partkey AS id, first(b.p_partkey ORDER BY abs(a.p_retailprice - b.p_retailprice), b.p_partkey) AS closest, min(abs(a.p_retailprice - b.p_retailprice)) AS d
            FROM part a JOIN part b ON a.p_partkey <> b.p_partkey WHERE a.p_partkey NOT IN (SELECT id FROM l) GROUP BY 1)
        SELECT id, closest, 1 / (1 + d) AS closest_score FROM o""",
    "co_citation": """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
        SELECT a.p AS a, b.p AS b, count(*) AS n_sources FROM e a JOIN e b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2""",
    "shared_tags_overlap": f"WITH {_TAGS}, {_SHARED} SELECT * FROM st",
    "link_degrees": f"WITH {_LINKS}, {_BOTH} SELECT q AS id, count(*) AS degree FROM bo GROUP BY q",
    "link_reasons": f"""WITH {_V}, {_LINKS}, {_BOTH}, {_TAGS}, {_SHARED}, {_COCITE}
        SELECT sh.q, sh.n, CASE WHEN bo.q IS NOT NULL THEN 'linked' WHEN n_shared > 0 THEN 'shared-tags' WHEN n_sources > 0 THEN 'co-cited' ELSE 'semantic' END AS kind,
            CASE WHEN n_shared > 0 THEN top_tag END AS detail
        FROM sh LEFT JOIN bo ON bo.q = sh.q AND bo.n = sh.n LEFT JOIN st ON st.a = least(sh.q, sh.n) AND st.b = greatest(sh.q, sh.n)
        LEFT JOIN cc ON cc.a = least(sh.q, sh.n) AND cc.b = greatest(sh.q, sh.n) WHERE rank <= 5""",
    "stale_entities": f"WITH {_USERS} SELECT id, mtime FROM u ORDER BY mtime, id LIMIT 20",
    "recent_entities": "SELECT user_id AS id, max(event_id) AS at FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "relative_time": f"""WITH {_USERS}, a AS (SELECT id, mtime, 1706745600000 - mtime AS age FROM u)
        SELECT id, CASE WHEN age < 0 THEN '' WHEN age < 3600000 THEN 'just now' WHEN age < 86400000 THEN (age // 3600000) || 'h ago' WHEN age < 2592000000 THEN (age // 86400000) || 'd ago'
            WHEN age < 31536000000 THEN (age // 2592000000) || 'mo ago' ELSE (age // 31536000000) || 'y ago' END AS age, strftime(make_timestamp(mtime * 1000), '%Y-%m-%d') AS day FROM a""",
    "folder_exclusion": "SELECT p_brand || '/' || p_type || '/' || p_partkey AS path FROM part WHERE p_brand <> 'Brand#1' AND NOT (p_brand = 'Brand#2' AND p_type = 'ECONOMY')",
    "surface_dictionary": f"WITH {_SURFACES} SELECT * FROM su",
    "resolve_ambiguous": f"WITH {_SURFACES} SELECT surface, first(path ORDER BY length(path), path) AS path, count(DISTINCT path) > 1 AS ambiguous FROM su GROUP BY surface",
    "inflect_variants": f"WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS surface FROM documents) SELECT surface, {_INFLECT} AS variant FROM w",
    "mention_first_per_target": """WITH n AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 8),
        d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z]', ' ', 'g') || ' ' AS t FROM documents),
        k AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(trim(t), ' +')) AS word FROM d)
        SELECT doc_id AS doc, (instr(t, ' ' || word || ' ') - 1)::INTEGER AS start, word AS surface FROM k JOIN n USING (word) JOIN d USING (doc_id)""",
    "wikilink_text": "SELECT p_partkey, '[[' || p_name || ']]' AS plain, '[[' || p_name || '|' || p_brand || ']]' AS aliased FROM part",
    "word_counts": r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))::BIGINT AS n_words FROM documents",
    "markdown_clean": "SELECT doc_id, " + _cleaned("""'# Head' || chr(10) || '> *quoted* `code` [[Note|alias]] [[Other]] [label](http://x/y)' || chr(10) || '- **item** ![p](q)' || chr(10) || text""") + " AS clean FROM documents",
    "keyword_overlap_rank": r"""WITH i AS (SELECT DISTINCT item_id AS q, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM benchmark),
        d AS (SELECT DISTINCT doc_id AS n, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM documents),
        z AS (SELECT q, count(*) AS size FROM i WHERE length(w) >= 4 GROUP BY q),
        s AS (SELECT q, n, count(*)::DOUBLE / any_value(size) AS s FROM i JOIN d USING (w) JOIN z USING (q) WHERE length(w) >= 4 GROUP BY q, n)
        SELECT q, n, round(s, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY s DESC, n)::INTEGER AS rank FROM s
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, n) <= 10""",
    "blend_fuzzy_semantic": """WITH c AS (SELECT p_partkey AS id, 1.0::DOUBLE / (1 + levenshtein('wd', lower(p_name))) AS m, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 10000 END AS sem FROM part WHERE regexp_matches(lower(p_name), 'w.*d')),
        s AS (SELECT id, 0.6::DOUBLE * (m / max(m) OVER ()) + 0.4::DOUBLE * coalesce(sem, 0) AS s FROM c)
        SELECT id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, id)::INTEGER AS rank FROM s QUALIFY row_number() OVER (ORDER BY s DESC, id) <= 37""",
    "fuzzy_names": "SELECT p_partkey, p_name, -levenshtein('rdwt', lower(p_name))::DOUBLE AS raw FROM part WHERE regexp_matches(lower(p_name), 'r.*d.*w.*t')",
    "new_concepts_antijoin": f"""WITH {_SURFACES},
        l AS (SELECT p_partkey % 5 AS q, p_partkey AS id, p_retailprice / 2000 AS score, [p_name, p_type, p_brand] AS parts FROM part),
        b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 8),
        p AS (SELECT q, score, rank, unnest(parts) AS concept, unnest([0, 1, 2]) AS pl FROM b WHERE score >= 0.45),
        f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q, lower(concept) ORDER BY rank, pl) = 1),
        k AS (SELECT * FROM f WHERE lower(concept) NOT IN (SELECT surface FROM su) AND NOT (q = 1 AND lower(concept) = 'economy'))
        SELECT q, concept, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY rank, pl)::INTEGER AS k FROM k QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank, pl) <= 3""",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "session_coalesce": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, s""",
    "reuse_by_mtime": "SELECT user_id AS path, max(event_id) AS mtime FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'purchase'",
    "percent_pills": "SELECT vec_id, CASE WHEN label = 0 THEN '~' ELSE '' END || floor(embedding[1]::DOUBLE * 100 + 0.5)::BIGINT || '%' AS pill FROM embeddings",
    "eval_windows": f"""WITH {_V}, {_LINKS}, {_ALL_PAIRS}, {_directed('ch', 2.0, 'ap')}, sc AS (SELECT a.q, a.n, (a.d + b.d) / 2 AS s FROM dir a JOIN dir b ON b.q = a.n AND b.n = a.q), {_evaluated('sc')}""",
    "snippets": f"SELECT doc_id, nullif(left({_cleaned('text')}, 160), '') AS line FROM documents",
    "topic_labels": r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) > 3 GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        s AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df), 9) AS s FROM tf JOIN df USING (term)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) <= 5)
        SELECT doc_id, string_agg(term, ' · ' ORDER BY rank) AS label FROM r GROUP BY doc_id""",
    "hash_embed": r"SELECT doc_id, 64::INTEGER AS dims, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
    "linked_text": f"""WITH {_BENCH_WORDS}, na AS (SELECT DISTINCT word AS surface FROM bw),
        su AS (SELECT surface, surface AS base FROM na UNION ALL SELECT * FROM (SELECT {_INFLECT} AS v, surface AS base FROM na) WHERE length(v) >= 3 AND v NOT IN (SELECT surface FROM na)),
        un AS (SELECT surface, any_value(base) AS base FROM su GROUP BY surface HAVING count(DISTINCT base) = 1),
        dt AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', ' ', 'g') AS t FROM documents),
        dw AS (SELECT doc_id, unnest(string_split(t, ' ')) AS word FROM dt),
        h AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN word = base THEN 4 ELSE 5 + length(base) END) AS more FROM dw JOIN un ON surface = word GROUP BY doc_id)
        SELECT doc_id AS doc, coalesce(n, 0)::INTEGER AS n_links, (length(t) + coalesce(more, 0))::INTEGER AS n_chars FROM dt LEFT JOIN h USING (doc_id)""",
    "later_mentions": f"""WITH {_BENCH_WORDS}, {_PLACES}
        SELECT DISTINCT doc_id AS doc, start::INTEGER AS start, word AS surface FROM pl JOIN bw USING (word)
        WHERE item_id = doc_id % (SELECT count(*) FROM benchmark) AND NOT (100 BETWEEN start AND start + length(word))""",
    "linked_notes": """SELECT l_orderkey AS src, l_partkey || '.md' AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey || '.md')::INTEGER AS rank
        FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_orderkey, l_partkey""",
    "topic_gate": f"WITH {_V}, {_LINKS} SELECT src AS doc, dst AS path FROM li JOIN mean a ON a.id = src JOIN mean b ON b.id = dst WHERE list_dot_product(a.v, b.v) < 0",
    "tag_alias_folding": "SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END, p_type || ', ' || p_brand, p_name) AS input FROM part",
    "median_size": "SELECT p_brand, round(median(p_retailprice), 6) AS middle FROM part GROUP BY 1",
    "report_exclusion": "SELECT 'parts/' || p_partkey AS path FROM part WHERE p_partkey <> 7",
    "link_exclusion": "SELECT p_brand || '/' || p_type || '/' || p_partkey AS path FROM part WHERE p_brand <> 'Brand#1' AND NOT (p_brand = 'Brand#2' AND p_type = 'ECONOMY')",
    "empty_query_pool": f"WITH {_USERS} SELECT id, 0.0::DOUBLE AS semantic FROM u ORDER BY mtime DESC, id LIMIT 80",
    "typed_concepts": f"""WITH {_SURFACES}, t AS (SELECT c_custkey AS q, trim(c_name) AS concept FROM customer UNION ALL SELECT p_partkey, trim(p_name) FROM part)
        SELECT q, concept, 1::INTEGER AS k FROM t WHERE length(concept) >= 3 AND lower(concept) NOT IN (SELECT surface FROM su)""",
    "unused_names": """WITH n AS (SELECT p_partkey AS id, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
        SELECT id, p_name || ' ' || CASE k WHEN 1 THEN 2 ELSE k + 2 END AS name FROM n""",
    "context_badge": "SELECT vec_id, CASE WHEN embedding[1]::DOUBLE > 0.01 THEN floor(embedding[1]::DOUBLE * 100 + 0.5)::BIGINT || '%' END AS badge FROM embeddings",
    "link_insertion": "SELECT p_partkey, left(p_name, 4) AS query, 'see [[x]] and [[' || p_name || ']] end' AS line FROM part",
    "cursor_context": r"""WITH d AS (SELECT doc_id, text, length(text) // 2 AS h FROM documents),
        b AS (SELECT doc_id, left(text, h) || '[[open' || substr(text, h + 1) AS t, h + 6 AS c FROM d)
        SELECT doc_id, md5(regexp_replace(substr(t, greatest(c - 600, 0) + 1, c + 600 - greatest(c - 600, 0)), '\[\[[^\]]*$', ' ')) AS context_md5 FROM b""",
    "context_key": """WITH u AS (SELECT p_partkey, p_brand, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT) AS u FROM part)
        SELECT p_partkey, p_brand || ':' || lower(to_base(list_reduce(list_prepend(5381::BIGINT, u), lambda h, x: (h * 33 + x) % 4294967296), 36)) AS key FROM u""",
    "context_rank": f"""WITH {_V} SELECT m.id, round(list_dot_product(m.v, v.v), 6) AS semantic FROM mean m, v WHERE v.id = 0 AND m.id <> 0 ORDER BY list_dot_product(m.v, v.v) DESC, m.id LIMIT 80""",
    "single_link": """WITH w AS (SELECT p_partkey, p_name, p_type, regexp_extract(p_name, '^([^ ]+)', 1) AS w FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a ' || p_name ELSE 'a [[' || p_type || CASE WHEN lower(p_type) = lower(w) THEN '' ELSE '|' || w END || ']]' || substr(p_name, length(w) + 1) END AS body FROM w""",
    "skipped_spans": """WITH w AS (SELECT p_partkey::VARCHAR AS doc, regexp_extract(p_name, '^([^ ]+)', 1) AS w FROM part)
        SELECT doc, unnest([11 + 3 * length(w), 25 + 5 * length(w)])::INTEGER AS start, lower(w) AS surface FROM w WHERE length(w) >= 3""",
    "rebuild_predicate": """SELECT * FROM (VALUES ('model_id', 'engine'), ('device', 'engine'), ('index_speed', 'engine'), ('chunking', 'force'), ('max_chunks', 'force'),
        ('show_summary', 'force'), ('heading_context', 'force'), ('top_k', NULL), ('min_similarity', NULL)) t(setting, rebuild)""",
    "paragraph_split": f"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\. ', '.' || chr(10), 'g'), '! |\\? ', chr(10) || chr(10) || chr(10), 'g') AS t FROM documents),
        p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n{{2,}}'), lambda p: regexp_replace(regexp_replace(replace(p, chr(10), ' '), '^[{_BLANK}]+', ''), '[{_BLANK}]+$', '')), lambda p: p <> '') AS p FROM d)
        SELECT doc_id, (unnest(range(1, len(p) + 1)) - 1)::INTEGER AS no, md5(unnest(p)) AS text_md5 FROM p""",
    "whole_note_text": f"SELECT doc_id, md5(left('note ' || doc_id || '. ' || {_cleaned('text')}, 6000)) AS text_md5 FROM documents",
    "cache_expiry": "SELECT user_id AS path, max(event_id) AS mtime FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) = 'view'",
    "index_header": """WITH n AS (SELECT vec_id // 10, any_value(len(embedding)) AS dims, count(*) AS c FROM embeddings GROUP BY 1)
        SELECT 4::INTEGER AS version, 'm' AS model_id, max(dims)::INTEGER AS dims, true AS quantized, false AS has_chunk_text, sum(dims * (4 + c))::BIGINT AS total_bytes FROM n""",
    "index_round_trip": "SELECT vec_id::VARCHAR AS path, vec_id AS mtime, 'l' AS label, (vec_id % 2 = 0)::INTEGER AS n_ideas FROM embeddings WHERE vec_id % 7 <> 0",
}
SQL["suggestion_list"] = f"""WITH nn AS ({SQL['new_concepts_antijoin']}),
        no AS (SELECT p_partkey % 5 AS q, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_retailprice / 2000 DESC, p_partkey) AS r FROM part),
        a AS (SELECT q, 0 AS kind, r, id, NULL AS concept FROM no WHERE r <= 37 UNION ALL SELECT q, 1, k, NULL, concept FROM nn)
        SELECT q, row_number() OVER (PARTITION BY q ORDER BY kind, r)::INTEGER AS place, CASE kind WHEN 0 THEN 'note' ELSE 'new' END AS kind, id, concept FROM a"""
