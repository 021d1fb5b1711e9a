"""DuckDB SQL that says the same as the queries of the same names."""

from __future__ import annotations

from graphloom import config as C
from graphloom.plans import views as W


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _nt(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def _wc(x: str) -> str:
    return f"(CASE WHEN {_nt(x)} = '' THEN 0 ELSE len(string_split({_nt(x)}, ' ')) END)"


def _year(x: str) -> str:
    return rf"(CASE WHEN regexp_matches(trim({x}), '^[+-]?\d+$') THEN try_cast(trim({x}) AS INTEGER) END)"


def _mt(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def _doi(x: str) -> str:
    return f"trim(replace(replace(lower(trim(coalesce({x}, ''))), 'https://doi.org/', ''), 'http://doi.org/', ''))"


def _rel(x: str) -> str:
    return f"regexp_replace(regexp_replace(replace(replace({_fold(_nt(x))}, '-', '_'), ' ', '_'), '^are_', 'is_'), '^were_', 'was_')"


def _canon(x: str) -> str:
    t = f"trim({_nt(x)}, ' .,:;\"''')"
    key = _fold(rf"regexp_replace({t}, '(?i)^(a|an|the)\s+', '')")
    alias = " ".join(f"WHEN k = '{a}' THEN '{b}'" for a, b in C.ALIASES.items())
    cuts = " ".join(f"WHEN ends_with(k, '{s}') AND len(string_split(trim(k), ' ')) > 1 THEN trim(left(k, len(k) - {len(s)}))" for s in C.STRIP_SUFFIXES)
    return f"(SELECT CASE {alias} {cuts} ELSE k END FROM (SELECT {key} AS k))"


def _fold(x: str) -> str:
    """Case folding, for the letters that the tables hold."""
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


PAPERS = f"papers AS (SELECT {', '.join(W.exprs(W.PAPER, 'VARCHAR'))}, doc_id AS seq FROM documents)"

VERDICTS = f"""base AS (SELECT *, {_nt('title')} AS t, {_nt('abstract')} AS a, {_nt('id')} AS i, {_year('year')} AS y,
    CASE WHEN {_nt('title')} = '' OR {_nt('abstract')} = '' OR coalesce(trim(year), '') = '' THEN 'missing' WHEN {_year('year')} IS NULL THEN 'missing'
         WHEN {_year('year')} > 2025 THEN 'future' WHEN {_wc('abstract')} < 20 THEN 'short' END AS b FROM papers),
ranked AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN b IS NULL THEN CASE WHEN i <> '' THEN 'id:' || i ELSE 'title:' || {_fold('t')} END ELSE 'row:' || seq END ORDER BY seq) AS r FROM base),
verdicts AS (SELECT *, coalesce(b, CASE WHEN r > 1 THEN 'duplicate' ELSE 'clean' END) AS verdict FROM ranked),
clean AS (SELECT CASE WHEN i <> '' THEN i ELSE t END AS id, t AS title, y::BIGINT AS year, a AS abstract, citationCount::BIGINT AS cited_by_count FROM verdicts WHERE verdict = 'clean')"""

MERGED = f"""u AS (SELECT *, (src <> 'openalex')::INT AS o FROM papers),
k AS (SELECT *, CASE WHEN {_doi('doi')} <> '' THEN 'doi:' || {_doi('doi')} WHEN {_mt('title')} <> '' THEN 'title:' || {_mt('title')} ELSE 'id:' || coalesce(id, '') END AS key
      FROM u WHERE coalesce(title, '') <> '' OR coalesce(doi, '') <> ''),
merged AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(coalesce(abstract, '')) DESC, o, seq) = 1)"""

_ORDER = ", ".join(W.ORDER)
FACTS = f"facts AS (SELECT {', '.join(W.exprs(W.FACT, 'VARCHAR'))}, row_number() OVER (ORDER BY {_ORDER}) - 1 AS seq FROM lineitem)"
SURFACES = f"quads AS (SELECT {', '.join(W.exprs(W.SURFACE, 'VARCHAR'))}, row_number() OVER (ORDER BY {_ORDER}) - 1 AS seq FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"


def _generic(x: str) -> str:
    w = f"string_split({_nt(x)}, ' ')"
    return f"({_nt(x)} = '' OR ({w}[-1] IN ({_list(C.GENERIC_TERMS)}) AND (len({w}) = 1 OR {w}[1] IN ({_list(C.VAGUE_QUALIFIERS)}))))"


CLASSIFIED = f"""c0 AS (SELECT *, lower(trim(coalesce(subject, ''))) AS s, lower(trim(coalesce(object, ''))) AS o, {_rel('relation')} AS relation_norm, {_year('year')} AS year_int FROM quads),
classified AS (SELECT *, CASE WHEN s = '' OR o = '' OR relation_norm = '' THEN 'missing_field' WHEN year_int IS NULL OR year_int NOT BETWEEN {W.YEAR_FROM} AND {W.YEAR_TO} THEN 'invalid_year'
    WHEN relation_norm IN ({_list(C.BANNED_RELATIONS)}) THEN 'banned_relation' WHEN {_generic('s')} OR {_generic('o')} THEN 'generic_entity'
    WHEN {_wc('s')} > 6 OR {_wc('o')} > 6 THEN 'entity_too_long' ELSE 'valid' END AS verdict FROM c0)"""

PREPARED = rf"""p0 AS (SELECT {_canon('subject')} AS source, {_canon('object')} AS target, regexp_replace(lower(trim(relation_norm)), '\s+', '_', 'g') AS rel, year_int AS year, paper_id, subject, object, seq
    FROM classified WHERE verdict = 'valid'),
prepared AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos FROM p0 WHERE source <> '' AND target <> '' AND rel <> '')"""


def _forms(view: str) -> str:
    return f"""forms AS (SELECT entity, surface, count(*) AS n, min(place) AS first_seq FROM (
    SELECT source AS entity, trim(subject) AS surface, seq * 2 AS place FROM {view} UNION ALL SELECT target, trim(object), seq * 2 + 1 FROM {view}) GROUP BY 1, 2),
nodes AS (SELECT entity AS id, CASE WHEN entity IN ({_list(C.UPPER_VOCAB)}) THEN upper(entity) ELSE surface END AS label, n_forms FROM (
    SELECT *, count(*) OVER (PARTITION BY entity) AS n_forms, row_number() OVER (PARTITION BY entity ORDER BY n DESC, first_seq) AS r FROM forms) WHERE r = 1)"""


MERGES = "merges AS (SELECT lower(s_name) AS longer, format('supplier#{:09d}', s_suppkey // 10) AS shorter FROM supplier WHERE s_suppkey > 0)"
APPLIED = """applied AS (SELECT coalesce(a.shorter, source) AS source, coalesce(b.shorter, target) AS target, (a.longer IS NOT NULL)::INT + (b.longer IS NOT NULL)::INT AS n_merged, subject, object, seq
    FROM prepared LEFT JOIN merges a ON source = a.longer LEFT JOIN merges b ON target = b.longer)"""

EDGES = rf"""edges AS (SELECT lower(subject) AS source, lower(object) AS target, regexp_replace(relation, '\s+', '_', 'g') AS relation, year::INT AS year FROM facts)"""
_CUTS = ", ".join(f"({c})" for c in (*W.CUTOFFS, W.FINAL_YEAR))
SNAPS = f"snaps AS (SELECT c.cutoff_year, edges.* FROM edges JOIN (VALUES {_CUTS}) c(cutoff_year) ON year <= cutoff_year)"
SNODES = "snodes AS (SELECT DISTINCT cutoff_year, node FROM (SELECT cutoff_year, source AS node FROM snaps UNION ALL SELECT cutoff_year, target FROM snaps))"
SPAIRS = "spairs AS (SELECT DISTINCT cutoff_year, least(source, target) AS node_a, greatest(source, target) AS node_b FROM snaps WHERE source <> target)"
POSITIVES = f"""positives AS (SELECT a.cutoff_year, f.node_a, f.node_b FROM spairs f JOIN snodes a ON a.node = f.node_a JOIN snodes b ON b.node = f.node_b AND b.cutoff_year = a.cutoff_year
    WHERE f.cutoff_year = {W.FINAL_YEAR} AND a.cutoff_year < {W.FINAL_YEAR} AND NOT EXISTS (SELECT 1 FROM spairs e WHERE e.cutoff_year = a.cutoff_year AND e.node_a = f.node_a AND e.node_b = f.node_b))"""


def _draw(side: str) -> str:
    return f"('0x' || substr(md5('42|' || cutoff_year || '|' || attempt || '|{side}'), 1, 8))::BIGINT % size"


NEGATIVES = f"""placed AS (SELECT cutoff_year, node, row_number() OVER (PARTITION BY cutoff_year ORDER BY node) - 1 AS place, count(*) OVER (PARTITION BY cutoff_year) AS size FROM snodes WHERE cutoff_year < {W.FINAL_YEAR}),
need AS (SELECT cutoff_year, count(*) AS need, any_value(size) AS size FROM positives JOIN (SELECT DISTINCT cutoff_year, size FROM placed) USING (cutoff_year) GROUP BY 1),
tries AS (SELECT cutoff_year, need, size, unnest(range(need * 50)) AS attempt FROM need WHERE size > 1),
draws AS (SELECT *, {_draw('a')} AS a, {_draw('b')} AS b FROM tries),
found AS (SELECT d.cutoff_year, least(x.node, y.node) AS node_a, greatest(x.node, y.node) AS node_b, attempt, need FROM draws d
    JOIN placed x ON x.cutoff_year = d.cutoff_year AND x.place = d.a JOIN placed y ON y.cutoff_year = d.cutoff_year AND y.place = d.b WHERE a <> b),
negatives AS (SELECT cutoff_year, node_a, node_b, attempt FROM (SELECT *, row_number() OVER (PARTITION BY cutoff_year ORDER BY attempt) AS r FROM found f
    WHERE NOT EXISTS (SELECT 1 FROM spairs e WHERE e.cutoff_year = {W.FINAL_YEAR} AND e.node_a = f.node_a AND e.node_b = f.node_b)) WHERE r <= need)"""

VECS = "vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, label AS y, sqrt(list_sum([x * x for x in embedding::DOUBLE[]])) AS n FROM embeddings)"
_COS = "round(coalesce(list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]) / nullif(a.n * b.n, 0), 0), 6)"
SCORED = f"scored AS (SELECT a.vec_id AS node_a, b.vec_id AS node_b, (2020 + a.vec_id % 4)::BIGINT AS g, (a.y = b.y)::BIGINT AS label, {_COS} AS score FROM vecs a JOIN vecs b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 10)"
CUM = """s AS (SELECT g, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY g) AS ap, sum(neg) OVER (PARTITION BY g) AS an FROM s WINDOW w AS (PARTITION BY g ORDER BY score DESC))"""
KNN = f"""sims AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]) / (a.n * b.n) AS sim FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id),
knn AS (SELECT a, b, round(sim, 6) AS sim FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) <= 10)"""

NAMES = "names AS (SELECT DISTINCT unnest([p_name, p_name || 's', 'the ' || p_name || 's', p_name || ' ' || p_size % 3, p_name || ' networks', 'networks', 'network']) AS entity FROM part)"
TFIDF = f"""padded AS (SELECT entity, ' ' || unnest(string_split(lower({_nt('entity')}), ' ')) || ' ' AS w FROM names),
grams AS (SELECT entity, substr(w, i, n) AS gram FROM (SELECT entity, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM padded, (VALUES (3), (4), (5)) t(n) WHERE len(w) >= n)
    UNION ALL SELECT entity, w FROM padded WHERE len(w) < 3),
tf AS (SELECT entity, gram, count(*) AS tf FROM grams GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT entity, gram, tf * (ln((1.0 + (SELECT count(*) FROM names)) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (gram)),
tfidf AS (SELECT entity, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity)) AS weight FROM raw)"""
_NUM = "list_sort(list_distinct(regexp_extract_all({x}, '\\d+')))"
MERGE = f"""psim AS (SELECT x.entity AS a, y.entity AS b, sum(x.weight * y.weight) AS sim FROM tfidf x JOIN tfidf y ON x.gram = y.gram AND x.entity <> y.entity GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.9 - 1e-9),
top AS (SELECT * FROM psim QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) = 1),
cand AS (SELECT a AS entity, CASE WHEN len(a) > len(b) THEN a ELSE b END AS longer, CASE WHEN len(a) > len(b) THEN b ELSE a END AS shorter, round(sim, 3) AS similarity,
    list_distinct(string_split({_nt('a')}, ' ')) AS wa, list_distinct(string_split({_nt('b')}, ' ')) AS wb FROM top
    WHERE len(a) <> len(b) AND NOT (len({_NUM.format(x='a')}) > 0 AND len({_NUM.format(x='b')}) > 0 AND {_NUM.format(x='a')} <> {_NUM.format(x='b')})),
candidates AS (SELECT entity, longer, shorter, similarity, len([w for w in (CASE WHEN len(wa) <= len(wb) THEN wa ELSE wb END) if w NOT IN ({_list(C.GENERIC_HEAD_WORDS)})]) = 0 AS risky FROM cand)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def oracle_sql() -> dict[str, str]:
    papers, verdicts = _with(PAPERS), _with(PAPERS, VERDICTS)
    classified = _with(SURFACES, CLASSIFIED)
    prepared = _with(SURFACES, CLASSIFIED, PREPARED)
    edges, snaps = _with(FACTS, EDGES), _with(FACTS, EDGES, SNAPS)
    labels = _with(FACTS, EDGES, SNAPS, SNODES, SPAIRS, POSITIVES)
    scored, cum = _with(VECS, SCORED), _with(VECS, SCORED, CUM)
    nbrs = "nbrs AS (SELECT DISTINCT source AS node, target AS nbr FROM edges UNION SELECT DISTINCT target, source FROM edges)"
    ratios = f"round({_ratio('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round({_ratio('tp', 'tp + fp')}, 6) AS precision, round({_ratio('tp', 'tp + fn')}, 6) AS recall, round({_ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1"
    cos = "coalesce(list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]) / nullif(a.n * b.n, 0), 0)"
    pairs = f"pairs AS (SELECT a.vec_id AS node_a, b.vec_id AS node_b, 2020 + a.vec_id % 4 AS g, (a.y = b.y)::BIGINT AS label, {cos} AS cos FROM vecs a JOIN vecs b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 10)"
    known_p = "known AS (SELECT *, 1 / (1 + exp(0.1::DOUBLE - 3 * cos)) AS p FROM pairs)"
    known = _with(VECS, pairs, known_p)
    evaluated = _with(
        VECS, pairs, known_p,
        "both2 AS (SELECT CASE g WHEN 2022 THEN 'Validation' ELSE 'Test' END AS split, node_a, node_b, label, m AS method, CASE m WHEN 'Cosine Similarity' THEN cos ELSE p END AS score FROM known, (VALUES ('Cosine Similarity'), ('Logistic Regression')) t(m) WHERE g IN (2022, 2023))",
        "grid AS (SELECT method, i, count(*) FILTER (score >= i / 100.0::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= i / 100.0::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < i / 100.0::DOUBLE AND label = 1) AS fn FROM both2, range(1, 100) t(i) WHERE split = 'Validation' GROUP BY 1, 2)",
        "chosen AS (SELECT method, CASE WHEN tp + fp > 0 THEN i / 100.0::DOUBLE ELSE 0.5 END AS t FROM grid QUALIFY row_number() OVER (PARTITION BY method ORDER BY tp + fp > 0 DESC, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) DESC, i) = 1)",
        "counted AS (SELECT split, method, count(*) AS n, sum(label)::BIGINT AS positive, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn, count(*) FILTER (score < t AND label = 0) AS tn FROM both2 JOIN chosen USING (method) GROUP BY 1, 2)",
        "s2 AS (SELECT split, method, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM both2 GROUP BY 1, 2, 3)",
        "cum2 AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp, sum(pos) OVER (PARTITION BY split, method) AS allp, sum(neg) OVER (PARTITION BY split, method) AS alln FROM s2 WINDOW w AS (PARTITION BY split, method ORDER BY score DESC))",
        "areas AS (SELECT split, method, sum(neg * (ctp - pos) + neg * pos / 2)::DOUBLE / (max(allp) * max(alln)) AS auc, sum(pos * ctp / (ctp + cfp)) / max(allp) AS ap FROM cum2 GROUP BY 1, 2)",
    )
    prefixes = "|".join(C.INVALID_PREFIXES)
    gaps = _with(
        VECS,
        "gnodes AS (SELECT printf('n%05d', vec_id) AS id, CASE vec_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'case-' || vec_id ELSE 'Node ' || vec_id END AS label, v, n FROM vecs)",
        "gedges AS (SELECT printf('n%05d', vec_id) AS source, printf('n%05d', vec_id + step) AS target, 2018 + vec_id % 7 AS year FROM vecs, (VALUES (1), (2), (3)) t(step))",
        "nbr AS (SELECT source AS node, target AS to_ FROM gedges UNION SELECT target, source FROM gedges)",
        f"usable AS (SELECT id, v, n FROM gnodes WHERE NOT regexp_matches(lower(coalesce(label, id)), '^({prefixes})'))",
        "active AS (SELECT DISTINCT unnest([source, target]) AS id FROM gedges WHERE year >= 2023)",
        f"near AS (SELECT a.id AS a, b.id AS b FROM usable a JOIN active USING (id) JOIN usable b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({cos}, 12) DESC, b.id) <= 30)",
        "cands AS (SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM near WHERE NOT EXISTS (SELECT 1 FROM nbr WHERE node = a AND to_ = b))",
        f"sims2 AS (SELECT node_a, node_b, {cos} AS cos, 1 / (1 + exp(0.1::DOUBLE - 3 * {cos})) AS p FROM cands JOIN gnodes a ON a.id = node_a JOIN gnodes b ON b.id = node_b)",
    )
    scan = 'SELECT id, title, year, doi, "citationCount"::BIGINT AS "citationCount", len(abstract) AS n_abstract FROM papers'
    return {
        "merge_dedupe_papers": _with(PAPERS, MERGED) + "SELECT src AS source, id, title, doi, len(abstract) AS n_abstract FROM merged",
        "merge_source_counts": _with(PAPERS, MERGED) + "SELECT src AS source, count(*) AS n FROM merged GROUP BY 1",
        "merge_stats": _with(PAPERS, MERGED) + "SELECT raw, dropped, kept, raw - kept - dropped AS duplicates FROM (SELECT count(*) AS raw, count(*) FILTER (coalesce(title, '') = '' AND coalesce(doi, '') = '') AS dropped, (SELECT count(*) FROM merged) AS kept FROM papers)",
        "collect_filter": papers + f"SELECT id, seq FROM papers WHERE coalesce(id, '') <> '' AND {_wc('abstract')} >= 20 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1",
        "clean_papers": verdicts + "SELECT * FROM clean",
        "clean_stats": verdicts + "SELECT count(*) AS input, count(*) FILTER (verdict = 'duplicate') AS duplicates_removed, count(*) FILTER (verdict = 'missing') AS missing_required_fields, count(*) FILTER (verdict = 'short') AS short_or_empty_abstract, count(*) FILTER (verdict = 'future') AS future_papers_removed, count(*) FILTER (verdict = 'clean') AS output FROM verdicts",
        "year_distribution": verdicts + "SELECT year, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM clean GROUP BY 1",
        "dataset_stats": verdicts + f"SELECT count(*) AS papers, min(year) AS min_year, max(year) AS max_year, round(avg(w), 6) AS words_mean, round(median(w), 6)::DOUBLE AS words_median, min(w)::BIGINT AS words_min, max(w)::BIGINT AS words_max, round(coalesce(avg(cited_by_count), 0), 6) AS cited_mean, round(coalesce(median(cited_by_count), 0), 6)::DOUBLE AS cited_median, coalesce(max(cited_by_count), 0) AS cited_max FROM (SELECT *, {_wc('abstract')} AS w FROM clean)",
        "holdout_split": papers + f"SELECT CASE WHEN y < 2026 THEN 'train' WHEN y = 2026 THEN 'holdout' END AS split, count(*) AS n FROM (SELECT coalesce({_year('year')}, 0) AS y FROM papers) GROUP BY 1",
        "year_quota": papers + f"SELECT {_year('year')}::BIGINT AS year, seq FROM papers WHERE {_year('year')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_year('year')} ORDER BY seq) <= 20",
        "papers_per_year": papers + f"SELECT {_year('year')}::BIGINT AS y, count(*) AS n FROM papers WHERE {_year('year')} IS NOT NULL GROUP BY 1",
        "quad_verdicts": classified + "SELECT subject, relation_norm, object, year_int::BIGINT AS year_int, verdict, count(*) AS n FROM classified GROUP BY ALL",
        "quad_breakdown": classified + "SELECT * FROM (SELECT verdict AS reason, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM classified GROUP BY 1) WHERE reason <> 'valid'",
        "clean_quads": classified + "SELECT subject, relation_norm AS relation, object, year_int::BIGINT AS year, paper_id FROM classified WHERE verdict = 'valid'",
        "rejected_quads": classified + "SELECT subject, relation, object, year, paper_id, verdict AS reason FROM classified WHERE verdict <> 'valid'",
        "llm_json_parse": f"""WITH e AS (SELECT *, CASE WHEN event_id % 3 = 1 THEN NULL ELSE (2018 + event_id % 7)::VARCHAR END AS year FROM events WHERE event_id % 6 IN (0, 1, 5)),
twice AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 6 = 1)
SELECT event_type AS subject, 'is ' || event_type AS relation, 'u' || user_id AS object, year, event_id::VARCHAR AS paper_id FROM twice""",
        "canonical_entities": prepared[:-1] + ",\n" + _forms("prepared") + "\nSELECT id, label, n_forms FROM nodes",
        "graph_edges": prepared + "SELECT source, target, rel || ':' || pos AS key, rel AS relation, year::BIGINT AS year, paper_id FROM prepared",
        "graph_nodes": _with(FACTS, "prepared AS (SELECT lower(subject) AS source, lower(object) AS target, subject, object, seq FROM facts)", _forms("prepared")) + "SELECT id, label FROM nodes",
        "graph_summary": prepared[:-1] + ",\n" + MERGES + ",\n" + APPLIED + ",\n" + _forms("applied") + "\nSELECT (SELECT count(*) FROM p0) AS input, (SELECT count(*) FROM p0) - (SELECT count(*) FROM prepared) AS skipped, (SELECT sum(n_merged)::BIGINT FROM applied) AS merges_applied, count(*) AS unique_entities, count(*) FILTER (n_forms > 1) AS multi_form_entities FROM nodes",
        "relation_counts": edges + "SELECT relation, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, relation LIMIT 10",
        "apply_merges": prepared[:-1] + ",\n" + MERGES + ",\n" + APPLIED + "\nSELECT source, target, count(*) AS n, sum(n_merged)::BIGINT AS n_merged FROM applied GROUP BY 1, 2",
        "collapse_merge_chains": "WITH RECURSIVE " + MERGES + """, walk AS (SELECT longer, shorter, 0 AS d FROM merges UNION ALL SELECT w.longer, m.shorter, d + 1 FROM walk w JOIN merges m ON w.shorter = m.longer AND m.longer <> m.shorter WHERE d < 40)
SELECT longer, shorter FROM walk WHERE longer <> shorter QUALIFY row_number() OVER (PARTITION BY longer ORDER BY d DESC) = 1""",
        "snapshot_summary": snaps[:-1] + ",\n" + SNODES + "\nSELECT cutoff_year::BIGINT AS cutoff_year, n_nodes, n_edges FROM (SELECT cutoff_year, count(*) AS n_edges FROM snaps GROUP BY 1) JOIN (SELECT cutoff_year, count(*) AS n_nodes FROM snodes GROUP BY 1) USING (cutoff_year)",
        "snapshot_nodes": snaps[:-1] + ",\n" + SNODES + "\nSELECT cutoff_year::BIGINT AS cutoff_year, node FROM snodes",
        "snapshot_pairs": snaps[:-1] + ",\n" + SPAIRS + "\nSELECT cutoff_year::BIGINT AS cutoff_year, node_a, node_b FROM spairs",
        "node_degree": _with(FACTS, EDGES, nbrs) + "SELECT node, count(*) AS degree FROM nbrs GROUP BY 1",
        "active_nodes": edges + f"SELECT DISTINCT node FROM (SELECT source AS node, year FROM edges UNION ALL SELECT target, year FROM edges) WHERE year >= {W.FINAL_YEAR - 1}",
        "common_neighbors": _with(FACTS, EDGES, nbrs, "prs AS (SELECT DISTINCT source AS node_a, 'p' || (substr(source, 2)::BIGINT + 1) AS node_b FROM edges)") + "SELECT node_a, node_b, count(b.nbr) AS common_neighbors FROM prs LEFT JOIN nbrs a ON a.node = node_a LEFT JOIN nbrs b ON b.node = node_b AND b.nbr = a.nbr GROUP BY 1, 2",
        "link_positives": labels + "SELECT cutoff_year::BIGINT AS cutoff_year, node_a, node_b FROM positives",
        "link_negatives": labels[:-1] + ",\n" + NEGATIVES + "\nSELECT cutoff_year::BIGINT AS cutoff_year, node_a, node_b, attempt FROM negatives",
        "label_counts": labels[:-1] + ",\n" + NEGATIVES + "\nSELECT cutoff_year::BIGINT AS cutoff_year, count(*) AS n, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM (SELECT cutoff_year, 1 AS y FROM positives UNION ALL SELECT cutoff_year, 0 FROM negatives) GROUP BY 1",
        "repeated_pairs": labels + "SELECT node_a, node_b, count(DISTINCT cutoff_year) AS n_cutoffs FROM positives GROUP BY 1, 2 HAVING count(DISTINCT cutoff_year) > 1",
        "split_by_cutoff": scored + "SELECT CASE WHEN g IN (2020, 2021) THEN 'train' WHEN g = 2022 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, sum(label)::BIGINT AS positives FROM scored GROUP BY 1",
        "cosine_pairs": scored + "SELECT node_a, node_b, g AS cutoff_year, label, score FROM scored",
        "pair_features": _with(VECS) + f"SELECT a.vec_id AS node_a, b.vec_id AS node_b, 193::BIGINT AS dim, round(list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]), 6) AS hadamard, round(list_sum([abs(x[1] - x[2]) for x in list_zip(a.v, b.v)]), 6) AS l1, round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.v, b.v)]), 6) AS l2, {_COS} AS cos_sim FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1",
        "knn_candidates": _with(VECS, KNN) + "SELECT a, b, sim FROM knn",
        "unlinked_candidates": _with(VECS, KNN) + "SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM knn WHERE abs(a - b) > 10",
        "confusion_metrics": scored[:-1] + f""",
c AS (SELECT g, count(*) AS n, count(*) FILTER (label = 1) AS positive, count(*) FILTER (score >= 0.2 AND label = 1) AS tp, count(*) FILTER (score >= 0.2 AND label = 0) AS fp, count(*) FILTER (score < 0.2 AND label = 1) AS fn, count(*) FILTER (score < 0.2 AND label = 0) AS tn FROM scored GROUP BY 1)
SELECT *, {ratios} FROM c""",
        "roc_auc": cum + "SELECT g, round(sum(neg * (tp - pos) + neg * pos / 2)::DOUBLE / (max(ap) * max(an)), 6) AS roc_auc FROM cum GROUP BY 1",
        "average_precision": cum + "SELECT g, round(sum(pos * tp / (tp + fp)) / max(ap), 6) AS average_precision FROM cum GROUP BY 1",
        "roc_points": cum + f"SELECT g, score AS threshold, round({_ratio('fp', 'an')}, 6) AS fpr, round({_ratio('tp', 'ap')}, 6) AS tpr FROM cum",
        "pr_points": cum + f"SELECT g, score AS threshold, round({_ratio('tp', 'tp + fp')}, 6) AS precision, round({_ratio('tp', 'ap')}, 6) AS recall FROM cum",
        "precision_at_k": scored + "SELECT g, k::BIGINT AS k, round(avg(label), 6) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, node_a, node_b) AS r FROM scored) JOIN (VALUES (10), (20), (50)) t(k) ON r <= k GROUP BY 1, 2",
        "best_threshold": scored[:-1] + """,
grid AS (SELECT g, i, count(*) FILTER (score >= i / 100.0::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= i / 100.0::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < i / 100.0::DOUBLE AND label = 1) AS fn FROM scored, range(1, 100) t(i) GROUP BY 1, 2),
f AS (SELECT *, tp + fp > 0 AS ok, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM grid QUALIFY row_number() OVER (PARTITION BY g ORDER BY ok DESC, f1 DESC, i) = 1)
SELECT g, CASE WHEN ok THEN round(i / 100.0::DOUBLE, 6) ELSE 0.5 END AS threshold, CASE WHEN ok THEN round(f1, 6) ELSE -1 END AS f1 FROM f""",
        "scaler_stats": "SELECT i, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY 1",
        "char_ngram_tfidf": _with(NAMES, TFIDF) + "SELECT entity, gram, round(weight, 6) AS weight FROM tfidf",
        "merge_candidates": _with(NAMES, TFIDF, MERGE) + "SELECT longer, shorter, similarity, risky FROM candidates",
        "merge_map": _with(NAMES, TFIDF, MERGE) + "SELECT longer, shorter FROM candidates QUALIFY row_number() OVER (PARTITION BY longer ORDER BY entity DESC) = 1",
        "entity_length_hist": _with(SURFACES) + f"SELECT {_wc('subject')}::BIGINT AS n_words, count(*) AS n FROM quads WHERE subject IS NOT NULL GROUP BY 1",
        "long_entities": f"SELECT doc_id AS id, split_part(text, chr(10), 1) AS label FROM documents WHERE {_wc('split_part(text, chr(10), 1)')} > 6 ORDER BY 1 LIMIT 100",
        "entity_validity": f"SELECT doc_id, coalesce(label, '') <> '' AND {_wc('label')} <= 8 AND NOT regexp_matches(lower({_nt('label')}), '^({'|'.join(C.INVALID_PREFIXES)})') AS ok FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'case-' || lang WHEN 1 THEN split_part(text, chr(10), 1) WHEN 2 THEN '' ELSE 'Results of ' || source END AS label FROM documents)",
        "gap_confidence": scored + "SELECT node_a, node_b, round(p, 4) AS probability, CASE WHEN p >= 0.9 THEN 'HIGH' WHEN p >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT *, abs(score) * 4 AS p FROM scored)",
        "scaled_vectors": "WITH u AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings), m AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS std FROM u GROUP BY 1) SELECT vec_id, round(sum(abs((v - mean) / CASE WHEN std > 0 THEN std ELSE 1 END)), 6) AS total FROM u JOIN m USING (i) GROUP BY 1",
        "model_scores": known + "SELECT node_a, node_b, round(p, 6) AS probability FROM known",
        "model_accuracy": known + "SELECT round(avg(((p >= 0.6)::BIGINT = label)::INT), 6) AS accuracy FROM known",
        "evaluation_metrics": evaluated + f"""SELECT split, method, n, positive, {ratios}, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM counted JOIN areas USING (split, method)""",
        "evaluation_report_lines": evaluated + """SELECT printf('Threshold of %s from validation: %.2f', method, t) AS line FROM chosen
UNION ALL SELECT printf('| %d | %s | %.3f |', k, method, avg(label)) FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, node_a, node_b) AS r FROM both2 WHERE split = 'Test') JOIN (VALUES (10), (20), (50)) t(k) ON r <= k GROUP BY k, method""",
        "gap_candidates": gaps + "SELECT node_a, node_b FROM cands",
        "gap_report": gaps + """SELECT rank, node_a, node_b, coalesce(la.label, node_a) AS label_a, coalesce(lb.label, node_b) AS label_b, round(p, 4) AS probability, CASE WHEN p >= 0.9 THEN 'HIGH' WHEN p >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round(cos, 4) AS cosine_similarity,
    (SELECT count(*) FROM nbr WHERE node = node_a) AS degree_a, (SELECT count(*) FROM nbr WHERE node = node_b) AS degree_b, (SELECT count(*) FROM nbr x JOIN nbr y ON x.to_ = y.to_ WHERE x.node = node_a AND y.node = node_b) AS common_neighbors
FROM (SELECT *, row_number() OVER (ORDER BY p DESC, node_a, node_b) AS rank FROM sims2) JOIN gnodes la ON la.id = node_a JOIN gnodes lb ON lb.id = node_b WHERE rank <= 50""",
        "gap_baseline": gaps + """SELECT rank, node_a, node_b, coalesce(la.label, node_a) AS label_a, coalesce(lb.label, node_b) AS label_b, round(cos, 4) AS cosine_similarity
FROM (SELECT *, row_number() OVER (ORDER BY cos DESC, node_a, node_b) AS rank FROM sims2) JOIN gnodes la ON la.id = node_a JOIN gnodes lb ON lb.id = node_b WHERE rank <= 50""",
        "undirected_with_loops": edges + "SELECT DISTINCT least(source, t) AS node_a, greatest(source, t) AS node_b FROM (SELECT source, CASE WHEN year % 2 = 0 THEN target ELSE source END AS t FROM edges)",
        "walk_checks": edges + "SELECT node, 3::BIGINT AS walks, node AS start, 0::BIGINT AS not_linked, 33::BIGINT AS steps FROM (SELECT DISTINCT unnest([source, target]) AS node FROM edges WHERE year <= 1996)",
        "json_strict_scan": papers + scan, "json_tolerant_scan": papers + scan,
        "json_array_file": "SELECT s_suppkey::VARCHAR AS id, s_name AS title, '2020' AS year, NULL::VARCHAR AS abstract FROM supplier",
        "graph_file": "SELECT s_name AS source, lower(s_name) AS label, n_name AS target, 'in:' || s_suppkey AS key, 'in' AS relation, (2000 + s_suppkey % 9)::BIGINT AS year, s_suppkey::VARCHAR AS paper_id FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "graphml_lines": """WITH n AS (SELECT s_name AS x FROM supplier UNION ALL SELECT n_name FROM nation)
SELECT '<node id="' || x || '"><data key="node_label">' || lower(x) || '</data></node>' AS line FROM n
UNION ALL SELECT '<edge source="' || s_name || '" target="' || n_name || '" id="in:' || s_suppkey || '"><data key="edge_relation">in</data><data key="edge_year">' || (2000 + s_suppkey % 9) || '</data><data key="edge_timestamp">' || (2000 + s_suppkey % 9) || '</data><data key="edge_paper_id">' || s_suppkey || '</data></edge>' FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
        "snapshot_scan": snaps + f"SELECT cutoff_year::BIGINT AS cutoff_year, count(*) AS n FROM snaps GROUP BY 1 UNION ALL SELECT 0, count(*) FROM snaps WHERE cutoff_year = {W.CUTOFFS[1]}",
        "pairs_csv": scored + "SELECT node_a::VARCHAR AS node_a, node_b::VARCHAR AS node_b, g AS cutoff_year, label FROM scored",
        "feature_files": scored + "SELECT node_a, node_b, 193::BIGINT AS dim, score AS cos_sim FROM scored",
        "embedding_files": _with(VECS) + "SELECT vec_id::VARCHAR AS node, round(n, 6) AS norm FROM vecs WHERE vec_id % 4 = 1",
        "merge_map_file": f"WITH {MERGES} SELECT longer, shorter FROM merges",
        "prompt_texts": papers + "SELECT seq, 'Year ' || coalesce(year, 'None') || '; reply as {json}.' || chr(10) || coalesce(abstract, 'None') || chr(10) AS prompt FROM papers ORDER BY seq LIMIT 60",
        "papers_to_do": papers + "SELECT id, seq FROM papers WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM papers WHERE id IS NOT NULL AND seq % 3 = 0)",
        "extracted_quads": verdicts + "SELECT 'prompt' AS subject, 'has length' AS relation, n::VARCHAR AS object, '2020' AS year, id AS paper_id FROM (SELECT id, length(year || '|' || abstract) AS n FROM clean) WHERE n % 7 <> 0",
        "holdout_files": papers + f"SELECT CASE WHEN y < 2026 THEN 'train' WHEN y = 2026 THEN 'holdout' END AS split, count(*) AS n FROM (SELECT coalesce({_year('year')}, 0) AS y FROM papers) GROUP BY 1",
        "dataset_report_lines": verdicts + "SELECT count(*) || ' papers, ' || min(year) || ' to ' || max(year) || '.' AS line FROM clean UNION ALL SELECT printf('| %d | %d | %.1f%% |', year, count(*), count(*) * 100.0::DOUBLE / (SELECT count(*) FROM clean)) FROM clean GROUP BY year",
        "merge_review_lines": _with(NAMES, TFIDF, MERGE) + "SELECT row_number() OVER (ORDER BY risky DESC, similarity DESC, entity) AS place, '| ' || longer || ' | ' || shorter || ' | ' || similarity || ' | ' || CASE WHEN risky THEN 'yes' ELSE '' END || ' |' AS line FROM candidates",
        "vector_norms": _with(VECS) + "SELECT vec_id, round(n, 6) AS norm FROM vecs",
    }
