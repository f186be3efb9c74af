"""DuckDB statements for the queries of the catalog, composed from common table expressions."""

from __future__ import annotations

_WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NL = r"\r\n|[\x{0a}-\x{0d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_MARKER = r"^<!-- (figure|equation): ([0-9]+) -->$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _normal(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


_PARTS = {
    "pg": ((), "SELECT paper_id, page, arg_max(text, coalesce(loaded_at, TIMESTAMP '1970-01-01')) FILTER (WHERE true) AS text FROM pages GROUP BY ALL"),
    "ec": ((), "SELECT DISTINCT paper_id, local_id, name, type, aliases, description FROM extracted_concepts"),
    "raw": ((), f"SELECT paper_id, lower(replace({_strip('concept_id')}, '_', '-')) AS concept_id, relation, evidence, recorded_at FROM paper_concepts WHERE concept_id IS NOT NULL"),
    "pc": (("raw",), "SELECT DISTINCT paper_id, concept_id, relation FROM raw"),
    "par": ((), "SELECT c.id AS source_id, f.target_id FROM concepts c JOIN (SELECT regexp_replace(id, '^[^-]+-', '') AS rest, min(id) AS target_id FROM concepts GROUP BY 1) f ON regexp_replace(c.id, '^[^-]+-', '') = f.rest WHERE c.id <> f.target_id"),
    "st": (("pc", "par"), "SELECT DISTINCT p.source_id, p.target_id, 'is_a' AS relation, a.paper_id FROM par p JOIN pc a ON a.concept_id = p.source_id JOIN pc b ON b.concept_id = p.target_id AND b.paper_id = a.paper_id"),
    "gen": (("par",), "SELECT source_id, target_id, unnest(['is_a', 'related_to']) AS relation FROM par"),
    "gk": (("gen", "st"), "SELECT g.* FROM gen g WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.source_id = g.source_id AND st.target_id = g.target_id AND st.relation = g.relation)"),
    "nodes": (("pc",), "SELECT c.id, c.type, CAST(coalesce(n.n, 0) AS INTEGER) AS paper_count FROM concepts c LEFT JOIN (SELECT concept_id, count(DISTINCT paper_id) AS n FROM pc GROUP BY 1) n ON n.concept_id = c.id"),
    "elig": (("nodes",), "SELECT id AS concept_id FROM nodes, search_config s WHERE list_contains(s.concept_types, type) AND paper_count / CAST((SELECT count(*) FROM papers) AS DOUBLE) <= s.generic_concept_threshold"),
    "bridge": ((), "SELECT id AS concept_id, r.paper_id, r.local_id FROM (SELECT id, unnest(merged_from) AS r FROM normalized_concepts)"),
    "moved": (("quotes",), "SELECT * FROM quotes UNION ALL SELECT paper_id, page + 1, quote FROM quotes"),
    "resm": (("moved", "ch"), f"SELECT q.paper_id, q.page, q.quote, arg_min(ch.id, ch.idx) AS chunk_id FROM (SELECT DISTINCT * FROM moved) q LEFT JOIN ch ON ch.paper_id = q.paper_id AND ch.page = q.page AND contains({_normal('ch.text')}, {_normal('q.quote')}) GROUP BY ALL"),
    "pgr": ((), "SELECT DISTINCT least(l, r) || '~' || greatest(l, r) AS group_id, unnest([ref_l, ref_r]).paper_id AS paper_id, unnest([ref_l, ref_r]).local_id AS local_id FROM (SELECT left_ref AS ref_l, right_ref AS ref_r, left_ref.paper_id || ':' || left_ref.local_id AS l, right_ref.paper_id || ':' || right_ref.local_id AS r FROM candidate_pairs WHERE left_ref IS NOT NULL AND right_ref IS NOT NULL)"),
    "pmem": (("pgr",), "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY paper_id, local_id) - 1 AS pos FROM pgr"),
    "world": (("bridge", "ec"), "SELECT DISTINCT b.concept_id AS group_id, e.paper_id, e.local_id, e.type FROM bridge b JOIN ec e ON e.paper_id = b.paper_id WHERE e.local_id IN ('c1', 'c2') AND e.type IS NOT NULL"),
    "norm": ((), "SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM normalized_concepts"),
    # quotes of edges, each once, with the chunk that holds it
    "pcq": (("raw", "res"), "SELECT DISTINCT x.paper_id, x.concept_id, x.relation, x.page, x.quote, res.chunk_id FROM (SELECT paper_id, concept_id, relation, unnest(evidence).page AS page, unnest(evidence).quote AS quote FROM raw) x JOIN res ON res.paper_id = x.paper_id AND res.page = x.page AND res.quote = x.quote"),
    "stq": (("st", "pcq"), "SELECT DISTINCT st.source_id, st.target_id, st.relation, st.paper_id, q.page, q.quote, q.chunk_id FROM st JOIN pcq q ON q.paper_id = st.paper_id AND q.concept_id IN (st.source_id, st.target_id)"),
    "quotes": (("raw",), "SELECT DISTINCT paper_id, e.page AS page, e.quote AS quote FROM (SELECT paper_id, unnest(evidence) AS e FROM raw WHERE concept_id <> '')"),
    # chunks: lines, blocks, pieces within the budget, greedy packing
    "ln": (("pg",), f"SELECT paper_id, page, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT paper_id, page, regexp_split_to_array(text, '{_NL}') AS l FROM pg WHERE text IS NOT NULL)"),
    "lk": (("ln",), f"SELECT paper_id, page, n, line, {_strip('line')} AS s FROM ln WHERE NOT regexp_matches({_strip('line')}, '{_MARKER}')"),
    "lb": (("lk",), "SELECT *, sum(CASE WHEN s = '' OR starts_with(s, '#') OR before IS NULL OR before = '' OR starts_with(before, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, page ORDER BY n) AS b FROM (SELECT *, lag(s) OVER (PARTITION BY paper_id, page ORDER BY n) AS before FROM lk)"),
    "bl": (("lb",), f"SELECT paper_id, page, b, {_strip('string_agg(line, chr(10) ORDER BY n)')} AS text FROM lb WHERE s <> '' GROUP BY ALL"),
    "pi": (("bl",), "SELECT paper_id, page, row_number() OVER (PARTITION BY paper_id, page ORDER BY b, ofs) AS k, text, n FROM ("
        f"SELECT paper_id, page, b, 0 AS ofs, text, len({_words('text')}) AS n FROM bl WHERE len({_words('text')}) <= BUDGET"
        " UNION ALL SELECT paper_id, page, b, ofs, array_to_string(w[ofs:ofs + BUDGET - 1], ' '), least(BUDGET, len(w) - ofs + 1) FROM ("
        f"SELECT paper_id, page, b, w, unnest(range(1, len(w) + 1, BUDGET)) AS ofs FROM (SELECT paper_id, page, b, {_words('text')} AS w FROM bl WHERE len({_words('text')}) > BUDGET)))"),
    "pk": (("pi",), "SELECT paper_id, page, k, text, n AS held, 1 AS c FROM pi WHERE k = 1 UNION ALL SELECT i.paper_id, i.page, i.k, i.text, CASE WHEN p.held + i.n > BUDGET THEN i.n ELSE p.held + i.n END, CASE WHEN p.held + i.n > BUDGET THEN p.c + 1 ELSE p.c END FROM pk p JOIN pi i ON i.paper_id = p.paper_id AND i.page = p.page AND i.k = p.k + 1"),
    "ch": (("pk",), "SELECT paper_id || ':' || idx AS id, paper_id, CAST(idx AS INTEGER) AS idx, page, text FROM (SELECT paper_id, page, text, row_number() OVER (PARTITION BY paper_id ORDER BY page, c) - 1 AS idx FROM (SELECT paper_id, page, c, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM pk GROUP BY ALL))"),
    "res": (("quotes", "ch"), f"SELECT q.paper_id, q.page, q.quote, arg_min(ch.id, ch.idx) AS chunk_id FROM quotes q LEFT JOIN ch ON ch.paper_id = q.paper_id AND ch.page = q.page AND contains({_normal('ch.text')}, {_normal('q.quote')}) GROUP BY ALL"),
    "v": ((), "SELECT row_idx, CAST(vector AS DOUBLE[]) AS v FROM concept_vectors WHERE vector IS NOT NULL"),
    "sc": (("v",), "SELECT q.row_idx AS query_id, i.row_idx, round(CASE WHEN list_sum(list_transform(q.v, lambda x: x * x)) > 0 AND list_sum(list_transform(i.v, lambda x: x * x)) > 0 THEN list_cosine_similarity(q.v, i.v) ELSE 0.0 END, 9) AS score FROM v q, v i WHERE q.row_idx % 50 = 0 AND len(q.v) = len(i.v)"),
    "tk": (("sc",), "SELECT query_id, row_idx, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_idx) AS rank FROM sc) WHERE rank <= 10"),
    "c2p": (("pc",), "SELECT DISTINCT concept_id, paper_id FROM pc WHERE relation IN ('proposes', 'uses', 'addresses')"),
    "it": (("ec",), f"SELECT v.row_idx, ['chunk', 'summary', 'concept'][v.row_idx % 3 + 1] AS kind, coalesce({_slug('e.name')}, '') AS slug, v.paper_id FROM concept_vectors v LEFT JOIN ec e ON e.paper_id = v.paper_id AND e.local_id = v.local_id"),
    "hits": (("tk", "it", "c2p"), "SELECT t.query_id, t.row_idx, t.score, t.rank, i.kind, CASE WHEN i.kind = 'summary' THEN CAST(i.paper_id AS VARCHAR) ELSE i.paper_id || ':' || i.row_idx END AS ref, i.paper_id FROM tk t JOIN it i ON i.row_idx = t.row_idx WHERE i.kind <> 'concept' UNION ALL SELECT t.query_id, t.row_idx, t.score, t.rank, i.kind, i.slug, c.paper_id FROM tk t JOIN it i ON i.row_idx = t.row_idx JOIN c2p c ON c.concept_id = i.slug WHERE i.kind = 'concept'"),
    "ed": (("pc",), "SELECT pc.* FROM pc, search_config s WHERE list_contains(s.paper_relations, pc.relation)"),
    # every edge between concepts: one for each paper that states it, and the general ones that none states
    "ce": (("gk", "st"), "SELECT source_id, target_id, relation, 'paper' AS origin, paper_id FROM st UNION ALL SELECT source_id, target_id, relation, 'general_knowledge', NULL FROM gk"),
    "ways": (("ce",), "SELECT source_id AS from_id, target_id AS reached_id, concat_ws('|', source_id, relation, target_id, origin, paper_id) AS edge_id, relation, true AS ahead FROM ce UNION ALL SELECT target_id, source_id, concat_ws('|', source_id, relation, target_id, origin, paper_id), relation, false FROM ce"),
    "hop": (("ways", "elig"), "SELECT w.* FROM ways w, search_config s WHERE list_contains(s.concept_relations, w.relation) AND w.reached_id IN (SELECT concept_id FROM elig)"),
    "src": ((), "SELECT id AS paper_id FROM papers WHERE id % 50 = 0"),
    "dir": (("hits",), "SELECT paper_id, round(max(score), 6) AS best_score, count(*) AS n_hits FROM hits GROUP BY 1"),
    "cmp": ((), "SELECT unnest([l, r]) AS slug, least(l, r) || '~' || greatest(l, r) AS group_id FROM (SELECT left_ref.paper_id || ':' || left_ref.local_id AS l, right_ref.paper_id || ':' || right_ref.local_id AS r FROM candidate_pairs WHERE left_ref IS NOT NULL AND right_ref IS NOT NULL)"),
}


def _standing(hops: int, sources: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Paths by number of hops, over the source papers of a table."""
    out = {"s0": (("ed", "elig", sources), f"SELECT ed.paper_id AS source_paper_id, ed.relation AS source_relation, ed.concept_id AS at, [ed.concept_id] AS visited, CAST([] AS VARCHAR[]) AS edges FROM ed WHERE ed.concept_id IN (SELECT concept_id FROM elig) AND ed.paper_id IN (SELECT paper_id FROM {sources})")}
    for n in range(1, hops + 1):
        out[f"s{n}"] = ((f"s{n - 1}", "hop"), f"SELECT s.source_paper_id, s.source_relation, h.reached_id AS at, list_append(s.visited, h.reached_id) AS visited, list_append(s.edges, h.edge_id) AS edges FROM s{n - 1} s JOIN hop h ON h.from_id = s.at WHERE NOT list_contains(s.visited, h.reached_id)")
    union = " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(hops + 1))
    out["path"] = ((*(f"s{n}" for n in range(hops + 1)), "ed"), f"SELECT s.*, e.paper_id AS target_paper_id, e.relation AS target_relation FROM ({union}) s JOIN ed e ON e.concept_id = s.at WHERE e.paper_id <> s.source_paper_id")
    return out


def _with(body: str, *names: str, more: dict | None = None, budget: int = 64) -> str:
    parts = _PARTS | (more or {})
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in parts[name][0]:
                visit(need)
            order.append(name)

    for n in names:
        visit(n)
    if not order:
        return body
    text = ",\n".join(f"{n} AS ({parts[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if 'pk' in order or 'lab' in order else ''}{text}\n{body}".replace("BUDGET", str(budget))


def statements(families: dict, relations: tuple[str, ...], budget: int) -> dict[str, str]:
    """The statements by query name; families are the vocabulary's terms, budget the words of a chunk."""
    _ = relations
    terms = ", ".join(f"('{family}', {n}, '{t.value}', {str(t.traversable).lower()})" for family, ts in families.items() for n, t in enumerate(ts))
    types = ", ".join(f"'{t.value}'" for t in families["concept_type"])
    expected = "SELECT id AS paper_id, unnest(range(1, page_count + 1)) AS page FROM papers WHERE page_count >= 1"
    path = "SELECT source_paper_id, source_relation, array_to_string(visited, '>') AS visited, array_to_string(edges, ';') AS edges, target_paper_id, target_relation FROM path"
    counted = "SELECT target_paper_id AS paper_id, count(*) AS n_paths FROM path GROUP BY 1"
    one, two, none = _standing(1, "src"), _standing(2, "src"), _standing(0, "src")
    found = _standing(1, "dir")
    labels = {
        "lab": (("cmp",), "SELECT group_id, group_id AS component FROM cmp UNION SELECT b.group_id, l.component FROM lab l JOIN cmp a ON a.group_id = l.group_id JOIN cmp b ON b.slug = a.slug WHERE l.component < b.group_id"),
    }
    labels["comp"] = (("lab", "cmp"), "SELECT l.group_id, min(l.component) AS component FROM lab l WHERE l.group_id IN (SELECT group_id FROM cmp WHERE slug IN (SELECT slug FROM cmp GROUP BY 1 HAVING count(DISTINCT group_id) > 1)) GROUP BY 1")
    # the best of the papers that paths reach and vectors don't
    best = found | {
        "cnt": (("path",), counted),
        "bst": (("cnt", "dir"), "SELECT paper_id, n_paths, CAST(row_number() OVER (ORDER BY n_paths DESC, paper_id) AS INTEGER) AS place FROM cnt WHERE paper_id NOT IN (SELECT paper_id FROM dir) ORDER BY place LIMIT (SELECT max_graph_candidates FROM search_config)"),
    }
    q = {
        "scan_papers": f"SELECT id, title, pub_year, venue, page_count, CAST(len(authors) AS INTEGER) AS n_authors, nullif({_strip('s3_uri')}, '') AS s3_uri, preprocess.tool AS tool FROM papers",
        "scan_pages": _with("SELECT paper_id, page, CAST(length(text) AS INTEGER) AS chars FROM pg", "pg"),
        "page_gaps": f"WITH x AS ({expected}), f AS (SELECT DISTINCT paper_id, page FROM pages), g AS (SELECT x.paper_id, x.page, 'missing' AS problem FROM x ANTI JOIN f USING (paper_id, page) UNION ALL SELECT f.paper_id, f.page, 'unexpected' FROM f ANTI JOIN x USING (paper_id, page)) SELECT paper_id, format('{{:03d}}.md', page) AS name, problem FROM g",
        "papers_without_extraction": "SELECT id AS paper_id FROM papers WHERE id NOT IN (SELECT paper_id FROM extracted_concepts WHERE paper_id IS NOT NULL AND extracted_at < TIMESTAMPTZ '2025-02-01 00:00:00+00')",
        "incompatible_indexes": "SELECT DISTINCT index_id, schema_version, domain_model_version, expected FROM index_manifests, (SELECT unnest([1, 2]) AS expected) WHERE schema_version IS DISTINCT FROM 1 OR domain_model_version IS DISTINCT FROM expected",
        "parse_markers": _with(f"SELECT paper_id, page, regexp_extract(s, '{_MARKER}', 1) AS kind, CAST(regexp_extract(s, '{_MARKER}', 2) AS INTEGER) AS number, CAST(n AS INTEGER) AS line FROM (SELECT *, {_strip('line')} AS s FROM ln) WHERE regexp_matches(s, '{_MARKER}')", "ln"),
        "normalize_ws": _with(f"SELECT paper_id, page, {_normal('text')} AS text FROM pg", "pg"),
        "count_tokens": _with(f"SELECT paper_id, page, CAST(len({_words('text')}) AS INTEGER) AS n_tokens FROM pg", "pg"),
        "slugs": _with(f"SELECT paper_id, local_id, coalesce(nullif({_slug('name')}, ''), 'concept-' || paper_id || '-' || local_id) AS id FROM ec", "ec"),
        "concept_texts": "SELECT id, canonical_name || CASE WHEN len(aliases) > 0 THEN ' (' || array_to_string(aliases, ', ') || ')' ELSE '' END || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || description ELSE '' END AS text FROM normalized_concepts",
        "file_names": "SELECT DISTINCT paper_id, page, format('{:04d}/pages/{:03d}.md', paper_id, page) AS file, 'paper:' || paper_id AS node FROM pages",
        "vocabulary": f"SELECT * FROM (VALUES {terms}) t(family, position, value, traversable)",
        "chunk_pages": _with("SELECT id, paper_id, idx, page AS page_start, page AS page_end, text FROM ch", "ch", budget=budget),
        "evidence_issues": _with(
            "SELECT paper_id, message, count(*) AS n FROM (SELECT q.paper_id, CASE WHEN g.page IS NULL THEN 'page ' || q.page || ' is outside 1..' || coalesce(p.page_count, 0) ELSE 'is not found in the text of page ' || q.page END AS message"
            f" FROM moved q LEFT JOIN pg g ON g.paper_id = q.paper_id AND g.page = q.page LEFT JOIN papers p ON p.id = q.paper_id WHERE g.page IS NULL OR NOT coalesce(contains({_normal('coalesce(g.text, chr(0))')}, {_normal('q.quote')}), false)) GROUP BY ALL", "moved", "pg"),
        "evidence_resolve": _with("SELECT * FROM res WHERE chunk_id IS NOT NULL", "res", budget=budget),
        "evidence_unresolved": _with("SELECT paper_id, page, quote FROM resm WHERE chunk_id IS NULL", "resm", budget=budget),
        "slug_lookup": _with("SELECT paper_id, local_id, concept_id FROM bridge", "bridge"),
        "paper_count_df": "SELECT id, CAST(len(list_distinct(list_transform(merged_from, lambda r: r.paper_id))) AS INTEGER) AS paper_count, round(len(list_distinct(list_transform(merged_from, lambda r: r.paper_id))) / CAST((SELECT count(*) FROM papers) AS DOUBLE), 6) AS document_frequency FROM normalized_concepts",
        "eligible_concepts": _with("SELECT concept_id FROM elig", "elig"),
        "unknown_refs": _with("SELECT b.concept_id AS path, CASE WHEN b.paper_id IN (SELECT paper_id FROM ec) THEN 'paper ' || b.paper_id || ' has no concept ''' || b.local_id || '''' ELSE 'there is no extraction for paper ' || b.paper_id END AS message FROM (SELECT * FROM bridge UNION ALL SELECT concept_id, paper_id + 1, local_id FROM bridge) b ANTI JOIN ec ON ec.paper_id = b.paper_id AND ec.local_id = b.local_id", "bridge", "ec"),
        "uncovered_concepts": _with("SELECT e.paper_id, e.local_id, 'paper ' || e.paper_id || ' ''' || e.local_id || ''' is in no merged_from' AS message FROM ec e ANTI JOIN bridge b ON b.paper_id = e.paper_id AND b.local_id = e.local_id", "bridge", "ec"),
        "solo_concepts": _with("SELECT e.paper_id, e.local_id, e.name FROM ec e ANTI JOIN (SELECT unnest([left_ref, right_ref]) AS r FROM candidate_pairs) g ON g.r.paper_id = e.paper_id AND g.r.local_id = e.local_id", "ec"),
        "type_issues": _with("SELECT n.id, 'is ''' || n.type || ''', which none of the merged concepts has; they are ' || array_to_string(list_sort(list(DISTINCT e.type)), ', ') AS message FROM normalized_concepts n JOIN bridge b ON b.concept_id = n.id JOIN ec e ON e.paper_id = b.paper_id AND e.local_id = b.local_id GROUP BY n.id, n.type HAVING count(*) FILTER (WHERE e.type = n.type) = 0", "bridge", "ec"),
        "slug_collisions": _with(f"SELECT slug, array_to_string(list_sort(list(DISTINCT paper_id)), ',') AS group_ids FROM (SELECT {_slug('name')} AS slug, paper_id FROM ec) WHERE slug <> '' GROUP BY 1 HAVING count(DISTINCT paper_id) > 1", "ec"),
        "collision_components": _with("SELECT l.group_id, min(l.component) AS component FROM lab l WHERE l.group_id IN (SELECT group_id FROM cmp WHERE slug IN (SELECT slug FROM cmp GROUP BY 1 HAVING count(DISTINCT group_id) > 1)) GROUP BY 1", "lab", more=labels),
        "stated_relations": _with("SELECT source_id, target_id, relation, array_to_string(list_sort(list(DISTINCT paper_id)), ',') AS paper_ids FROM st GROUP BY ALL", "st"),
        "gk_edges_unstated": _with("SELECT * FROM gk", "gk"),
        "relation_conflicts": _with("SELECT 'repeats what ' || CASE WHEN count(DISTINCT paper_id) = 1 THEN 'paper ' || array_to_string(list_sort(list(DISTINCT paper_id)), ', ') || ' states' ELSE 'papers ' || array_to_string(list_sort(list(DISTINCT paper_id)), ', ') || ' state' END || ': ' || st.source_id || ' ' || st.relation || ' ' || st.target_id AS message FROM st JOIN gen USING (source_id, target_id, relation) GROUP BY st.source_id, st.relation, st.target_id", "st", "gen"),
        "paper_edges_collapsed": _with("SELECT k.paper_id, k.concept_id, k.relation, CAST(count(x.e) AS INTEGER) AS n_evidence, coalesce(string_agg(x.t, chr(10) ORDER BY x.t), '') AS quotes FROM pc k LEFT JOIN (SELECT DISTINCT paper_id, concept_id, relation, e, e.page || '|' || e.quote AS t FROM (SELECT paper_id, concept_id, relation, unnest(evidence) AS e FROM raw)) x ON x.paper_id = k.paper_id AND x.concept_id = k.concept_id AND x.relation = k.relation GROUP BY ALL", "pc"),
        "concepts_to_papers": _with("SELECT * FROM c2p", "c2p"),
        "graph_edges": _with("SELECT 'paper:' || paper_id AS source, concept_id AS target, relation AS key FROM pc UNION ALL SELECT source_id, target_id, concat_ws(':', relation, origin, paper_id) FROM ce", "pc", "ce"),
        "graph_violations": _with(
            "SELECT rule, count(*) AS n, array_to_string(list_sort(list(key))[1:5], ', ') AS named FROM ("
            "SELECT 'edge_paper' AS rule, CAST(paper_id AS VARCHAR) AS key FROM (SELECT DISTINCT paper_id FROM pc) WHERE paper_id NOT IN (SELECT id FROM papers)"
            " UNION ALL SELECT 'edge_concept', concept_id FROM (SELECT DISTINCT concept_id FROM pc) WHERE concept_id NOT IN (SELECT id FROM concepts)"
            " UNION ALL SELECT 'concept_slug', id FROM concepts WHERE NOT regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*')"
            f" UNION ALL SELECT 'concept_type', id FROM concepts WHERE type IS NULL OR type NOT IN ({types})"
            " UNION ALL SELECT 'edge_relation', paper_id || '|' || concept_id FROM pc WHERE relation IS NULL OR relation NOT IN ('proposes', 'uses', 'addresses', 'mentions')"
            " UNION ALL SELECT 'relation_origin', source_id || '|' || relation || '|' || target_id FROM st WHERE NOT EXISTS (SELECT 1 FROM raw WHERE raw.paper_id = st.paper_id AND raw.concept_id IN (st.source_id, st.target_id) AND len(raw.evidence) > 0)"
            " UNION ALL SELECT 'concept_count', id FROM nodes WHERE paper_count > (SELECT count(*) FROM papers)) GROUP BY 1", "pc", "nodes", "st"),
        "extraction_violations": f"SELECT DISTINCT rule, key FROM (SELECT 'local_unique' AS rule, paper_id || '|' || local_id AS key FROM extracted_concepts GROUP BY paper_id, local_id HAVING count(*) > 1 UNION ALL SELECT 'local_name', paper_id || '|' || local_id FROM extracted_concepts WHERE coalesce({_strip('name')}, '') = '' UNION ALL SELECT 'local_type', paper_id || '|' || local_id FROM extracted_concepts WHERE type IS NULL OR type NOT IN ({types}))",
        "index_consistency": "WITH m AS (SELECT DISTINCT index_id, unnest(paper_ids) AS paper_id FROM index_manifests) SELECT index_id, paper_id, 'paper isn''t declared' AS problem FROM m WHERE paper_id NOT IN (SELECT id FROM papers) UNION ALL SELECT NULL, id, 'paper is in no index' FROM papers WHERE id NOT IN (SELECT paper_id FROM m)",
        "build_counts": _with("SELECT 'papers' AS what, count(*) AS n FROM papers UNION ALL SELECT 'chunks', count(*) FROM ch UNION ALL SELECT 'concepts', count(*) FROM concepts UNION ALL SELECT 'paper_concepts', count(*) FROM pc UNION ALL SELECT 'concept_relations', count(*) FROM ce UNION ALL SELECT 'merged_concepts', count(*) FROM normalized_concepts WHERE len(merged_from) > 1", "ch", "pc", "ce", budget=budget),
        "embedding_items": _with(
            "SELECT row_number() OVER (ORDER BY k, a, b) - 1 AS row_idx, kind, ref, paper_id, md5(text) AS text_md5 FROM (SELECT 0 AS k, 'chunk' AS kind, id AS ref, paper_id, text, paper_id AS a, idx AS b FROM ch UNION ALL SELECT 1, 'summary', CAST(id AS VARCHAR), id, title, id, 0 FROM papers"
            " UNION ALL SELECT 2, 'concept', id, NULL, canonical_name || CASE WHEN len(aliases) > 0 THEN ' (' || array_to_string(aliases, ', ') || ')' ELSE '' END || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || description ELSE '' END, row_number() OVER (ORDER BY id), 0 FROM normalized_concepts)", "ch", budget=budget),
        "vector_topk": _with("SELECT query_id, row_idx, round(score, 6) AS score, rank FROM tk", "tk"),
        "vector_paper_hits": _with("SELECT h.paper_id, round(max(h.score), 6) AS best_score, count(*) AS n_hits, string_agg(concat_ws('|', h.kind, h.ref, h.query_id), ',' ORDER BY h.score DESC, h.query_id, h.rank, h.kind, h.ref) AS hits FROM hits h GROUP BY 1", "hits"),
        "candidate_pairs": _with("SELECT left_idx, right_idx, round(arg_min(score, (query_id, place)), 6) AS score FROM (SELECT least(query_id, row_idx) AS left_idx, greatest(query_id, row_idx) AS right_idx, score, query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM tk WHERE rank <= 6 AND row_idx <> query_id) WHERE place <= 5 GROUP BY ALL", "tk"),
        "traverse_0hop": _with(path, "path", more=none),
        "traverse_1hop": _with(path, "path", more=one),
        "traverse_2hop": _with("SELECT source_paper_id, target_paper_id, CAST(len(edges) AS INTEGER) AS n_hops, count(*) AS n_paths FROM path GROUP BY ALL", "path", more=two),
        "reached_papers": _with(counted, "path", more=one),
        "graph_candidates": _with(f"SELECT paper_id, n_paths, CAST(row_number() OVER (ORDER BY n_paths DESC, paper_id) AS INTEGER) AS rank FROM ({counted}) WHERE paper_id NOT IN (SELECT paper_id FROM src) ORDER BY rank LIMIT (SELECT max_graph_candidates FROM search_config)", "path", more=one),
        "search_flagship": _with(
            "SELECT f.*, p.title FROM (SELECT 'direct' AS kind, d.paper_id, d.best_score, d.n_hits, CAST(0 AS BIGINT) AS n_paths, 0 AS place FROM dir d UNION ALL SELECT 'graph', paper_id, NULL, 0, n_paths, place FROM bst) f LEFT JOIN papers p ON p.id = f.paper_id",
            "bst", "dir", more=best),
        "search_paths": _with("SELECT source_paper_id, source_relation, array_to_string(visited, '>') AS visited, array_to_string(edges, ';') AS edges, target_paper_id, target_relation FROM path WHERE target_paper_id IN (SELECT paper_id FROM bst)", "bst", "path", more=best),
        "walked_hops": _with("SELECT h.edge_id AS edge, h.ahead, count(*) AS n FROM path p JOIN hop h ON h.edge_id = p.edges[1] AND h.reached_id = p.visited[2] AND h.from_id = p.visited[1] WHERE len(p.edges) = 1 GROUP BY ALL", "path", "hop", more=one),
        "ranked_by_paths": _with(counted, "path", more=one),
        "extraction_issues": _with(
            "SELECT q.paper_id, 'paper_concepts[' || q.edge_pos || '].evidence[' || q.evidence_pos || ']' || CASE WHEN g.page IS NULL THEN '.page' ELSE '.quote' END AS path, CASE WHEN g.page IS NULL THEN 'page ' || q.page || ' is outside 1..' || coalesce(p.page_count, 0) ELSE 'is not found in the text of page ' || q.page END AS message"
            " FROM (SELECT paper_id, page + 1 AS page, quote, dense_rank() OVER (PARTITION BY paper_id ORDER BY concept_id, relation) - 1 AS edge_pos, row_number() OVER (PARTITION BY paper_id, concept_id, relation ORDER BY page, quote) - 1 AS evidence_pos FROM (SELECT DISTINCT paper_id, concept_id, relation, e.page AS page, e.quote AS quote FROM (SELECT paper_id, concept_id, relation, unnest(evidence) AS e FROM raw) WHERE e.page IS NOT NULL AND e.quote IS NOT NULL)) q"
            f" LEFT JOIN pg g ON g.paper_id = q.paper_id AND g.page = q.page LEFT JOIN papers p ON p.id = q.paper_id WHERE g.page IS NULL OR NOT coalesce(contains({_normal('coalesce(g.text, chr(0))')}, {_normal('q.quote')}), false)"
            " UNION ALL SELECT id + 1, 'paper_id', 'is ' || id || ', but the paper being checked is ' || (id + 1) FROM papers WHERE id % 10 = 0", "raw", "pg"),
        "scanned_corpus": _with(
            "SELECT 'ledger' AS what, count(*) AS n, count(*) * (count(*) - 1) // 2 AS total FROM papers UNION ALL SELECT 'papers', count(*), CAST(sum(coalesce(page_count, 0)) AS BIGINT) FROM papers UNION ALL SELECT 'pages', count(*), CAST(sum(length(text)) AS BIGINT) FROM pg WHERE text <> ''"
            " UNION ALL SELECT 'extractions', count(DISTINCT paper_id), CAST(sum(DISTINCT paper_id) AS BIGINT) FROM ec UNION ALL SELECT w, CAST(sum(n) AS BIGINT), CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT paper_id, count(*) AS n FROM (SELECT DISTINCT paper_id, local_id FROM ec) GROUP BY 1), (SELECT unnest(['concepts', 'edges']) AS w) GROUP BY w"
            " UNION ALL SELECT 'normalized', count(*), CAST(sum(len(merged_from)) AS BIGINT) FROM normalized_concepts UNION ALL SELECT 'general', count(*), count(*) * (count(*) - 1) // 2 FROM gen", "pg", "ec", "gen"),
        "group_members": _with("SELECT m.group_id, CAST(m.pos AS INTEGER) AS pos, m.paper_id, m.local_id, e.name FROM pmem m JOIN ec e ON e.paper_id = m.paper_id AND e.local_id = m.local_id", "pmem", "ec"),
        "grouping_issues": _with("SELECT 'group_size' AS rule, group_id AS key FROM pgr GROUP BY group_id HAVING count(*) < 2 UNION ALL SELECT 'group_overlap', paper_id || '|' || local_id FROM pgr GROUP BY paper_id, local_id HAVING count(*) > 1", "pgr"),
        "combined_groups": _with("SELECT coalesce(c.component, m.group_id) AS group_id, string_agg(m.paper_id || ':' || m.local_id, ',' ORDER BY m.group_id, m.pos) AS refs, bool_and(c.component IS NULL) AS answered FROM pmem m LEFT JOIN comp c ON c.group_id = m.group_id GROUP BY 1", "pmem", "comp", more=labels),
        "collision_issues": _with(
            "SELECT slug, '''' || slug || ''' is the id of a concept in ' || count(*) || ' groups that were merged apart: ' || string_agg(t.text, '; ' ORDER BY c.group_id) AS message FROM (SELECT DISTINCT slug, group_id FROM cmp) c"
            " JOIN (SELECT group_id, string_agg('paper ' || paper_id || ' ''' || local_id || '''', ', ' ORDER BY pos) AS text FROM pmem GROUP BY 1) t ON t.group_id = c.group_id GROUP BY slug HAVING count(*) > 1", "cmp", "pmem"),
        "merge_issues": _with(
            "SELECT n.id AS group_id, 'concepts[0].merged_from[' || n.n || ']' AS path, 'paper ' || n.r.paper_id || ' ''' || n.r.local_id || ''' is not one of the grouped concepts' AS message FROM (SELECT id, unnest(merged_from) AS r, generate_subscripts(merged_from, 1) - 1 AS n FROM normalized_concepts) n ANTI JOIN world w ON w.group_id = n.id AND w.paper_id = n.r.paper_id AND w.local_id = n.r.local_id"
            " UNION ALL SELECT n.id, 'concepts[0].type', 'is ''' || n.type || ''', which none of the merged concepts has; they are ' || array_to_string(list_sort(list(DISTINCT w.type)), ', ') FROM normalized_concepts n JOIN bridge b ON b.concept_id = n.id JOIN world w ON w.group_id = n.id AND w.paper_id = b.paper_id AND w.local_id = b.local_id GROUP BY n.id, n.type HAVING count(*) FILTER (WHERE w.type = n.type) = 0"
            " UNION ALL SELECT w.group_id, 'concepts', 'paper ' || w.paper_id || ' ''' || w.local_id || ''' is in no merged_from' FROM world w ANTI JOIN bridge b ON b.concept_id = w.group_id AND b.paper_id = w.paper_id AND b.local_id = w.local_id", "world", "bridge"),
        "normalization_issues": _with(
            "SELECT 'concepts[' || n.pos || '].type' AS path, 'is ''' || n.type || ''', which none of the merged concepts has; they are ' || array_to_string(list_sort(list(DISTINCT e.type)), ', ') AS message FROM norm n JOIN bridge b ON b.concept_id = n.id JOIN ec e ON e.paper_id = b.paper_id AND e.local_id = b.local_id GROUP BY n.pos, n.type HAVING count(*) FILTER (WHERE e.type = n.type) = 0"
            " UNION ALL SELECT 'concepts', 'paper ' || e.paper_id || ' ''' || e.local_id || ''' is in no merged_from' FROM (SELECT DISTINCT paper_id, local_id FROM ec) e ANTI JOIN bridge b ON b.paper_id = e.paper_id AND b.local_id = e.local_id"
            " UNION ALL SELECT 'concepts[' || n.pos || '].merged_from[' || n.n || ']', CASE WHEN n.r.paper_id IN (SELECT paper_id FROM ec) THEN 'paper ' || n.r.paper_id || ' has no concept ''' || n.r.local_id || '''' ELSE 'there is no extraction for paper ' || n.r.paper_id END FROM (SELECT pos, unnest(merged_from) AS r, generate_subscripts(merged_from, 1) - 1 AS n FROM norm) n ANTI JOIN ec ON ec.paper_id = n.r.paper_id AND ec.local_id = n.r.local_id", "norm", "bridge", "ec"),
        "extraction_rules": f"""
WITH e AS (SELECT paper_id, local_id, name, type FROM extracted_concepts), i AS (SELECT DISTINCT paper_id, local_id FROM e),
r AS (SELECT left_ref.paper_id AS paper_id, left_ref.local_id AS s, right_ref.local_id AS t FROM candidate_pairs WHERE left_ref IS NOT NULL AND right_ref IS NOT NULL)
SELECT rule, count(*) AS n FROM (
  SELECT 'local_unique' AS rule FROM e GROUP BY paper_id, local_id HAVING count(*) > 1
  UNION ALL SELECT 'local_edge_unique' FROM e GROUP BY paper_id, local_id HAVING count(*) > 1
  UNION ALL SELECT 'local_form' FROM e WHERE NOT coalesce(regexp_full_match(local_id, 'c[1-9][0-9]*'), false)
  UNION ALL SELECT 'local_type' FROM e WHERE type IS NULL OR type NOT IN ({types})
  UNION ALL SELECT 'local_name' FROM e WHERE coalesce({_strip('name')}, '') = ''
  UNION ALL SELECT 'no_concept' FROM papers WHERE id NOT IN (SELECT paper_id FROM e)
  UNION ALL SELECT 'source_declared' FROM (SELECT DISTINCT paper_id, s AS local_id FROM r) ANTI JOIN i USING (paper_id, local_id)
  UNION ALL SELECT 'target_declared' FROM (SELECT DISTINCT paper_id, t AS local_id FROM r) ANTI JOIN i USING (paper_id, local_id)
  UNION ALL SELECT 'local_relation_unique' FROM r GROUP BY paper_id, s, t HAVING count(*) > 1
  UNION ALL SELECT 'local_self' FROM r WHERE coalesce(s = t, true)
  UNION ALL SELECT 'edge_evidence' FROM e UNION ALL SELECT 'relation_evidence' FROM r
) GROUP BY 1""",
        "built_paper_edges": _with("SELECT k.paper_id, k.concept_id, k.relation, coalesce(string_agg(concat_ws('|', q.page, q.quote, q.chunk_id), chr(10) ORDER BY concat_ws('|', q.page, q.quote, q.chunk_id)), '') AS quotes FROM pc k LEFT JOIN pcq q ON q.paper_id = k.paper_id AND q.concept_id = k.concept_id AND q.relation = k.relation GROUP BY ALL", "pc", "pcq", budget=budget),
        "built_concept_edges": _with(
            "SELECT c.source_id, c.target_id, c.relation, c.origin, c.paper_id, CASE WHEN c.origin <> 'paper' THEN 'by name' END AS rationale, coalesce(string_agg(concat_ws('|', q.page, q.quote, q.chunk_id), chr(10) ORDER BY concat_ws('|', q.page, q.quote, q.chunk_id)), '') AS quotes"
            " FROM ce c LEFT JOIN stq q ON q.source_id = c.source_id AND q.target_id = c.target_id AND q.relation = c.relation AND q.paper_id = c.paper_id GROUP BY ALL", "ce", "stq", budget=budget),
        "stored_index": _with(
            "SELECT 'chunks' AS what, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total FROM ch UNION ALL SELECT 'items', n, n * (n - 1) // 2 FROM itn UNION ALL SELECT 'vectors', n, n * 16 FROM itn UNION ALL SELECT 'papers', count(*), CAST(sum(id) AS BIGINT) FROM papers"
            " UNION ALL SELECT 'concepts', count(*), CAST(sum(paper_count) AS BIGINT) FROM nodes UNION ALL SELECT 'paper_concepts', (SELECT count(*) FROM pc), (SELECT count(*) FROM pcq)"
            " UNION ALL SELECT 'concept_relations', (SELECT count(*) FROM gk) + (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, relation, paper_id FROM stq)), (SELECT count(*) FROM stq) UNION ALL SELECT 'manifest', count(*), BUDGET FROM papers",
            "ch", "nodes", "pc", "pcq", "gk", "stq", "itn", more={"itn": (("ch",), "SELECT (SELECT count(*) FROM ch) + (SELECT count(*) FROM papers) + (SELECT count(*) FROM concepts) AS n")}, budget=budget),
    }
    return q
